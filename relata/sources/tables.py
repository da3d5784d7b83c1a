"""The data directory's tables and the views on them that the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores (a small single file) dealt over all cores; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def trade_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, arg1, type1, arg2, type2, l_orderkey, l_linenumber): part names as paths between the nations of supplier and customer."""
    t = lambda n: table(spark, sf_dir, n)
    nation, region = t("nation"), t("region")
    supp = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("n_name").alias("arg1"), F.col("r_name").alias("type1"))
    cust = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("arg2"), F.col("c_mktsegment").alias("type2"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "arg2", "type2")
    part = t("part").select("p_partkey", F.col("p_name").alias("path"))
    l = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    j = l.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("path", "arg1", "type1", "arg2", "type2", "l_orderkey", "l_linenumber")


def sparse_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, arg1, type1, arg2, type2): brand and priority as paths between customers and parts."""
    t = lambda n: table(spark, sf_dir, n)
    l = t("lineitem").select("l_orderkey", "l_partkey")
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment")
    j = l.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.concat("p_brand", F.lit(">"), "o_orderpriority").alias("path"), F.col("c_name").alias("arg1"), F.col("c_mktsegment").alias("type1"), F.col("p_name").alias("arg2"), F.col("p_type").alias("type2"))


def order_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, arg1, type1, arg2, type2): priorities as paths between customers in a year (many of them rare) and months."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderpriority").alias("path"), F.concat("c_name", F.lit(" "), F.year("o_orderdate").cast("string")).alias("arg1"), F.col("c_mktsegment").alias("type1"), F.date_format("o_orderdate", "yyyy-MM").alias("arg2"), F.col("o_orderstatus").alias("type2"))


def brand_type_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, pred, gold): parts, by brand and by type."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("pred"), F.col("p_type").alias("gold"))


def discount_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(confidence, correct): discounts in tenths, whether a line was returned."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "R").alias("correct"))


def event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label log in the store's shape: users and event types; values above 50 are human answers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.pmod("event_id", F.lit(7)).cast("string")).alias("key"), F.col("event_type").alias("label"), F.when(F.col("value") > 50, "oracle").otherwise("induced_seed_pos").alias("source"),
        F.col("user_id").cast("string").alias("entity1"), F.pmod("event_id", F.lit(7)).cast("string").alias("entity2"), F.col("event_id").alias("seq"),
    )
