"""Readers of gold data: tuples as TSV, document relations as JSON, relation partitions as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.functions.text import normalize_phrase


def read_tuples(spark: SparkSession, path: str) -> DataFrame:
    """(sentence, seq, arg1, rel, arg2) from lines of four or more tab-separated fields; shorter ones are skipped."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    p = lines.withColumn("_f", F.split("value", "\t")).where(F.size("_f") >= 4)
    return p.select(F.trim(F.col("_f")[0]).alias("sentence"), "seq", *[F.trim(F.col("_f")[i + 1]).alias(c) for i, c in enumerate(("arg1", "rel", "arg2"))])


_DOCUMENT = "title string, vertexSet array<array<struct<name:string>>>, labels array<struct<h:int,t:int,r:string>>"


def read_document_relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples: title, seq, arg1, rel, arg2; partition: arg1, arg2, gold) from documents with entity mentions and labelled pairs.

    An entity is named by its first mention; relations with a missing part are skipped; a pair's last relation counts.
    """
    docs = spark.read.schema(_DOCUMENT).json(path, multiLine=True).withColumn("_d", F.monotonically_increasing_id())
    name = lambda i: normalize_phrase(F.get(F.get("vertexSet", i), F.lit(0))["name"])
    rows = docs.select(F.coalesce("title", F.col("_d").cast("string")).alias("title"), "vertexSet", "_d", F.posexplode("labels").alias("_i", "_l"))
    rows = rows.select("title", F.struct("_d", "_i").alias("seq"), name(F.col("_l.h")).alias("arg1"), F.col("_l.r").alias("rel"), name(F.col("_l.t")).alias("arg2"))
    ok = rows.where("arg1 <> '' and arg2 <> '' and rel is not null and rel <> ''")
    triples = ok.withColumn("seq", F.row_number().over(Window.partitionBy("title").orderBy("seq")))
    return triples, ok.groupBy("arg1", "arg2").agg(F.max_by("rel", "seq").alias("gold"))


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(arg1, arg2, gold) from a list of {arg1, arg2, relation}; rows without all three are dropped; a pair's last relation counts."""
    r = spark.read.schema("arg1 string, arg2 string, relation string").json(path, multiLine=True).withColumn("_s", F.monotonically_increasing_id())
    ok = r.where("arg1 <> '' and arg2 <> '' and relation <> ''")
    return ok.groupBy(normalize_phrase(F.col("arg1")).alias("arg1"), normalize_phrase(F.col("arg2")).alias("arg2")).agg(F.max_by("relation", "_s").alias("gold"))
