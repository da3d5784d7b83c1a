"""Path statistics in long form: how often each filler stands in each slot of each path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config

SLOTS = ("x", "y", "tx", "ty")


def slot_counts(props: DataFrame) -> DataFrame:
    """(path, slot, filler, n): one pass and one shuffle for the four slots; missing types are '?'."""
    kind = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), c.alias("filler")) for s, c in zip(SLOTS, (F.col("arg1"), F.col("arg2"), kind("type1"), kind("type2")))])
    # the four slots of equal propositions are counted together first, so the exploded rows are distinct ones
    distinct = props.groupBy("path", "arg1", "arg2", "type1", "type2").agg(F.count("*").alias("_n"))
    s = distinct.select("path", "_n", F.inline(slots))
    return s.groupBy("path", "slot", "filler").agg(F.sum("_n").alias("n"))


def path_support(props: DataFrame) -> DataFrame:
    return props.groupBy("path").agg(F.count("*").alias("support"))


def support_of(counts: DataFrame) -> DataFrame:
    """Support from slot counts: each proposition has one x."""
    return counts.where("slot = 'x'").groupBy("path").agg(F.sum("n").alias("support"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Statistics of several batches together (slot counts are sums)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("path", "slot", "filler").agg(F.sum("n").alias("n"))


def doc_digest(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def new_documents(docs: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose digest isn't in the ledger, each text once (the smallest id stays)."""
    d = docs.withColumn("digest", doc_digest(F.coalesce(F.col(text), F.lit(""))))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    return d.join(first, ["digest", "doc_id"]).dropDuplicates(["digest"]).join(ledger.select("digest"), "digest", "left_anti")


def store_stats(counts: DataFrame, ledger: DataFrame) -> DataFrame:
    totals = support_of(counts).agg(F.count("*").alias("n_paths"), F.coalesce(F.sum("support"), F.lit(0)).alias("total_support"))
    return totals.crossJoin(ledger.agg(F.countDistinct("digest").alias("n_docs")))  # one row each


def candidates(support: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    return support.where(F.col("support") >= cfg.min_path_support)


def dominant(counts: DataFrame, keys: list[str], value: str = "filler", n: str = "n") -> DataFrame:
    """The most frequent value of each group, ties to the smallest."""
    per = counts.groupBy(*keys, value).agg(F.sum(n).alias("_n"))
    return per.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("dominant"))


def type_signatures(counts: DataFrame) -> DataFrame:
    """(path, sx, sy): the dominant types of both slots; '?' without any."""
    d = dominant(counts.where("slot in ('tx', 'ty')"), ["path", "slot"])
    one = lambda s: F.coalesce(F.max(F.when(F.col("slot") == s, F.col("dominant"))), F.lit("?"))
    return d.groupBy("path").agg(one("tx").alias("sx"), one("ty").alias("sy"))


def blocks(support: DataFrame, signatures: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(path, support, sx, sy, block_size, place, is_head): the paths of each block by support; the first
    ``max_block_size`` are its head."""
    c = candidates(support, cfg)
    if cfg.type_signature_blocking:
        c = c.join(signatures, "path", "left").withColumns({"sx": F.coalesce("sx", F.lit("?")), "sy": F.coalesce("sy", F.lit("?"))})
    else:
        c = c.withColumns({"sx": F.lit("*"), "sy": F.lit("*")})
    w = Window.partitionBy("sx", "sy")
    place = F.row_number().over(w.orderBy(F.desc("support"), "path"))
    c = c.withColumns({"block_size": F.count("*").over(w), "place": place})
    return c.withColumn("is_head", F.col("place") <= cfg.max_block_size)


def median_support(support: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The upper middle element of the candidates' supports; 1 without any. Distinct supports are counted first, so the
    running sum is over few rows."""
    per = candidates(support, cfg).groupBy("support").agg(F.count("*").alias("k"))
    run = per.select("support", F.sum("k").over(Window.orderBy("support")).alias("upto"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("n"))
    return run.agg(F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("support"))), F.lit(1)).cast("double").alias("median"))
