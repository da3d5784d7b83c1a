"""The relation schema: domain, range, and parents by asymmetric containment of argument sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config
from relata.operators.pathstats import dominant, support_of
from relata.sources.scratch import is_stored, stored


def label_fillers(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, slot, filler, n) from (path, label) and slot counts."""
    return labels.select("path", "label").join(counts, "path").groupBy("label", "slot", "filler").agg(F.sum("n").alias("n"))


def relation_schema(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, domain, range, support)."""
    return _schema_of(labels, counts, label_fillers(labels, counts))


def _schema_of(labels: DataFrame, counts: DataFrame, fillers: DataFrame) -> DataFrame:
    d = dominant(fillers.where("slot in ('tx', 'ty')"), ["label", "slot"])
    kinds = d.groupBy("label").agg(F.max(F.when(F.col("slot") == "tx", F.col("dominant"))).alias("domain"), F.max(F.when(F.col("slot") == "ty", F.col("dominant"))).alias("range"))
    support = labels.join(support_of(counts), "path", "left").groupBy("label").agg(F.coalesce(F.sum("support"), F.lit(0)).alias("support"))
    return support.join(kinds, "label", "left").select("label", F.coalesce("domain", F.lit("?")).alias("domain"), F.coalesce("range", F.lit("?")).alias("range"), "support")


def parents(labels: DataFrame, counts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(label, domain, range, support, parent, containment): the narrowest broader label that holds most of both argument sets.

    Only labels that share a filler in each slot can qualify, so candidates come from joins on (domain, range, slot,
    filler), not from all pairs of labels.
    """
    # one step after the other: each one's shuffles are gone before the next
    fillers = stored(label_fillers(labels, counts), "fillers")
    schema = stored(_schema_of(labels, counts, fillers), "domains")
    sets = stored(fillers.where("slot in ('x', 'y')").select("label", "slot", "filler").join(schema.select("label", "domain", "range"), "label"), "sets")
    size = sets.groupBy("label").agg(F.sum(F.when(F.col("slot") == "x", 1).otherwise(0)).alias("nx"), F.sum(F.when(F.col("slot") == "y", 1).otherwise(0)).alias("ny"))
    a, b = sets, sets.select(F.col("label").alias("parent"), "slot", "filler", "domain", "range")
    both = a.join(b, ["domain", "range", "slot", "filler"]).where("label <> parent").groupBy("label", "parent").agg(F.sum(F.when(F.col("slot") == "x", 1).otherwise(0)).alias("ix"), F.sum(F.when(F.col("slot") == "y", 1).otherwise(0)).alias("iy"))
    both = stored(both.where("ix > 0 and iy > 0"), "shared")  # without a shared filler in each slot containment is 0
    j = both.join(size, "label").join(size.select(F.col("label").alias("parent"), F.col("nx").alias("px"), F.col("ny").alias("py")), "parent")
    up, down = F.least(F.col("ix") / F.col("nx"), F.col("iy") / F.col("ny")), F.least(F.col("ix") / F.col("px"), F.col("iy") / F.col("py"))
    spread = F.col("px") + F.col("py")
    ok = j.withColumns({"_up": up, "_down": down, "_spread": spread}).where((spread > F.col("nx") + F.col("ny")) & (F.col("_up") >= cfg.subsumption_min_containment) & (F.col("_down") < F.col("_up")))
    best = ok.groupBy("label").agg(F.min(F.struct("_spread", -F.col("_up"), F.col("parent").alias("parent"), F.col("_up").alias("up"))).alias("_b"))
    return schema.join(best, "label", "left").select("label", "domain", "range", "support", F.col("_b.parent").alias("parent"), F.coalesce(F.round("_b.up", 3), F.lit(0.0)).alias("containment"))


def with_depth(schema: DataFrame) -> DataFrame:
    """Adds depth (roots 0). A parent is strictly broader, so walks end; each round doubles the steps walked (pointer jumping)."""
    schema = schema if is_stored(schema) else stored(schema, "schema")
    at = schema.select("label", F.col("parent").alias("_up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    known = at.select(F.col("label").alias("_up"), F.lit(True).alias("_known"))
    at = stored(at.join(known, "_up", "left").select("label", F.when(F.col("_known"), F.col("_up")).alias("_up"), "depth"), "depths")
    while not at.where("_up is not null").isEmpty():
        up = at.select(F.col("label").alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        at = stored(at.join(up, "_up", "left").select("label", F.col("_next").alias("_up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth")), "depths")
    return schema.join(at.select("label", "depth"), "label")
