"""Distributional similarity of paths: positive PMI of slot fillers, slot similarity, path distance, block thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config
from relata.sources.scratch import stored

ZERO = 1e-12  # distances up to this are noise of equal filler sets


def smoothed(counts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Slot counts with a share of each path's mass given to its argument types where its fillers are rare.

    alpha = min(limit, share of the path's mass on fillers seen once in the corpus); off by default (limit 0).
    """
    args = counts.where("slot in ('x', 'y')").withColumn("n", F.col("n").cast("double"))
    if cfg.type_smoothing_max_alpha <= 0:
        return args
    seen = args.groupBy("slot", "filler").agg(F.sum("n").alias("_all"))
    per = args.join(seen, ["slot", "filler"]).groupBy("path", "slot").agg(F.sum("n").alias("_total"), F.sum(F.when(F.col("_all") <= 1, F.col("n")).otherwise(0.0)).alias("_rare"))
    per = per.select("path", "slot", (F.least(F.lit(cfg.type_smoothing_max_alpha), F.col("_rare") / F.col("_total")) * F.col("_total")).alias("_mass")).where("_mass > 0")
    types = counts.where("slot in ('tx', 'ty')").select("path", F.substring("slot", 2, 1).alias("slot"), F.col("filler").alias("_t"), F.col("n").alias("_tn"))
    total = types.groupBy("path", "slot").agg(F.sum("_tn").alias("_tt"))
    pseudo = types.join(total, ["path", "slot"]).join(per, ["path", "slot"]).select("path", "slot", F.concat(F.lit("§T:"), "_t").alias("filler"), (F.col("_mass") * F.col("_tn") / F.col("_tt")).alias("n"))
    return args.unionByName(pseudo)


def slot_pmi(counts: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(slot, path, filler, mi): ln(n N / (path total * filler total)) where positive; totals over all paths."""
    c = stored(smoothed(counts, cfg), "slots")  # read four times below
    by_path = c.groupBy("slot", "path").agg(F.sum("n").alias("_p"))
    by_word = c.groupBy("slot", "filler").agg(F.sum("n").alias("_w"))
    by_slot = c.groupBy("slot").agg(F.sum("n").alias("_N"))
    mi = F.log(F.col("n") * F.col("_N") / (F.col("_p") * F.col("_w")))
    j = c.join(by_path, ["slot", "path"]).join(by_word, ["slot", "filler"]).join(F.broadcast(by_slot), "slot")  # two rows
    return j.select("slot", "path", "filler", mi.alias("mi")).where("mi > 0")


def pmi_mass(mi: DataFrame) -> DataFrame:
    return mi.groupBy("slot", "path").agg(F.sum("mi").alias("mass"))


def slot_similarity(mi: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """(slot, p, q, sim), p < q, for pairs that share fillers (in a block, if blocks (path, sx, sy) are given).

    The join is on (slot, filler, block): pairs without a shared filler never exist. A filler shared by many paths is the
    skewed key; adaptive execution splits it, and positive PMI has already dropped what is everywhere.
    """
    keys = ["slot", "filler"]
    if block is not None:
        mi = mi.join(block.select("path", "sx", "sy"), "path")
        keys += ["sx", "sy"]
    mi = stored(mi, "pmi")  # read four times below
    a = mi.select(*keys, F.col("path").alias("p"), F.col("mi").alias("_a"))
    b = mi.select(*keys, F.col("path").alias("q"), F.col("mi").alias("_b"))
    shared = a.join(b, keys).where("p < q").groupBy("slot", "p", "q").agg(F.sum(F.col("_a") + F.col("_b")).alias("_num"))
    mass = pmi_mass(mi)
    m = lambda c: mass.select("slot", F.col("path").alias(c), F.col("mass").alias(f"_{c}m"))
    return shared.join(m("p"), ["slot", "p"]).join(m("q"), ["slot", "q"]).select("slot", "p", "q", (F.col("_num") / (F.col("_pm") + F.col("_qm"))).alias("sim"))


def path_distance(sims: DataFrame) -> DataFrame:
    """(p, q, distance) of pairs similar in both slots; all others have distance 1."""
    both = sims.groupBy("p", "q").agg(F.max(F.when(F.col("slot") == "x", F.col("sim"))).alias("_x"), F.max(F.when(F.col("slot") == "y", F.col("sim"))).alias("_y"))
    return both.where("_x > 0 and _y > 0").select("p", "q", (1 - F.sqrt(F.col("_x") * F.col("_y"))).alias("distance"))


def block_distances(mi: DataFrame, block: DataFrame) -> DataFrame:
    """:func:`path_distance` of :func:`slot_similarity` inside blocks (path, sx, sy), in one aggregate.

    Pairs of paths are pairs of numbers until only those remain that share a filler in both slots: sums of both slots are made at
    once, so pairs of one slot only go before they meet their masses, and a pair is 24 bytes of the shuffle, however long its paths.
    """
    number = F.row_number().over(Window.partitionBy("sx", "sy").orderBy("path")).cast("long")  # in the order of names; a pair's block is part of its key
    ids = stored(block.select("path", "sx", "sy").withColumn("n", number), "numbers")
    kinds = stored(ids.select("sx", "sy").distinct().withColumn("block", F.row_number().over(Window.orderBy("sx", "sy")).cast("int")), "blocks")  # a row per block
    rows = stored(mi.join(ids, "path").join(F.broadcast(kinds), ["sx", "sy"]).select("block", (F.col("slot") == "x").alias("is_x"), "filler", "n", "mi"), "pmi")  # read three times below
    keys = ["block", "is_x", "filler"]
    pair = rows.select(*keys, F.col("n").alias("p"), F.col("mi").alias("_a")).join(rows.select(*keys, F.col("n").alias("q"), F.col("mi").alias("_b")), keys).where("p < q")
    both = F.col("_a") + F.col("_b")
    sums = pair.groupBy("block", "p", "q").agg(F.sum(F.when(F.col("is_x"), both).otherwise(0.0)).alias("_x"), F.sum(F.when(F.col("is_x"), 0.0).otherwise(both)).alias("_y"))
    sums = stored(sums.where("_x > 0 and _y > 0"), "shared")
    mass = rows.groupBy("block", "n").agg(F.sum(F.when(F.col("is_x"), F.col("mi")).otherwise(0.0)).alias("mx"), F.sum(F.when(F.col("is_x"), 0.0).otherwise(F.col("mi"))).alias("my"))
    mass = stored(mass.join(ids.join(F.broadcast(kinds), ["sx", "sy"]).select("block", "n", "path"), ["block", "n"]), "masses")
    m = lambda c: mass.select("block", F.col("n").alias(c), F.col("path").alias(f"_{c}"), F.col("mx").alias(f"_{c}x"), F.col("my").alias(f"_{c}y"))
    j = sums.join(m("p"), ["block", "p"]).join(m("q"), ["block", "q"])
    x, y = F.col("_x") / (F.col("_px") + F.col("_qx")), F.col("_y") / (F.col("_py") + F.col("_qy"))
    return j.select(F.col("_p").alias("p"), F.col("_q").alias("q"), (1 - F.sqrt(x * y)).alias("distance"))


def block_thresholds(block: DataFrame, distances: DataFrame, reference: float | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(sx, sy, size, threshold) of each block from its heads' pair distances: the middle of the widest gap.

    Pairs that share no filler in both slots count with distance 1. They are added as a number, not as rows: sorted
    after all others they contribute one gap, from the largest smaller distance to 1, at most.
    """
    head = block.where("is_head")
    size = head.groupBy("sx", "sy").agg(F.count("*").alias("size"))
    one = lambda c: head.select(F.col("path").alias(c), F.col("sx"), F.col("sy"))
    d = distances.join(one("p"), "p").join(head.select(F.col("path").alias("q"), F.col("sx").alias("_sx"), F.col("sy").alias("_sy")), "q").where("sx = _sx and sy = _sy")
    d = d.select("sx", "sy", "distance")
    near = d.groupBy("sx", "sy").agg(F.count("*").alias("_stored"))
    full = size.join(near, ["sx", "sy"], "left").withColumn("_ones", (F.col("size") * (F.col("size") - 1) / 2).cast("long") - F.coalesce("_stored", F.lit(0)))
    ones = full.where("_ones > 0").select("sx", "sy", F.lit(1.0).alias("distance"), F.least(F.col("_ones"), F.lit(2)).alias("_k"))
    points = d.where(F.col("distance") > ZERO).unionByName(ones.select("sx", "sy", F.explode(F.array_repeat("distance", F.col("_k").cast("int"))).alias("distance")))
    w = Window.partitionBy("sx", "sy").orderBy("distance")
    gaps = points.select("sx", "sy", "distance", F.lead("distance").over(w).alias("_next"), F.row_number().over(w).alias("_rank"))
    cut = gaps.groupBy("sx", "sy").agg(
        F.count("*").alias("_nonzero"),
        F.max_by((F.col("distance") + F.col("_next")) / 2, F.when(F.col("_next").isNotNull(), F.struct(F.col("_next") - F.col("distance"), -F.col("_rank")))).alias("_cut"),
    )
    ref = F.lit(cfg.threshold_min if reference is None else reference) + 1e-9
    clamp = lambda c: F.least(F.greatest(c, F.lit(cfg.threshold_min)), F.lit(cfg.threshold_max))
    thr = (
        F.when(F.col("size") < 2, cfg.threshold_min)
        .when(F.coalesce("_nonzero", F.lit(0)) == 0, cfg.threshold_max)
        .when((F.col("size") < cfg.min_block_for_gap) | (F.col("_nonzero") < 2), clamp(ref))
        .otherwise(clamp(F.col("_cut")))
    )
    return size.join(cut, ["sx", "sy"], "left").select("sx", "sy", "size", thr.alias("threshold"))


def ema_threshold(previous: DataFrame, current: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sx, sy, threshold): smoothed with the block's threshold of the pass before, where it has one."""
    b = cfg.threshold_ema_beta
    p = previous.select("sx", "sy", F.col("threshold").alias("_old"))
    return current.join(p, ["sx", "sy"], "left").withColumn("threshold", F.coalesce(b * F.col("_old") + (1 - b) * F.col("threshold"), "threshold")).drop("_old")


def nearest_medoid(paths: DataFrame, medoids: DataFrame, distances: DataFrame) -> DataFrame:
    """(path, label, distance, accepted): the closest medoid of the path's block other than itself, ties to the smaller label.

    paths: (path, sx, sy, threshold); medoids: (label, medoid, sx, sy); distances: p < q, missing = 1.
    """
    d = distances.select(F.col("p").alias("path"), F.col("q").alias("medoid"), "distance").unionByName(distances.select(F.col("q").alias("path"), F.col("p").alias("medoid"), "distance"))
    pairs = paths.join(medoids, ["sx", "sy"]).where("path <> medoid").join(d, ["path", "medoid"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    best = pairs.groupBy("path", "threshold").agg(F.min(F.struct("distance", "label")).alias("_b"))
    return best.select("path", F.col("_b.label").alias("label"), F.col("_b.distance").alias("distance"), (F.col("_b.distance") <= F.col("threshold")).alias("accepted"))
