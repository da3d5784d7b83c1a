"""Relation induction: full passes, incremental passes, and the policy that picks between them.

The relation inventory (paths, labels, medoids, clusters of the pass before) is a set of tables; the driver sees counts, a row per
block of argument types, and the few last terms of the running reference distance. What a record-at-a-time loop would
do in sequence is done in rounds:

* Labels. A cluster takes the label of the earlier cluster it overlaps most (first in order of processing where several claim
  one); these names are reserved. All others get their readable label, numbered in order of processing where it repeats.
* The rest of a large block, and changed paths of an incremental pass, go to the closest medoid within the threshold. Those
  without one lead clusters of their own, which later paths may join: a path leads if no earlier one near it does, which
  is settled in rounds (each settles all paths whose earlier neighbours are settled).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config
from relata.functions.text import readable_label
from relata.operators import cluster as C
from relata.operators import dirt, pathstats
from relata.sources.scratch import is_stored, scope, stored

LABELS = "path string, label string"
MEDOIDS = "label string, medoid string, sx string, sy string"
COHESION = "label string, cohesion double"
PREVIOUS = "part string, path string, label string"
SUPPORT = "path string, support long"
TABLES = {"labels": LABELS, "medoids": MEDOIDS, "cohesion": COHESION, "previous": PREVIOUS, "support": SUPPORT}


@dataclass
class State:
    """What a pass leaves behind: tables (None: empty), and on the driver a row per block and per calibration bin."""

    labels: DataFrame | None = None
    medoids: DataFrame | None = None
    cohesion: DataFrame | None = None
    previous: DataFrame | None = None  # members of each cluster; the rest of a block counts as single clusters
    support: DataFrame | None = None
    thresholds: dict[tuple[str, str], float] = field(default_factory=dict)
    smoothed: dict[tuple[str, str], float] = field(default_factory=dict)
    reference: float | None = None
    calibration: dict[int, tuple[int, int]] = field(default_factory=dict)
    median: float = 1.0
    n_medoids: int = 0
    fits: int = 0
    singletons: int = 0

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        found = getattr(self, name)
        return spark.createDataFrame([], TABLES[name]) if found is None else found


def needs_full(state: State, n: int, changed: int, new_block: bool, cfg: Config = DEFAULT) -> bool:
    return (
        not state.n_medoids
        or state.fits >= cfg.recluster_every
        or changed > max(1, n // 2)
        or new_block
        or state.singletons > max(2, state.n_medoids // 10)
    )


def distances(counts: DataFrame, block: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Pair distances inside blocks; mutual information over all candidate paths."""
    return dirt.block_distances(dirt.slot_pmi(counts, cfg), block)


def _prepared(counts: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, float]:
    """Blocks and distances (stored) and the median support."""
    counts = counts if is_stored(counts) else stored(counts, "counts")
    block = stored(pathstats.blocks(pathstats.support_of(counts), pathstats.type_signatures(counts), cfg), "blocks")
    with scope() as keep:
        dist = keep(stored(distances(counts.join(block.select("path"), "path"), block, cfg), "distances"))
    return block, dist, float(pathstats.median_support(block.select("path", "support"), cfg).first()["median"])


def unique_names(wanted: DataFrame, reserved: DataFrame) -> DataFrame:
    """(*, label): each row's base name, numbered from _2 in order (``ord``) where it repeats, never a reserved name (label).

    wanted: (id, base, ord). Clashes between numbered names and other bases are rare; each round gives those rows the next
    numbers of their base.
    """
    w = Window.partitionBy("base").orderBy("ord")
    name = F.when(F.col("_k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("_k").cast("string")))
    rows = wanted.withColumn("_k", F.row_number().over(w))
    taken = reserved.select("label").distinct().withColumn("_taken", F.lit(True))
    while True:
        rows = rows.withColumn("label", name).join(taken, "label", "left")
        first = F.row_number().over(Window.partitionBy("label").orderBy("_k", "ord"))
        rows = stored(rows.withColumn("_clash", F.coalesce("_taken", F.lit(False)) | (first > 1)).drop("_taken"), "names")
        if rows.where("_clash").isEmpty():
            return rows.drop("_k", "_clash")
        top = rows.groupBy("base").agg(F.max("_k").alias("_top"))
        n = F.sum(F.col("_clash").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.join(top, "base").withColumn("_k", F.when(F.col("_clash"), F.col("_top") + n).otherwise(F.col("_k"))).drop("_top", "_clash", "label")


def name_clusters(clusters: DataFrame, order: Column, previous: DataFrame, reserved: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(cluster, label) of clusters (cluster, path, and what ``order`` needs); a cluster is named by its representative path.

    previous: (part, path, label) of the pass before; reserved: labels in use.
    """
    clusters = clusters.withColumn("ord", order)
    own = clusters.groupBy("cluster").agg(F.min("ord").alias("ord"))
    scores = C.carryover_scores(clusters.select("cluster", "path"), previous.select("path", F.struct("label", "part").alias("label")))
    best = scores.groupBy("cluster").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), F.col("label.label").alias("label"))).alias("_b"))
    best = best.where(-F.col("_b.j") >= cfg.label_carryover_jaccard).select("cluster", F.col("_b.label").alias("label"))
    claims = own.join(best, "cluster").join(reserved.select("label").distinct(), "label", "left_anti")
    carried = claims.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("ord"))).where("_r = 1").select("cluster", "label")
    carried = stored(carried, "carried")
    rest = own.join(carried, "cluster", "left_anti").withColumn("base", readable_label(F.col("cluster")))
    fresh = unique_names(rest, reserved.select("label").unionByName(carried.select("label")))
    return stored(carried.unionByName(fresh.select("cluster", "label")), "cluster-names")


def follow_leaders(paths: DataFrame, medoids: DataFrame, dist: DataFrame) -> DataFrame:
    """(path, leads): whether a path without a medoid in reach leads a cluster of its own.

    paths: (path, sx, sy, ord, threshold, may_lead); medoids: (label, medoid, sx, sy). Paths are taken in order: a path leads if it may,
    no medoid is within its threshold, and no earlier leader of its block is.
    """
    near = dist.select(F.col("p").alias("path"), F.col("q").alias("_q"), "distance").unionByName(dist.select(F.col("q").alias("path"), F.col("p").alias("_q"), "distance"))
    # only stored distances (below 1) can be within a threshold, so no path meets a medoid that it shares nothing with
    by_medoid = near.join(medoids.select(F.col("medoid").alias("_q"), "sx", "sy"), "_q").join(paths.select("path", "sx", "sy", "threshold"), ["path", "sx", "sy"])
    free = stored(paths.join(by_medoid.where(F.col("distance") <= F.col("threshold")).select("path"), "path", "left_anti").where("may_lead").select("path", "sx", "sy", "ord", "threshold"), "free")
    one = free.select("path", "sx", "sy", "ord", "threshold")
    other = free.select(F.col("path").alias("_q"), F.col("sx").alias("_x"), F.col("sy").alias("_y"), F.col("ord").alias("_o"))
    # an edge from each path to the earlier ones that it would join
    edges = near.join(one, "path").join(other, "_q").where((F.col("sx") == F.col("_x")) & (F.col("sy") == F.col("_y")) & (F.col("_o") < F.col("ord")) & (F.col("distance") <= F.col("threshold")))
    edges = stored(edges.select("path", "_q"), "near")
    settled = stored(free.select("path").join(edges.select("path").distinct(), "path", "left_anti").withColumn("leads", F.lit(True)), "leads")
    while True:
        open_ = edges.join(settled.select("path"), "path", "left_anti").join(settled.select(F.col("path").alias("_q"), "leads"), "_q", "left")
        ends = open_.groupBy("path").agg(F.max(F.coalesce("leads", F.lit(False))).alias("_led"), F.min(F.col("leads").isNotNull()).alias("_all"))
        more = stored(ends.where("_led or _all").select("path", (~F.col("_led")).alias("leads")), "leads")
        if more.isEmpty():
            return settled
        settled = stored(settled.unionByName(more), "leads")


def join_nearest(paths: DataFrame, medoids: DataFrame, leaders: DataFrame, dist: DataFrame) -> DataFrame:
    """(path, label) of paths with a medoid, or an earlier leader, within their threshold; ties to the smaller label.

    leaders: (label, path as medoid, sx, sy, ord).
    """
    every = medoids.select("label", "medoid", "sx", "sy", F.lit(None).cast(dict(leaders.dtypes)["ord"]).alias("_mo")).unionByName(leaders.select("label", "medoid", "sx", "sy", F.col("ord").alias("_mo")))
    d = dist.select(F.col("p").alias("path"), F.col("q").alias("medoid"), "distance").unionByName(dist.select(F.col("q").alias("path"), F.col("p").alias("medoid"), "distance"))
    pairs = d.join(paths.select("path", "sx", "sy", "ord", "threshold"), "path").join(every, ["medoid", "sx", "sy"])
    ok = pairs.where((F.col("distance") <= F.col("threshold")) & (F.col("_mo").isNull() | (F.col("_mo") < F.col("ord"))))
    return ok.groupBy("path").agg(F.min(F.struct("distance", "label")).alias("_b")).select("path", F.col("_b.label").alias("label"))


def _thresholds(block: DataFrame, dist: DataFrame, out: State, cfg: Config) -> DataFrame:
    """Thresholds of the blocks, smoothed over passes; a row per block passes the driver."""
    spark = block.sparkSession
    rows = []
    for r in dirt.block_thresholds(block, dist, out.reference, cfg).collect():
        key, t = (r["sx"], r["sy"]), r["threshold"]
        if r["size"] >= 2:
            old = out.smoothed.get(key)
            t = t if old is None else cfg.threshold_ema_beta * old + (1 - cfg.threshold_ema_beta) * t
            out.smoothed[key] = t
        out.thresholds[key] = t
        rows.append((*key, t))
    return spark.createDataFrame(rows, "sx string, sy string, threshold double")


def _order(populated: Column) -> Column:
    """Order of processing: populated blocks first, then types; inside a block heads by representative, then the rest."""
    return F.struct((~populated).cast("int").alias("a"), F.col("sx").alias("b"), F.col("sy").alias("c"), F.col("_tail").alias("d"), (-F.col("support")).alias("e"), F.col("path").alias("f"))


def _kept(state: State, keep: Callable[[DataFrame], DataFrame]) -> State:
    for name in TABLES:
        keep(getattr(state, name))
    return state


def full_pass(counts: DataFrame, state: State | None = None, cfg: Config = DEFAULT) -> State:
    """Cluster all candidate paths inside their blocks and label the clusters. Only the state's tables stay."""
    with scope() as keep:
        return _kept(_full_pass(counts, state or State(), cfg), keep)


def _full_pass(counts: DataFrame, state: State, cfg: Config) -> State:
    spark = counts.sparkSession
    block, dist, median = _prepared(counts, cfg)
    populated = F.col("block_size") >= cfg.min_block_for_gap
    out = State(smoothed=dict(state.smoothed), reference=state.reference, calibration=dict(state.calibration), median=median)
    made = []
    for some in (True, False):  # populated blocks teach the reference that sparse ones use
        part = block.where(populated == some)
        made.append(stored(C.cluster_blocks(part, dist, _thresholds(part, dist, out, cfg)), "clusters"))
        if some:
            out.reference = running_reference(made[0].join(part.select("path", "support"), "path"), dist, out.reference)
    heads = made[0].unionByName(made[1])
    ord_ = _order(populated)
    shape = block.select("path", "support", "block_size", "is_head")
    rows = stored(heads.join(shape, "path").withColumn("_tail", F.lit(0)), "heads")
    names = name_clusters(rows, ord_, state.table(spark, "previous"), spark.createDataFrame([], "label string"), cfg)
    med = C.medoids(heads.select("cluster", "path"), dist).join(names, "cluster")
    blocks_of = heads.select(F.col("cluster"), "sx", "sy").distinct()
    medoids = stored(med.join(blocks_of, "cluster").select("label", "medoid", "sx", "sy"), "medoids")
    labels = heads.join(names, "cluster").select("path", "label")
    previous = heads.join(names, "cluster").select(F.col("cluster").alias("part"), "path", "label")

    tail = block.where("not is_head")
    if not tail.isEmpty():
        limits = spark.createDataFrame([(*k, v) for k, v in out.thresholds.items()], "sx string, sy string, threshold double")
        rest = tail.join(F.broadcast(limits), ["sx", "sy"]).withColumn("_tail", F.lit(1)).withColumns({"may_lead": F.lit(True)})  # a row per block
        rest = stored(rest.withColumn("ord", ord_), "rest")
        lead = follow_leaders(rest, medoids, dist).where("leads").select("path")
        lead = stored(rest.join(lead, "path"), "leaders")
        new = name_clusters(lead.withColumn("cluster", F.col("path")).select("cluster", "path", "ord"), F.col("ord"), state.table(spark, "previous"), names, cfg)
        leaders = lead.join(new, F.col("path") == F.col("cluster")).select("label", F.col("path").alias("medoid"), "sx", "sy", "ord")
        joined = join_nearest(rest.join(lead.select("path"), "path", "left_anti"), medoids, leaders, dist)
        more = stored(joined.unionByName(leaders.select(F.col("medoid").alias("path"), "label")), "rest-labels")
        labels = labels.unionByName(more)
        previous = previous.unionByName(more.select(F.col("path").alias("part"), "path", "label"))
        medoids = medoids.unionByName(leaders.select("label", "medoid", "sx", "sy"))
    out.labels, out.previous, out.medoids = stored(labels, "labels"), stored(previous, "previous"), stored(medoids, "medoids")
    coh = C.cohesion(heads.select("cluster", "path"), dist).where("cohesion is not null").join(names, "cluster")
    out.cohesion = stored(coh.select("label", "cohesion"), "cohesion")
    out.support = stored(block.select("path", "support"), "support")
    out.n_medoids = out.medoids.count()
    return out


def running_reference(clusters: DataFrame, dist: DataFrame, start: float | None) -> float | None:
    """The reference after all merged clusters (cluster, path, sx, sy, support) of populated blocks, in order: each halves what was
    before it, so only the last terms count."""
    ends = C.cohesion(clusters.select("cluster", "path"), dist).where("size >= 2")
    order = clusters.where("cluster = path").select("cluster", F.struct("sx", "sy", -F.col("support"), "path").alias("_o"))
    last = [1 - r["cohesion"] for r in ends.join(order, "cluster").orderBy(F.desc("_o")).limit(C.FOLD).collect()][::-1]
    for d in last:
        start = d if start is None else 0.5 * start + 0.5 * d
    return start


def incremental_pass(counts: DataFrame, changed: DataFrame, state: State, cfg: Config = DEFAULT) -> State:
    """Assign changed paths (path) to the closest medoid of their block; a path that had a label and finds none keeps it."""
    with scope() as keep:
        return _kept(_incremental_pass(counts, changed, state, cfg), keep)


def _incremental_pass(counts: DataFrame, changed: DataFrame, state: State, cfg: Config) -> State:
    spark = counts.sparkSession
    block, dist, median = _prepared(counts, cfg)
    limits = spark.createDataFrame([(*k, v) for k, v in state.thresholds.items()], "sx string, sy string, threshold double")
    had = state.labels.select("path", F.lit(True).alias("_had"))
    rows = block.join(changed.select("path").distinct(), "path").join(F.broadcast(limits), ["sx", "sy"], "left").join(had, "path", "left")  # a row per block
    rows = rows.withColumns({"threshold": F.coalesce("threshold", F.lit(cfg.threshold_min)), "may_lead": F.col("_had").isNull(), "ord": F.struct((-F.col("support")).alias("e"), F.col("path").alias("f"))})
    rows = stored(rows, "changed")
    lead = follow_leaders(rows, state.medoids, dist).where("leads").select("path")
    lead = stored(rows.join(lead, "path"), "leaders")
    new = unique_names(lead.select(F.col("path").alias("id"), readable_label(F.col("path")).alias("base"), "ord"), state.labels.select("label"))
    leaders = stored(lead.join(new.select("id", "label"), F.col("path") == F.col("id")).select("label", F.col("path").alias("medoid"), "sx", "sy", "ord"), "new-medoids")
    joined = join_nearest(rows.join(lead.select("path"), "path", "left_anti"), state.medoids, leaders, dist)
    fresh = stored(joined.unionByName(leaders.select(F.col("medoid").alias("path"), "label")), "new-labels")
    n = leaders.count()
    state.labels = stored(state.labels.join(fresh.select("path"), "path", "left_anti").unionByName(fresh), "labels")
    state.medoids = stored(state.medoids.unionByName(leaders.select("label", "medoid", "sx", "sy")), "medoids")
    state.support, state.median = stored(block.select("path", "support"), "support"), median
    state.n_medoids, state.singletons = state.n_medoids + n, state.singletons + n
    return state


def fit(counts: DataFrame, state: State, cfg: Config = DEFAULT) -> tuple[State, str]:
    """(state, 'same' | 'full' | 'incremental')."""
    with scope() as keep:
        state, kind = _fit(counts, state, cfg)
        return (state if kind == "same" else _kept(state, keep)), kind


def _fit(counts: DataFrame, state: State, cfg: Config) -> tuple[State, str]:
    spark = counts.sparkSession
    counts = counts if is_stored(counts) else stored(counts, "counts")
    support = stored(pathstats.candidates(pathstats.support_of(counts), cfg), "support")
    old = state.table(spark, "support").select("path", F.col("support").alias("_old"))
    both = support.join(old, "path", "full")
    changed = stored(both.where(F.col("support").isNotNull() & ~F.col("support").eqNullSafe(F.col("_old"))).select("path"), "changed")
    n, n_changed, gone = support.count(), changed.count(), both.where("support is null").isEmpty()
    if state.labels is not None and not n_changed and gone:
        return state, "same"
    new_block = False
    if cfg.type_signature_blocking and state.n_medoids and n_changed:
        seen = pathstats.type_signatures(counts).join(changed, "path").select("sx", "sy").distinct().collect()  # a row per block
        new_block = any((r["sx"], r["sy"]) not in state.thresholds for r in seen)
    if needs_full(state, n, n_changed, new_block, cfg):
        return full_pass(counts, state, cfg), "full"
    state = incremental_pass(counts, changed, state, cfg)
    state.fits += 1
    return state, "incremental"


def label_table(spark: SparkSession, state: State) -> DataFrame:
    """(path, label, cohesion) of a state."""
    return state.table(spark, "labels").join(state.table(spark, "cohesion"), "label", "left").select("path", "label", "cohesion")


def annotate(props: DataFrame, labels: DataFrame) -> DataFrame:
    """Propositions with ``label``: the induced one of their path, else its readable form."""
    return props.join(labels.select("path", F.col("label").alias("_l")), "path", "left").withColumn("label", F.coalesce("_l", readable_label(F.col("path")))).drop("_l")
