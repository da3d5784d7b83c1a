"""Complete-linkage clustering inside type blocks (heads of at most ``max_block_size`` paths, so a group is bounded)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FOLD = 64  # terms of a reference folded by halves that a double can hold


def complete_linkage(d: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers; clusters merge, closest first, while their largest pair distance is below the threshold.

    Nearest-neighbour chains find the same merges as the greedy order does for this (reducible) linkage in n^2 steps;
    merges at or above the threshold are left out.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    root = np.arange(n)
    live = np.ones(n, bool)
    chain: list[int] = []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            i = chain[-1]
            row = np.where(live, d[i], np.inf)
            row[i] = np.inf
            j = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
            if len(chain) > 1 and j == chain[-2]:
                break
            chain.append(j)
        a, b = sorted((chain.pop(), chain.pop()))
        if not d[a, b] < threshold:
            # no pair closer than these two remains for either: both are done, as no later merge can be closer
            live[a] = live[b] = False
            continue
        merged = np.maximum(d[a], d[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        live[b] = False
        root[root == b] = a
    return root


def cluster_blocks(block: DataFrame, distances: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(sx, sy, path, cluster): clusters of the block heads; a cluster is named by its smallest path of largest support.

    Only pairs nearer than 1 travel; the dense matrix exists inside one group only (800 x 800 at the default cap).
    """
    head = block.where("is_head").select("sx", "sy", "path", "support")
    side = lambda c: head.select(F.col("path").alias(c), F.col("sx").alias(f"_x{c}"), F.col("sy").alias(f"_y{c}"))
    pairs = distances.join(side("p"), "p").join(side("q"), "q").where("_xp = _xq and _yp = _yq")
    near = pairs.groupBy(F.col("_xp").alias("sx"), F.col("_yp").alias("sy")).agg(F.collect_list(F.struct("p", "q", "distance")).alias("pairs"))
    paths = head.groupBy("sx", "sy").agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), "path"))).alias("paths"))
    rows = paths.join(near, ["sx", "sy"], "left").join(thresholds.select("sx", "sy", "threshold"), ["sx", "sy"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                names = [p["path"] for p in r.paths]
                at = {p: i for i, p in enumerate(names)}
                d = np.ones((len(names), len(names)))
                for e in r.pairs if r.pairs is not None else []:
                    d[at[e["p"]], at[e["q"]]] = d[at[e["q"]], at[e["p"]]] = e["distance"]
                root = complete_linkage(d, r.threshold)
                first: dict[int, str] = {}
                for i, c in enumerate(root.tolist()):  # names are in order of (support desc, path)
                    first.setdefault(c, names[i])
                yield pd.DataFrame({"sx": r.sx, "sy": r.sy, "path": names, "cluster": [first[c] for c in root.tolist()]})

    return rows.mapInPandas(run, "sx string, sy string, path string, cluster string")


def member_pairs(clusters: DataFrame, distances: DataFrame) -> DataFrame:
    """(cluster, p, q, distance) of stored pairs inside clusters."""
    one = lambda c: clusters.select(F.col("path").alias(c), F.col("cluster").alias(f"_{c}"))
    return distances.join(one("p"), "p").join(one("q"), "q").where("_p = _q").select(F.col("_p").alias("cluster"), "p", "q", "distance")


def cohesion(clusters: DataFrame, distances: DataFrame) -> DataFrame:
    """(cluster, size, cohesion): mean similarity over all member pairs (missing pairs count 0); null for one member."""
    sims = member_pairs(clusters, distances).groupBy("cluster").agg(F.sum(1 - F.col("distance")).alias("_s"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return size.join(sims, "cluster", "left").select("cluster", "size", F.when(F.col("size") > 1, F.coalesce("_s", F.lit(0.0)) / pairs).alias("cohesion"))


def medoids(clusters: DataFrame, distances: DataFrame) -> DataFrame:
    """(cluster, medoid): the member with the smallest sum of distances to the others, ties to the smallest path."""
    m = member_pairs(clusters, distances)
    both = m.select("cluster", F.col("p").alias("path"), "distance").unionByName(m.select("cluster", F.col("q").alias("path"), "distance"))
    near = both.groupBy("cluster", "path").agg(F.sum("distance").alias("_d"), F.count("*").alias("_k"))
    size = clusters.groupBy("cluster").agg(F.count("*").alias("_n"))
    total = clusters.join(size, "cluster").join(near, ["cluster", "path"], "left")
    total = total.withColumn("_total", F.round(F.coalesce("_d", F.lit(0.0)) + F.col("_n") - 1 - F.coalesce("_k", F.lit(0)), 9))
    return total.groupBy("cluster").agg(F.min_by("path", F.struct("_total", "path")).alias("medoid"))


def merge_reference(clusters: DataFrame, distances: DataFrame, block_size: DataFrame, min_block: int = 3, start: float | None = None) -> DataFrame:
    """One row (reference): mean distances of the merged clusters of populated blocks, folded in order by halves.

    clusters carry sx, sy and seq (the order of processing). The fold's weights halve at each step, so only the last FOLD clusters
    count in a double, and no more are gathered.
    """
    c = cohesion(clusters.select("cluster", "path"), distances).where("size >= 2")
    order = clusters.groupBy("cluster", "sx", "sy").agg(F.min("seq").alias("seq")).join(block_size.where(F.col("size") >= min_block).select("sx", "sy"), ["sx", "sy"])
    d = c.join(order, "cluster").select("seq", (1 - F.col("cohesion")).alias("d")).orderBy(F.desc("seq")).limit(FOLD)
    folded = F.aggregate(F.sort_array(F.collect_list(F.struct("seq", "d"))), F.lit(start).cast("double"), lambda r, x: F.coalesce(0.5 * r + 0.5 * x["d"], x["d"]))
    return d.agg(folded.alias("reference"))


def carryover_scores(new: DataFrame, old: DataFrame) -> DataFrame:
    """(cluster, label, jaccard): the overlap of each new cluster (cluster, path) with each earlier one (label, path)."""
    shared = new.join(old, "path").groupBy("cluster", "label").agg(F.count("*").alias("_i"))
    a = new.groupBy("cluster").agg(F.count("*").alias("_a"))
    b = old.groupBy("label").agg(F.count("*").alias("_b"))
    return shared.join(a, "cluster").join(b, "label").select("cluster", "label", (F.col("_i") / (F.col("_a") + F.col("_b") - F.col("_i"))).alias("jaccard"))
