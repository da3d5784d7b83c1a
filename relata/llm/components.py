"""Connected components by hooking and shortcutting on parent tables (FastSV: Zhang, Azad and Hu, 2020).

Each vertex has a parent, at first the smallest of its neighbours and itself. In a round it sees the grandparents of its neighbours; the
smallest becomes its parent's parent and, if smaller, its own. Rounds grow with the logarithm of the component sizes. Only aggregates
(partial minima first) and joins with a stored table: no vertex's neighbours are gathered, and a vertex that is linked to a third
of all others is a skewed key of a plain join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.llm.common import forget, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, root), stored, for each vertex of the edges (u long, v long; links of a vertex to itself are none): root is the smallest
    vertex of its component."""
    pair = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    e = stored(edges.where("u <> v").select(F.inline(pair)).distinct(), "edges")
    at = stored(e.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("_m")).select("vertex", F.least("vertex", "_m").alias("root")), "parents")
    for _ in range(most_rounds):
        up = at.join(at.select(F.col("vertex").alias("root"), F.col("root").alias("above")), "root")
        seen = e.join(up.select(F.col("vertex").alias("v"), "above"), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("above").alias("low"))
        own = up.join(seen, "vertex")
        offers = F.array(F.struct(F.col("vertex").alias("x"), F.least("root", "above", "low").alias("o"), F.col("root").alias("old")), F.struct(F.col("root").alias("x"), F.col("low").alias("o"), F.lit(None).cast("long").alias("old")))
        new = own.select(F.inline(offers)).groupBy("x").agg(F.min("o").alias("root"), F.max("old").alias("old"))
        new = stored(new.select(F.col("x").alias("vertex"), "root", "old"), "parents")
        forget(at)
        at = new
        if at.where("root <> old").isEmpty():
            forget(e)
            out = at.drop("old")
            out._relata_path = at._relata_path  # callers forget it
            return out
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
