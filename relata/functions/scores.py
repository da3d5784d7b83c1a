"""Column functions for scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1 to 4 places; 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1")]


def bucket(conf: Column, bins: int) -> Column:
    return F.least(F.greatest(F.floor(conf * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def raw_confidence(support: Column, median: Column, cohesion: Column, cfg: Config = DEFAULT) -> Column:
    """Support against the corpus median, blended with the cluster's cohesion where it has one."""
    term = F.least(F.lit(1.0), support / (support + F.greatest(median, F.lit(1.0))))
    w = cfg.conf_cohesion_weight
    return F.round(F.coalesce(w * cohesion + (1 - w) * term, term), 3)


def calibrated(raw: Column, correct: Column, total: Column, cfg: Config = DEFAULT) -> Column:
    """Laplace-smoothed accuracy of the score's bin, weighted by its evidence; the score itself below the minimum."""
    k = cfg.calib_min_evidence
    w = total / (total + k)
    return F.round(F.when(F.coalesce(total, F.lit(0)) < k, raw).otherwise(w * (correct + 1) / (total + 2) + (1 - w) * raw), 3)


def heuristic_uncertainty(context: Column, type1: Column, type2: Column, confidence: Column) -> Column:
    from relata.functions.text import word_count

    same = F.coalesce(type1, F.lit("")) == F.coalesce(type2, F.lit(""))
    s = F.when(word_count(context) < 2, 0.3).otherwise(0.0) + F.when(same, 0.3).otherwise(0.0) + (1 - F.coalesce(confidence, F.lit(0.5))) * 0.4
    return F.least(s, F.lit(1.0))


def margin_uncertainty(proba: Column) -> Column:
    """1 - (best - second best); of a single class 1 - p."""
    s = F.sort_array(proba, False)
    return F.when(F.size(s) == 1, 1 - s[0]).otherwise(1 - (F.get(s, F.lit(0)) - F.get(s, F.lit(1))))


def shrunk(probability: Column, n_train: int, cfg: Config = DEFAULT) -> Column:
    return F.round(probability * n_train / (n_train + cfg.al_shrinkage), 3) if n_train else F.lit(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
