"""Scores of extractions, partitions, hierarchies and confidences against gold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.functions import text as T
from relata.functions.scores import bucket, f1, prf, ratio


def _one(df: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        df = df.crossJoin(o)  # aggregates of one row each
    return df


def tuple_matches(pred: DataFrame, gold: DataFrame, arg_threshold: float = 0.5, rel_threshold: float = 0.0, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, pseq, gseq) of predicted and gold tuples (seq, arg1, rel, arg2) of the same document that match.

    With a positive argument threshold a match shares a token in the first argument (or has none in both): the join is on
    tokens, not on all pairs.
    """
    side = lambda df, s: df.select(*by, F.col("seq").alias(f"{s}seq"), T.token_set(F.col("arg1")).alias(f"_{s}1"), T.token_set(F.col("arg2")).alias(f"_{s}2"), T.token_set(F.replace(F.coalesce("rel", F.lit("")), F.lit("_"), F.lit(" "))).alias(f"_{s}r"))
    key = lambda s: F.explode(F.when(F.size(f"_{s}1") == 0, F.array(F.lit(""))).otherwise(F.col(f"_{s}1")))
    p, g = side(pred, "p"), side(gold, "g")
    if arg_threshold > 0:
        p, g = p.withColumn("_k", key("p")), g.withColumn("_k", key("g"))
    else:
        p, g = p.withColumn("_k", F.lit("")), g.withColumn("_k", F.lit(""))
    j = p.join(g, [*by, "_k"]).drop("_k")
    for a, b in (("_p1", "_g1"), ("_p2", "_g2")):  # sets of sizes too far apart can't reach the threshold
        j = j.where(F.least(F.size(a), F.size(b)) >= arg_threshold * F.greatest(F.size(a), F.size(b)) - 1e-9)
    ok = (T.set_jaccard(F.col("_p1"), F.col("_g1")) >= arg_threshold) & (T.set_jaccard(F.col("_p2"), F.col("_g2")) >= arg_threshold)
    if rel_threshold > 0:
        ok = ok & (T.set_jaccard(F.col("_pr"), F.col("_gr")) >= rel_threshold)
    return j.where(ok).select(*by, "pseq", "gseq").distinct()


def greedy_matches(matches: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, pseq, gseq): each prediction in order takes the first gold tuple left. Sequential inside a document only."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *doc, matches in batch[[*by, "m"]].itertuples(index=False, name=None):
                used: set[int] = set()
                for m in matches:
                    g = next((x for x in m["g"] if x not in used), None)
                    if g is not None:
                        used.add(g)
                        rows.append((*doc, m["pseq"], g))
            yield pd.DataFrame(rows, columns=[*by, "pseq", "gseq"])

    per = matches.groupBy(*by, "pseq").agg(F.sort_array(F.collect_list("gseq")).alias("g")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pseq", "g"))).alias("m"))
    kinds = dict(matches.dtypes)
    return per.mapInPandas(take, ", ".join(f"{c} {kinds[c]}" for c in (*by, "pseq", "gseq")))


def coverage(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the share of gold argument pairs that some prediction has."""
    pairs = lambda df: df.select(T.normalize_phrase(F.col("arg1")).alias("_a"), T.normalize_phrase(F.col("arg2")).alias("_b")).distinct()
    g = pairs(gold)
    hit = g.join(pairs(pred), ["_a", "_b"], "left_semi").agg(F.count("*").alias("_h"))
    return _one(g.agg(F.count("*").alias("_g")), hit).select(F.round(ratio(F.col("_h"), F.col("_g")), 4).alias("coverage"))


def evaluate_tuples(pred: DataFrame, gold: DataFrame, arg_threshold: float = 0.5, rel_threshold: float = 0.0, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row: precision, recall, f1, coverage, tp, fp, fn, n_pred, n_gold."""
    tp = greedy_matches(tuple_matches(pred, gold, arg_threshold, rel_threshold, by), by).agg(F.count("*").alias("tp"))
    n = _one(tp, pred.agg(F.count("*").alias("n_pred")), gold.agg(F.count("*").alias("n_gold")), coverage(pred, gold))
    n = n.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gold") - F.col("tp")})
    return n.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")), "coverage", "tp", "fp", "fn", "n_pred", "n_gold")


def contingency(items: DataFrame) -> DataFrame:
    """(pred, gold, n) of items (pred, gold) that have both."""
    return items.where("pred is not null and gold is not null").groupBy("pred", "gold").agg(F.count("*").alias("n"))


def _with_totals(cells: DataFrame) -> DataFrame:
    p, g = cells.groupBy("pred").agg(F.sum("n").alias("_p")), cells.groupBy("gold").agg(F.sum("n").alias("_g"))
    return cells.join(p, "pred").join(g, "gold")


def bcubed(items: DataFrame) -> DataFrame:
    """precision, recall, f1, n from the contingency table: an item's cell over its cluster, averaged. Work is in the number
    of cells, not of items or pairs."""
    c = _with_totals(contingency(items))
    a = c.agg(F.coalesce(F.sum(F.col("n") * F.col("n") / F.col("_p")), F.lit(0.0)).alias("_sp"), F.coalesce(F.sum(F.col("n") * F.col("n") / F.col("_g")), F.lit(0.0)).alias("_sg"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    p, r = ratio(F.col("_sp"), F.col("n")), ratio(F.col("_sg"), F.col("n"))
    return a.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1(p, r), 4).alias("f1"), "n")


def _pair_counts(items: DataFrame) -> DataFrame:
    cells = contingency(items)
    two = lambda c: F.coalesce(F.sum(F.col(c) * (F.col(c) - 1) / 2), F.lit(0.0))
    both = cells.agg(two("n").alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    p = cells.groupBy("pred").agg(F.sum("n").alias("k")).agg(two("k").alias("_p"))
    g = cells.groupBy("gold").agg(F.sum("n").alias("k")).agg(two("k").alias("_g"))
    return _one(both, p, g).withColumns({"fp": F.col("_p") - F.col("tp"), "fn": F.col("_g") - F.col("tp")})


def pairwise_prf(items: DataFrame) -> DataFrame:
    """precision, recall, f1 over all item pairs, in closed form from the contingency table."""
    return _pair_counts(items).select(*prf(F.col("tp"), F.col("fp"), F.col("fn")))


def partition_agreement(items: DataFrame) -> DataFrame:
    """precision, recall, pairwise_f1, bcubed_f1, approx_error, n_paths of two partitions (pred, gold)."""
    p = _pair_counts(items)
    pair = p.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")), F.col("n").alias("n_paths")).withColumnRenamed("f1", "pairwise_f1")
    b = bcubed(items).select(F.col("f1").alias("bcubed_f1"))
    return _one(pair, b).withColumn("approx_error", F.round(1 - F.col("bcubed_f1"), 4))


def hierarchy_prf(schema: DataFrame, gold: DataFrame) -> DataFrame:
    """Parent links (label, parent) against gold ones, over labels that both have."""
    j = schema.select("label", F.col("parent").alias("_p")).join(gold.select("label", F.col("parent").alias("_g")), "label")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    has_p, has_g = F.coalesce(F.col("_p") != "", F.lit(False)), F.coalesce(F.col("_g") != "", F.lit(False))
    a = j.agg(n(has_p & has_g & (F.col("_p") == F.col("_g")), "tp"), n(has_p, "n_pred_edges"), n(has_g, "n_gold_edges"))
    return a.select(*prf(F.col("tp"), F.col("n_pred_edges") - F.col("tp"), F.col("n_gold_edges") - F.col("tp")), "n_pred_edges", "n_gold_edges")


def calibration_curve(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(bucket, avg_conf, accuracy, count) of (confidence, correct)."""
    ok = F.col("correct").cast("int")
    return samples.groupBy(bucket(F.col("confidence"), bins).alias("bucket")).agg(F.round(F.avg("confidence"), 3).alias("avg_conf"), F.round(F.avg(ok), 3).alias("accuracy"), F.count("*").alias("count"))


def calibration_report(samples: DataFrame, bins: int = 10) -> DataFrame:
    """One row (ece, brier, n); nulls and 0 without samples."""
    ok = F.col("correct").cast("int")
    per = samples.groupBy(bucket(F.col("confidence"), bins).alias("b")).agg(F.avg("confidence").alias("c"), F.avg(ok).alias("a"), F.count("*").alias("k"), F.sum((F.col("confidence") - ok) * (F.col("confidence") - ok)).alias("s"))
    t = per.agg(F.sum(F.col("k") * F.abs(F.col("c") - F.col("a"))).alias("e"), F.sum("s").alias("s"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    return t.select(F.round(F.try_divide(F.col("e"), F.col("n")), 4).alias("ece"), F.round(F.try_divide(F.col("s"), F.col("n")), 4).alias("brier"), "n")


def confusion_cells(items: DataFrame, top: int = 12) -> DataFrame:
    """(gold, pred, n) for the ``top`` labels of each side by frequency (ties by name); absent cells count 0."""
    cells = contingency(items)
    rank = lambda c: cells.groupBy(c).agg(F.sum("n").alias("_n")).orderBy(F.desc("_n"), c).limit(top).select(c)
    return rank("gold").crossJoin(rank("pred")).join(cells, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))  # top x top rows


def pronoun_free(relations: DataFrame) -> DataFrame:
    """One row: the share of (subject, object) rows without a pronoun on either side."""
    clean = (~F.col("subject").isin(*T.PRONOUNS) & ~F.col("object").isin(*T.PRONOUNS)).cast("int")
    return relations.agg(F.round(F.coalesce(F.avg(clean), F.lit(0.0)), 3).alias("proxy_precision"))


def labelled_precision(relations: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of judged triples that are right; null without any. labels: (subject, relation, object, correct)."""
    return relations.join(labels, ["subject", "relation", "object"]).agg(F.round(F.avg(F.col("correct").cast("int")), 3).alias("labelled_precision"))


def pair_partition(props: DataFrame) -> DataFrame:
    """(arg1, arg2, label): the label of the last proposition of each pair (by seq)."""
    return props.groupBy("arg1", "arg2").agg(F.max_by("label", "seq").alias("label"))


def top_similarity(embeddings: DataFrame, sample: int = 10) -> DataFrame:
    """One row: mean best cosine of the first ``sample`` entities."""
    from relata.operators.kg import similar_entities

    first = [r["entity"] for r in embeddings.select("entity").orderBy("entity").limit(sample).collect()]
    best = similar_entities(embeddings, first, 1)
    return best.agg(F.round(F.avg("similarity"), 3).alias("avg_top1_similarity"), F.count("*").alias("sampled_entities"))


def w_first(df: DataFrame, keys: list[str], seq: str = "seq", last: bool = False) -> DataFrame:
    """The first (or last) row of each key by sequence."""
    order = F.desc(seq) if last else F.asc(seq)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rn = 1").drop("_rn")
