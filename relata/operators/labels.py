"""The label store as a table: latest label per key, human precedence, weak seeds, calibration samples, consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, NO_RELATION, Config
from relata.functions import text as T
from relata.functions.scores import bucket, calibrated, heuristic_uncertainty, raw_confidence
from relata.sources.scratch import stored

ORACLE = "oracle"


def label_records(examples: DataFrame) -> DataFrame:
    """Records in the store's shape from examples with label and source."""
    have = set(examples.columns)
    text = lambda c, d="": F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    cols = [text(c).alias(c) for c in ("entity1", "entity2", "type1", "type2", "context")]
    conf = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in have else F.lit(0.0)
    extra = ["seq"] if "seq" in have else []
    return examples.select(T.label_key(text("entity1"), text("entity2"), text("context")).alias("key"), "label", "source", *cols, text("frame_agreement", "none").alias("frame_agreement"), conf.alias("confidence"), *extra)


def latest(log: DataFrame, seq: str = "seq") -> DataFrame:
    """The last record of each key. An aggregate with partial maxima, so a key with many records is no hot task."""
    rest = [c for c in log.columns if c != "key"]
    top = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return top.select("key", *[F.col(f"_r.{c}").alias(c) for c in rest])


def source_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("n"))


def has_human(records: DataFrame) -> bool:
    return not records.where(F.col("source") == ORACLE).isEmpty()


def query_pool(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs whose key no human has labelled."""
    keyed = pairs.withColumn("key", T.label_key(F.col("entity1"), F.col("entity2"), F.col("context")))
    return keyed.join(records.where(F.col("source") == ORACLE).select("key").distinct(), "key", "left_anti")


def top_queries(pool: DataFrame, k: int = 5, score: Column | None = None) -> DataFrame:
    """The ``k`` most uncertain pairs (ties by key, then seq where there is one); a heuristic score without a model."""
    s = heuristic_uncertainty(F.col("context"), F.col("type1"), F.col("type2"), F.col("confidence")) if score is None else score
    ties = [c for c in ("key", "seq") if c in pool.columns]
    return pool.withColumn("uncertainty", F.round(s, 9)).orderBy(F.desc("uncertainty"), *ties).limit(k)


def either_way(rows: DataFrame, a: str, b: str, keep: list[str], seq: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, _k1, _k2, _hit): for a look-up in both directions: the last row (a, b), else the first row (b, a), inside each document (by)."""
    hit = F.struct(*keep)
    side = lambda x, y, p, o: rows.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(x).alias("_k1"), F.col(y).alias("_k2"), F.lit(p).alias("_p"), o.alias("_o"), hit.alias("_v"))
    both = side(a, b, 1, F.col(seq)).unionByName(side(b, a, 0, -F.col(seq)))
    return both.groupBy(*[f"_{c}" for c in by], "_k1", "_k2").agg(F.max_by("_v", F.struct("_p", "_o")).alias("_hit"))


def _document(*tables: DataFrame) -> tuple[str, ...]:
    """The column that keeps documents apart, where all tables have it."""
    return ("doc_id",) if all("doc_id" in t.columns for t in tables) else ()


def _with_hit(left: DataFrame, hit: DataFrame, by: tuple[str, ...]) -> DataFrame:
    on = (F.col("entity1") == F.col("_k1")) & (F.col("entity2") == F.col("_k2"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(hit, on, "left")


def tag_pairs(pairs: DataFrame, props: DataFrame) -> DataFrame:
    """Pairs with frame_agreement and confidence of the proposition of the same document that joins them, in either direction.
    props: [doc_id,] arg1, arg2, label, confidence, seq."""
    by = _document(pairs, props)
    j = _with_hit(pairs, either_way(props, "arg1", "arg2", ["label", "confidence"], by=by), by)
    return j.withColumns({"frame_agreement": F.coalesce("_hit.label", F.lit("none")), "confidence": F.coalesce("_hit.confidence", "confidence")}).drop("_k1", "_k2", "_hit", *[f"_{c}" for c in by])


def induced_examples(props: DataFrame) -> DataFrame:
    """Weak positives from propositions that aren't negated (label, raw confidence, types; no context)."""
    return props.where(~F.col("negated")).select(*_document(props), F.col("arg1").alias("entity1"), F.col("arg2").alias("entity2"), F.col("label").alias("relation"), F.lit("").alias("context"), F.col("label").alias("frame_agreement"), "confidence", "type1", "type2", "seq")


def structural_pairs(pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """Pairs in the unordered negative set (lo, hi), per document where both have doc_id."""
    by = list(_document(pairs, negatives))
    p = pairs.withColumns({"lo": F.least("entity1", "entity2"), "hi": F.greatest("entity1", "entity2")})
    return p.join(negatives.select(*by, "lo", "hi").distinct(), [*by, "lo", "hi"], "left_semi").drop("lo", "hi")


def negative_cap(pool: DataFrame, cap: int, seq: str = "seq") -> DataFrame:
    """The first ``cap`` rows by sequence."""
    return pool.orderBy(seq).limit(cap)


def _changes(events: DataFrame, old: DataFrame) -> DataFrame:
    """Seeds (key, label, seq) that change the store in their order: no human label of the key, and a label other than the one before."""
    w = Window.partitionBy("key").orderBy("seq")
    j = events.join(old, "key", "left").withColumn("_before", F.coalesce(F.lag("label").over(w), "_old"))
    return j.where((F.coalesce("_by", F.lit("")) != ORACLE) & (F.col("_before").isNull() | (F.col("_before") != F.col("label")))).drop("_before", "_old", "_by")


def seed(records: DataFrame, pairs: DataFrame, examples: DataFrame, negatives: DataFrame, max_negatives: int | None = None) -> DataFrame:
    """The store (key, label, source, ...) after weak seeding, document after document (by doc_id, where the tables have it).

    In each document positives take types and context of the pair they join; then come as many structural negatives as
    positives were written (one at least, or ``max_negatives``). Human labels stay; a weak one is replaced where the label differs.
    Per key the last seed that differs from the label before it counts. The order is (doc_id, positives first, seq), so the result
    is the same however rows are dealt. Positives written are counted before any negatives.
    """
    by = _document(pairs, examples, negatives)
    doc = F.col("doc_id").cast("string") if by else F.lit("")
    order = lambda phase, d: F.struct(d.alias("d"), F.lit(phase).alias("phase"), F.col("seq").cast("long").alias("s"))
    e = _with_hit(examples, either_way(pairs, "entity1", "entity2", ["type1", "type2", "context"], by=by), by)
    e = e.withColumns({"type1": F.coalesce("_hit.type1", "type1"), "type2": F.coalesce("_hit.type2", "type2"), "context": F.coalesce(F.nullif(F.col("_hit.context"), F.lit("")), "context")}).drop("_k1", "_k2", "_hit", *[f"_{c}" for c in by])
    pos = stored(label_records(e.withColumns({"label": F.col("relation"), "source": F.lit("induced_seed_pos"), "seq": order(0, doc)})), "seeds")
    old = records.select("key", F.col("label").alias("_old"), F.col("source").alias("_by"))
    pool = structural_pairs(pairs, negatives)
    if by:
        caps = _changes(pos, old).groupBy(F.col("seq.d").alias("_d")).agg(F.count("*").alias("_cap"))
        ranked = pool.withColumns({"_d": doc, "_rank": F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))}).join(caps, "_d", "left")
        most = F.lit(max_negatives) if max_negatives is not None else F.greatest(F.coalesce("_cap", F.lit(0)), F.lit(1))
        chosen = ranked.where(F.col("_rank") <= most).drop("_d", "_rank", "_cap")
    else:
        chosen = negative_cap(pool, max_negatives if max_negatives is not None else max(_changes(pos, old).count(), 1))
    neg = label_records(chosen.withColumns({"label": F.lit(NO_RELATION), "source": F.lit("induced_seed_neg"), "seq": order(1, doc)}))
    cols = [c for c in records.columns if c != "seq"]
    now = F.lit(None).cast(pos.schema["seq"].dataType)
    before = records.select(*cols).withColumns({"seq": now, "_new": F.lit(False)})
    after = _changes(pos.unionByName(neg), old).select(*cols, "seq").withColumn("_new", F.lit(True))
    return latest(before.unionByName(after).withColumn("seq", F.struct("_new", "seq"))).select(*cols)


def calibration_bins(samples: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(bucket, correct, total) of (confidence, correct)."""
    return samples.groupBy(bucket(F.col("confidence"), cfg.calib_bins).alias("bucket")).agg(F.sum(F.col("correct").cast("int")).alias("correct"), F.count("*").alias("total"))


def calibration_samples(records: DataFrame) -> DataFrame:
    """(confidence, correct) of human labels on pairs that an induced relation joined."""
    return records.where((F.col("source") == ORACLE) & (F.col("frame_agreement") != "none")).select("confidence", (F.col("label") == F.col("frame_agreement")).alias("correct"))


def calibrate(df: DataFrame, bins: DataFrame, raw: str = "raw", out: str = "confidence", cfg: Config = DEFAULT) -> DataFrame:
    b = bins.select(F.col("bucket").alias("_b"), F.col("correct").alias("_c"), F.col("total").alias("_t"))
    j = df.withColumn("_b", bucket(F.col(raw), cfg.calib_bins)).join(F.broadcast(b), "_b", "left")  # calib_bins rows
    return j.withColumn(out, calibrated(F.col(raw), F.col("_c"), F.col("_t"), cfg)).drop("_b", "_c", "_t")


def with_raw_confidence(props: DataFrame, support: DataFrame, labels: DataFrame, median: float, cfg: Config = DEFAULT, out: str = "raw") -> DataFrame:
    """labels: (path, label, cohesion)."""
    j = props.join(support, "path", "left").join(labels.select("path", F.col("cohesion").alias("_coh")), "path", "left")
    return j.withColumn(out, raw_confidence(F.coalesce("support", F.lit(1)), F.lit(float(median)), F.col("_coh"), cfg)).drop("support", "_coh")


def consolidate(*edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relations of several sources, in order, each (subject, relation, object) once: the first keeps its attributes.

    Each input carries seq; the inputs' order is the first sort key.
    """
    out = None
    for i, e in enumerate(edges):
        e = e.withColumn("_o", F.lit(i))
        out = e if out is None else out.unionByName(e)
    keys = [*by, "subject", "relation", "object"]
    rest = [c for c in out.columns if c not in (*keys, "_o")]
    first = out.groupBy(*keys).agg(F.min_by(F.struct(*rest, "_o"), F.struct("_o", "seq")).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest], F.col("_r._o").alias("origin"))


def followed(first: DataFrame, later: DataFrame, relation: str, by: tuple[str, ...] = ()) -> DataFrame:
    """:func:`consolidate` of relations that are consolidated (first) and later ones, each once among themselves and all of one
    ``relation``. Only the first ones of that relation can hide a later one, so the later ones, which may be many, need no grouping."""
    keys = [*by, "subject", "object"]
    hidden = stored(first.where(F.col("relation") == relation).select(*[F.col(c).alias(f"_{c}") for c in keys]), "hidden")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rest = later.withColumn("origin", F.lit(1)).join(hidden, same, "left_anti")
    return first.unionByName(rest.select(*first.columns))


def proposition_edges(props: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Relations from propositions (label, confidence, negated, seq): negated ones go, or are penalised and marked."""
    p = props.where(~F.col("negated")) if cfg.skip_negated else props
    conf = F.round(F.col("confidence") * F.when(F.col("negated"), cfg.negation_penalty).otherwise(1.0), 3)
    source = F.when(F.col("negated"), "open_ie_induced_negated").otherwise("open_ie_induced")
    extra = ["doc_id"] if "doc_id" in props.columns else []
    return p.select(*extra, "seq", F.col("arg1").alias("subject"), F.col("label").alias("relation"), F.col("arg2").alias("object"), conf.alias("confidence"), source.alias("source"), F.col("sentence").alias("evidence"))


def model_edges(pairs: DataFrame, n_train: int, cfg: Config = DEFAULT) -> DataFrame:
    """Relations from classified pairs (prediction, probability, seq), without NO_RELATION."""
    from relata.functions.scores import shrunk

    p = pairs.where(F.col("prediction").isNotNull() & (F.col("prediction") != NO_RELATION))
    extra = ["doc_id"] if "doc_id" in pairs.columns else []
    return p.select(*extra, "seq", F.col("entity1").alias("subject"), F.col("prediction").alias("relation"), F.col("entity2").alias("object"), shrunk(F.col("probability"), n_train, cfg).alias("confidence"), F.lit("active_learned").alias("source"), F.coalesce("context", F.lit("")).alias("evidence"))


def cooccurrence_tuples(pairs: DataFrame) -> DataFrame:
    """The baseline without learning: every pair, its context as the relation."""
    return pairs.select("doc_id", "seq", F.col("entity1").alias("arg1"), F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit("RELATED")).alias("rel"), F.col("entity2").alias("arg2"))


def triples(relations: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Distinct (h, r, t) for the graph: no empty part, no excluded source."""
    r = relations.where(~F.col("source").isin(*cfg.kg_excluded_sources))
    return r.where("subject <> '' and relation <> '' and object <> ''").select(F.col("subject").alias("h"), F.col("relation").alias("r"), F.col("object").alias("t")).distinct()
