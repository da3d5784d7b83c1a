"""Registered queries: every operator on whole tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT
from relata.functions import scores as S
from relata.functions import text as T
from relata.operators import active, cluster, dirt, induce, kg, labels, metrics, pathstats, schema, similarity
from relata.operators import text as X
from relata.sources import tables as V
from relata.sources.annotate import shape_sentences
from relata.sources.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """Slot counts, written once for the steps that read them."""
    return stored(pathstats.slot_counts(V.trade_propositions(spark, d)), "counts")


def _dist(counts: DataFrame, block: DataFrame | None = None) -> DataFrame:
    """Pair distances: of all pairs, or of those inside blocks, where nothing else is asked for."""
    return stored(dirt.path_distance(dirt.slot_similarity(dirt.slot_pmi(counts), block)), "distances")


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return _dist(_counts(spark, d))


def _blocks(counts: DataFrame, cfg=DEFAULT) -> DataFrame:
    return pathstats.blocks(pathstats.support_of(counts), pathstats.type_signatures(counts), cfg)


def _by_first_word(counts: DataFrame) -> DataFrame:
    """Clusters by a stated key: the path's first word."""
    return counts.select("path", F.substring_index("path", " ", 1).alias("cluster")).distinct()


# ---- path statistics -------------------------------------------------------------------------------------------------------


@query
def slot_counts(spark: SparkSession, d: str) -> DataFrame:
    return pathstats.slot_counts(V.trade_propositions(spark, d))


@query
def path_support(spark: SparkSession, d: str) -> DataFrame:
    return pathstats.path_support(V.trade_propositions(spark, d))


@query
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    ledger = V.table(spark, d, "documents").select(pathstats.doc_digest(F.coalesce("text", F.lit(""))).alias("digest"))
    return pathstats.store_stats(_counts(spark, d), ledger)


@query
def merged_counts(spark: SparkSession, d: str) -> DataFrame:
    p = V.trade_propositions(spark, d)
    return pathstats.merge_counts(*[pathstats.slot_counts(p.where(F.pmod("l_linenumber", F.lit(2)) == i)) for i in (0, 1)])


@query
def dominant_type(spark: SparkSession, d: str) -> DataFrame:
    return pathstats.dominant(_counts(spark, d).where("slot in ('tx', 'ty')"), ["path", "slot"])


@query
def type_signature_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(_counts(spark, d)).select("path", "support", "sx", "sy", "block_size")


@query
def block_head_tail(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(_counts(spark, d), replace(DEFAULT, max_block_size=5)).select("path", "sx", "sy", F.col("place").cast("long").alias("place"), "is_head")


@query
def corpus_median_support(spark: SparkSession, d: str) -> DataFrame:
    return pathstats.median_support(pathstats.path_support(V.sparse_propositions(spark, d)))


@query
def idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents")
    seen = docs.where(F.pmod("doc_id", F.lit(3)) == 0).select(pathstats.doc_digest(F.coalesce("text", F.lit(""))).alias("digest"))
    return pathstats.new_documents(docs, seen).select("doc_id", "digest")


@query
def doc_sha_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(pathstats.doc_digest(F.coalesce("text", F.lit(""))).alias("digest"), "doc_id")
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


# ---- distributional similarity -------------------------------------------------------------------------------------------------


@query
def slot_pmi(spark: SparkSession, d: str) -> DataFrame:
    return dirt.slot_pmi(_counts(spark, d)).select("slot", "path", "filler", *_r6("mi"))


@query
def pmi_mass(spark: SparkSession, d: str) -> DataFrame:
    return dirt.pmi_mass(dirt.slot_pmi(_counts(spark, d))).select("slot", "path", *_r6("mass"))


@query
def slot_similarity(spark: SparkSession, d: str) -> DataFrame:
    return dirt.slot_similarity(dirt.slot_pmi(_counts(spark, d))).select("slot", "p", "q", *_r6("sim"))


@query
def path_distance(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d).select("p", "q", *_r6("distance"))


@query
def top_similar_paths(spark: SparkSession, d: str) -> DataFrame:
    """The five closest paths of each path (a top-k report)."""
    e = _distances(spark, d)
    both = e.select("p", "q", "distance").unionByName(e.select(F.col("q").alias("p"), F.col("p").alias("q"), "distance")).withColumn("distance", F.round("distance", 6))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy("distance", "q")).cast("long")).where("rank <= 5")


@query
def block_gap_threshold(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    block = stored(_blocks(counts), "blocks")
    return dirt.block_thresholds(block, _dist(counts, block)).select("sx", "sy", "size", *_r6("threshold"))


@query
def ema_threshold(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    block = stored(_blocks(counts), "blocks")
    now = stored(dirt.block_thresholds(block, _dist(counts, block)), "thresholds")
    before = now.where("size >= 3").select("sx", "sy", F.lit(0.5).alias("threshold"))
    return dirt.ema_threshold(before, now).select("sx", "sy", *_r6("threshold"))


@query
def type_smoothing(spark: SparkSession, d: str) -> DataFrame:
    counts = pathstats.slot_counts(V.order_propositions(spark, d))
    return dirt.smoothed(counts, replace(DEFAULT, type_smoothing_max_alpha=0.5)).where("filler like '§T:%'").select("path", "slot", "filler", *_r6("n"))


@query
def nearest_medoid(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    block = stored(_blocks(counts), "blocks")
    dist = _dist(counts, block)
    # the two strongest paths of each block stand for its clusters
    med = block.where("place <= 2").select(F.upper("path").alias("label"), F.col("path").alias("medoid"), "sx", "sy")
    near = dirt.nearest_medoid(block.select("path", "sx", "sy", F.lit(0.6).alias("threshold")), med, dist.withColumn("distance", F.round("distance", 6)))
    return near.select("path", "label", *_r6("distance"), "accepted")


# ---- clusters (given) ------------------------------------------------------------------------------------------------------------


@query
def cluster_cohesion(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    return cluster.cohesion(_by_first_word(counts), _dist(counts)).select("cluster", "size", *_r6("cohesion"))


@query
def cluster_medoid(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    return cluster.medoids(_by_first_word(counts), _dist(counts))


@query
def merge_reference(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    c = _by_first_word(counts).withColumns({"sx": F.lit("*"), "sy": F.lit("*")}).withColumn("seq", F.col("cluster"))
    size = c.groupBy("sx", "sy").agg(F.count("*").alias("size"))
    return cluster.merge_reference(c, _dist(counts), size).select(*_r6("reference"))


@query
def carryover_jaccard(spark: SparkSession, d: str) -> DataFrame:
    c = _by_first_word(_counts(spark, d))
    old = c.select("path", F.upper(F.substring_index("path", " ", -1)).alias("label"))
    return cluster.carryover_scores(c, old).select("cluster", "label", *_r6("jaccard"))


@query
def readable_label(spark: SparkSession, d: str) -> DataFrame:
    paths = V.table(spark, d, "part").select(F.concat("p_name", F.lit("→"), F.coalesce("p_type", F.lit("")), F.lit("→#→"), "p_brand").alias("path")).distinct()
    return paths.select("path", T.readable_label(F.col("path")).alias("label"))


@query
def unique_label(spark: SparkSession, d: str) -> DataFrame:
    """Labels of part types by their first word, numbered in order of the path; one of the numbered names is taken already."""
    p = V.table(spark, d, "part").select(F.concat("p_type", F.lit(" "), "p_brand").alias("path")).distinct()
    wanted = p.select(F.col("path").alias("id"), T.readable_label(F.substring_index("path", " ", 1)).alias("base"), F.col("path").alias("ord"))
    return induce.unique_names(wanted, wanted.select(F.col("base").alias("label")).distinct().where("label < 'N'")).select(F.col("id").alias("path"), "label")


# ---- schema ------------------------------------------------------------------------------------------------------------------------


def _nested_labels(counts: DataFrame) -> DataFrame:
    """Each path as a label of its own and under its brand: a taxonomy of two levels."""
    p = counts.select("path").distinct()
    return p.select("path", F.col("path").alias("label")).unionByName(p.select("path", F.substring_index("path", ">", 1).alias("label")))


@query
def relation_schema(spark: SparkSession, d: str) -> DataFrame:
    counts = stored(pathstats.slot_counts(V.sparse_propositions(spark, d)), "counts")
    return schema.relation_schema(_nested_labels(counts), counts)


@query
def subsumption_parent(spark: SparkSession, d: str) -> DataFrame:
    counts = stored(pathstats.slot_counts(V.sparse_propositions(spark, d)), "counts")
    return schema.parents(_nested_labels(counts), counts).select("label", "parent", "containment")


@query
def hierarchy_depth(spark: SparkSession, d: str) -> DataFrame:
    counts = stored(pathstats.slot_counts(V.sparse_propositions(spark, d)), "counts")
    return schema.with_depth(schema.parents(_nested_labels(counts), counts)).select("label", F.col("depth").cast("long").alias("depth"))


# ---- confidence and labels -----------------------------------------------------------------------------------------------------------


@query
def raw_confidence(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    support = pathstats.support_of(counts)
    c = _by_first_word(counts)
    coh = c.join(cluster.cohesion(c, _dist(counts)), "cluster").select("path", F.col("cluster").alias("label"), F.round("cohesion", 6).alias("cohesion"))
    median = pathstats.median_support(support).first()["median"]
    return labels.with_raw_confidence(support.select("path"), support, coh, median).select("path", "raw")


@query
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return labels.calibration_bins(V.discount_samples(spark, d))


@query
def calibrated_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = V.discount_samples(spark, d)
    return labels.calibrate(s.select(F.round("confidence", 3).alias("raw")).distinct(), labels.calibration_bins(s))


@query
def calibration_samples(spark: SparkSession, d: str) -> DataFrame:
    log = labels.latest(V.event_labels(spark, d)).withColumns({"frame_agreement": F.when(F.pmod("seq", F.lit(3)) == 0, "none").otherwise("click"), "confidence": F.lit(0.5)})
    s = labels.calibration_samples(log)
    return s.groupBy("confidence", "correct").agg(F.count("*").alias("n"))


@query
def label_latest(spark: SparkSession, d: str) -> DataFrame:
    return labels.latest(V.event_labels(spark, d)).select("key", "label", "source", "seq")


@query
def label_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.source_counts(labels.latest(V.event_labels(spark, d)))


@query
def label_keys(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "conversations").select("conv_id", "turn", T.label_key(F.col("role"), F.col("conv_id").cast("string"), F.col("text")).alias("key"))
    return c


@query
def weak_seed_merge(spark: SparkSession, d: str) -> DataFrame:
    store = labels.label_records(labels.latest(V.event_labels(spark, d).where("seq % 2 = 0")).drop("key", "seq"))
    lo = V.event_labels(spark, d).where("seq % 2 = 1")
    examples = lo.select("entity1", "entity2", F.col("label").alias("relation"), F.lit("").alias("context"), F.lit("none").alias("frame_agreement"), F.lit(0.5).alias("confidence"), F.lit("").alias("type1"), F.lit("").alias("type2"), "seq")
    pairs = lo.groupBy("entity1", "entity2").agg(F.min("seq").alias("seq")).withColumns({"type1": F.lit("U"), "type2": F.lit("K"), "context": F.lit("")})
    none = spark.createDataFrame([], "lo string, hi string")
    return labels.seed(store, pairs, examples, none).select("key", "label", "source", "type1", "type2")


# ---- metrics ---------------------------------------------------------------------------------------------------------------------------


@query
def prf(spark: SparkSession, d: str) -> DataFrame:
    g = V.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.count(F.when(c, 1)).alias(n) for c, n in ((F.col("l_linestatus") == "O", "tp"), (F.col("l_quantity") > 25, "fp"), (F.col("l_discount") > 0.05, "fn"))])
    return g.select("l_returnflag", *S.prf(F.col("tp"), F.col("fp"), F.col("fn")))


def _trade_tuples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and gold tuples per customer: part names of this and of the next line of an order."""
    c = V.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(c, F.col("l_orderkey") == F.col("o_orderkey"))
    base = j.select(F.col("o_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq"), F.col("p_name").alias("arg1"), F.col("p_type").alias("rel"), F.col("p_brand").alias("arg2"))
    return base.where("seq % 2 = 1"), base.where("seq % 2 = 0")


@query
def openie_candidates(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tuple_matches(*_trade_tuples(spark, d), arg_threshold=0.3)


@query
def openie_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(*_trade_tuples(spark, d))


@query
def openie_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate_tuples(*_trade_tuples(spark, d), arg_threshold=0.3)


@query
def bcubed(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bcubed(V.brand_type_items(spark, d))


@query
def pairwise_prf(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pairwise_prf(V.brand_type_items(spark, d))


@query
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    return metrics.partition_agreement(V.brand_type_items(spark, d))


@query
def hierarchy_prf(spark: SparkSession, d: str) -> DataFrame:
    nation, region = V.table(spark, d, "nation"), V.table(spark, d, "region")
    gold = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("label"), F.col("r_name").alias("parent"))
    return metrics.hierarchy_prf(gold.withColumn("parent", F.when(F.pmod(F.length("label"), F.lit(3)) > 0, F.col("parent"))), gold)


@query
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_report(V.discount_samples(spark, d))


@query
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_curve(V.discount_samples(spark, d))


@query
def confusion_cells(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_cells(V.brand_type_items(spark, d))


@query
def precision_proxy(spark: SparkSession, d: str) -> DataFrame:
    p = X.entity_pairs(_sentences(spark, d)).select(F.substring_index("context", " ", 1).alias("subject"), F.col("entity2").alias("object"))
    return metrics.pronoun_free(p)


@query
def labelled_precision(spark: SparkSession, d: str) -> DataFrame:
    t = V.sparse_propositions(spark, d).select(F.col("arg1").alias("subject"), F.col("path").alias("relation"), F.col("arg2").alias("object"))
    judged = t.distinct().where("length(object) % 2 = 0").withColumn("correct", F.length("subject") % 2 == 0)
    return metrics.labelled_precision(t, judged)


@query
def pair_partition(spark: SparkSession, d: str) -> DataFrame:
    p = V.trade_propositions(spark, d)
    return metrics.pair_partition(p.select("arg1", "arg2", F.col("path").alias("label"), F.struct("l_orderkey", "l_linenumber", "path").alias("seq")))


# ---- text ----------------------------------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return V.spread(V.table(spark, d, "documents").select("doc_id", "text"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return shape_sentences(_documents(spark, d))


@query
def normalize_surface(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").select("doc_id", F.sha1(T.normalize_surface(F.col("text")).cast("binary")).alias("digest"))


def _glossed_texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents, and a sentence with two glosses for each nation."""
    n = V.table(spark, d, "nation").withColumn("n_name", F.translate("n_name", "_0123456789", "XABCDEFGHIJ"))
    name = F.initcap(F.lower("n_name"))
    board = F.concat(F.lit("reports say "), name, F.lit(" Trade Board ("), F.left("n_name", F.lit(2)), F.lit("TB) met; "), F.left("n_name", F.lit(3)), F.lit(" ("), name, F.lit(" Office) did not."))
    made = n.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("doc_id"), board.alias("text"))
    return V.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(made)


@query
def acronym_gloss(spark: SparkSession, d: str) -> DataFrame:
    return X.glosses(_glossed_texts(spark, d))


def _name_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Two mentions per customer: segment and nation as a name, and its initials."""
    c = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    full = F.concat_ws(" ", F.initcap(F.lower("n_name")), F.initcap(F.lower("c_mktsegment")))
    return c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("sent_id"), F.posexplode(F.array(full, F.concat(F.left("n_name", F.lit(1)), F.lit("."), F.left("c_mktsegment", F.lit(1)), F.lit(".")))).alias("ent_idx", "text"), F.lit("ORG").alias("label"))


@query
def acronym_initials(spark: SparkSession, d: str) -> DataFrame:
    return X.initial_glosses(_name_mentions(spark, d))


@query
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    m = _name_mentions(spark, d)
    alias = spark.createDataFrame([("F.B.", "Francophone Builders")], "alias string, canonical string")
    return X.canonical(m, "text", X.initial_glosses(m), alias).groupBy("canonical").agg(F.count("*").alias("n"))


@query
def pronoun_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    words = F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "), " ")
    return X.pronoun_counts(docs, docs.withColumn("text", F.replace("text", F.lit(" it "), F.lit(" engine "))), words)


@query
def rule_coref_antecedent(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    people = X.mentions(s).withColumn("label", F.when(F.col("label") == "LONG", "PERSON").otherwise("ORG"))
    return X.antecedents(X.tokens(s), people).select("doc_id", "sent_id", "i", "text", "antecedent")


@query
def sentence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.entity_pairs(_sentences(spark, d)).select("doc_id", "sent_id", "entity1", "type1", "entity2", "type2", "start1", "start2")


@query
def pair_context(spark: SparkSession, d: str) -> DataFrame:
    return X.entity_pairs(_sentences(spark, d)).select("doc_id", "sent_id", "start1", "start2", "context")


@query
def dep_path(spark: SparkSession, d: str) -> DataFrame:
    f = X.proposition_candidates(_sentences(spark, d))
    return f.select("doc_id", "sent_id", F.col("a.start").alias("start1"), F.col("b.start").alias("start2"), F.array_join("lemmas", "→").alias("path"))


@query
def open_propositions(spark: SparkSession, d: str) -> DataFrame:
    return X.propositions(X.proposition_candidates(_sentences(spark, d))).select("doc_id", "sent_id", "arg1", "type1", "arg2", "type2", "path", "negated")


@query
def structural_negatives(spark: SparkSession, d: str) -> DataFrame:
    return X.structural_negatives(X.proposition_candidates(_sentences(spark, d)))


@query
def concepts(spark: SparkSession, d: str) -> DataFrame:
    """Entities, and pairs of adjacent long words as noun chunks."""
    s = _sentences(spark, d)
    m = X.mentions(s).withColumn("canonical", T.normalize_surface(F.col("text")))
    after = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    twos = F.zip_with(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), after, lambda a, b: F.struct(a["i"].alias("start"), a["text"].alias("a"), b["text"].alias("b")))
    long = F.filter(twos, lambda x: (F.char_length(x["a"]) >= 7) & (F.char_length(x["b"]) >= 7))
    c = s.select("doc_id", "sent_id", F.inline(long)).select("doc_id", "sent_id", "start", F.concat_ws(" ", "a", "b").alias("text")).withColumn("lemma", F.col("text"))
    return X.concepts(m, c).select("doc_id", "concept", "type", "surface", "confidence", F.array_join("sources", ",").alias("sources"))


@query
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each turn beside the next one of its conversation."""
    after = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = V.table(spark, d, "conversations").withColumns({"_next": F.lead("text").over(after), "_more": F.lead("turn").over(after)})
    return c.where("_more is not null").select("conv_id", "turn", F.round(T.token_jaccard(F.col("text"), F.col("_next")), 6).alias("jaccard"))


@query
def context_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = X.context_profiles(_sentences(spark, d))
    return p.select("doc_id", "entity", F.array_join("words", " ").alias("words"))


# ---- active learning -------------------------------------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("sent_id", "pair_idx")
    return X.entity_pairs(_sentences(spark, d)).withColumn("seq", F.row_number().over(order).cast("long"))


@query
def heuristic_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    u = S.heuristic_uncertainty(F.col("context"), F.col("type1"), F.col("type2"), F.col("confidence"))
    return _pairs(spark, d).select("doc_id", "seq", F.round(u, 6).alias("uncertainty"))


@query
def margin_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Of vectors' squared components, as shares of their sum."""
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return V.table(spark, d, "embeddings").select("vec_id", F.round(S.margin_uncertainty(F.transform(squares, lambda x: x / total)), 6).alias("uncertainty"))


@query
def query_pool_antijoin(spark: SparkSession, d: str) -> DataFrame:
    pairs = V.event_labels(spark, d).select("entity1", "entity2", F.lit("").alias("context"), "seq")
    store = labels.label_records(labels.latest(V.event_labels(spark, d).where("seq % 2 = 0")).drop("key"))
    return labels.query_pool(pairs, store).select("key", "seq")


@query
def topk_queries(spark: SparkSession, d: str) -> DataFrame:
    pool = _pairs(spark, d).withColumn("key", F.concat_ws("|", "doc_id", F.col("seq").cast("string")))
    return labels.top_queries(pool, 25).select("key", "uncertainty")


@query
def negative_cap(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    neg = X.structural_negatives(X.proposition_candidates(_sentences(spark, d)))
    pool = labels.structural_pairs(pairs, neg).withColumn("_order", F.struct(F.col("doc_id").cast("long"), "seq"))
    return labels.negative_cap(pool, 100, "_order").select("doc_id", "seq", "entity1", "entity2")


@query
def pair_tags(spark: SparkSession, d: str) -> DataFrame:
    p = V.trade_propositions(spark, d)
    props = p.groupBy("arg1", "arg2", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).agg(F.min("path").alias("label")).withColumn("confidence", F.lit(0.5))
    n = V.table(spark, d, "nation").select("n_name")
    pairs = n.select(F.col("n_name").alias("entity1")).crossJoin(n.select(F.col("n_name").alias("entity2"))).withColumn("confidence", F.lit(0.7))  # 25 x 25 names
    return labels.tag_pairs(pairs, props)


# ---- consolidation and graph ---------------------------------------------------------------------------------------------------------------------


@query
def consolidate_first_wins(spark: SparkSession, d: str) -> DataFrame:
    p = V.trade_propositions(spark, d).select("arg1", F.col("path").alias("label"), "arg2", F.lit(0.5).alias("confidence"), F.lit(False).alias("negated"), F.col("path").alias("sentence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return labels.consolidate(labels.proposition_edges(p)).select("subject", "relation", "object", "confidence", "evidence", "seq")


@query
def negation_edges(spark: SparkSession, d: str) -> DataFrame:
    p = V.sparse_propositions(spark, d).select("arg1", F.col("path").alias("label"), "arg2", F.lit(0.875).alias("confidence"), (F.length("arg2") % 2 == 0).alias("negated"), F.col("type2").alias("sentence"), F.lit(0).alias("seq"))
    e = labels.proposition_edges(p, replace(DEFAULT, skip_negated=False))
    return e.groupBy("source", "confidence").agg(F.count("*").alias("n"))


@query
def baseline_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return labels.cooccurrence_tuples(_pairs(spark, d))


@query
def triples_for_kg(spark: SparkSession, d: str) -> DataFrame:
    r = V.sparse_propositions(spark, d).select(F.col("arg1").alias("subject"), F.when(F.length("arg2") % 3 > 0, F.col("path")).otherwise("").alias("relation"), F.col("arg2").alias("object"), F.when(F.col("type1") == "BUILDING", "distributional_similarity").otherwise("open_ie_induced").alias("source"))
    return labels.triples(r)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Contexts of whole nations: the words of the parts they buy."""
    p = V.trade_propositions(spark, d).groupBy("arg2", "path").agg(F.count("*").alias("n"))
    return p.groupBy(F.lit("all").alias("doc_id"), F.col("arg2").alias("entity")).agg(F.flatten(F.sort_array(F.collect_list(F.flatten(F.array_repeat(F.split("path", " "), F.col("n").cast("int")))))).alias("words"), F.min(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))).alias("first"))


@query
def tfidf_context(spark: SparkSession, d: str) -> DataFrame:
    return similarity.tfidf(_profiles(spark, d)).select("entity", "term", *_r6("weight"))


@query
def similar_to_edges(spark: SparkSession, d: str) -> DataFrame:
    v = similarity.tfidf(_profiles(spark, d))
    return similarity.close_entities(v, replace(DEFAULT, similarity_eps=0.02)).select("a", "b", *_r6("cosine"))


@query
def cosine_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of the vectors whose id is divisible by 50 among all vectors."""
    v = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    return kg.nearest_neighbours(v, v.where("vec_id % 50 = 0"), 5).select("vec_id", "other", F.round("similarity", 5).alias("similarity"))


# ---- without an oracle -----------------------------------------------------------------------------------------------------------------------------


@query
def complete_linkage_clusters(spark: SparkSession, d: str) -> DataFrame:
    counts = _counts(spark, d)
    block = stored(_blocks(counts), "blocks")
    dist = stored(induce.distances(counts, block), "distances")
    return cluster.cluster_blocks(block, dist, dirt.block_thresholds(block, dist))


@query
def induced_labels(spark: SparkSession, d: str) -> DataFrame:
    return induce.label_table(spark, induce.full_pass(_counts(spark, d))).select("path", "label", *_r6("cohesion"))


@query
def similarity_components(spark: SparkSession, d: str) -> DataFrame:
    p = similarity.similarity_patterns(stored(X.context_profiles(_sentences(spark, d)), "profiles"))
    return p.select("doc_id", F.col("cluster_id").cast("long").alias("cluster_id"), F.array_join("entities", ",").alias("entities"), F.array_join("signature", ",").alias("signature"), F.col("size").cast("long").alias("size"))


@query
def validity_model(spark: SparkSession, d: str) -> DataFrame:
    """A classifier trained on the pairs of even documents (type pairs as labels), applied to all pairs."""
    pairs = _pairs(spark, d)
    train = labels.label_records(pairs.where("cast(doc_id as long) % 2 = 0").withColumns({"label": F.concat_ws("_", "type1", "type2"), "source": F.lit("oracle")}))
    return active.train(train).predict(pairs).select("doc_id", "seq", "prediction", "probability")


@query
def link_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The best twenty links of the graph that nations, segments and regions make."""
    p = V.trade_propositions(spark, d)
    t = p.select(F.col("arg1").alias("h"), F.lit("IN").alias("r"), F.col("type1").alias("t")).unionByName(p.select(F.col("arg2").alias("h"), F.lit("SELLS_TO").alias("r"), F.col("type2").alias("t"))).distinct()
    ent, rel = kg.train(t)
    return kg.predict_links(ent, rel, t, 20)


@query
def complete_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Relations of the whole pipeline over the whole texts of all documents (link_prediction has the graph)."""
    from relata.plans.learner import Learner

    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return Learner.for_evaluation(spark).run(docs, graph=False)["relations"].select("doc_id", "subject", "relation", "object", "confidence", "source")
