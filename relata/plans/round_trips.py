"""Registered queries of stores, logs, gold readers, sinks and given annotations, each with its SQL: what is written is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.config import Config
from relata.operators import induce, kg, labels, metrics, pathstats, similarity
from relata.operators import text as X
from relata.plans import oracles as O
from relata.plans.queries import _dist, _profiles, _trade_tuples
from relata.schemas import LABELS, SENTENCES
from relata.sources import export, gold, stores
from relata.sources import tables as V
from relata.sources.scratch import fresh_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


# ---- stores and logs --------------------------------------------------------------------------------------------------------


@query(O._sql(O._F1, O._COUNTS, "SELECT path, slot, filler, n FROM counts"))
def path_log(spark: SparkSession, d: str) -> DataFrame:
    """Slot counts written to a log in two parts, with document markers, and read from its lines."""
    path, p = fresh_dir(spark, "path-log"), V.trade_propositions(spark, d)
    digests = V.table(spark, d, "documents").select(pathstats.doc_digest(F.coalesce("text", F.lit(""))).alias("digest")).distinct()
    for i in (0, 1):
        stores.write_path_log(pathstats.slot_counts(p.where(F.pmod("l_linenumber", F.lit(2)) == i)), digests, path)
    return stores.read_path_log(spark, path)[0]


@query("SELECT DISTINCT sha1(coalesce(text, '')) AS digest FROM documents")
def path_log_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The document markers of such a log."""
    path = fresh_dir(spark, "path-log")
    digests = V.table(spark, d, "documents").select(pathstats.doc_digest(F.coalesce("text", F.lit(""))).alias("digest")).distinct()
    stores.write_path_log(pathstats.slot_counts(V.trade_propositions(spark, d)), digests, path)
    return stores.read_path_log(spark, path)[1]


@query(O._sql(O._F1, O._COUNTS, "SELECT path, slot, filler, n FROM counts"))
def path_store(spark: SparkSession, d: str) -> DataFrame:
    """A store after four batches, a compaction, and a batch that died before its ledger entry."""
    store, p = stores.PathStore(spark, fresh_dir(spark, "path-store"), compact_every=3), stored(V.trade_propositions(spark, d), "propositions")
    dead = pathstats.slot_counts(p.limit(50)).withColumn("batch", F.lit("unfinished"))
    store.counts.append(dead)
    for i in range(4):
        store.add(p.where(F.pmod("l_linenumber", F.lit(4)) == i), spark.createDataFrame([(f"part {i}",)], "digest string"))
    return store.slot_counts()


@query("SELECT DISTINCT sha1(coalesce(text, '')) AS digest FROM documents")
def store_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Digests of a store that got all documents twice: the second time none is new."""
    store = stores.PathStore(spark, fresh_dir(spark, "path-store"), compact_every=2)
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    none = V.trade_propositions(spark, d).limit(0)
    for _ in range(2):
        store.add(none, stored(pathstats.new_documents(docs, store.digests()).select("digest"), "digests"))
    return store.ledger.read().select("digest")


_LABELLED = O._LOG + ",\n" + O._LATEST


@query(O._sql(_LABELLED, "SELECT key, label, source FROM latest"))
def label_log(spark: SparkSession, d: str) -> DataFrame:
    """A label log of two appended files and a compaction: the last line of each key."""
    path, log = fresh_dir(spark, "label-log"), V.event_labels(spark, d)
    cols = [c.split()[0] for c in LABELS.split(", ")]
    full = log.select(*[F.col(c) if c in log.columns else F.lit(None).cast("double" if c == "confidence" else "string").alias(c) for c in cols], "seq")
    half = log.agg(F.expr("percentile(seq, 0.5)")).first()[0]
    for part in (F.col("seq") <= half, F.col("seq") > half):
        stores.append_label_log(full.where(part).orderBy("seq").coalesce(1).select(*cols), path)  # a log file is a sequence
    last = stored(labels.latest(full.where("seq % 2 = 0")).select(*cols), "records")
    before = stored(stores.read_label_log(spark, path), "read")
    stores.compact_label_log(before.join(last.limit(0).select("key"), "key", "left_anti"), path)
    return stores.read_label_log(spark, path).select("key", "label", "source")


# ---- gold readers -------------------------------------------------------------------------------------------------------------


@query("SELECT c_name || ' of ' || n_name AS sentence, c_name AS arg1, c_mktsegment AS rel, n_name AS arg2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def gold_tuples(spark: SparkSession, d: str) -> DataFrame:
    """Tuples as tab-separated lines, with short lines between them."""
    path = fresh_dir(spark, "gold") + ".tsv"
    c = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat_ws("\t", F.concat("c_name", F.lit(" of "), "n_name"), F.concat(F.lit(" "), "c_name"), "c_mktsegment", "n_name", F.lit("more"))
    c.select(F.explode(F.array(line, F.concat_ws("\t", "c_name", "n_name"))).alias("value")).write.text(path)
    return gold.read_tuples(spark, path).select("sentence", "arg1", "rel", "arg2")


def _documents_json(spark: SparkSession, d: str) -> str:
    """One file of documents: a region's nations as entities, each in the relation of its name's length to the next and none to a missing one."""
    path = fresh_dir(spark, "gold") + ".json"
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = n.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("n"))
    label = lambda i: F.struct(i.alias("h"), (i + 1).alias("t"), F.concat(F.lit("R"), F.length(F.get("n", i)).cast("string")).alias("r"))
    docs = per.select(F.col("r_name").alias("title"), F.transform("n", lambda x: F.array(F.struct(F.concat(F.lit(" "), x).alias("name")), F.struct(F.lit("other").alias("name")))).alias("vertexSet"), F.transform(F.sequence(F.lit(0), F.size("n") - 1), label).alias("labels"))
    docs.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*docs.columns)))).alias("value")).coalesce(1).write.text(path)  # five documents
    return path


_NEXT = "nx AS (SELECT r_name, n_name, lead(n_name) OVER (PARTITION BY r_name ORDER BY n_name) AS other FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(O._sql(_NEXT, "SELECT r_name AS title, lower(n_name) AS arg1, 'R' || length(n_name) AS rel, lower(other) AS arg2 FROM nx WHERE other IS NOT NULL"))
def gold_documents(spark: SparkSession, d: str) -> DataFrame:
    return gold.read_document_relations(spark, _documents_json(spark, d))[0].select("title", "arg1", "rel", "arg2")


@query(O._sql(_NEXT, "SELECT lower(n_name) AS arg1, lower(other) AS arg2, 'R' || length(n_name) AS gold FROM nx WHERE other IS NOT NULL"))
def gold_document_partition(spark: SparkSession, d: str) -> DataFrame:
    return gold.read_document_relations(spark, _documents_json(spark, d))[1]


@query("SELECT lower(s_name) AS arg1, lower(n_name) AS arg2, 'second' AS gold FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def gold_partition(spark: SparkSession, d: str) -> DataFrame:
    """A list of pairs as JSON: the last relation of a pair counts, incomplete ones are dropped."""
    path = fresh_dir(spark, "gold") + ".json"
    s = V.table(spark, d, "supplier").join(V.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("s_name").alias("arg1"), F.col("n_name").alias("arg2"), F.lit(r).alias("relation")) for i, r in enumerate(("first", "second", ""))])).alias("x"))
    rows.agg(F.to_json(F.transform(F.sort_array(F.collect_list("x")), lambda x: x.dropFields("i"))).alias("value")).coalesce(1).write.text(path)  # a gold file
    return gold.read_partition(spark, path)


# ---- sinks ----------------------------------------------------------------------------------------------------------------------


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


_ONCE = "o AS (SELECT arg1, path, arg2, row_number() OVER (PARTITION BY arg1, path, arg2 ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM f1)"


@query(O._sql(O._F1, _ONCE, "SELECT arg1 AS subject, path AS relation, arg2 AS object, 0.5::DOUBLE AS confidence, 'open_ie_induced' AS source, path || ', \"said\"' AS evidence FROM o WHERE k = 1"))
def relations_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "relations-csv")
    p = V.trade_propositions(spark, d).select("arg1", F.col("path").alias("label"), "arg2", F.lit(0.5).alias("confidence"), F.lit(False).alias("negated"), F.concat("path", F.lit(', "said"')).alias("sentence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    export.relations_csv(labels.consolidate(labels.proposition_edges(p)), path)
    return spark.read.option("header", True).option("escape", "\\").schema("subject string, relation string, object string, confidence double, source string, evidence string").csv(path)


@query(O._sql(O._F1, "SELECT DISTINCT arg1, type1, upper(path) AS relation, arg2, type2, path, false AS negated, path AS sentence FROM f1"))
def propositions_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "propositions-csv")
    p = V.trade_propositions(spark, d).select("arg1", "type1", F.upper("path").alias("label"), "arg2", "type2", "path", F.lit(False).alias("negated"), F.col("path").alias("sentence")).distinct()
    export.propositions_csv(p, path)
    return _csv(spark, path, "arg1 string, type1 string, relation string, arg2 string, type2 string, path string, negated boolean, sentence string")


@query("SELECT p_brand AS concept, p_type AS type, p_brand AS surface, 0.9::DOUBLE AS confidence, 'NER,' || p_type AS sources FROM part GROUP BY ALL")
def concepts_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "concepts-csv")
    c = V.table(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_type").alias("type")).distinct()
    export.concepts_csv(c.select("concept", "type", F.col("concept").alias("surface"), F.lit(0.9).alias("confidence"), F.array(F.lit("NER"), "type").alias("sources")), path)
    return _csv(spark, path, "concept string, type string, surface string, confidence double, sources string")


@query("SELECT vec_id::VARCHAR AS entity, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def embeddings_csv(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_dir(spark, "embeddings-csv")
    v = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    export.embeddings_csv(v, path, 64)
    return _csv(spark, path, ", ".join(["entity string", *[f"dim_{i} double" for i in range(64)]])).select("entity", F.round("dim_0", 6).alias("first"), F.round("dim_63", 6).alias("last"))


# ---- dependency trees: ten shapes of a sentence between each nation and its region -----------------------------------------------------

# fixed values: tokens as text/part of speech/label/head; A and B are the two names
_SHAPES = {
    "active": "A/PROPN/nsubj/1 supplies/VERB/ROOT/1 B/PROPN/dobj/1",
    "passive with agent": "A/PROPN/nsubjpass/2 was/AUX/auxpass/2 supplied/VERB/ROOT/2 by/ADP/agent/2 B/PROPN/pobj/3",
    "passive": "A/PROPN/nsubjpass/2 was/AUX/auxpass/2 supplied/VERB/ROOT/2 to/ADP/prep/2 B/PROPN/pobj/3",
    "object in front": "A/PROPN/dobj/2 B/PROPN/nsubj/2 supplies/VERB/ROOT/2",
    "object and no other": "A/PROPN/dobj/1 supplies/VERB/ROOT/1 B/PROPN/npadvmod/1",
    "two objects": "supplies/VERB/ROOT/0 A/PROPN/dobj/0 with/ADP/prep/0 B/PROPN/pobj/2",
    "negated": "A/PROPN/nsubj/3 did/AUX/aux/3 not/PART/neg/3 supplies/VERB/ROOT/3 B/PROPN/dobj/3",
    "no content": "A/PROPN/ROOT/0 ,/PUNCT/punct/0 B/PROPN/appos/0",
    "at the limit": "A/PROPN/nsubj/1 a/NOUN/nmod/2 b/NOUN/nmod/3 c/NOUN/nmod/4 d/NOUN/nmod/5 e/NOUN/ROOT/5 B/PROPN/dobj/5",
    "beyond the limit": "A/PROPN/nsubj/1 a/NOUN/nmod/2 b/NOUN/nmod/3 c/NOUN/nmod/4 d/NOUN/nmod/5 e/NOUN/nmod/6 f/NOUN/ROOT/6 B/PROPN/dobj/6",
}
_LEMMAS = {"supplies": "supply", "supplied": "supply", "was": "be", "did": "do"}


def _trees(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, shape in _SHAPES.items():
        parts = [t.split("/") for t in shape.split()]
        toks = [(i, 2 * i, t, _LEMMAS.get(t, t), pos, dep, int(head), False, pos == "PUNCT") for i, (t, pos, dep, head) in enumerate(parts)]
        said = [(i, i + 1, i, t, "GPE" if t == "A" else "REGION") for i, (t, *_) in enumerate(parts) if t in "AB"]
        rows.append((name, 0, shape, toks, said, []))
    shapes = spark.createDataFrame(rows, SENTENCES)  # the ten shapes
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    put = lambda c: F.transform(c, lambda x: x.withField("text", F.when(x["text"] == "A", F.col("n_name")).when(x["text"] == "B", F.col("r_name")).otherwise(x["text"])))
    s = n.crossJoin(F.broadcast(shapes)).withColumns({"tokens": put("tokens"), "mentions": put("mentions")})
    return s.select(F.concat_ws("|", "doc_id", "n_name").alias("doc_id"), "sent_id", "sentence", "tokens", "mentions", "chunks")


# worked out by hand from the direction rules: (shape, path, whether the second name is the subject, negated)
_EXPECTED = """shape(k, path, swapped, negated) AS (VALUES ('active', 'supply', false, false), ('passive with agent', 'supply→by', true, false), ('passive', 'supply→to', true, false),
  ('object in front', 'supply', true, false), ('object and no other', 'supply', true, false), ('two objects', 'supply→with', false, false), ('negated', 'supply', false, true), ('at the limit', 'a→b→c→d→e', false, false)),
n AS (SELECT n_name, lower(n_name) AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(O._sql(_EXPECTED, "SELECT k || '|' || n_name AS doc_id, CASE WHEN swapped THEN b ELSE a END AS arg1, CASE WHEN swapped THEN 'REGION' ELSE 'GPE' END AS type1, CASE WHEN swapped THEN a ELSE b END AS arg2, CASE WHEN swapped THEN 'GPE' ELSE 'REGION' END AS type2, path, negated FROM n, shape"))
def tree_propositions(spark: SparkSession, d: str) -> DataFrame:
    return X.propositions(X.proposition_candidates(_trees(spark, d))).select("doc_id", "arg1", "type1", "arg2", "type2", "path", "negated")


@query(O._sql(_EXPECTED, "SELECT 'no content|' || n_name AS doc_id, least(a, b) AS lo, greatest(a, b) AS hi FROM n"))
def tree_negatives(spark: SparkSession, d: str) -> DataFrame:
    return X.structural_negatives(X.proposition_candidates(_trees(spark, d)))


# ---- coreference clusters: a customer's name, its short form and a pronoun ----------------------------------------------------------------


@query("""SELECT c_custkey::VARCHAR AS doc_id, 'Ms ' || c_mktsegment || ' came. Then Ms ' || c_mktsegment || ' saw Ms ' || c_mktsegment || ' of ' || n_name || '.' AS resolved FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def cluster_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The shortest name with a capital letter stands for all mentions of a cluster; the longer of two spans that overlap gives way."""
    c = V.table(spark, d, "customer").join(V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("Ms "), "c_mktsegment")
    docs = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(name, F.lit(" came. Then she saw herself of "), "n_name", F.lit(".")).alias("text"), F.length(name).alias("k"), F.length("n_name").alias("m"))
    at = lambda start, length: F.struct(start.alias("start"), (start + length).alias("end"))
    she = F.col("k") + 12
    spans = F.array(at(F.lit(0), F.col("k")), at(she, F.lit(3)), at(she + 8, F.lit(7)), at(she, F.col("m") + 19))
    m = docs.select("doc_id", "text", F.posexplode(spans).alias("i", "s")).select("doc_id", F.lit(0).alias("cluster"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("text"))
    return X.resolve_clusters(docs.select("doc_id", "text"), m).select("doc_id", "resolved")


# ---- induction, similarity and graph operators ----------------------------------------------------------------------------------------------


_MEDIAN = "med AS (SELECT max(support) AS m FROM (SELECT support, row_number() OVER (ORDER BY support, path) AS k, count(*) OVER () AS n FROM support) WHERE k = n // 2 + 1)"


@query(O._sql(O._F1, O._SUPPORT, _MEDIAN, "SELECT path, support FROM support, med WHERE support >= m"))
def path_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Paths with a minimum support above one: the corpus median."""
    support = stored(pathstats.path_support(V.trade_propositions(spark, d)), "support")
    least = int(pathstats.median_support(support).first()["median"])
    return pathstats.candidates(support, Config(min_path_support=least)).select("path", "support")


@query(
    O._sql(
        O._F1, O._COUNTS, O._MI, O._DIST, O._SUPPORT, O._DOMINANT, O._BLOCKS,
        "both_ AS (SELECT p AS path, q AS medoid, round(distance, 6) AS distance FROM dist UNION ALL SELECT q, p, round(distance, 6) FROM dist)",
        """SELECT b.path, upper(m.path) AS label FROM blocks b JOIN blocks m ON m.sx = b.sx AND m.sy = b.sy AND m.place <= 2 JOIN both_ d ON d.path = b.path AND d.medoid = m.path WHERE b.place > 2 AND d.distance <= 0.6
        QUALIFY row_number() OVER (PARTITION BY b.path ORDER BY d.distance, upper(m.path)) = 1""",
    )
)
def join_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a block assigned to its two strongest paths as medoids, as an incremental pass does."""
    counts = stored(pathstats.slot_counts(V.trade_propositions(spark, d)), "counts")
    block = stored(pathstats.blocks(pathstats.support_of(counts), pathstats.type_signatures(counts)), "blocks")
    medoids = block.where("place <= 2").select(F.upper("path").alias("label"), F.col("path").alias("medoid"), "sx", "sy")
    paths = block.where("place > 2").select("path", "sx", "sy", F.lit(0.6).alias("threshold"), F.struct("place", "path").alias("ord"))
    leaders = paths.limit(0).select(F.lit("").alias("label"), F.col("path").alias("medoid"), "sx", "sy", "ord")
    return induce.join_nearest(paths, medoids, leaders, _dist(counts, block).withColumn("distance", F.round("distance", 6)))


_GIVEN = "given AS (SELECT DISTINCT path, CASE WHEN length(path) % 2 = 0 THEN 'EVEN' END AS label FROM f1)"


@query(O._sql(O._F1, _GIVEN, "SELECT arg1, coalesce(label, coalesce(nullif(substr(regexp_replace(upper(path), '[^A-Z0-9_]', '', 'g'), 1, 40), ''), 'RELATED_TO')) AS label, count(*) AS n FROM f1 JOIN given USING (path) GROUP BY ALL"))
def induced_annotation(spark: SparkSession, d: str) -> DataFrame:
    """Propositions with the label of their path, else its readable form."""
    p = V.trade_propositions(spark, d)
    given = p.select("path").distinct().where("length(path) % 2 = 0").select("path", F.lit("EVEN").alias("label"))
    return induce.annotate(p, given).groupBy("arg1", "label").agg(F.count("*").alias("n"))


@query(O._sql(O._F1, "c AS (SELECT DISTINCT path, split_part(path, ' ', 1) AS label FROM f1)", "SELECT path, label, CASE WHEN length(label) % 2 = 0 THEN 0.5 END::DOUBLE AS cohesion FROM c"))
def label_table(spark: SparkSession, d: str) -> DataFrame:
    """(path, label, cohesion) of a state."""
    paths = V.trade_propositions(spark, d).select("path", F.substring_index("path", " ", 1).alias("label")).distinct()
    return induce.label_table(spark, induce.State(labels=paths, cohesion=paths.select("label", F.lit(0.5).alias("cohesion")).distinct().where("length(label) % 2 = 0")))


@query(O._sql(O._SENT, O._CTX, "SELECT doc_id, seq, entity1 AS subject, type1 || '_' || type2 AS relation, entity2 AS object, round(0.7 * 40 / 50, 3)::DOUBLE AS confidence, 'active_learned' AS source, context AS evidence FROM ctx WHERE type1 <> 'LONG'"))
def model_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations from classified pairs: a pair of types as the prediction, none where the first is long."""
    from relata.plans.queries import _pairs

    said = F.when(F.col("type1") == "LONG", "NO_RELATION").otherwise(F.concat_ws("_", "type1", "type2"))
    return labels.model_edges(_pairs(spark, d).withColumns({"prediction": said, "probability": F.lit(0.7)}), 40).select("doc_id", "seq", "subject", "relation", "object", "confidence", "source", "evidence")


_CLOSE = "close AS (SELECT a.entity AS a, b.entity AS b FROM vec a JOIN vec b ON a.term = b.term AND a.entity < b.entity GROUP BY ALL HAVING 1 - sum(a.weight * b.weight) <= 0.02 + 1e-12)"
_REACH = """both_ AS (SELECT a, b FROM close UNION SELECT b, a FROM close),
reach AS (SELECT a AS entity, a AS other FROM both_ UNION SELECT r.entity, b.b FROM reach r JOIN both_ b ON b.a = r.other),
part AS (SELECT entity, min(other) AS root FROM reach GROUP BY entity)"""
_PARTS = "WITH RECURSIVE " + ",\n".join((O._F1, O._TFIDF, _CLOSE, _REACH))


@query(_PARTS + "\nSELECT entity, root FROM part")
def entity_components(spark: SparkSession, d: str) -> DataFrame:
    close = similarity.close_entities(similarity.tfidf(_profiles(spark, d)), Config(similarity_eps=0.02))
    return similarity.connected(close).select("entity", "root")


@query(_PARTS + "\nSELECT dense_rank() OVER (ORDER BY root) - 1 AS cluster_id, string_agg(entity, ',' ORDER BY entity) AS entities, count(*) AS size FROM part GROUP BY root")
def similarity_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = similarity.similarity_patterns(_profiles(spark, d), Config(similarity_eps=0.02))
    return p.select(F.col("cluster_id").cast("long").alias("cluster_id"), F.array_join("entities", ",").alias("entities"), F.col("size").cast("long").alias("size"))


@query(_PARTS + "\nSELECT a.entity AS subject, 'SIMILAR_TO' AS relation, b.entity AS object, 0.25::DOUBLE AS confidence, 'distributional_similarity' AS source FROM part a JOIN part b ON a.root = b.root AND a.entity < b.entity")
def similar_to(spark: SparkSession, d: str) -> DataFrame:
    p = similarity.similarity_patterns(_profiles(spark, d), Config(similarity_eps=0.02))
    return similarity.similar_to(p).select("subject", "relation", "object", "confidence", "source")


_COSINES = "s AS (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id{0})"
_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@query(O._sql(_V, _COSINES.format(" AND a.vec_id % 50 = 0"), "SELECT vec_id::VARCHAR AS entity, other::VARCHAR AS other, round(c, 5) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, other::VARCHAR) AS rank FROM s QUALIFY rank <= 5"))
def similar_entities(spark: SparkSession, d: str) -> DataFrame:
    """The five entities most similar to each of a stated list (ids divisible by 50), among all."""
    v = V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity"), "embedding", "vec_id")
    wanted = [r["entity"] for r in v.where("vec_id % 50 = 0").select("entity").collect()]
    return kg.similar_entities(v.drop("vec_id"), wanted, 5).select("entity", "other", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(O._sql(_V, "f AS (SELECT vec_id FROM v ORDER BY vec_id::VARCHAR LIMIT 10)", _COSINES.format(" AND a.vec_id IN (SELECT vec_id FROM f)"), "m AS (SELECT vec_id, max(c) AS c FROM s GROUP BY 1)", "SELECT round(avg(c), 3) AS avg_top1_similarity, count(*) AS sampled_entities FROM m"))
def entity_similarity_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean best cosine of the first ten entities (a sampling metric)."""
    return metrics.top_similarity(V.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("entity"), "embedding"))


# greedy matches in SQL: a document's predictions in order, each takes the first gold tuple that is left
_GREEDY = """hit AS (SELECT p.doc_id, p.seq AS pseq, g.seq AS gseq FROM tok p JOIN tok g ON p.doc_id = g.doc_id AND p.seq % 2 = 1 AND g.seq % 2 = 0
  WHERE len(list_intersect(p.t1, g.t1)) / (len(p.t1) + len(g.t1) - len(list_intersect(p.t1, g.t1))) >= 0.3 AND len(list_intersect(p.t2, g.t2)) / (len(p.t2) + len(g.t2) - len(list_intersect(p.t2, g.t2))) >= 0.3),
pr AS (SELECT doc_id, pseq, list(DISTINCT gseq ORDER BY gseq) AS gs, row_number() OVER (PARTITION BY doc_id ORDER BY pseq) AS k FROM hit GROUP BY doc_id, pseq),
step AS (SELECT doc_id, 0::BIGINT AS k, NULL::BIGINT AS pseq, NULL::BIGINT AS gseq, []::BIGINT[] AS used FROM (SELECT DISTINCT doc_id FROM pr)
  UNION ALL SELECT s.doc_id, p.k, p.pseq, list_filter(p.gs, lambda x: NOT list_contains(s.used, x))[1], list_append(s.used, list_filter(p.gs, lambda x: NOT list_contains(s.used, x))[1]) FROM step s JOIN pr p ON p.doc_id = s.doc_id AND p.k = s.k + 1),
took AS (SELECT doc_id, pseq, gseq FROM step WHERE gseq IS NOT NULL)"""
_MATCHED = "WITH RECURSIVE " + O._TUPLES + ",\n" + _GREEDY


@query(_MATCHED + "\nSELECT doc_id, pseq, gseq FROM took")
def openie_matches(spark: SparkSession, d: str) -> DataFrame:
    return metrics.greedy_matches(metrics.tuple_matches(*_trade_tuples(spark, d), arg_threshold=0.3))


SQL["openie_scores"] = _MATCHED + """,
n AS (SELECT (SELECT count(*) FROM took) AS tp, count(*) FILTER (seq % 2 = 1) AS np, count(*) FILTER (seq % 2 = 0) AS ng FROM base),
c AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT a1, a2 FROM tok WHERE seq % 2 = 0 INTERSECT SELECT DISTINCT a1, a2 FROM tok WHERE seq % 2 = 1)) / (SELECT count(*) FROM (SELECT DISTINCT a1, a2 FROM tok WHERE seq % 2 = 0)) AS c)
SELECT round(tp / np, 4) AS precision, round(tp / ng, 4) AS recall, round(2 * (tp / np) * (tp / ng) / (tp / np + tp / ng), 4) AS f1, round(c, 4) AS coverage, tp, np - tp AS fp, ng - tp AS fn, np AS n_pred, ng AS n_gold FROM n, c"""

# complete linkage in SQL: in each step every block merges the two clusters whose farthest members are closest, while that is below its threshold
_LINKED = ",\n".join((O._F1, O._COUNTS, O._MI, O._DIST, O._SUPPORT, O._DOMINANT, O._BLOCKS, O._THRESHOLDS)) + """,
near AS (SELECT p AS a, q AS b, distance FROM dist UNION ALL SELECT q, p, distance FROM dist),
state AS (SELECT 0 AS step, sx, sy, path, path AS c FROM blocks
  UNION ALL SELECT s.step + 1, s.sx, s.sy, s.path, CASE WHEN s.c = m.b THEN m.a ELSE s.c END FROM state s JOIN (
    SELECT sx, sy, a, b FROM (
      SELECT x.sx, x.sy, x.c AS a, y.c AS b, max(coalesce(n.distance, 1.0)) AS far FROM state x JOIN state y ON x.sx = y.sx AND x.sy = y.sy AND x.c < y.c LEFT JOIN near n ON n.a = x.path AND n.b = y.path GROUP BY ALL) l
    JOIN thr USING (sx, sy) WHERE far < threshold QUALIFY row_number() OVER (PARTITION BY sx, sy ORDER BY far, a, b) = 1) m ON m.sx = s.sx AND m.sy = s.sy),
ends AS (SELECT * FROM state QUALIFY step = max(step) OVER (PARTITION BY sx, sy)),
linked AS (SELECT sx, sy, path, support, first(path) OVER (PARTITION BY sx, sy, c ORDER BY support DESC, path) AS cluster FROM ends JOIN support USING (path))"""
SQL["complete_linkage_clusters"] = "WITH RECURSIVE " + _LINKED + "\nSELECT sx, sy, path, cluster FROM linked"

# labels of a full pass: blocks of two use the reference that the merged clusters of larger blocks leave, folded by halves in their order
_INSIDE = "SELECT cluster, count(*) AS size, (SELECT sum(1 - distance) FROM dist d JOIN {0} a ON a.path = d.p JOIN {0} b ON b.path = d.q WHERE a.cluster = c.cluster AND b.cluster = c.cluster) / (count(*) * (count(*) - 1) / 2.0) AS cohesion FROM {0} c GROUP BY cluster HAVING count(*) > 1"
SQL["induced_labels"] = "WITH RECURSIVE " + _LINKED + f""",
large AS (SELECT l.* FROM linked l JOIN sizes USING (sx, sy) WHERE size >= 3),
merged AS ({_INSIDE.format("large")}),
folded AS (SELECT 1 - cohesion AS d, row_number() OVER (ORDER BY l.sx, l.sy, l.support DESC, l.path) AS k, count(*) OVER () AS n FROM merged m JOIN large l ON l.path = m.cluster),
ref AS (SELECT sum(d * CASE WHEN k = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - k + 1) END) AS r FROM folded),
small AS (SELECT b.sx, b.sy, b.path, b.support, size, first(b.path) OVER (PARTITION BY b.sx, b.sy ORDER BY b.support DESC, b.path) AS top FROM blocks b JOIN sizes USING (sx, sy) WHERE size < 3),
pair AS (SELECT x.sx, x.sy, coalesce(d.distance, 1.0) AS d FROM small x JOIN small y ON x.sx = y.sx AND x.sy = y.sy AND x.path < y.path LEFT JOIN dist d ON d.p = x.path AND d.q = y.path),
joined AS (SELECT path, cluster FROM large UNION ALL SELECT s.path, CASE WHEN p.d < CASE WHEN p.d <= 1e-12 THEN 0.75 ELSE least(greatest(coalesce((SELECT r FROM ref), 0.3) + 1e-9, 0.3), 0.75) END THEN s.top ELSE s.path END FROM small s LEFT JOIN pair p USING (sx, sy)),
whole AS ({_INSIDE.format("joined")}),
named AS (SELECT *, coalesce(nullif(substr(regexp_replace(upper(cluster), '[^A-Z0-9_]', '', 'g'), 1, 40), ''), 'RELATED_TO') AS label FROM joined)
SELECT path, label, round(cohesion, 6) AS cohesion FROM named LEFT JOIN whole USING (cluster)"""

# clusters of entities with similar contexts in each document; labels spread by the smallest over close pairs, as often as the widest component needs
SQL["similarity_components"] = "WITH RECURSIVE " + O._SENT + """,
said AS (SELECT m.doc_id, m.sent_id, m.i, m.word AS entity, w.word FROM men m LEFT JOIN words w ON w.doc_id = m.doc_id AND w.sent_id = m.sent_id AND w.i = m.i + 1 AND w.word NOT IN (SELECT word FROM stops)),
ent AS (SELECT doc_id, entity, count(word) AS k FROM said GROUP BY doc_id, entity QUALIFY count(*) OVER (PARTITION BY doc_id) >= 3),
num AS (SELECT doc_id, count(*) AS n FROM ent GROUP BY doc_id),
bag AS (SELECT doc_id, entity, 'empty' AS term, 1 AS tf FROM ent WHERE k = 0 UNION ALL SELECT doc_id, entity, word, count(*) FROM said SEMI JOIN ent USING (doc_id, entity) WHERE length(word) > 1 GROUP BY ALL),
voc AS (SELECT doc_id, term, sum(tf) AS a, count(*) AS df FROM bag GROUP BY doc_id, term QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sum(tf) DESC, term) <= 50),
wgt AS (SELECT doc_id, entity, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM bag JOIN voc USING (doc_id, term) JOIN num USING (doc_id)),
vec AS (SELECT doc_id, entity, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, entity)) AS w FROM wgt),
close AS (SELECT a.doc_id, a.entity AS a, b.entity AS b FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.term = b.term AND a.entity <> b.entity GROUP BY ALL HAVING 1 - sum(a.w * b.w) <= 0.4 + 1e-9),
state AS (SELECT 0 AS step, doc_id, a AS entity, a AS root FROM (SELECT DISTINCT doc_id, a FROM close)
  UNION ALL SELECT s.step + 1, s.doc_id, s.entity, least(min(s.root), min(o.root)) FROM state s JOIN close c ON c.doc_id = s.doc_id AND c.a = s.entity JOIN state o ON o.doc_id = c.doc_id AND o.entity = c.b WHERE s.step < 30 GROUP BY ALL),
part AS (SELECT doc_id, entity, root FROM state WHERE step = 30),
grp AS (SELECT doc_id, root, list(entity ORDER BY entity) AS entities, count(*) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY root) - 1 AS cluster_id FROM part GROUP BY doc_id, root),
firsts AS (SELECT doc_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY min((sent_id, i))) AS o FROM said GROUP BY doc_id, entity),
top AS (SELECT p.doc_id, p.root, s.word, count(*) AS k, min((f.o, s.sent_id, s.i)) AS place FROM part p JOIN said s USING (doc_id, entity) JOIN firsts f USING (doc_id, entity) WHERE s.word IS NOT NULL GROUP BY ALL),
sig AS (SELECT doc_id, root, list(word ORDER BY k DESC, place) AS words FROM (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY doc_id, root ORDER BY k DESC, place) <= 3) GROUP BY ALL)
SELECT g.doc_id, g.cluster_id, array_to_string(g.entities, ',') AS entities, coalesce(array_to_string(s.words, ','), '') AS signature, g.size FROM grp g LEFT JOIN sig s USING (doc_id, root)"""
