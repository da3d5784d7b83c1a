"""Entities with similar contexts: tf-idf, cosine neighbours, density clusters of two or more, SIMILAR_TO hypotheses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, SIMILAR_TO, Config
from relata.sources.scratch import forget, stored

EMPTY = "EMPTY"


def terms_of(words: Column) -> Column:
    """The terms of an entity's words (see :func:`tfidf`)."""
    text = F.when(F.size(words) == 0, F.lit(EMPTY)).otherwise(F.array_join(words, " "))
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), 1)


def tfidf(profiles: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, entity, term, weight) from (*by, entity, words): unit vectors over the most frequent terms.

    Terms are runs of two or more word characters, lower case; an entity without words has the one word EMPTY. The
    vocabulary holds the ``similarity_terms`` most frequent terms (ties by term); idf is ln((1 + n) / (1 + df)) + 1.
    """
    t = profiles.select(*by, "entity", F.explode(terms_of(F.col("words"))).alias("term"))
    tf = stored(t.groupBy(*by, "entity", "term").agg(F.count("*").alias("tf")), "terms")  # read twice below
    n = profiles.groupBy(*by).agg(F.countDistinct("entity").alias("_n"))
    vocab = tf.groupBy(*by, "term").agg(F.sum("tf").alias("_all"), F.count("*").alias("_df"))
    vocab = vocab.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_all"), "term"))).where(F.col("_r") <= cfg.similarity_terms)
    vocab = vocab.join(n, list(by)).select(*by, "term", (F.log((1 + F.col("_n")) / (1 + F.col("_df"))) + 1).alias("_idf"))
    w = stored(tf.join(vocab, [*by, "term"]).select(*by, "entity", "term", (F.col("tf") * F.col("_idf")).alias("_w")), "weights")  # twice, too
    norm = w.groupBy(*by, "entity").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return w.join(norm, [*by, "entity"]).select(*by, "entity", "term", (F.col("_w") / F.col("_norm")).alias("weight"))


def close_entities(vectors: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, a, b, cosine), a < b, of entities within the distance ``similarity_eps``.

    Entities with equal vectors share a signature and are linked as a chain to the smallest, so that many entities without
    context (all EMPTY) give rows in proportion; pairs come from the distinct vectors only.
    """
    sig = stored(vectors.groupBy(*by, "entity").agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("term", F.round("weight", 9).alias("w"))))).alias("_s")), "signatures")  # three times
    rep = stored(sig.groupBy(*by, "_s").agg(F.min("entity").alias("_rep")), "first-entities")
    same = sig.join(rep, [*by, "_s"]).where("entity <> _rep").select(*by, F.col("_rep").alias("a"), F.col("entity").alias("b"), F.lit(1.0).alias("cosine"))
    v = stored(vectors.join(rep.select(*by, F.col("_rep").alias("entity")), [*by, "entity"], "left_semi"), "distinct-vectors")
    x = v.select(*by, "term", F.col("entity").alias("a"), F.col("weight").alias("_a"))
    y = v.select(*by, "term", F.col("entity").alias("b"), F.col("weight").alias("_b"))
    near = x.join(y, [*by, "term"]).where("a < b").groupBy(*by, "a", "b").agg(F.sum(F.col("_a") * F.col("_b")).alias("cosine"))
    return near.where(1 - F.col("cosine") <= cfg.similarity_eps + 1e-12).unionByName(same)


def connected(edges: DataFrame, by: tuple[str, ...] = ("doc_id",), most_rounds: int = 60) -> DataFrame:
    """(*by, entity, root): components of (a, b) edges; root is the smallest name. Labels spread by the minimum over neighbours
    and jump to their label's label, so rounds grow with the logarithm of a component's width."""
    e = stored(edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "close")
    at = stored(e.groupBy(*by, F.col("a").alias("entity")).agg(F.min("b").alias("_m")).select(*by, "entity", F.least("_m", "entity").alias("root")), "roots")
    for _ in range(most_rounds):
        label = at.select(*by, F.col("entity").alias("b"), F.col("root").alias("_r"))
        low = e.join(label, [*by, "b"]).groupBy(*by, F.col("a").alias("entity")).agg(F.min("_r").alias("_low"))
        step = at.join(low, [*by, "entity"], "left").withColumn("_new", F.least("root", F.coalesce("_low", "root")))
        jump = at.select(*by, F.col("entity").alias("_new"), F.col("root").alias("_up"))
        step = stored(step.join(jump, [*by, "_new"], "left").select(*by, "entity", F.least("_new", F.coalesce("_up", "_new")).alias("root"), F.col("root").alias("_old")), "roots")
        forget(at)
        at = step
        if step.where("root <> _old").isEmpty():
            forget(e)
            return at.drop("_old")
    raise RuntimeError("components did not settle")


def similarity_patterns(profiles: DataFrame, cfg: Config = DEFAULT, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, cluster_id, entities, signature, size): clusters of two or more entities, numbered by their smallest entity; documents
    with fewer than three entities have none. A cluster of minimum size two is a component of the close pairs.

    profiles: a row for each entity. :func:`tfidf`, :func:`close_entities` and :func:`connected` of a document meet no other document, so
    a document's profiles are gathered once and all three are made of them in numpy, many documents at a time.
    """
    if not cfg.similarity_without_context:
        profiles = profiles.where(F.size("words") > 0)
    p = profiles.where("entity is not null").select(*by, F.struct("first", "entity", "words", terms_of(F.col("words")).alias("terms")).alias("_e"))
    p = p.groupBy(*by).agg(F.sort_array(F.collect_list("_e")).alias("_e")).where(F.size("_e") >= 3).dropna(subset=list(by))
    p = p.select(*by, *[F.col(f"_e.{c}").alias(f"_{c}") for c in ("entity", "words", "terms")])
    kinds = dict(p.dtypes)
    return p.mapInArrow(_clusters(by, cfg), ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", cluster_id int, entities array<string>, signature array<string>, size int")


def _clusters(by: tuple[str, ...], cfg: Config) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                yield _clustered(b.slice(k, 512), by, cfg)

    return run


def _ranked(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The places of strings in the sorted distinct ones, and these."""
    d = strings.dictionary_encode("encode")
    order = pc.sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[d.indices.to_numpy()], d.dictionary.take(pa.array(order))


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _place(of: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place of each row among those of its group (of), in an order by groups first."""
    n = np.bincount(of)
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of)) - (np.cumsum(n) - n)[of[order]]
    return place


def _clustered(rows: pa.RecordBatch, by: tuple[str, ...], cfg: Config) -> pa.RecordBatch:
    """Rows of :func:`similarity_patterns` from documents (*by, _entity, _words, _terms), entities in order of their first mention."""
    n = _lengths(rows.column("_entity"))
    doc = np.repeat(np.arange(len(n)), n)
    names, words, terms = (rows.column(f"_{c}").flatten() for c in ("entity", "words", "terms"))
    name, _ = _ranked(names)
    term, known = _ranked(terms.flatten())
    # tf, and the place of each term among the most frequent ones of its document
    key, tf = np.unique(np.repeat(np.arange(len(doc)), _lengths(terms)) * max(len(known), 1) + term, return_counts=True)
    e, t = np.divmod(key, max(len(known), 1))
    kind, at = np.unique(doc[e] * max(len(known), 1) + t, return_inverse=True)
    of, t = np.divmod(kind, max(len(known), 1))
    df = np.bincount(at)
    place = _place(of, np.lexsort((t, -np.bincount(at, tf), of)))[at]
    weight = tf * (np.log((1 + n[of]) / (1 + df)) + 1)[at]
    kept = place < cfg.similarity_terms
    e, place, weight = e[kept], place[kept], weight[kept]
    weight = weight / np.sqrt(np.bincount(e, weight * weight, len(doc)))[e]
    a, b = _close(doc, e, place, weight, cfg)
    root = _components(len(doc), a, b)

    member = np.flatnonzero(np.bincount(root, minlength=len(doc))[root] > 1)
    least = np.full(len(doc), len(doc))
    np.minimum.at(least, root[member], name[member])
    member = member[np.lexsort((name[member], least[root[member]], doc[member]))]
    new = np.concatenate([[True], root[member][1:] != root[member][:-1]])[: len(member)]
    first = np.flatnonzero(new)
    cluster = np.full(len(doc), -1)
    cluster[member] = np.cumsum(new) - 1
    home = doc[member[first]]
    ends = np.append(first, len(member))

    # the words of a cluster, in the order in which they are said
    word, said = _ranked(words.flatten())
    of = cluster[np.repeat(np.arange(len(doc)), _lengths(words))]
    key, when, count = np.unique(of[of >= 0] * max(len(said), 1) + word[of >= 0], return_index=True, return_counts=True)
    of, word = np.divmod(key, max(len(said), 1))
    order = np.lexsort((when, -count, of))
    order = order[_place(of, order)[order] < 3]
    top = np.concatenate([[0], np.cumsum(np.bincount(of[order], minlength=len(first)))])
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [*[rows.column(c).take(pa.array(home)) for c in by], pa.array(_place(home, np.arange(len(home))), pa.int32()), lists(ends, names.take(pa.array(member))), lists(top, said.take(pa.array(word[order]))), pa.array(np.diff(ends), pa.int32())],
        [*by, "cluster_id", "entities", "signature", "size"],
    )


def _close(doc: np.ndarray, e: np.ndarray, place: np.ndarray, weight: np.ndarray, cfg: Config, dense: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of entities (doc: of each) that have the components of the pairs within the distance ``similarity_eps``. e, place, weight: the entries
    of their vectors, by entity. Entities with equal vectors are linked to the first of them, which stands for all. Documents with more than ``dense``
    distinct vectors are searched breadth first, so that their close pairs, which may be very many, are never held."""
    begin = np.flatnonzero(np.diff(e, prepend=-1))
    have = e[begin]
    h = (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.rint(weight * 1e9).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.add.reduceat(h ^ (h >> np.uint64(29)), begin) if len(begin) else h
    order = np.lexsort((have, h, doc[have]))
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (doc[have[order]][1:] == doc[have[order]][:-1])])[: len(order)]
    start = np.flatnonzero(~same)
    stands = have[order][start][np.cumsum(~same) - 1] if len(order) else have
    a, b = [stands[same]], [have[order][same]]

    alone = np.sort(stands[~same])
    number = np.full(len(doc), -1)
    number[alone] = np.arange(len(alone))
    own = number[e] >= 0
    e, place, weight = number[e[own]], place[own], weight[own]
    far = 1 - cfg.similarity_eps - 1e-12
    bounds = np.flatnonzero(np.diff(doc[alone], prepend=-1, append=-1))
    entries = np.searchsorted(e, bounds)
    for lo, hi, i, j in zip(bounds[:-1], bounds[1:], entries[:-1], entries[1:]):
        if hi - lo < 2:
            continue
        x = np.zeros((hi - lo, int(place[i:j].max()) + 1))
        x[e[i:j] - lo, place[i:j]] = weight[i:j]
        p, q = np.nonzero(x @ x.T >= far) if hi - lo <= dense else _reached(x, far, dense)
        a.append(alone[lo + p[p < q]])
        b.append(alone[lo + q[p < q]])
    return np.concatenate(a), np.concatenate(b)


def _reached(x: np.ndarray, far: float, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first vector of each component to its others; each vector meets those not reached yet, ``rows`` against ``rows`` at a time."""
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    rest = np.arange(len(x))
    while len(rest):
        first, edge, rest = rest[0], rest[:1], rest[1:]
        while len(edge) and len(rest):
            near = np.zeros(len(rest), bool)
            for k in range(0, len(edge), rows):
                for m in range(0, len(rest), rows):
                    near[m : m + rows] |= (x[edge[k : k + rows]] @ x[rest[m : m + rows]].T >= far).any(0)
            edge, rest = rest[near], rest[~near]
            a.append(np.full(len(edge), first))
            b.append(edge)
    return np.concatenate(a), np.concatenate(b)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each number's component."""
    root = np.arange(n)
    while True:
        p, q = root[a], root[b]
        if (p == q).all():
            return root
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def similar_to(patterns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """SIMILAR_TO relations of all pairs of each cluster (the reference output; its size is the square of a cluster's). ``seq`` numbers
    them in their document by (evidence, subject, object): the pairs of a cluster are in order, so only clusters are sorted."""
    pairs = F.flatten(F.transform("entities", lambda a, k: F.transform(F.slice("entities", k + 2, F.greatest(F.size("entities") - k - 1, F.lit(0))), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    evidence = F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"), F.lit(" signature=["), F.array_join(F.transform("signature", lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "), F.lit("]"))
    n = F.size("entities").cast("long")
    before = Window.partitionBy("doc_id").orderBy("evidence").rowsBetween(Window.unboundedPreceding, -1)
    p = patterns.select("doc_id", "entities", evidence.alias("evidence")).withColumn("_at", F.coalesce(F.sum(n * (n - 1) / 2).over(before).cast("long"), F.lit(0)))
    p = p.select("doc_id", "evidence", "_at", F.posexplode(pairs).alias("_i", "_p"))
    return p.select("doc_id", F.col("_p.subject").alias("subject"), F.lit(SIMILAR_TO).alias("relation"), F.col("_p.object").alias("object"), F.lit(cfg.conf_similarity).alias("confidence"), F.lit("distributional_similarity").alias("source"), "evidence", (F.col("_at") + F.col("_i") + 1).alias("seq"))
