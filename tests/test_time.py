"""Steps of the whole pipeline that must not take rounds, shuffles or passes of their own, against plainer ones."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from relata.config import Config
from relata.operators import similarity
from relata.operators import text as X
from relata.plans.learner import Learner
from relata.sources import annotate


def _profiles(spark):
    r = random.Random(5)
    rows = [("d%d" % d, "e%02d" % e, [r.choice("red Big a slow fast old-new x1".split()) for _ in range(r.randint(0, 4))], (e % 7, e)) for d in range(12) for e in range(d * 4)]
    rows += [(None, "e%d" % e, ["red"], (0, e)) for e in range(4)] + [("gap", "e%d" % e, None if e < 2 else ["old", None, "old"], (0, e)) for e in range(5)]
    return spark.createDataFrame(rows, "doc_id string, entity string, words array<string>, first struct<s:int,e:int>")


def test_clusters_of_a_document_take_no_rounds(spark, monkeypatch):
    p = _profiles(spark)
    cfg = Config(similarity_terms=4)
    roots = similarity.connected(similarity.close_entities(similarity.tfidf(p, cfg), cfg)).collect()
    want, said = defaultdict(set), {(x.doc_id, x.entity): (x.first, x.words or []) for x in p.collect()}
    for x in roots:
        want[x.doc_id, x.root].add(x.entity)
    many = {d for d, n in p.groupBy("doc_id").count().collect() if n >= 3}
    want = {k: v for k, v in want.items() if k[0] in many}
    assert len(want) > 15
    for name in ("tfidf", "close_entities", "connected"):
        monkeypatch.setattr(similarity, name, lambda *a: 1 / 0)
    got = similarity.similarity_patterns(p.repartition(3), cfg).collect()
    assert {(x.doc_id, x.entities[0]): set(x.entities) for x in got} == want
    assert all(x.entities == sorted(x.entities) and x["size"] == len(x.entities) for x in got)
    for x in got:
        words = [w for _, ws in sorted(said[x.doc_id, e] for e in x.entities) for w in ws]
        assert x.signature == sorted(dict.fromkeys(words), key=lambda w: -words.count(w))[:3]
    for d in {x.doc_id for x in got}:
        own = sorted((x.cluster_id, x.entities[0]) for x in got if x.doc_id == d)
        assert [k for k, _ in own] == list(range(len(own))) and [e for _, e in own] == sorted(e for _, e in own)
    assert similarity.similarity_patterns(p.where(F.lit(False)), cfg).count() == 0


def test_links_of_large_documents_are_searched_breadth_first():
    r = np.random.default_rng(3)
    doc = np.repeat([0, 1, 2], [70, 1, 40])
    x = np.where(r.random((111, 6)) < 0.3, r.random((111, 6)), 0)
    x[:, 0] += (x.sum(1) == 0) * 0.5
    x /= np.sqrt((x * x).sum(1))[:, None]
    e, place = np.nonzero(x)
    parts = [similarity._components(111, *similarity._close(doc, e, place, x[e, place], Config(similarity_eps=0.05), dense)) for dense in (1024, 8)]
    assert (parts[0] == parts[1]).all() and 10 < len(set(parts[0])) < 90
    near = (x @ x.T >= 0.95) & (doc[:, None] == doc)
    reach = np.linalg.matrix_power(near.astype(float), 1)
    for _ in range(7):
        reach = (reach @ reach > 0).astype(float)
    assert (reach.argmax(1) == parts[0]).all()


def test_kept_sentences_of_shapes_are_made_of_bytes(spark, monkeypatch):
    """The same rows as token by token, and these are what a run reads."""
    texts = ["", None, "...\n\n.", "he.she", "Extraordinary\nACCOUNTABILITY meets KKelvinscales it", "İstanbulites étés naïvetéabcdefghi 3abcdefghij4klmnopqrs.", "a.b", "their theirs THEM. the of hem", "wonderful", "wonderful.", ".wonderfully the, wonderful; is wonderful\r\nit", "\U0001f600abcdefghijkl\U0001f600it mnopqrstuvw x", "中文. abcdefghi 中 mnopqrstuvw 文.中"]
    r = random.Random(2)
    texts += ["".join(r.choice(["extraordinary", "it", "he", "the", " ", " ", ".", "\n", "é", "abcdefghi", "KK", "x,", "0", ""]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(k if k != 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = X.kept_sentences(annotate.shape_sentences(docs))
    got = annotate.shape_sentences.kept(docs)
    assert got.schema == want.schema
    rows = sorted(map(repr, want.collect()))
    assert len(rows) > 150 and sorted(map(repr, got.collect())) == rows
    small = [x for b in docs.where("doc_id is not null").selectExpr("cast(doc_id as string) doc_id", "lower(coalesce(text, '')) text").toArrow().to_batches() for k in annotate._kept_of([b], 40) for x in k.to_pylist()]
    assert small == [x for x in got.where("doc_id is not null").toArrow().to_pylist()]
    monkeypatch.setattr(X, "kept_sentences", lambda *a: 1 / 0)
    monkeypatch.setattr(annotate.shape_sentences, "kept", lambda docs: got)
    assert Learner.for_evaluation(spark)._sentences(docs).count() == len(rows)
