import numpy as np
import pytest
from pyspark.sql import functions as F

from relata.config import Config
from relata.functions import scores as S
from relata.operators import active, kg, labels, similarity
from relata.plans.learner import Learner, captured, measure

TEXT = [
    "magnificent engineers visited beautiful cathedrals. wonderful musicians visited beautiful cathedrals. he was there.",
    "magnificent engineers and wonderful musicians. magnificent engineers built beautiful cathedrals.",
    None,
]


@pytest.fixture(scope="module")
def learner(spark):
    x = Learner.for_evaluation(spark)
    with captured() as lines:
        print("running")
        x.run(spark.createDataFrame(list(enumerate(TEXT)), "doc_id long, text string"))
    assert "running" in lines
    return x


def test_run(learner):
    r = learner.result
    assert r["pass_kind"] == "full"
    rel = {(x.subject, x.object) for x in r["relations"].where("source = 'open_ie_induced'").collect()}
    assert ("engineers", "beautiful") in rel
    assert {x.path for x in r["propositions"].collect()} >= {"visited"}
    assert all(0 <= x.raw <= 1 for x in r["propositions"].collect())
    assert r["concepts"].where("concept = 'engineers'").count() == 2
    p = learner.payload()
    assert p["counts"]["relations"] == r["relations"].count() and learner.last()["pass"] == "full"
    assert "relations:" in learner.summary() and learner.status()["mode"] == "memory"
    e = learner.evaluate()
    assert e["drift"]["approx_error"] == 0.0 and not [x for x in e.values() if "error" in x], e


def test_labels_take_over(learner):
    q = learner.queries(4)
    assert q and all(x["suggestion"] is not None for x in q)
    with pytest.raises(KeyError):
        learner.label("no such key", "X")
    out = learner.label(q[0]["key"], "ADMIRES")
    assert [r.label for r in learner.records.where(F.col("key") == q[0]["key"]).collect()] == ["ADMIRES"]
    assert labels.has_human(learner.records)
    assert {r["source"] for r in out} <= {"active_learned", "distributional_similarity"}
    gold = active.DictOracle({("Engineers", "Beautiful"): "VISITS"})
    history = learner.active_loop(gold, rounds=2, k=2)
    assert history[0]["queried"] == 2 and history[-1]["model_fitted"]


def test_memory_on_disk(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXT)), "doc_id long, text string")
    make = lambda: Learner(spark, path=str(tmp_path / "memory"), labels_path=str(tmp_path / "labels"))
    a = make()
    assert a.run(docs)["pass_kind"] == "full"
    a.label(a.queries(1)[0]["key"], "ADMIRES")
    b = make()
    assert labels.has_human(b.records)
    out = b.run(docs)
    assert out["pass_kind"] == "same" and out["propositions"].count() == a.result["propositions"].count()
    assert sorted(map(tuple, b.state.labels.collect())) == sorted(map(tuple, a.state.labels.collect()))


def test_before_a_run(spark):
    x = Learner.for_evaluation(spark)
    for call in (x.last, x.queries, lambda: x.label("a", "b")):
        with pytest.raises(RuntimeError):
            call()


def test_oracles_and_cost():
    o = active.DictOracle({("A", "B"): "R"})
    assert o.label({"entity1": "a", "entity2": "b"}) == "R" and o.label({"entity1": "b", "entity2": "a"}) == "NO_RELATION"
    e = {"entity1": "a", "entity2": "b", "type1": "", "type2": "", "context": ""}
    assert active.PromptOracle(lambda _: " ").label(e) == "NO_RELATION"
    assert measure(lambda: 3)["result"] == 3


def test_scores(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.calibrated(F.lit(0.6), F.lit(5), F.lit(10))) == 0.6
    assert one(S.calibrated(F.lit(0.6), F.lit(30), F.lit(40))) == pytest.approx(40 / 60 * 31 / 42 + 20 / 60 * 0.6, abs=1e-3)
    assert one(S.raw_confidence(F.lit(3), F.lit(1.0), F.lit(None).cast("double"))) == 0.75
    assert one(S.raw_confidence(F.lit(3), F.lit(1.0), F.lit(0.25))) == 0.5
    assert one(S.heuristic_uncertainty(F.lit("a"), F.lit("P"), F.lit("P"), F.lit(0.5))) == pytest.approx(0.8)
    assert one(S.margin_uncertainty(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1)))) == pytest.approx(0.5)
    assert one(S.margin_uncertainty(F.array(F.lit(0.7)))) == pytest.approx(0.3)
    assert one(S.shrunk(F.lit(0.5), 10)) == 0.25 and one(S.shrunk(F.lit(0.5), 0)) == 0.0
    assert one(S.bucket(F.lit(1.0), 10)) == 9 and one(S.bucket(F.lit(-1.0), 10)) == 0


def test_model(spark):
    rows = [("a", "b", "P", "P", "works for the firm", "WORKS")] * 20 + [("a", "c", "P", "G", "lives in the town", "LIVES")] * 20
    df = spark.createDataFrame(rows, "entity1 string, entity2 string, type1 string, type2 string, context string, label string").withColumn("source", F.lit("oracle"))
    assert not active.train(df.where("label = 'WORKS'")).is_fitted
    m = active.train(df)
    assert m.classes == ["LIVES", "WORKS"] and m.n_train == 40
    out = m.predict(df)
    assert out.where("prediction <> label or probability < 0.8").count() == 0
    assert active.Model().predict(df).where("prediction is not null").count() == 0


def test_pair_look_up_prefers_the_last_exact_then_the_first_reverse(spark):
    props = spark.createDataFrame([("a", "b", "R1", 0.1, 1), ("a", "b", "R2", 0.2, 2), ("d", "c", "S1", 0.3, 3), ("d", "c", "S2", 0.4, 4)], "arg1 string, arg2 string, label string, confidence double, seq int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("x", "y")], "entity1 string, entity2 string").withColumn("confidence", F.lit(0.7))
    out = {(r.entity1, r.entity2): (r.frame_agreement, r.confidence) for r in labels.tag_pairs(pairs, props).collect()}
    assert out == {("a", "b"): ("R2", 0.2), ("b", "a"): ("R1", 0.1), ("c", "d"): ("S1", 0.3), ("x", "y"): ("none", 0.7)}


def test_similarity_patterns(spark):
    rows = [("d", "a", ["red", "big"]), ("d", "b", ["red", "big"]), ("d", "c", ["slow"]), ("d", "e", []), ("d", "f", []), ("few", "a", ["red"]), ("few", "b", ["red"])]
    df = spark.createDataFrame([(*r, (0, i)) for i, r in enumerate(rows)], "doc_id string, entity string, words array<string>, first struct<s:int,e:int>")
    got = [(r.doc_id, r.cluster_id, r.entities, r.signature, r["size"]) for r in similarity.similarity_patterns(df).orderBy("cluster_id").collect()]
    assert got == [("d", 0, ["a", "b"], ["red", "big"], 2), ("d", 1, ["e", "f"], [], 2)]
    some = similarity.similarity_patterns(df, Config(similarity_without_context=False)).collect()
    assert [r.entities for r in some] == [["a", "b"]]
    edges = similarity.similar_to(similarity.similarity_patterns(df)).orderBy("subject").collect()
    assert [(r.subject, r.object, r.confidence) for r in edges] == [("a", "b", 0.25), ("e", "f", 0.25)]
    assert edges[0].evidence == "cluster 0 signature=['red', 'big']"


def test_graph(spark):
    t = [(f"p{i}", "IN", f"c{i % 4}") for i in range(40)] + [(f"c{i}", "OF", f"l{i % 2}") for i in range(4)]
    df = spark.createDataFrame(t, "h string, r string, t string")
    ent, rel = kg.train(df, Config(kg_dim=16))
    assert ent.count() == 46 and rel.count() == 2
    assert kg.hits_at(ent, rel, df, 10) > 0.8
    assert kg.hits_at(ent, rel, df.limit(0)) is None
    links = kg.predict_links(ent, rel, df, 8).collect()
    assert len(links) == 8 and sum(r.known for r in links) >= 6
    emb = kg.magnitudes(ent)
    near = kg.similar_entities(emb, ["p0", "nobody"], 3).collect()
    assert len(near) == 3 and all(r.entity == "p0" != r.other for r in near)
    train, test, valid = kg.split_triples(df)
    assert valid and train.count() + test.count() == 44 and not kg.split_triples(df.limit(5))[2]
    with pytest.raises(ValueError):
        kg.train(df.limit(2))


def test_rounds_of_parts():
    for parts in (4, 6, 10):
        rounds = kg.rounds_of(parts)
        assert all(sorted(x for p in r for x in p) == list(range(parts)) for r in rounds)
        pairs = [p for r in rounds for p in r]
        assert len(pairs) == len(set(pairs)) == parts * (parts - 1) // 2


@pytest.mark.parametrize("model,per_task", [("complex", 1000), ("rotate", 20)])
def test_graph_models_and_parts(spark, model, per_task):
    t = [(f"p{i}", "IN", f"c{i % 4}") for i in range(40)] + [(f"c{i}", "OF", f"l{i % 2}") for i in range(4)]
    df = spark.createDataFrame(t, "h string, r string, t string")
    cfg = Config(kg_dim=16, kg_model=model)
    ent, rel = kg.train(df, cfg, per_task)
    assert ent.count() == 46 == ent.select("entity").distinct().count() and rel.count() == 2
    assert kg.hits_at(ent, rel, df, 10, cfg) > 0.7
    one = kg.link_scores(ent, rel, df.where("h = 'c0'"), 5, cfg).orderBy(F.desc("score")).collect()
    e = {r.entity: np.array(r.re) + 1j * np.array(r.im) for r in ent.collect()}
    turn = {r.relation: np.array(r.re) + 1j * np.array(r.im) for r in rel.collect()}
    plain = lambda x: -np.abs(e["c0"] * turn["OF"] - x).sum() if model == "rotate" else np.real((e["c0"] * turn["OF"] * np.conj(x)).sum())
    want = sorted(((plain(x), n) for n, x in e.items()), reverse=True)[:5]
    assert [r.t for r in one] == [n for _, n in want] and [r.score for r in one] == pytest.approx([s for s, _ in want])


def test_nearest_neighbours(spark):
    g = np.random.default_rng(1)
    v = g.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in kg.nearest_neighbours(df, df.where("vec_id < 5"), 4).collect():
        got.setdefault(r.vec_id, set()).add(r.other)
    assert got == {i: set(np.argsort(-s[i])[:4].tolist()) for i in range(5)}
    assert kg.nearest_neighbours(df, df.limit(0)).count() == 0


def test_consolidation_keeps_the_first(spark):
    cols = "seq long, subject string, relation string, object string, confidence double, source string, evidence string"
    a = spark.createDataFrame([(2, "a", "R", "b", 0.2, "s", "late"), (1, "a", "R", "b", 0.1, "s", "early")], cols)
    b = spark.createDataFrame([(0, "a", "R", "b", 0.9, "t", "other"), (0, "a", "S", "b", 0.9, "t", "other")], cols)
    out = {r.relation: (r.confidence, r.evidence) for r in labels.consolidate(a, b).collect()}
    assert out == {"R": (0.1, "early"), "S": (0.9, "other")}
    assert labels.triples(labels.consolidate(a, b).withColumn("source", F.lit("distributional_similarity"))).count() == 0
