"""The chain of coreference models, with stand-ins for the optional libraries."""

import sys
import types

import pytest

from relata.plans.learner import Learner
from relata.sources import coref, scratch


def test_the_chain_takes_the_first_that_starts(monkeypatch):
    assert coref.choose() is None and coref.name_of(None) == "rules"  # none of the libraries is here

    class Broken:
        def __init__(self):
            raise OSError("no model")

    class Works:
        def predict(self, texts):
            return [types.SimpleNamespace(get_clusters=lambda as_strings: [[(0, 3), (8, 11)]])]

    fast, spacy, exp = types.ModuleType("fastcoref"), types.ModuleType("spacy"), types.ModuleType("spacy_experimental")
    monkeypatch.setitem(sys.modules, "fastcoref", fast)
    fast.FCoref = Broken
    coref.load.cache_clear()
    assert coref.choose() is None
    monkeypatch.setitem(sys.modules, "spacy", spacy)
    monkeypatch.setitem(sys.modules, "spacy_experimental", exp)
    span = types.SimpleNamespace(start_char=1, end_char=4)
    spacy.load = lambda name: lambda text: types.SimpleNamespace(spans={"coref_clusters_1": [span], "other": [span]})
    coref.load.cache_clear()
    assert coref.choose() is coref.SpacyExperimental and coref.load(coref.SpacyExperimental)("x") == [[(1, 4)]]
    fast.FCoref = Works
    coref.load.cache_clear()
    assert coref.choose() is coref.FastCoref and coref.load(coref.FastCoref)("Ada saw her") == [[(0, 3), (8, 11)]]
    coref.load.cache_clear()


def test_texts_by_clusters_or_whole(spark):
    class Clusters:
        module = "stand-in"

        def __call__(self, text):
            if "fail" in text:
                raise ValueError("no")
            at = [i for i in range(len(text)) if text.startswith(("Ada", "she"), i)]
            return [[(i, i + 3) for i in at]] if at else []

    class Whole:
        module = "stand-in"

        def __call__(self, text):
            return text.upper()

    docs = spark.createDataFrame([(1, "Ada ran. Then she sat."), (2, "fail she"), (3, None), (4, "none")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in coref.with_model(Clusters)(docs).collect()}
    assert out == {"1": "Ada ran. Then Ada sat.", "2": "fail she", "3": "", "4": "none"}
    assert {r.doc_id: r.text for r in coref.with_model(Whole)(docs).collect()} == {"1": "ADA RAN. THEN SHE SAT.", "2": "FAIL SHE", "3": "", "4": "NONE"}


def test_evaluation_and_status(spark):
    text = "magnificent engineers visited beautiful cathedrals. it was seen. wonderful musicians admired beautiful cathedrals and magnificent engineers."
    learner = Learner.for_evaluation(spark)
    assert not learner.status()["ready"] and learner.status()["coref_backend"] == "rules" and learner.status()["annotator"] == "shape_sentences"
    with pytest.raises(RuntimeError):
        learner.evaluate()
    learner.run(spark.createDataFrame([(1, text), (2, text.replace("visited", "saw"))], "doc_id long, text string"))
    props = learner.result["propositions"].collect()
    gold = spark.createDataFrame([(p.doc_id, p.seq, p.arg1, p.label, p.arg2) for p in props], "doc_id string, seq long, arg1 string, rel string, arg2 string")
    part = spark.createDataFrame([(p.arg1, p.arg2, p.label) for p in props], "arg1 string, arg2 string, label string").distinct()
    tree = spark.createDataFrame([(p.label, "TOP") for p in props], "label string, parent string").distinct()
    judged = learner.result["relations"].selectExpr("subject", "relation", "object", "true AS correct").distinct()
    e = learner.evaluate(gold, part, tree, judged, compare_no_coref=True)
    assert not [k for k, v in e.items() if isinstance(v, dict) and "error" in v]
    assert {"coreference", "pronoun_free", "drift", "baseline_pairs", "calibration", "calibration_curve", "hits_at_10", "similarity", "tuples", "bcubed", "pairwise", "confusion", "hierarchy", "labelled_precision", "coref_off_vs_on"} == set(e)
    assert e["tuples"]["f1"] == 1.0 and e["labelled_precision"]["labelled_precision"] == 1.0 and e["baseline_pairs"]["pairs"] == learner.result["pairs"].count()
    assert {"entities", "rotations"} <= set(learner.result) and learner.status()["ready"]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    far = types.SimpleNamespace(conf=Conf(), sparkContext=types.SimpleNamespace(master="spark://a:7077"))
    with pytest.raises(RuntimeError):
        scratch.shared_dir(far)
