import pytest

from relata.operators import metrics as M
from relata.sources.export import clean, confusion_text, report

PRED = [("d", 1, "dave", "TAKE_JOB_WITH", "general electric"), ("d", 2, "dave", "STUDY_AT", "stanford"), ("d", 3, "dave", "MARRY", "lucile")]
GOLD = [("d", 1, "dave", "work for", "general electric"), ("d", 2, "dave", "study at", "stanford"), ("d", 3, "bill", "study at", "stanford")]
TUPLES = "doc_id string, seq long, arg1 string, rel string, arg2 string"


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("rel,want", [(0.0, (0.6667, 2, 1, 1)), (0.3, (0.3333, 1, 2, 2))])
def test_tuples(spark, rel, want):
    r = one(M.evaluate_tuples(spark.createDataFrame(PRED, TUPLES), spark.createDataFrame(GOLD, TUPLES), rel_threshold=rel))
    assert (r["precision"], r["tp"], r["fp"], r["fn"]) == want
    assert r["precision"] == r["recall"] == r["f1"] and r["coverage"] == 0.6667 and (r["n_pred"], r["n_gold"]) == (3, 3)


def test_greedy_matching_is_one_to_one_in_order(spark):
    m = spark.createDataFrame([("d", 1, 1), ("d", 2, 1), ("d", 2, 2), ("d", 3, 2), ("e", 1, 9)], "doc_id string, pseq long, gseq long")
    assert sorted(map(tuple, M.greedy_matches(m).collect())) == [("d", 1, 1), ("d", 2, 2), ("e", 1, 9)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], TUPLES)
    r = one(M.evaluate_tuples(none, none))
    assert r["precision"] == r["coverage"] == 0.0 and r["tp"] == 0
    items = spark.createDataFrame([], "pred string, gold string")
    assert one(M.bcubed(items)) == {"precision": 0.0, "recall": 0.0, "f1": 0.0, "n": 0}
    assert one(M.calibration_report(spark.createDataFrame([], "confidence double, correct boolean"))) == {"ece": None, "brier": None, "n": 0}


def test_partitions(spark):
    items = spark.createDataFrame([("A", "EDU"), ("A", "EDU"), ("B", "EMP"), ("A", "EDU"), ("A", None)], "pred string, gold string")
    assert one(M.bcubed(items)) == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "n": 4}
    assert one(M.pairwise_prf(items)) == {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    cells = {(r.gold, r.pred): r.n for r in M.confusion_cells(items).collect()}
    assert cells == {("EDU", "A"): 3, ("EMP", "B"): 1, ("EDU", "B"): 0, ("EMP", "A"): 0}
    assert confusion_text(M.confusion_cells(items)).splitlines()[1].split() == ["EDU", "3", "0"]


def test_agreement(spark):
    r = one(M.partition_agreement(spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B")], "pred string, gold string")))
    assert r == {"precision": 0.0, "recall": 0.0, "pairwise_f1": 0.0, "bcubed_f1": 0.6667, "approx_error": 0.3333, "n_paths": 3}
    singles = spark.createDataFrame([("A", "X"), ("B", "Y")], "pred string, gold string")
    assert one(M.partition_agreement(singles))["approx_error"] == 0.0


def test_hierarchy(spark):
    s = spark.createDataFrame([("STUDY", "AFFILIATE"), ("AFFILIATE", "RELATED"), ("RELATED", None)], "label string, parent string")
    assert one(M.hierarchy_prf(s, s)) == {"precision": 1.0, "recall": 1.0, "f1": 1.0, "n_pred_edges": 2, "n_gold_edges": 2}


def test_calibration(spark):
    rows = [(0.9, i < 6) for i in range(10)] + [(0.5, i < 5) for i in range(10)]
    assert one(M.calibration_report(spark.createDataFrame(rows, "confidence double, correct boolean"))) == {"ece": 0.15, "brier": 0.29, "n": 20}


def test_precision_proxies(spark):
    r = spark.createDataFrame([("he", "R", "ada"), ("ada", "R", "bob"), ("bob", "S", "it")], "subject string, relation string, object string")
    assert one(M.pronoun_free(r)) == {"proxy_precision": 0.333}
    judged = spark.createDataFrame([("ada", "R", "bob", True), ("x", "R", "y", False)], "subject string, relation string, object string, correct boolean")
    assert one(M.labelled_precision(r, judged)) == {"labelled_precision": 1.0}
    assert one(M.labelled_precision(r, judged.limit(0))) == {"labelled_precision": None}


def test_pair_partition_takes_the_last(spark):
    p = spark.createDataFrame([("a", "b", "X", 1), ("a", "b", "Y", 2)], "arg1 string, arg2 string, label string, seq int")
    assert M.pair_partition(p).first().label == "Y"
    assert [r.label for r in M.w_first(p, ["arg1"]).collect()] == ["X"]


def test_payloads():
    assert clean({"a": float("nan"), "b": {3, 1}, "c": (1.5, object)}) == {"a": None, "b": [1, 3], "c": [1.5, str(object)]}
    assert report({"a": {"b": 1}, "c": [2]}) == "a:\n  b: 1\nc:\n  2\n  ---\n"
