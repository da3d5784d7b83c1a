import json

import pytest

from relata.operators import induce, labels, pathstats
from relata.sources import gold, stores
from relata.sources.export import concepts_csv, embeddings_csv, propositions_csv, relations_csv, similarity_csv
from relata.streaming.ingest import Ingest

PROPS = "path string, arg1 string, type1 string, arg2 string, type2 string"


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_path_log(spark, tmp_path):
    a = {"path": "met", "support": 2, "x": {"ada": 2}, "y": {"bob": 1, "eve": 1}, "tx": {"P": 2}, "ty": {"P": 2}}
    log = lines(tmp_path / "log", a, "", "{broken", {"doc_id": "d1"}, {k: v for k, v in a.items() if k != "support"}, {"doc_id": "d1"})
    counts, ledger = stores.read_path_log(spark, log)
    assert {(r.slot, r.filler): r.n for r in counts.collect()} == {("x", "ada"): 4, ("y", "bob"): 2, ("y", "eve"): 2, ("tx", "P"): 4, ("ty", "P"): 4}
    assert [r.digest for r in ledger.collect()] == ["d1"]
    assert stores.read_path_support(spark, log).first().support == 4
    stores.write_path_log(counts, ledger, str(tmp_path / "copy"))
    again, _ = stores.read_path_log(spark, str(tmp_path / "copy"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, counts.collect()))


def test_label_log_takes_the_last_line(spark, tmp_path):
    log = lines(tmp_path / "log", {"key": "a", "label": "X", "source": "oracle"}, "nonsense", {"label": "no key"}, {"key": "a", "label": "Y", "source": "oracle"}, {"key": "b", "label": "Z"})
    assert {r.key: r.label for r in stores.read_label_log(spark, log).collect()} == {"a": "Y", "b": "Z"}


def test_label_log_compaction(spark, tmp_path):
    from relata.schemas import LABELS

    path = str(tmp_path / "labels")
    row = lambda key, label: (key, label, "oracle", "a", "b", "P", "P", "", "none", 0.0)
    for x in ("X", "Y"):
        stores.append_label_log(spark.createDataFrame([row("k", x)], LABELS).coalesce(1), path)
    kept = spark.createDataFrame([row("k", "Y"), row("l", "Z")], LABELS)
    stores.compact_label_log(kept, path)
    assert {r.key: r.label for r in stores.read_label_log(spark, path).collect()} == {"k": "Y", "l": "Z"}
    assert spark.read.text(path).count() == 2


@pytest.mark.parametrize("kept", [False, True])
def test_path_store(spark, tmp_path, kept):
    s = stores.PathStore(spark, str(tmp_path / "store") if kept else None, compact_every=2)
    p = spark.createDataFrame([("met", "ada", "P", "bob", "P")], PROPS)
    for d in ("d1", "d2", "d3"):
        s.add(p, spark.createDataFrame([(d,)], "digest string"))
    assert {r.slot: r.n for r in s.slot_counts().collect()} == {"x": 3, "y": 3, "tx": 3, "ty": 3}
    assert {"d1", "d2", "d3"} <= {r.digest for r in s.digests().collect()}
    if kept:
        again = stores.PathStore(spark, str(tmp_path / "store"))
        assert pathstats.support_of(again.slot_counts()).first().support == 3


def test_counts_without_a_ledger_entry_do_not_count(spark, tmp_path):
    s = stores.PathStore(spark, str(tmp_path / "store"))
    p = spark.createDataFrame([("met", "ada", "P", "bob", "P")], PROPS)
    s.add(p, spark.createDataFrame([("d1",)], "digest string"))
    from pyspark.sql import functions as F

    s.counts.append(pathstats.slot_counts(p).withColumn("batch", F.lit("unfinished")))
    assert pathstats.support_of(s.slot_counts()).first().support == 1


def test_a_dead_batch_does_not_come_back_by_compaction(spark, tmp_path):
    from pyspark.sql import functions as F

    s = stores.PathStore(spark, str(tmp_path / "store"), compact_every=3)
    p = spark.createDataFrame([("met", "ada", "P", "bob", "P")], PROPS)
    s.counts.append(pathstats.slot_counts(p).withColumn("batch", F.lit("unfinished")))
    for i in range(1, 9):
        s.add(p, spark.createDataFrame([(f"d{i}",)], "digest string"))
        assert pathstats.support_of(s.slot_counts()).first().support == i
        assert len(s.counts.batches()) < 3 and len(s.ledger.batches()) <= 3
        assert len([f for f in (tmp_path / "store").iterdir() if f.is_dir()]) <= 10
    assert sorted(r.digest for r in s.digests().collect()) == [f"d{i}" for i in range(1, 9)]


def test_a_read_error_never_empties_the_labels(spark, tmp_path, monkeypatch):
    from relata.plans import learner
    from relata.schemas import LABELS

    path = str(tmp_path / "labels")
    row = lambda key, label, source: (key, label, source, "a", "b", "P", "P", "", "none", 0.0)
    stores.append_label_log(spark.createDataFrame([row("k", "X", "oracle"), row("l", "Y", "induced_seed_pos")], LABELS), path)

    def broken(*a):
        raise OSError("no answer")

    with monkeypatch.context() as m:
        m.setattr(learner, "read_label_log", broken)
        with pytest.raises(OSError):
            learner.Learner(spark, labels_path=path)
    assert {r.key: r.label for r in learner.Learner(spark, labels_path=path).records.collect()} == {"k": "X", "l": "Y"}
    assert learner.Learner(spark, labels_path=str(tmp_path / "none")).records.isEmpty()
    # what others wrote in the meantime stays: keys that aren't here, and human labels
    stores.append_label_log(spark.createDataFrame([row("m", "Z", "oracle"), row("l", "H", "oracle")], LABELS), path)
    stores.compact_label_log(spark.createDataFrame([row("k", "X2", "oracle"), row("l", "Y2", "induced_seed_pos")], LABELS), path)
    assert {r.key: r.label for r in stores.read_label_log(spark, path).collect()} == {"k": "X2", "l": "H", "m": "Z"}
    stores.compact_label_log(spark.createDataFrame([], LABELS), path)
    assert stores.read_label_log(spark, path).count() == 3


def test_documents_that_share_names_stay_apart(spark):
    from relata.schemas import LABELS

    pairs = [(d, i, "ada", "P", "bob", "Q", c, 0.7) for d, i, c in (("d1", 1, "met"), ("d2", 1, "saw"), ("d3", 1, "met"))] + [("d1", 2, "x", "P", "y", "P", "or", 0.7), ("d2", 2, "x", "P", "z", "P", "or", 0.7), ("d2", 3, "y", "P", "z", "P", "or", 0.7), ("d3", 2, "x", "P", "w", "P", "or", 0.7)]
    props = [("d1", 1, "ada", "P", "bob", "Q", "MET", 0.5, False), ("d2", 1, "bob", "Q", "ada", "P", "SAW", 0.6, False), ("d3", 1, "ada", "P", "bob", "Q", "KNEW", 0.4, True)]
    negatives = [("d1", "x", "y"), ("d2", "x", "z"), ("d2", "y", "z"), ("d3", "w", "x")]
    found = []
    for n in (1, 5):
        p = spark.createDataFrame(pairs, "doc_id string, seq long, entity1 string, type1 string, entity2 string, type2 string, context string, confidence double").repartition(n)
        q = spark.createDataFrame(props, "doc_id string, seq long, arg1 string, type1 string, arg2 string, type2 string, label string, confidence double, negated boolean").repartition(n, "label")
        neg = spark.createDataFrame(negatives, "doc_id string, lo string, hi string").repartition(n)
        tags = sorted((r.doc_id, r.seq, r.frame_agreement, r.confidence) for r in labels.tag_pairs(p, q).collect())
        out = labels.seed(spark.createDataFrame([], LABELS), p, labels.induced_examples(q), neg)
        found.append((tags, sorted((r.key, r.label, r.source) for r in out.collect())))
    assert found[0] == found[1]
    tags, seeds = found[0]
    assert [t[2] for t in tags if t[1] == 1] == ["MET", "SAW", "KNEW"]
    weak = "induced_seed_neg"
    assert seeds == sorted([("ada|bob|met", "MET", "induced_seed_pos"), ("bob|ada|saw", "SAW", "induced_seed_pos"), ("x|y|or", "NO_RELATION", weak), ("x|z|or", "NO_RELATION", weak), ("x|w|or", "NO_RELATION", weak)])


def test_state_round_trip(spark, tmp_path):
    tables = {"labels": [("met", "MET")], "medoids": [("MET", "met", "P", "Q")], "cohesion": [("MET", 0.5)], "previous": [("met", "met", "MET")], "support": [("met", 7)]}
    made = {t: spark.createDataFrame(rows, induce.TABLES[t]) for t, rows in tables.items()}
    a = induce.State(**made, thresholds={("P", "Q"): 0.3}, smoothed={("P", "Q"): 0.4}, reference=0.2, calibration={3: (1, 2)}, median=7.0, n_medoids=1, fits=2, singletons=1)
    path = str(tmp_path / "state")
    for _ in range(3):
        stores.save_state(a, path, spark)
        b = stores.load_state(path, spark)
        for name, rows in tables.items():
            assert [tuple(r) for r in getattr(b, name).collect()] == rows
        assert (b.thresholds, b.smoothed, b.reference, b.calibration, b.median, b.n_medoids, b.fits, b.singletons) == (a.thresholds, a.smoothed, a.reference, a.calibration, a.median, 1, 2, 1)
        a = b  # a state that reads from the version before can be saved again
    (tmp_path / "state" / "manifest.json").write_text("{broken")
    for f in (tmp_path / "state").glob(".manifest*.crc"):
        f.unlink()
    assert stores.load_state(path, spark) == induce.State()
    assert stores.load_state(None, spark) == stores.load_state(str(tmp_path / "none"), spark) == induce.State()


def test_gold_readers(spark, tmp_path):
    tsv = lines(tmp_path / "t.tsv", "a b\tA\tr\tB\textra", "short\tA", "a b\tC\ts\tD")
    assert [(r.sentence, r.arg1, r.rel, r.arg2) for r in gold.read_tuples(spark, tsv).orderBy("seq").collect()] == [("a b", "A", "r", "B"), ("a b", "C", "s", "D")]
    docs = [{"title": "T", "vertexSet": [[{"name": "Ada  X"}], [{"name": "Bob"}], []], "labels": [{"h": 0, "t": 1, "r": "P1"}, {"h": 0, "t": 2, "r": "P2"}, {"h": 0, "t": 9, "r": "P2"}, {"h": 0, "t": 1, "r": "P3"}]}, {"title": "U"}]
    triples, part = gold.read_document_relations(spark, lines(tmp_path / "d.json", json.dumps(docs)))
    assert [(r.title, r.arg1, r.rel, r.arg2) for r in triples.orderBy("seq").collect()] == [("T", "ada x", "P1", "bob"), ("T", "ada x", "P3", "bob")]
    assert [tuple(r) for r in part.collect()] == [("ada x", "bob", "P3")]
    w = lines(tmp_path / "w.json", json.dumps([{"arg1": "A", "arg2": "B", "relation": "r"}, {"arg1": "A", "arg2": ""}, {"arg1": "a", "arg2": "b", "relation": "s"}]))
    assert [tuple(r) for r in gold.read_partition(spark, w).collect()] == [("a", "b", "s")]


def test_csv_sinks(spark, tmp_path):
    concepts_csv(spark.createDataFrame([("a", "P", "A", 0.9, ["NER", "X"])], "concept string, type string, surface string, confidence double, sources array<string>"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().sources == "NER,X"
    relations_csv(spark.createDataFrame([("a", "R", "b", 0.5, "s", "e, f")], "subject string, relation string, object string, confidence double, source string, evidence string"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().evidence == "e, f"
    propositions_csv(spark.createDataFrame([("a", "P", "L", "b", "Q", "x→y", False, "s")], "arg1 string, type1 string, label string, arg2 string, type2 string, path string, negated boolean, sentence string"), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == ["arg1", "type1", "relation", "arg2", "type2", "path", "negated", "sentence"]
    embeddings_csv(spark.createDataFrame([("a", [0.5, 1.5])], "entity string, embedding array<double>"), str(tmp_path / "e"), 2)
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).first().dim_1 == "1.5"
    similarity_csv(spark.createDataFrame([("a", "b", 0.123456)], "entity string, other string, similarity double"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first().similarity == "0.1235"


def test_stream_ingests_each_text_once(spark, tmp_path):
    text = "magnificent engineers visited beautiful cathedrals. wonderful musicians admired beautiful cathedrals."
    src = str(tmp_path / "in")
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    docs.write.parquet(src)
    job = Ingest(spark, str(tmp_path / "mem"))
    for _ in range(2):
        q = job.stream(spark.readStream.schema(docs.schema).parquet(src), str(tmp_path / "check"))
        q.awaitTermination()
        assert q.exception() is None
        spark.createDataFrame([(3, text)], "doc_id long, text string").write.mode("append").parquet(src)
    n = {r.path: r.support for r in pathstats.support_of(job.store.slot_counts()).collect()}
    assert n and set(n.values()) == {1} and job.passes == ["full"]
    later = Ingest(spark, str(tmp_path / "mem"))
    assert sorted(map(tuple, later.state.labels.collect())) == sorted(map(tuple, job.state.labels.collect()))
    assert later.batch(docs).count() == 0


def test_seeding_keeps_human_labels_and_caps_negatives(spark):
    from relata.schemas import LABELS

    pairs = spark.createDataFrame([("d", 1, "ada", "P", "bob", "P", "met", 0.7), ("d", 2, "eve", "P", "ada", "P", "and", 0.7), ("d", 3, "x", "P", "y", "P", "or", 0.7), ("d", 4, "y", "P", "z", "P", "or", 0.7)], "doc_id string, seq long, entity1 string, type1 string, entity2 string, type2 string, context string, confidence double")
    examples = spark.createDataFrame([("bob", "ada", "MET", "", "MET", 0.5, "P", "P", 1), ("k", "l", "R", "", "R", 0.5, "A", "B", 2)], "entity1 string, entity2 string, relation string, context string, frame_agreement string, confidence double, type1 string, type2 string, seq long")
    neg = spark.createDataFrame([("d", "ada", "eve"), ("d", "x", "y"), ("d", "y", "z")], "doc_id string, lo string, hi string")
    human = spark.createDataFrame([("eve|ada|and", "KNOWS", "oracle", "eve", "ada", "P", "P", "and", "none", 0.0)], LABELS)
    out = {r.key: (r.label, r.source) for r in labels.seed(human, pairs, examples, neg).collect()}
    assert out == {"eve|ada|and": ("KNOWS", "oracle"), "bob|ada|met": ("MET", "induced_seed_pos"), "k|l|": ("R", "induced_seed_pos"), "x|y|or": ("NO_RELATION", "induced_seed_neg")}
