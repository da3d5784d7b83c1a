"""What a run leaves on disk, and what it doesn't make at all."""

import pathlib
import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from relata.operators import dirt, induce
from relata.operators import text as X
from relata.plans.learner import Learner
from relata.sources import scratch
from relata.sources.annotate import shape_sentences, with_parser

SF = "/root/testdata/sf0.001"


def _names(folder) -> list[str]:
    return sorted(p.name.split("-", 2)[2] for p in pathlib.Path(folder).iterdir() if p.name.startswith("relata-"))


def test_a_run_leaves_only_tables_that_its_results_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = entry.queries()["complete_pipeline"](spark, SF)
    assert out.count() > 1000
    gone = {"candidates", "digests", "slots", "pmi", "distances", "free", "rest", "profiles", "terms", "weights", "vectors", "close", "roots", "seeds", "fillers", "sets", "facts"}
    assert not gone & set(_names(tmp_path))
    pairs = spark.read.parquet(*[f"file://{p}" for p in tmp_path.iterdir() if p.name.endswith("-pairs")])
    assert dict(pairs.dtypes)["sentence"] == "bigint"  # a key, not the text once more for each pair


def test_results_show_the_sentence_of_each_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    r = Learner.for_evaluation(spark).run(docs, graph=False)
    want = {(x.doc_id, x.sent_id): x.sentence for x in shape_sentences(docs.withColumn("text", F.coalesce("text", F.lit("")))).collect()}
    for table in ("pairs", "propositions"):
        rows = r[table].select("doc_id", "sent_id", "sentence").collect()
        assert rows and all(x.sentence == want[x.doc_id, x.sent_id] for x in rows)
    own = r["relations"].where("source = 'open_ie_induced'").select("doc_id", "evidence").collect()
    said = {(d, s) for (d, _), s in want.items()}
    assert own and all((x.doc_id, x.evidence) in said for x in own)


def test_paths_meet_no_medoid_that_they_share_nothing_with(spark, monkeypatch):
    monkeypatch.setattr(dirt, "nearest_medoid", lambda *a: 1 / 0)  # joins every path of a block with all its medoids
    paths = spark.createDataFrame([(f"p{i}", "A", "B", i, 0.5, True) for i in range(4)], "path string, sx string, sy string, ord int, threshold double, may_lead boolean")
    med = spark.createDataFrame([("M", "m", "A", "B"), ("N", "n", "A", "C")], "label string, medoid string, sx string, sy string")
    dist = spark.createDataFrame([("m", "p0", 0.4), ("m", "p1", 0.6), ("n", "p2", 0.1)], "p string, q string, distance double")
    assert {x.path for x in induce.follow_leaders(paths, med, dist).where("leads").collect()} == {"p1", "p2", "p3"}


def test_distances_of_blocks_in_one_aggregate(spark):
    r = random.Random(7)
    rows = [(s, f"p{i:02d}", f"f{f}", r.random()) for s in "xy" for i in range(30) for f in r.sample(range(40), 6)]
    mi = spark.createDataFrame(rows, "slot string, path string, filler string, mi double")
    block = spark.createDataFrame([(f"p{i:02d}", "A", "AB"[i % 2]) for i in range(28)], "path string, sx string, sy string")
    want = {(x.p, x.q): round(x.distance, 9) for x in dirt.path_distance(dirt.slot_similarity(mi, block)).collect()}
    assert len(want) > 20
    assert {(x.p, x.q): round(x.distance, 9) for x in dirt.block_distances(mi, block).collect()} == want


def test_a_scope_ends_with_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    with scratch.scope() as outer:
        with scratch.scope() as keep:
            kept = keep(scratch.stored(spark.range(3), "kept"))
            scratch.stored(spark.range(3), "inner")
        assert _names(tmp_path) == ["kept"] and kept.count() == 3
        outer(scratch.stored(spark.range(2), "outer"))
    assert _names(tmp_path) == ["outer"]


def test_documents_with_resolved_pronouns_are_read_again(spark):
    def parse(text: str) -> list[dict]:
        """Sentences end at a blank and a full stop; Ada is a person, Rome a place."""
        out, at = [], 0
        for s in text.split(" . "):
            words, toks, ments = s.split(" "), [], []
            for i, w in enumerate(words):
                toks.append(dict(i=i, idx=at, text=w, lemma=w.lower(), pos="VERB" if w == "saw" else "NOUN", dep="ROOT" if i == 0 else "dep", head=max(i - 1, 0), is_stop=False, is_punct=False))
                at += len(w) + 1
                if w in ("Ada", "Rome"):
                    ments.append(dict(start=i, end=i + 1, root=i, text=w, label="PERSON" if w == "Ada" else "GPE"))
            at += 2
            out.append(dict(sentence=s, tokens=toks, mentions=ments, chunks=[]))
        return out

    docs = spark.createDataFrame([("1", "Ada left . then she saw Rome"), ("2", "she saw Rome"), ("3", "Ada saw Rome . it saw Ada")], "doc_id string, text string")
    learner = Learner.for_evaluation(spark, annotate=lambda d: with_parser(d, lambda: parse), resolver="rules")
    text, sents = learner._annotated(docs, learner.resolver)
    assert {tuple(r) for r in text.collect()} == {("1", "Ada left . then Ada saw Rome"), ("2", "she saw Rome"), ("3", "Ada saw Rome . Rome saw Ada")}
    assert [(r.doc_id, r.sent_id, r.sentence) for r in sents.where("sentence is not null").orderBy("doc_id", "sent_id").collect()] == [("1", 1, "then Ada saw Rome"), ("3", 0, "Ada saw Rome"), ("3", 1, "Rome saw Ada")]
    got = {(r.doc_id, r.arg1, r.path, r.arg2, r.sentence) for r in learner.run(docs, graph=False)["propositions"].collect()}
    assert got == {("1", "ada", "saw", "rome", "then Ada saw Rome"), ("3", "ada", "saw", "rome", "Ada saw Rome"), ("3", "rome", "saw", "ada", "Rome saw Ada")}


def test_profiles_take_dependents_on_both_sides(spark):
    tok = lambda i, head, stop=False: dict(i=i, idx=-1, text=f"w{i}", lemma=f"w{i}", pos="NOUN", dep="dep", head=head, is_stop=stop, is_punct=False)
    ment = lambda root, text: dict(start=root, end=root + 1, root=root, text=text, label="X")
    rows = [("d", 0, "s", [tok(0, 1), tok(1, 1), tok(2, 1), tok(3, 1, True), tok(4, 3)], [ment(3, "B"), ment(1, "A"), ment(4, "C")], []), ("d", 1, "s", [tok(0, 0), tok(1, 0)], [ment(0, "a")], []), ("d", 2, "s", None, [], [])]
    s = spark.createDataFrame(rows, "doc_id string, sent_id int, sentence string, tokens array<struct<i:int,idx:int,text:string,lemma:string,pos:string,dep:string,head:int,is_stop:boolean,is_punct:boolean>>, mentions array<struct<start:int,end:int,root:int,text:string,label:string>>, chunks array<struct<start:int,text:string,lemma:string>>")
    got = {r.entity: (r.words, tuple(r.first)) for r in X.context_profiles(s).collect()}
    assert got == {"a": (["w0", "w2", "w1"], (0, 1)), "b": (["w4"], (0, 0)), "c": ([], (0, 2))}
