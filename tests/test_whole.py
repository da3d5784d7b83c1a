"""Queries over whole texts, vectors and tables, against plain Python."""

import hashlib
import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_whole_texts_are_normalised(spark):
    got = {r.doc_id: r.digest for r in entry.queries()["normalize_surface"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    plain = {r.doc_id: re.sub(r"\s+", " ", (r.text or "").lower().replace("’", "'").replace(".", "")).strip(" ") for r in rows}
    assert any("\n" in (r.text or "") for r in rows)
    assert got == {k: hashlib.sha1(v.encode()).hexdigest() for k, v in plain.items()}


def test_whole_vectors_make_the_margin(spark):
    got = {r.vec_id: r.uncertainty for r in entry.queries()["margin_uncertainty"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        s = sorted((x * x for x in r.embedding), reverse=True)
        assert abs(got[r.vec_id] - (1 - (s[0] - s[1]) / sum(s))) < 2e-6


def test_the_whole_pipeline_gets_all_documents(spark, monkeypatch):
    from relata.plans import learner

    class Stub:
        def run(self, docs, graph=True):
            return {"relations": docs.selectExpr("doc_id", "text AS subject", "'' AS relation", "'' AS object", "0.5 AS confidence", "'' AS source")}

    monkeypatch.setattr(learner.Learner, "for_evaluation", lambda spark: Stub())
    got = {(r.doc_id, r.subject) for r in entry.queries()["complete_pipeline"](spark, SF).collect()}
    assert got == {(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_glosses_of_documents(spark, tmp_path):
    rows = [(1, "one\nsays World Trade Board (WTB) met"), (2, None), (3, "ZFO (Zonal Field Office) did")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "KENYA")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    got = {(r.doc_id, r.alias, r.canonical) for r in entry.queries()["acronym_gloss"](spark, str(tmp_path)).collect()}
    assert got == {("1", "wtb", "world trade board"), ("3", "zfo", "zonal field office"), ("nation 0", "ketb", "kenya trade board"), ("nation 0", "ken", "kenya office")}
