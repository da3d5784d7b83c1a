"""The stages against brute force, each on its own input, and the registered queries on the smallest tables."""

import brute
import pytest
from conftest import SF, corpus
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from relata.llm.common import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(d, t, "en", "s", len(t or "")) for d, t in corpus(9, 60)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "packing"] and P.ORACLE_SQL is None


def test_line_dedup_stage(spark, small):
    rows, df = small
    out = P.line_dedup(spark, df, SF)
    assert out.columns == df.columns
    want = brute.dedup_lines([r[:2] for r in rows])
    text = {r[0]: r[1] for r in rows}
    got = {r.doc_id: r for r in out.collect()}
    gone = {d for d in text if d not in got}
    assert all(text[d] and want[d] == "" for d in gone) and gone
    assert {d: r.text for d, r in got.items()} == {d: want[d] for d in got}
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def test_near_duplicates_stage(spark, small):
    rows, df = small
    kept = sorted(r.doc_id for r in P.near_duplicates(spark, df.unionByName(df.where("doc_id = -20")), SF).collect())
    classes = brute.similar([r[:2] for r in rows])
    assert kept == sorted({c for c, _ in classes.values()})


def test_quality_and_contamination_stages(spark):
    d = load(spark, SF, "documents")
    kept = P.quality(spark, d, SF)
    assert kept.columns == d.columns and 0.8 * d.count() < kept.count() < d.count()
    clean = P.decontaminate(spark, d, SF)
    truth = brute.contamination([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()])
    assert {r.doc_id for r in clean.collect()} == {k for k, v in truth.items() if not v[4]}


def test_stages_of_an_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        out = stage(spark, df, SF)
        assert out.count() == 0


def test_run_packs_what_the_stages_keep(spark):
    docs = load(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    out = P.run(spark, SF)
    assert sorted(r.doc_id for r in out.select("doc_id").distinct().collect()) == sorted(r.doc_id for r in docs.collect())
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert fill <= 2048


def test_queries_are_registered(spark):
    q = entry.queries()
    assert sum(n.startswith("op") for n in q if n[2:3].isdigit()) == 10 and "pipeline" in q
    n = load(spark, SF, "documents").count()
    for name in ("op1_imatch", "op2_line_dedup", "op3_decontaminate", "op6_ngram_jaccard", "op7_token_files", "op10_quality_knn"):
        assert q[name](spark, SF).count() == n
    assert q["op9_warc"](spark, SF).count() == q["op4_html_text"](spark, SF).count() == load(spark, SF, "pages").count()
    assert q["op5_chat_tree"](spark, SF).count() == load(spark, SF, "conversations").select("conv_id").distinct().count() + 1
