"""Fingerprints, line dedup, decontamination, Jaccard join and quality against brute force."""

import re

import brute
import pytest
from conftest import SF, corpus, prose
from pyspark.sql import functions as F

from relata.llm import decontam, fingerprints, jaccard, linededup, quality
from relata.llm.common import id_bucket, load
from relata.llm.components import components


# ---- 1 ----------------------------------------------------------------------------------------------------------------------


def test_edited_texts_equal_brute_force(docs, docs_rows):
    out = {r.doc_id: r for r in fingerprints.imatch(docs).collect()}
    want = brute.edited(docs_rows)
    assert {d: (r.n_chars, r.edited_sha256) for d, r in out.items()} == want
    by_text = {}
    for d, t in docs_rows:
        by_text.setdefault(t or "", set()).add(out[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())
    ids = sorted(out, reverse=True)
    text = dict(docs_rows)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        if (text[a] or "") == (text[b] or ""):
            assert out[a].near_next == 1.0


@pytest.mark.parametrize("low,high", [(0.001, 0.05), (0.03, 0.5)])
def test_fingerprints_equal_brute_force(docs, docs_rows, low, high):
    got = {r.doc_id: (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.imatch(docs, df_low=low, df_high=high).collect()}
    want = brute.imatch(docs_rows, low, high)
    assert {d: x[:2] for d, x in got.items()} == {d: x[:2] for d, x in want.items()}
    assert all(got[d][2:] == pytest.approx(x[2:]) for d, x in want.items())
    assert any(0 < x[2] < 1 for x in want.values()) and any("-" in x[0] for x in want.values())


def test_equal_ids_and_single_rows(spark, none):
    assert fingerprints.imatch(none).count() == 0
    one = fingerprints.imatch(spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(5, 1.0)]
    rows = [(None, "x"), (1, "b"), (1, "a"), (1, "a")]
    assert fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_similar_texts_are_nearer_than_others(spark):
    import random

    r = random.Random(3)
    base = [prose(r, 300, 3000) for _ in range(60)]
    rows = [(2 * i, t) for i, t in enumerate(base)] + [(2 * i + 1, t.replace("w1", "v1", 2)) for i, t in enumerate(base)]
    out = {x.doc_id: x for x in fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string"), df_high=0.9).collect()}
    near = sorted(out[2 * i + 1].near_next for i in range(60))
    far = sorted(out[2 * i].near_next for i in range(1, 60))
    assert near[30] > 0.5 and far[-5] < 0.2


def test_id_ranges_follow_the_order(spark):
    ids = [(i**3,) for i in range(5000)] + [(2**60,), (-(2**63),)]
    df = spark.createDataFrame(ids, "k long")
    rows = df.select("k", id_bucket(df, "k", rows_per_bucket=50, splits=16).alias("b")).orderBy("k").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and len({r.b for r in rows}) > 20


def test_hot_ids_have_ranges_of_their_own(spark):
    from collections import Counter

    from relata.llm.common import id_ranges

    rows = [(i * 7, f"t{i}") for i in range(300)] + [(700, f"u{i}") for i in range(400)] + [(-(2**63), "same")] * 300 + [(2**63 - 1, "same")] * 90 + [(2**63 - 1, f"v{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "_key long, text string").repartition(7)
    out = id_ranges(df, rows_per_bucket=16)
    got = out.collect()
    assert sorted((r._key, r.text) for r in got) == sorted(rows)
    order = sorted((r._bucket, r._key, r._h) for r in got)
    assert [x[1:] for x in order] == sorted(x[1:] for x in order)  # ranges agree with the order of key and hash
    assert max(Counter(r._bucket for r in got).values()) < 90
    assert len({r._bucket for r in id_ranges(df.limit(0), rows_per_bucket=16).collect()}) == 0
    equal = Counter(r._bucket for r in id_ranges(spark.createDataFrame([(5, "x")] * 40, "_key long, text string"), rows_per_bucket=4).collect())
    assert 5 <= len(equal) <= 10 and max(equal.values()) < 16


def test_hot_ids_in_fingerprints_and_token_files(spark, monkeypatch):
    from collections import Counter

    from relata.llm import common, tokenfiles
    from relata.llm.common import fresh_dir

    whole = common.id_ranges
    for m in (fingerprints, tokenfiles):
        monkeypatch.setattr(m, "id_ranges", lambda df, *a: whole(df, *a, rows_per_bucket=8))
    rows = [(i, f"word{i} and word{i + 1} again") for i in range(60)] + [(None, f"null {i} text") for i in range(50)] + [(7, "copy of seven")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = fingerprints.imatch(df, df_low=0.001, df_high=0.9).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    seven = [r for r in out if r.doc_id == 7 and r.n_chars == len("copy of seven")]
    assert len(seven) == 60 and sum(r.near_next == 1.0 for r in seven) >= 59  # each but the last is followed by a copy
    folder = fresh_dir(spark, "hot")
    got = sorted(map(tuple, tokenfiles.read_documents(spark, folder, tokenfiles.write_ids(df, folder)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(-(2**63) if r[0] is None else r[0] for r in rows)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]


# ---- 2 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,min_words", [(0, 50), (1, 50), (2, 8), (3, 1)])
def test_line_dedup_equals_brute_force(spark, seed, min_words):
    rows = corpus(seed, 50)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_lines int").repartition(4)
    out = linededup.dedup_lines(df.drop("n_lines"), min_words=min_words)
    assert {r.doc_id: r.text for r in out.collect()} == brute.dedup_lines(rows, min_words)


def test_line_dedup_of_runs_inside_a_document(spark):
    line = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    rows = [(1, "\n".join([line, other, line, other, "end", other])), (2, f"x\n{other}\nend")]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == f"{line}\n{other}\nend\n{other}" and out[1].n_deleted == 2 and out[1].n_lines == 6
    assert {d: r.text for d, r in out.items()} == brute.dedup_lines(rows)


def test_line_dedup_edges(spark, none):
    assert linededup.dedup_lines(none).count() == 0
    long = prose(__import__("random").Random(1), 60)
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None)]
    out = sorted(((r.doc_id or -1), r.text or "") for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(-1, long), (1, ""), (1, ""), (2, ""), (3, "")]  # the null id is first; equal rows are one document


def test_line_dedup_joins_only_what_is_deleted(spark):
    long, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 30), ("b", 19)))
    odd = " \t" + short + "\u00a0x \f "  # white space is ASCII's: 19 words
    rows = [(1, f"{long}\n{short}\n\nend"), (2, f"x\n{long}\n{short}\n\ny"), (3, f"{short}\nz\n{long}"), (4, f"{odd}\n{long}"), (5, f"\n{odd}\n{long}\n"), (6, None), (2, f"x\n{long}\n{short}\n\ny")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, source string").repartition(3)
    runs = {n: {r._d: [tuple(x) for x in r._runs] for r in linededup.repeated_runs(df, min_words=n).collect()} for n in (49, 50, 1)}
    assert runs[49] == {2: [(1, 3)], 5: [(1, 2)]} and runs[50] == {}  # all others have shorter runs
    assert runs[1] == {2: [(1, 3)], 3: [(0, 1), (2, 1)], 4: [(1, 1)], 5: [(1, 2)]}
    plan = linededup.dedup_lines(df, min_words=49)._jdf.queryExecution().optimizedPlan().toString()
    rows_of = re.findall(r"struct\(([^()]*)\) AS _row#", plan)
    assert rows_of and not any("text#" in x for x in rows_of)  # the text is not in the row's struct once more
    assert "Union" in plan  # texts without runs are not joined


@pytest.mark.parametrize("places", [64, 128])
def test_line_dedup_where_documents_share_a_bit(spark, monkeypatch, places):
    monkeypatch.setattr(linededup, "_PLACES", places)
    rows = corpus(4, 60)
    out = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_words=20)
    assert {r.doc_id: r.text for r in out.collect()} == brute.dedup_lines(rows, 20)


def test_line_dedup_is_native(docs):
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 3 ----------------------------------------------------------------------------------------------------------------------


def bench_rows(docs_rows):
    texts = [t for _, t in docs_rows if t and len(t.split()) > 40]
    w = texts[3].split()
    return [(1, " ".join(w[5:25]).upper()), (2, "one two"), (3, None), (4, "..."), (5, " ".join(texts[7].split()[:13])), (6, "w1"), (7, " ".join(w[5:25])), (10, "two one " * 9), (11, "é")]


@pytest.mark.parametrize("most_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, docs, docs_rows, most_bytes):
    bench = bench_rows(docs_rows)
    df = spark.createDataFrame(bench, "item_id long, text string")
    out = decontam.contamination(docs, df, most_bytes=most_bytes)
    assert {"doc_id", "text", "score"} <= set(out.columns)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()}
    assert got == brute.contamination(docs_rows, bench)


def test_contamination_edges(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, empty).where("contaminated or n_hit > 0").count() == 0
    assert decontam.contamination(none, empty).count() == 0
    rows = spark.createDataFrame([(1, "a b c " * 40), (1, "a b c " * 40), (None, None)], "doc_id long, text string")
    item = spark.createDataFrame([(9, "b c a b c a b c a b c a b c"), (9, "b c a b c a b c a b c a b c")], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(rows, item, keep_text=False).collect()) == [(0, 0, 0), (120, 119, 1), (120, 119, 1)]


def test_shift_table_skips():
    t = decontam.build_patterns([("1", " ".join(f"w{i}" for i in range(13)))])[0]
    assert (t.shift == 12).mean() > 0.99 and (t.shift == 0).sum() == 1


# ---- 6 ----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,block", [(0, 1024), (5, 3)])
def test_similar_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.similar(df).collect()}
    want = brute.similar(rows)
    assert got == want
    assert any(n > 2 for _, n in want.values())


def test_similar_edges(spark, none):
    assert jaccard.similar(none).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "zz"), (2, None), (3, ""), (None, "A, b c d e f")]
    out = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    low = -(2**63)
    assert out == [(low, low, 2), (1, low, 2), (1, low, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        b, r = jaccard.choose_bands(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and b * r <= 128
        assert 1 - (1 - t ** (r + 1)) ** (128 // (r + 1)) < recall


def test_components(spark):
    import random

    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.vertex: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}


# ---- 10 ---------------------------------------------------------------------------------------------------------------------


def test_quality_finds_junk_that_was_held_out(spark):
    d, y = load(spark, "/root/testdata/sf0.01", "documents"), load(spark, "/root/testdata/sf0.01", "labels")
    out = quality.score(d.select("doc_id", "text"), y).drop("text")
    j = out.join(y.select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in j) / len(j) > 0.95
    junk = [r for r in j if r.quality == 0]
    assert len(junk) > 5 and sum(r.predicted == 0 for r in junk) / len(junk) > 0.8


def test_quality_never_learns_from_held_out_rows(spark):
    import zlib

    d, y = load(spark, SF, "documents"), load(spark, SF, "labels")
    held = [r.doc_id for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    a = quality.score(d.select("doc_id", "text"), y)
    turned = y.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.score(d.select("doc_id", "text"), turned)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(r.doc_id for r in a.where("held_out").collect()) == sorted(held)


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.score(docs, labels)
    assert out.where("score <> 0.5 or predicted <> 1").count() == 0 and out.columns.count("score") == 1
    some = spark.createDataFrame([(i, i % 2) for i in range(-20, 100)] + [(None, 1), (5, None)], "doc_id long, quality int")
    scored = quality.score(docs, some).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert quality.score(none, some).count() == 0


def test_features_frequencies_and_votes_equal_brute_force(spark, docs, docs_rows):
    import numpy as np
    import pyarrow as pa

    texts = [t or "" for _, t in docs_rows][:60] + ["THIS is 12\tOK!! ß", "", "no", "no"]
    raw = quality.features(pa.array(texts))
    want = [brute.quality_features(t, quality.WORDS, quality.SHAPES) for t in texts]
    assert [{int(i): int(x[i]) for i in np.flatnonzero(x)} for x in raw] == want
    n, df = quality.document_frequencies(docs)
    every = [brute.quality_features(t or "", quality.WORDS, quality.SHAPES) for _, t in docs_rows]
    counted = np.zeros(quality.DIMENSIONS, int)
    for x in every:
        counted[list(x)] += 1
    assert n == len(docs_rows) and (df == counted).all()
    labels = np.arange(len(texts)) % 3 > 0
    model = quality.Model(raw, labels.astype(np.float32), df, n, latent=16, neighbours=5)
    u, s, v = np.linalg.svd(quality.weigh(raw, model.idf), full_matrices=False)
    assert np.allclose(np.abs((model.axes.T @ v[:16].T)), np.eye(16), atol=0.05)  # the leading singular vectors
    got = model.scores(raw, block=7)
    points = (quality.weigh(raw, model.idf) @ model.axes).astype(float).tolist()
    for i in range(len(texts)):
        assert got[i] == pytest.approx(brute.vote(points[i], points, labels.astype(int).tolist(), 5, model.power), abs=1e-3)


def test_names_in_any_case_and_with_signs(spark):
    odd = spark.createDataFrame([(1, "a b", "x", 2, 3.0, 4), (2, None, None, None, None, None)], "doc_id long, TEXT string, `a``b c` string, N_words int, Score double, _d int")
    items = spark.createDataFrame([(9, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    same = ["doc_id", "TEXT", "a`b c"]
    for most in (1 << 20, 2):
        out = decontam.contamination(odd, items, most_bytes=most)
        assert out.columns == [*same, "Score", "_d", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted((r.doc_id, r["a`b c"] or "", r.Score or 0, r._d or 0, r.n_words, r.contaminated) for r in out.collect()) == [(1, "x", 3.0, 4, 2, True), (2, "", 0, 0, 0, False)]
    out = quality.score(odd, labels)
    assert out.columns == [*same, "N_words", "_d", "held_out", "score", "predicted"]
    assert sorted((r.doc_id, r["a`b c"] or "") for r in out.collect()) == [(1, "x"), (2, "")]
    lines = odd.withColumnRenamed("N_words", "N_Lines")
    out = linededup.dedup_lines(lines)
    assert out.columns == [*same, "Score", "_d", "n_lines", "n_deleted", "deleted_runs"]
    assert sorted((r.doc_id, r._d or 0, r.n_lines, r.TEXT) for r in out.collect()) == [(1, 4, 1, "a b"), (2, 0, 0, None)]


def test_signature_ties_equal_brute_force():
    import numpy as np

    r = np.random.default_rng(3)
    for tied, core in ((0.55, 0.95), (0.5, 1.1), (0.9, 0.9)):
        sig = r.integers(0, 3, (60, 40), dtype=np.uint8)
        for i in range(0, 60, 3):
            sig[i] = np.where(r.random(40) < r.random() * 0.6, sig[i], sig[r.integers(60)])
        got = jaccard.tied_parts(sig, tied, core)
        near = (sig[:, None] == sig[None]).mean(axis=2)
        root = np.arange(60)
        for _ in range(60):
            root = np.where(near >= tied, root[None], 60).min(axis=1)
        # parts may only be finer where no pair within the core's reach is cut
        for i in range(60):
            for j in range(60):
                if near[i, j] >= tied + max(0, 1 - core):
                    assert got[i] == got[j]
                if got[i] == got[j]:
                    assert root[i] == root[j]


def test_many_null_and_repeated_rows_are_linear(spark):
    rows = [(None, f"w{i} " * 3 + " ".join(f"v{i}_{k}" for k in range(30))) for i in range(150)] * 2 + [(7, "a b c d e f")] * 200
    out = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.where("doc_id = 7").select("n_links").distinct().collect()[0][0] == 199
    assert out.where("doc_id <> 7").select("n_links").distinct().collect()[0][0] == 1 and out.count() == 500
