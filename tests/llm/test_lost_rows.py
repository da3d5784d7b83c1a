"""Cases in which rows or parts of texts were lost, or copies stayed."""

import duckdb
from conftest import SF

import __spark_entry__ as entry
import corpus_pipeline as P
from relata.llm import decontam, fingerprints, htmltext, warc
from relata.llm.common import fresh_dir


def _words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c, d = _words(0, 60), _words(100, 160), _words(200, 260), _words(300, 360)
    rows = [(1, a), (5, a + " more"), (5, b), (None, c), (None, c + " x"), (None, c + " y"), (None, d), (7, d + " z"), (8, None), (8, ""), (8, d + " q"), (8, ""), (9, "\n")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, df, SF).collect()]
    of_c = [x for x in got if x[1] and x[1].startswith(c)]
    assert len(of_c) == 1 and of_c[0] in rows
    assert sorted(map(str, set(got) - set(of_c))) == sorted(map(str, [(1, a), (5, b), (None, d), (8, None), (8, ""), (9, "\n")]))
    assert len(got) == 7


def test_near_copies_of_a_large_group_have_like_fingerprints(spark):
    import random

    r = random.Random(5)
    base = [f"g{i}" for i in range(200)]
    rows = []
    for i in range(40):  # a third of 120 rows
        w = list(base)
        w[r.randrange(200)] = f"v{i % 3}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{r.randrange(4000)}" for _ in range(200))) for i in range(80)]
    out = {x.doc_id: x for x in fingerprints.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(out[i].fingerprint.startswith("t") for i in range(40))
    near = sorted(out[i].near_next for i in range(1, 40))
    assert near[0] > 0.5
    assert min(out[i].near_edited for i in range(40)) > 0


def test_one_very_long_paragraph_keeps_the_others():
    short = [f"{i} " + "s" * 97 for i in range(19)]
    for at in (0, 10, 19):
        paragraphs = [*short[:at], "long " * 1000 + "end", *short[at:]]
        body = "".join(f"<p>{x}</p>" for x in paragraphs)
        assert htmltext.main_text(f"<body>{body}</body>") == "\n".join(paragraphs)
        inner = body.replace("<p>5 ", "<div class=ad>buy</div><p>5 ")
        page = f"<body><nav><p>menu</p></nav><div><a>in</a></div><div><h1>Title</h1>{inner}<ul><li>point</li></ul></div><div>by us</div></body>"
        assert htmltext.main_text(page) == "\n".join(["Title", *paragraphs, "point"])


def test_warc_null_page_ids(spark):
    rows = [(None, "http://a.b/", "x"), (1, "http://a.b/", "x"), (None, "http://a.b/", "y"), (None, None, None), (-(2**63), "u", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = fresh_dir(spark, "test-warc")
    out = warc.look_up(df, warc.build_index(warc.write_archives(df, folder), folder, 1), folder).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out))) == sorted(map(str, [(None, 1, "revisit", 1), (1, 1, "response", None), (None, 1, "response", None), (None, 0, "response", None), (-(2**63), 1, "response", None)]))


def test_items_without_an_id_are_searched(spark):
    a, b, c = _words(0, 13), _words(20, 33), _words(40, 53)
    docs = spark.createDataFrame([(1, a), (2, a + " " + b), (3, c), (4, _words(60, 90)), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, a), (7, b), (None, c), (None, c)], "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        con.register(name, df.toArrow())
    want = sorted(con.execute(entry.oracle_sql()["op3_decontaminate"]).fetchall())
    for most in (1 << 20, 40):
        out = decontam.contamination(docs, bench, most_bytes=most)
        got = sorted(tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
        assert got == [tuple(0 if x is None else x for x in w) for w in want]
    assert [w[2] for w in want][:4] == [13, 26, 13, 0]
