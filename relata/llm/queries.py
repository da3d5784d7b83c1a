"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relata.llm.chat import op5_chat_tree
from relata.llm.decontam import op3_decontaminate
from relata.llm.fingerprints import op1_imatch
from relata.llm.htmltext import op4_html_text
from relata.llm.jaccard import op6_ngram_jaccard
from relata.llm.linededup import op2_line_dedup
from relata.llm.packing import op8_min_bin_slack
from relata.llm.quality import op10_quality_knn
from relata.llm.tokenfiles import op7_token_files
from relata.llm.warc import op9_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_imatch, op2_line_dedup, op3_decontaminate, op4_html_text, op5_chat_tree, op6_ngram_jaccard, op7_token_files, op8_min_bin_slack, op9_warc, op10_quality_knn]
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# an earlier copy of a line, followed along a diagonal of (line, earlier line): islands of consecutive lines are the maximal repeated runs
_LINE_DEDUP = """WITH doc AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM doc WHERE text IS NOT NULL),
pair AS (SELECT a.doc_id, a.i, b.doc_id AS other, a.i - b.i AS diagonal, len(list_filter(string_split_regex(a.x, '\\s+'), lambda w: w <> '')) AS words
  FROM line a JOIN line b ON a.x = b.x AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.i < a.i)),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY i) AS k FROM pair),
run AS (SELECT doc_id, min(i) AS s, max(i) AS e FROM island GROUP BY doc_id, other, diagonal, k HAVING sum(words) >= 50),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM line l JOIN run r ON l.doc_id = r.doc_id AND l.i BETWEEN r.s AND r.e),
kept AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM line l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.t, '') END AS text, length(coalesce(k.t, '')) AS n_chars, coalesce(len(d.l), 0) AS n_lines, coalesce(c.n, 0) AS n_deleted
FROM doc d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN cut c ON c.doc_id = d.doc_id"""

_CONTAMINATION = f"""WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
pattern AS (SELECT DISTINCT item, m, list_slice(w, i, i + m - 1) AS p FROM (SELECT item, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM doc, (SELECT DISTINCT m FROM pattern) WHERE len(w) >= m),
hit AS (SELECT doc_id, i, x.m, item FROM (SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS p FROM place) x JOIN pattern USING (m, p)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)"""

_SIMILAR = f"""WITH RECURSIVE doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, k = x.n AND k = y.n AS same FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.b FROM reach r JOIN link l ON l.a = r.u)
SELECT d.doc_id, (SELECT min(u) FROM reach r WHERE r.v = d.doc_id) AS class_id, least(d.doc_id, coalesce((SELECT min(b) FROM link l WHERE l.a = d.doc_id AND l.same), d.doc_id)) AS copy_id,
  (SELECT count(*) FROM link l WHERE l.a = d.doc_id) AS n_links FROM documents d"""

# base32 of a digest: five hexadecimal digits are four of its signs
_SIGN = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {0}) & 31) + 1, 1)"
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
h AS (SELECT page_id, unnest(generate_series(0, 7)) AS k, sha1(html) AS s FROM p),
c AS (SELECT page_id, k, ('0x' || substr(s, 5 * k + 1, 5))::BIGINT AS v FROM h),
b AS (SELECT page_id, string_agg({" || ".join(_SIGN.format(x) for x in (15, 10, 5, 0))}, '' ORDER BY k) AS payload_digest FROM c GROUP BY page_id)
SELECT p.page_id, strlen(p.html) AS payload_bytes, b.payload_digest, CASE WHEN p.page_id = p.last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> p.last THEN p.last END AS refers_to
FROM p JOIN b USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    """The others' results come from hashes, tokenizers, a parser or a learnt model; tests hold those against brute force."""
    return {"op2_line_dedup": _LINE_DEDUP, "op3_decontaminate": _CONTAMINATION, "op6_ngram_jaccard": _SIMILAR, "op9_warc": _WARC}
