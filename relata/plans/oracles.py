"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from relata.functions.text import FULL_THEN_SHORT, SHORT_THEN_FULL

_F1 = """f1 AS (
  SELECT p.p_name AS path, sn.n_name AS arg1, r.r_name AS type1, cn.n_name AS arg2, c.c_mktsegment AS type2, l.l_orderkey, l.l_linenumber
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN region r ON sn.n_regionkey = r.r_regionkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey)"""
_F2 = """f1 AS (
  SELECT p.p_brand || '>' || o.o_orderpriority AS path, c.c_name AS arg1, c.c_mktsegment AS type1, p.p_name AS arg2, p.p_type AS type2
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"""
_F3 = """f1 AS (
  SELECT o_orderpriority AS path, c_name || ' ' || year(o_orderdate) AS arg1, c_mktsegment AS type1, strftime(o_orderdate, '%Y-%m') AS arg2, o_orderstatus AS type2
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_COUNTS = """counts AS (
  SELECT path, slot, filler, count(*) AS n FROM (
    SELECT path, 'x' AS slot, arg1 AS filler FROM f1 UNION ALL SELECT path, 'y', arg2 FROM f1
    UNION ALL SELECT path, 'tx', coalesce(nullif(type1, ''), '?') FROM f1 UNION ALL SELECT path, 'ty', coalesce(nullif(type2, ''), '?') FROM f1)
  GROUP BY path, slot, filler)"""
_SUPPORT = "support AS (SELECT path, count(*) AS support FROM f1 GROUP BY path)"
_MI = """args AS (SELECT * FROM counts WHERE slot IN ('x', 'y')),
mi AS (SELECT slot, path, filler, mi FROM (
  SELECT a.slot, a.path, a.filler, ln(a.n::DOUBLE * t.t / (p.t * w.t)) AS mi FROM args a
  JOIN (SELECT slot, path, sum(n)::DOUBLE AS t FROM args GROUP BY ALL) p USING (slot, path)
  JOIN (SELECT slot, filler, sum(n)::DOUBLE AS t FROM args GROUP BY ALL) w USING (slot, filler)
  JOIN (SELECT slot, sum(n)::DOUBLE AS t FROM args GROUP BY ALL) t USING (slot)) WHERE mi > 0),
mass AS (SELECT slot, path, sum(mi) AS mass FROM mi GROUP BY ALL)"""
_DIST = """sims AS (
  SELECT s.slot, s.p, s.q, s.num / (a.mass + b.mass) AS sim FROM (
    SELECT a.slot, a.path AS p, b.path AS q, sum(a.mi + b.mi) AS num FROM mi a JOIN mi b ON a.slot = b.slot AND a.filler = b.filler AND a.path < b.path GROUP BY ALL) s
  JOIN mass a ON a.slot = s.slot AND a.path = s.p JOIN mass b ON b.slot = s.slot AND b.path = s.q),
dist AS (SELECT x.p, x.q, 1 - sqrt(x.sim * y.sim) AS distance FROM sims x JOIN sims y ON x.p = y.p AND x.q = y.q AND x.slot = 'x' AND y.slot = 'y' WHERE x.sim > 0 AND y.sim > 0)"""
_DOMINANT = """dom AS (SELECT path, slot, filler AS dominant FROM counts WHERE slot IN ('tx', 'ty') QUALIFY row_number() OVER (PARTITION BY path, slot ORDER BY n DESC, filler) = 1),
sig AS (SELECT x.path, x.dominant AS sx, y.dominant AS sy FROM dom x JOIN dom y ON x.path = y.path AND x.slot = 'tx' AND y.slot = 'ty')"""
_BLOCKS = """blocks AS (SELECT path, support, sx, sy, count(*) OVER (PARTITION BY sx, sy) AS block_size, row_number() OVER (PARTITION BY sx, sy ORDER BY support DESC, path) AS place FROM support JOIN sig USING (path))"""
_CLUSTERS = "clusters AS (SELECT DISTINCT path, split_part(path, ' ', 1) AS cluster FROM f1)"
_INSIDE = "inside AS (SELECT a.cluster, d.p, d.q, d.distance FROM dist d JOIN clusters a ON a.path = d.p JOIN clusters b ON b.path = d.q WHERE a.cluster = b.cluster)"
_COHESION = """cohesion AS (SELECT c.cluster, c.size, CASE WHEN c.size > 1 THEN coalesce(s.s, 0) / (c.size * (c.size - 1) / 2.0) END AS cohesion
  FROM (SELECT cluster, count(*) AS size FROM clusters GROUP BY ALL) c LEFT JOIN (SELECT cluster, sum(1 - distance) AS s FROM inside GROUP BY ALL) s USING (cluster))"""
_THRESHOLDS = """pairs AS (SELECT a.sx, a.sy, d.distance FROM dist d JOIN blocks a ON a.path = d.p JOIN blocks b ON b.path = d.q WHERE a.sx = b.sx AND a.sy = b.sy),
sizes AS (SELECT sx, sy, count(*) AS size FROM blocks GROUP BY ALL),
ones AS (SELECT sx, sy, size * (size - 1) // 2 - coalesce(k, 0) AS k FROM sizes LEFT JOIN (SELECT sx, sy, count(*) AS k FROM pairs GROUP BY ALL) USING (sx, sy)),
points AS (SELECT * FROM pairs WHERE distance > 1e-12 UNION ALL SELECT sx, sy, 1.0 FROM ones, range(2) g(i) WHERE i < k),
gaps AS (SELECT *, lead(distance) OVER w AS nxt, row_number() OVER w AS rnk, count(*) OVER (PARTITION BY sx, sy) AS nonzero FROM points WINDOW w AS (PARTITION BY sx, sy ORDER BY distance)),
cut AS (SELECT sx, sy, nonzero, (distance + nxt) / 2 AS cut FROM gaps QUALIFY row_number() OVER (PARTITION BY sx, sy ORDER BY nxt - distance DESC NULLS LAST, rnk) = 1),
thr AS (SELECT sx, sy, size, CASE WHEN size < 2 THEN 0.3 WHEN coalesce(nonzero, 0) = 0 THEN 0.75 WHEN size < 3 OR nonzero < 2 THEN 0.3 + 1e-9 ELSE least(greatest(cut, 0.3), 0.75) END::DOUBLE AS threshold
  FROM sizes LEFT JOIN cut USING (sx, sy))"""
_NESTED = "labels AS (SELECT DISTINCT path, path AS label FROM f1 UNION ALL SELECT DISTINCT path, split_part(path, '>', 1) FROM f1)"
_SCHEMA = """fill AS (SELECT label, slot, filler, sum(n) AS n FROM labels JOIN counts USING (path) GROUP BY ALL),
ldom AS (SELECT label, slot, filler FROM fill WHERE slot IN ('tx', 'ty') QUALIFY row_number() OVER (PARTITION BY label, slot ORDER BY n DESC, filler) = 1),
rel AS (SELECT s.label, coalesce(x.filler, '?') AS domain, coalesce(y.filler, '?') AS "range", s.support FROM (SELECT label, sum(support)::BIGINT AS support FROM labels JOIN support USING (path) GROUP BY ALL) s
  LEFT JOIN ldom x ON x.label = s.label AND x.slot = 'tx' LEFT JOIN ldom y ON y.label = s.label AND y.slot = 'ty')"""
_PARENTS = """sets AS (SELECT label, list(DISTINCT filler) FILTER (slot = 'x') AS xs, list(DISTINCT filler) FILTER (slot = 'y') AS ys FROM fill GROUP BY label),
cand AS (SELECT a.label, b.label AS parent, len(pb.xs) + len(pb.ys) AS spread,
    least(len(list_intersect(pa.xs, pb.xs)) / len(pa.xs), len(list_intersect(pa.ys, pb.ys)) / len(pa.ys)) AS up,
    least(len(list_intersect(pa.xs, pb.xs)) / len(pb.xs), len(list_intersect(pa.ys, pb.ys)) / len(pb.ys)) AS down, len(pa.xs) + len(pa.ys) AS own
  FROM rel a JOIN rel b ON a.domain = b.domain AND a."range" = b."range" AND a.label <> b.label JOIN sets pa ON pa.label = a.label JOIN sets pb ON pb.label = b.label),
par AS (SELECT label, parent, up FROM cand WHERE spread > own AND up >= 0.6 AND down < up QUALIFY row_number() OVER (PARTITION BY label ORDER BY spread, up DESC, parent) = 1)"""
_BINS = """samples AS (SELECT l_discount * 10 AS confidence, l_returnflag = 'R' AS correct FROM lineitem),
bins AS (SELECT least(greatest(floor(confidence * 10), 0), 9)::INTEGER AS bucket, sum(correct::INTEGER)::BIGINT AS correct, count(*) AS total FROM samples GROUP BY 1)"""
_LOG = """log AS (SELECT user_id::VARCHAR || '|' || (event_id % 7)::VARCHAR AS key, event_type AS label, CASE WHEN value > 50 THEN 'oracle' ELSE 'induced_seed_pos' END AS source,
  user_id::VARCHAR AS entity1, (event_id % 7)::VARCHAR AS entity2, event_id AS seq FROM events)"""
_LATEST = "latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_CELLS = """cells AS (SELECT p_brand AS pred, p_type AS gold, count(*) AS n FROM part GROUP BY ALL),
tot AS (SELECT *, sum(n) OVER (PARTITION BY pred) AS p, sum(n) OVER (PARTITION BY gold) AS g FROM cells)"""
_BCUBED = "b AS (SELECT sum(n * n / p) / sum(n) AS p, sum(n * n / g) / sum(n) AS r, sum(n)::BIGINT AS n FROM tot)"
_TWO = """two AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS tp, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM cells GROUP BY pred)) AS pp,
  (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM cells GROUP BY gold)) AS gg, (SELECT sum(n)::BIGINT FROM cells) AS n),
pr AS (SELECT tp / pp AS p, tp / gg AS r, n FROM two)"""
_TUPLES = """base AS (SELECT o_orderkey AS doc_id, l_linenumber::BIGINT AS seq, p_name AS arg1, p_type AS rel, p_brand AS arg2 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
tok AS (SELECT doc_id, seq, list_distinct(list_filter(string_split(lower(trim(arg1)), ' '), lambda x: x <> '')) AS t1, list_distinct(list_filter(string_split(lower(trim(arg2)), ' '), lambda x: x <> '')) AS t2, lower(trim(arg1)) AS a1, lower(trim(arg2)) AS a2 FROM base)"""
_SENT = """sent AS (SELECT doc_id, i - 1 AS sent_id, list_filter(string_split(regexp_replace(s, '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[.\\n]')) AS s, generate_subscripts(string_split_regex(lower(coalesce(text, '')), '[.\\n]'), 1) AS i FROM documents)),
words AS (SELECT doc_id::VARCHAR AS doc_id, sent_id::INTEGER AS sent_id, unnest(w) AS word, (generate_subscripts(w, 1) - 1)::INTEGER AS i FROM sent),
stops AS (SELECT unnest(['the','of','and','to','in','is','it','as','on','by','for','with','that','this','be','at','are','was','he','or']) AS word),
men AS (SELECT doc_id, sent_id, i, word, CASE WHEN length(word) >= 12 THEN 'LONG' ELSE 'SHORT' END AS label FROM words WHERE length(word) >= 9)"""
_CTX = """pr AS (SELECT a.doc_id, a.sent_id, a.word AS entity1, a.label AS type1, b.word AS entity2, b.label AS type2, a.i AS start1, b.i AS start2 FROM men a JOIN men b
  ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.i - a.i - 1 BETWEEN 0 AND 10),
btw AS (SELECT p.doc_id, p.sent_id, p.start1, p.start2, string_agg(w.word, ' ' ORDER BY w.i) AS context FROM pr p JOIN words w ON w.doc_id = p.doc_id AND w.sent_id = p.sent_id AND w.i > p.start1 AND w.i < p.start2
  WHERE w.word NOT IN (SELECT word FROM stops) GROUP BY ALL),
ctx AS (SELECT pr.*, coalesce(b.context, '') AS context, row_number() OVER (PARTITION BY pr.doc_id ORDER BY pr.sent_id, pr.start1, pr.start2) AS seq FROM pr LEFT JOIN btw b USING (doc_id, sent_id, start1, start2))"""
_PATHS = "paths AS (SELECT doc_id, sent_id, entity1, type1, entity2, type2, start1, start2, replace(context, ' ', '→') AS path FROM ctx WHERE start2 - start1 <= 6)"
_UNC = "least(CASE WHEN len(list_filter(string_split(context, ' '), lambda x: x <> '')) < 2 THEN 0.3 ELSE 0 END + CASE WHEN type1 = type2 THEN 0.3 ELSE 0 END + (1 - 0.7) * 0.4, 1.0)::DOUBLE"
_TFIDF = """bag AS (SELECT arg2 AS entity, unnest(string_split(path, ' ')) AS term, n FROM (SELECT arg2, path, count(*) AS n FROM f1 GROUP BY ALL)),
tf AS (SELECT entity, term, sum(n) AS tf FROM (SELECT entity, unnest(regexp_extract_all(lower(term), '\\w\\w+')) AS term, n FROM bag) GROUP BY ALL),
vocab AS (SELECT term, sum(tf) AS a, count(*) AS df FROM tf GROUP BY term QUALIFY row_number() OVER (ORDER BY a DESC, term) <= 50),
w AS (SELECT entity, term, tf * (ln((1 + (SELECT count(DISTINCT arg2) FROM f1)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)),
vec AS (SELECT entity, term, w / sqrt(sum(w * w) OVER (PARTITION BY entity)) AS weight FROM w)"""


_NORMAL = "trim(regexp_replace(translate(lower({0}), '’.', ''''), '[\\s\\x{{00a0}}]+', ' ', 'g'))"


def _sql(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + "\n" + last if ctes else last


def oracle_sql() -> dict[str, str]:
    dist = (_F1, _COUNTS, _MI, _DIST)
    clus = (*dist, _CLUSTERS, _INSIDE)
    sent = (_SENT, _CTX)
    nested = (_F2, _COUNTS, _SUPPORT, _NESTED, _SCHEMA)
    return {
        "slot_counts": _sql(_F1, _COUNTS, "SELECT path, slot, filler, n FROM counts"),
        "path_support": _sql(_F1, _SUPPORT, "SELECT path, support FROM support"),
        "store_stats": _sql(_F1, _SUPPORT, "SELECT count(*) AS n_paths, sum(support)::BIGINT AS total_support, (SELECT count(DISTINCT sha1(coalesce(text, ''))) FROM documents) AS n_docs FROM support"),
        "merged_counts": _sql(_F1, _COUNTS, "SELECT path, slot, filler, n FROM counts"),
        "dominant_type": _sql(_F1, _COUNTS, _DOMINANT, "SELECT path, slot, dominant FROM dom"),
        "type_signature_blocks": _sql(_F1, _COUNTS, _SUPPORT, _DOMINANT, _BLOCKS, "SELECT path, support, sx, sy, block_size FROM blocks"),
        "block_head_tail": _sql(_F1, _COUNTS, _SUPPORT, _DOMINANT, _BLOCKS, "SELECT path, sx, sy, place, place <= 5 AS is_head FROM blocks"),
        "corpus_median_support": _sql(_F2, _SUPPORT, "SELECT coalesce(max(support), 1)::DOUBLE AS median FROM (SELECT support, row_number() OVER (ORDER BY support, path) AS k, count(*) OVER () AS n FROM support) WHERE k = n // 2 + 1"),
        "idempotent_ingest": """SELECT min(doc_id) AS doc_id, digest FROM (SELECT doc_id, sha1(coalesce(text, '')) AS digest FROM documents) GROUP BY digest
            HAVING digest NOT IN (SELECT sha1(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)""",
        "doc_sha_dedup": "SELECT sha1(coalesce(text, '')) AS digest, min(doc_id) AS first_doc, count(*) AS n_docs FROM documents GROUP BY 1",
        "slot_pmi": _sql(_F1, _COUNTS, _MI, "SELECT slot, path, filler, round(mi, 6) AS mi FROM mi"),
        "pmi_mass": _sql(_F1, _COUNTS, _MI, "SELECT slot, path, round(mass, 6) AS mass FROM mass"),
        "slot_similarity": _sql(*dist, "SELECT slot, p, q, round(sim, 6) AS sim FROM sims"),
        "path_distance": _sql(*dist, "SELECT p, q, round(distance, 6) AS distance FROM dist"),
        "top_similar_paths": _sql(*dist, "SELECT p, q, distance, row_number() OVER (PARTITION BY p ORDER BY distance, q) AS rank FROM (SELECT p, q, round(distance, 6) AS distance FROM dist UNION ALL SELECT q, p, round(distance, 6) FROM dist) QUALIFY rank <= 5"),
        "block_gap_threshold": _sql(*dist, _SUPPORT, _DOMINANT, _BLOCKS, _THRESHOLDS, "SELECT sx, sy, size, round(threshold, 6) AS threshold FROM thr"),
        "ema_threshold": _sql(*dist, _SUPPORT, _DOMINANT, _BLOCKS, _THRESHOLDS, "SELECT sx, sy, round(CASE WHEN size >= 3 THEN 0.5 * 0.5 + 0.5 * threshold ELSE threshold END, 6) AS threshold FROM thr"),
        "type_smoothing": _sql(
            _F3, _COUNTS,
            """a AS (SELECT * FROM counts WHERE slot IN ('x', 'y')), g AS (SELECT slot, filler, sum(n) AS a FROM a GROUP BY ALL),
            m AS (SELECT path, slot, least(0.5, sum(CASE WHEN g.a <= 1 THEN n ELSE 0 END) / sum(n)) * sum(n) AS mass FROM a JOIN g USING (slot, filler) GROUP BY ALL HAVING mass > 0),
            t AS (SELECT path, substr(slot, 2, 1) AS slot, filler, n, sum(n) OVER (PARTITION BY path, slot) AS tt FROM counts WHERE slot IN ('tx', 'ty'))""",
            "SELECT path, slot, '§T:' || filler AS filler, round(mass * n / tt, 6) AS n FROM t JOIN m USING (path, slot)",
        ),
        "nearest_medoid": _sql(
            *dist, _SUPPORT, _DOMINANT, _BLOCKS,
            "both_ AS (SELECT p AS path, q AS medoid, round(distance, 6) AS distance FROM dist UNION ALL SELECT q, p, round(distance, 6) FROM dist)",
            """SELECT b.path, upper(m.path) AS label, round(coalesce(d.distance, 1.0), 6) AS distance, coalesce(d.distance, 1.0) <= 0.6 AS accepted FROM blocks b JOIN blocks m ON m.sx = b.sx AND m.sy = b.sy AND m.place <= 2 AND m.path <> b.path
            LEFT JOIN both_ d ON d.path = b.path AND d.medoid = m.path QUALIFY row_number() OVER (PARTITION BY b.path ORDER BY coalesce(d.distance, 1.0), upper(m.path)) = 1""",
        ),
        "cluster_cohesion": _sql(*clus, _COHESION, "SELECT cluster, size, round(cohesion, 6) AS cohesion FROM cohesion"),
        "cluster_medoid": _sql(
            *clus,
            "n AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY ALL), near AS (SELECT cluster, path, sum(distance) AS d, count(*) AS k FROM (SELECT cluster, p AS path, distance FROM inside UNION ALL SELECT cluster, q, distance FROM inside) GROUP BY ALL)",
            "SELECT cluster, path AS medoid FROM clusters JOIN n USING (cluster) LEFT JOIN near USING (cluster, path) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(coalesce(d, 0) + n - 1 - coalesce(k, 0), 9), path) = 1",
        ),
        "merge_reference": _sql(
            *clus, _COHESION,
            "o AS (SELECT 1 - cohesion AS d, row_number() OVER (ORDER BY cluster) AS k, count(*) OVER () AS n FROM cohesion WHERE size >= 2)",
            "SELECT round(sum(d * CASE WHEN k = 1 THEN pow(0.5, n - 1) ELSE pow(0.5, n - k + 1) END), 6) AS reference FROM o",
        ),
        "carryover_jaccard": _sql(
            _F1, _CLUSTERS, "old AS (SELECT path, upper(split_part(path, ' ', -1)) AS label FROM clusters)",
            """i AS (SELECT cluster, label, count(*) AS i FROM clusters JOIN old USING (path) GROUP BY ALL), a AS (SELECT cluster, count(*) AS a FROM clusters GROUP BY ALL), b AS (SELECT label, count(*) AS b FROM old GROUP BY ALL)""",
            "SELECT cluster, label, round(i / (a + b - i), 6) AS jaccard FROM i JOIN a USING (cluster) JOIN b USING (label)",
        ),
        "readable_label": "SELECT DISTINCT path, coalesce(nullif(substr(regexp_replace(upper(replace(path, '→', '_')), '[^A-Z0-9_]', '', 'g'), 1, 40), ''), 'RELATED_TO') AS label FROM (SELECT p_name || '→' || coalesce(p_type, '') || '→#→' || p_brand AS path FROM part)",
        "unique_label": """WITH p AS (SELECT DISTINCT p_type || ' ' || p_brand AS path, coalesce(nullif(substr(regexp_replace(upper(split_part(p_type || ' ' || p_brand, ' ', 1)), '[^A-Z0-9_]', '', 'g'), 1, 40), ''), 'RELATED_TO') AS base FROM part),
            k AS (SELECT path, base, row_number() OVER (PARTITION BY base ORDER BY path) AS k, count(*) OVER (PARTITION BY base) AS n FROM p)
            SELECT path, CASE WHEN base < 'N' AND k = 1 THEN base || '_' || (n + 1) WHEN k = 1 THEN base ELSE base || '_' || k END AS label FROM k""",
        "relation_schema": _sql(*nested, 'SELECT label, domain, "range", support FROM rel'),
        "subsumption_parent": _sql(*nested, _PARENTS, "SELECT r.label, p.parent, coalesce(round(p.up, 3), 0.0)::DOUBLE AS containment FROM rel r LEFT JOIN par p USING (label)"),
        "hierarchy_depth": "WITH RECURSIVE " + ",\n".join((*nested, _PARENTS)) + """,
            walk(label, up, depth) AS (SELECT r.label, p.parent, 0 FROM rel r LEFT JOIN par p USING (label) UNION ALL SELECT w.label, p.parent, w.depth + 1 FROM walk w LEFT JOIN par p ON p.label = w.up WHERE w.up IS NOT NULL)
            SELECT label, max(depth)::BIGINT AS depth FROM walk GROUP BY label""",
        "raw_confidence": _sql(
            *clus, _COHESION, _SUPPORT, "med AS (SELECT max(support) AS m FROM (SELECT support, row_number() OVER (ORDER BY support) AS k, count(*) OVER () AS n FROM support) WHERE k = n // 2 + 1)",
            "SELECT s.path, round(CASE WHEN k.cohesion IS NULL THEN least(1.0, s.support / (s.support + greatest(m, 1))) ELSE 0.5 * round(k.cohesion, 6) + 0.5 * least(1.0, s.support / (s.support + greatest(m, 1))) END, 3) AS raw FROM support s JOIN clusters USING (path) JOIN cohesion k USING (cluster), med",
        ),
        "calibration_bins": _sql(_BINS, "SELECT bucket, correct, total FROM bins"),
        "calibrated_confidence": _sql(
            _BINS, "r AS (SELECT DISTINCT round(confidence, 3) AS raw FROM samples)",
            "SELECT raw, round(CASE WHEN coalesce(total, 0) < 20 THEN raw ELSE total / (total + 20) * (correct + 1) / (total + 2) + (1 - total / (total + 20)) * raw END, 3) AS confidence FROM r LEFT JOIN bins ON bucket = least(greatest(floor(raw * 10), 0), 9)",
        ),
        "calibration_samples": _sql(_LOG, _LATEST, "SELECT 0.5::DOUBLE AS confidence, label = 'click' AS correct, count(*) AS n FROM latest WHERE source = 'oracle' AND seq % 3 <> 0 GROUP BY ALL"),
        "label_latest": _sql(_LOG, _LATEST, "SELECT key, label, source, seq FROM latest"),
        "label_source_counts": _sql(_LOG, _LATEST, "SELECT source, count(*) AS n FROM latest GROUP BY source"),
        "label_keys": "SELECT conv_id, turn, coalesce(role, '') || '|' || conv_id::VARCHAR || '|' || substr(coalesce(text, ''), 1, 60) AS key FROM conversations",
        "weak_seed_merge": _sql(
            _LOG,
            """store AS (SELECT entity1 || '|' || entity2 || '|' AS key, label, source FROM log WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
            pos AS (SELECT l.entity1 || '|' || l.entity2 || '|' AS key, l.label, l.seq, coalesce(lag(l.label) OVER (PARTITION BY l.entity1, l.entity2 ORDER BY l.seq), s.label) AS before, s.source AS by_
              FROM log l LEFT JOIN store s ON s.key = l.entity1 || '|' || l.entity2 || '|' WHERE l.seq % 2 = 1),
            fresh AS (SELECT * FROM pos WHERE coalesce(by_, '') <> 'oracle' AND (before IS NULL OR before <> label) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)""",
            """SELECT key, label, 'induced_seed_pos' AS source, 'U' AS type1, 'K' AS type2 FROM fresh UNION ALL SELECT key, label, source, '', '' FROM store WHERE key NOT IN (SELECT key FROM fresh)""",
        ),
        "prf": """WITH c AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS tp, count(*) FILTER (l_quantity > 25) AS fp, count(*) FILTER (l_discount > 0.05) AS fn FROM lineitem GROUP BY 1),
            r AS (SELECT l_returnflag, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM c)
            SELECT l_returnflag, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM r""",
        "openie_candidates": _sql(
            _TUPLES,
            """SELECT DISTINCT p.doc_id, p.seq AS pseq, g.seq AS gseq FROM tok p JOIN tok g ON p.doc_id = g.doc_id AND p.seq % 2 = 1 AND g.seq % 2 = 0
            WHERE len(list_intersect(p.t1, g.t1)) / (len(p.t1) + len(g.t1) - len(list_intersect(p.t1, g.t1))) >= 0.3 AND len(list_intersect(p.t2, g.t2)) / (len(p.t2) + len(g.t2) - len(list_intersect(p.t2, g.t2))) >= 0.3""",
        ),
        "openie_coverage": _sql(_TUPLES, "g AS (SELECT DISTINCT a1, a2 FROM tok WHERE seq % 2 = 0), p AS (SELECT DISTINCT a1, a2 FROM tok WHERE seq % 2 = 1)", "SELECT round((SELECT count(*) FROM g SEMI JOIN p USING (a1, a2)) / (SELECT count(*) FROM g), 4) AS coverage"),
        "bcubed": _sql(_CELLS, _BCUBED, "SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1, n FROM b"),
        "pairwise_prf": _sql(_CELLS, _TWO, "SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM pr"),
        "partition_agreement": _sql(_CELLS, _BCUBED, _TWO, "SELECT round(pr.p, 4) AS precision, round(pr.r, 4) AS recall, round(2 * pr.p * pr.r / (pr.p + pr.r), 4) AS pairwise_f1, round(2 * b.p * b.r / (b.p + b.r), 4) AS bcubed_f1, round(1 - round(2 * b.p * b.r / (b.p + b.r), 4), 4) AS approx_error, pr.n AS n_paths FROM pr, b"),
        "hierarchy_prf": """WITH e AS (SELECT length(n_name) % 3 > 0 AS has FROM nation), c AS (SELECT count(*) FILTER (has) AS k, count(*) AS n FROM e)
            SELECT round(k / k, 4) AS precision, round(k / n, 4) AS recall, round(2 * (k / n) / (1 + k / n), 4) AS f1, k AS n_pred_edges, n AS n_gold_edges FROM c""",
        "calibration_report": _sql(
            _BINS, "b AS (SELECT least(greatest(floor(confidence * 10), 0), 9) AS b, avg(confidence) AS c, avg(correct::INTEGER) AS a, count(*) AS k, sum(pow(confidence - correct::INTEGER, 2)) AS s FROM samples GROUP BY 1)",
            "SELECT round(sum(k * abs(c - a)) / sum(k), 4) AS ece, round(sum(s) / sum(k), 4) AS brier, sum(k)::BIGINT AS n FROM b",
        ),
        "calibration_curve": _sql(_BINS, 'SELECT least(greatest(floor(confidence * 10), 0), 9)::INTEGER AS bucket, round(avg(confidence), 3) AS avg_conf, round(avg(correct::INTEGER), 3) AS accuracy, count(*) AS "count" FROM samples GROUP BY 1'),
        "confusion_cells": _sql(
            _CELLS, "g AS (SELECT gold FROM cells GROUP BY gold ORDER BY sum(n) DESC, gold LIMIT 12), p AS (SELECT pred FROM cells GROUP BY pred ORDER BY sum(n) DESC, pred LIMIT 12)",
            "SELECT g.gold, p.pred, coalesce(c.n, 0) AS n FROM g CROSS JOIN p LEFT JOIN cells c ON c.gold = g.gold AND c.pred = p.pred",
        ),
        "precision_proxy": _sql(*sent, "SELECT round(avg((split_part(context, ' ', 1) NOT IN ('he','him','his','she','her','hers','it','its','they','them','their') AND entity2 NOT IN ('he','him','his','she','her','hers','it','its','they','them','their'))::INTEGER), 3) AS proxy_precision FROM ctx"),
        "labelled_precision": _sql(_F2, "SELECT round(avg((length(arg1) % 2 = 0)::INTEGER), 3) AS labelled_precision FROM f1 WHERE length(arg2) % 2 = 0"),
        "pair_partition": _sql(_F1, "SELECT arg1, arg2, path AS label FROM f1 QUALIFY row_number() OVER (PARTITION BY arg1, arg2 ORDER BY l_orderkey DESC, l_linenumber DESC, path DESC) = 1"),
        "normalize_surface": "SELECT doc_id, sha1(trim(regexp_replace(translate(lower(coalesce(text, '')), '’.', ''''), '[\\s\\x{00a0}]+', ' ', 'g'))) AS digest FROM documents",
        "acronym_gloss": f"""WITH n AS (SELECT n_nationkey, translate(n_name, '_0123456789', 'XABCDEFGHIJ') AS u FROM nation), m AS (SELECT *, upper(u[1]) || lower(substr(u, 2)) AS name FROM n),
            src AS (SELECT doc_id::VARCHAR AS doc_id, text FROM documents UNION ALL SELECT 'nation ' || n_nationkey, 'reports say ' || name || ' Trade Board (' || substr(u, 1, 2) || 'TB) met; ' || substr(u, 1, 3) || ' (' || name || ' Office) did not.' FROM m),
            hit AS (SELECT doc_id, 0 AS r, unnest(regexp_extract_all(text, '{FULL_THEN_SHORT}', 1)) AS f, unnest(regexp_extract_all(text, '{FULL_THEN_SHORT}', 2)) AS a, generate_subscripts(regexp_extract_all(text, '{FULL_THEN_SHORT}'), 1) AS i FROM src
              UNION ALL SELECT doc_id, 1, unnest(regexp_extract_all(text, '{SHORT_THEN_FULL}', 2)), unnest(regexp_extract_all(text, '{SHORT_THEN_FULL}', 1)), generate_subscripts(regexp_extract_all(text, '{SHORT_THEN_FULL}'), 1) FROM src),
            norm AS (SELECT doc_id, r, i, {_NORMAL.format('f')} AS canonical, {_NORMAL.format('a')} AS alias FROM hit)
            SELECT doc_id, alias, canonical FROM norm WHERE alias <> '' AND canonical <> '' AND alias <> canonical AND length(replace(alias, ' ', '')) <= 9
            QUALIFY row_number() OVER (PARTITION BY doc_id, alias ORDER BY r DESC, i DESC) = 1""",
        "acronym_initials": """SELECT c_custkey::VARCHAR AS doc_id, lower(n_name[1] || c_mktsegment[1]) AS alias, lower(n_name || ' ' || c_mktsegment) AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT LIKE '% %'""",
        "canonical_names": """WITH m AS (SELECT lower(n_name || ' ' || c_mktsegment) AS name, lower(n_name[1] || c_mktsegment[1]) AS short, n_name NOT LIKE '% %' AS plain FROM customer JOIN nation ON c_nationkey = n_nationkey)
            SELECT canonical, count(*) AS n FROM (SELECT name AS canonical FROM m UNION ALL SELECT CASE WHEN short = 'fb' THEN 'francophone builders' WHEN plain THEN name ELSE short END FROM m) GROUP BY 1""",
        "pronoun_counts": """WITH w AS (SELECT len(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'), ' '), lambda x: x IN ('he','him','his','she','her','hers','it','its','they','them','their'))) AS a,
              len(list_filter(string_split(regexp_replace(lower(replace(coalesce(text, ''), ' it ', ' engine ')), '[^a-z]+', ' ', 'g'), ' '), lambda x: x IN ('he','him','his','she','her','hers','it','its','they','them','their'))) AS b FROM documents),
            s AS (SELECT sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM w)
            SELECT a AS pronouns_before, b AS pronouns_after, greatest(a - b, 0) AS pronouns_resolved, round(greatest(a - b, 0) / a, 3) AS resolution_rate FROM s""",
        "rule_coref_antecedent": _sql(
            _SENT,
            """t AS (SELECT w.*, last_value(CASE WHEN length(word) >= 12 THEN word END IGNORE NULLS) OVER v AS p, last_value(CASE WHEN length(word) BETWEEN 9 AND 11 THEN word END IGNORE NULLS) OVER v AS o
              FROM words w WINDOW v AS (PARTITION BY doc_id ORDER BY sent_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            u AS (SELECT doc_id, sent_id, i, word AS text, CASE WHEN word IN ('he','him','his','she','her','hers') THEN p WHEN word IN ('it','its') THEN o WHEN word IN ('they','them','their') THEN coalesce(p, o) END AS antecedent FROM t)""",
            "SELECT * FROM u WHERE antecedent IS NOT NULL",
        ),
        "sentence_pairs": _sql(*sent, "SELECT doc_id, sent_id, entity1, type1, entity2, type2, start1, start2 FROM pr"),
        "pair_context": _sql(*sent, "SELECT doc_id, sent_id, start1, start2, context FROM ctx"),
        "dep_path": _sql(*sent, _PATHS, "SELECT doc_id, sent_id, start1, start2, path FROM paths"),
        "open_propositions": _sql(*sent, _PATHS, "SELECT doc_id, sent_id, entity1 AS arg1, type1, entity2 AS arg2, type2, path, false AS negated FROM paths WHERE path <> '' AND entity1 <> entity2"),
        "structural_negatives": _sql(*sent, _PATHS, "SELECT DISTINCT doc_id, least(entity1, entity2) AS lo, greatest(entity1, entity2) AS hi FROM paths WHERE path = '' AND entity1 <> entity2"),
        "concepts": _sql(
            _SENT,
            """e AS (SELECT doc_id, word AS concept, label AS type, word AS surface FROM men QUALIFY row_number() OVER (PARTITION BY doc_id, word ORDER BY sent_id, i) = 1),
            c AS (SELECT DISTINCT a.doc_id, a.word || ' ' || b.word AS concept FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND b.i = a.i + 1 WHERE length(a.word) >= 7 AND length(b.word) >= 7)""",
            "SELECT doc_id, concept, type, surface, 0.9::DOUBLE AS confidence, 'NER' AS sources FROM e UNION ALL SELECT doc_id, concept, 'CONCEPT', concept, 0.6, 'NOUN_CHUNK' FROM c",
        ),
        "token_jaccard": """WITH c AS (SELECT conv_id, turn, text AS a, lead(text) OVER w AS b, lead(turn) OVER w AS more FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
            t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(a, '')), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(coalesce(b, '')), '\\s+'), lambda x: x <> '')) AS b FROM c WHERE more IS NOT NULL)
            SELECT conv_id, turn, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1 WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END::DOUBLE, 6) AS jaccard FROM t""",
        "context_profiles": _sql(
            _SENT, "nx AS (SELECT m.doc_id, m.sent_id, m.i, m.word AS entity, w.word FROM men m LEFT JOIN words w ON w.doc_id = m.doc_id AND w.sent_id = m.sent_id AND w.i = m.i + 1 AND w.word NOT IN (SELECT word FROM stops))",
            "SELECT doc_id, entity, coalesce(string_agg(word, ' ' ORDER BY sent_id, i), '') AS words FROM nx GROUP BY ALL",
        ),
        "heuristic_uncertainty": _sql(*sent, f"SELECT doc_id, seq, round({_UNC}, 6) AS uncertainty FROM ctx"),
        "margin_uncertainty": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS s FROM embeddings), p AS (SELECT vec_id, list_reverse_sort(list_transform(s, lambda x: x / list_sum(s))) AS p FROM e)
            SELECT vec_id, round(1 - (p[1] - p[2]), 6) AS uncertainty FROM p""",
        "query_pool_antijoin": _sql(_LOG, "SELECT entity1 || '|' || entity2 || '|' AS key, seq FROM log WHERE key NOT IN (SELECT entity1 || '|' || entity2 || '|' FROM (SELECT * FROM log WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY entity1, entity2 ORDER BY seq DESC) = 1) WHERE source = 'oracle')").replace("WHERE key NOT IN", "WHERE entity1 || '|' || entity2 || '|' NOT IN"),
        "topk_queries": _sql(*sent, f"SELECT doc_id || '|' || seq AS key, round({_UNC}, 9) AS uncertainty FROM ctx ORDER BY 2 DESC, 1 LIMIT 25"),
        "negative_cap": _sql(
            *sent, _PATHS, "neg AS (SELECT DISTINCT doc_id, least(entity1, entity2) AS lo, greatest(entity1, entity2) AS hi FROM paths WHERE path = '' AND entity1 <> entity2)",
            "SELECT c.doc_id, c.seq, c.entity1, c.entity2 FROM ctx c SEMI JOIN neg n ON n.doc_id = c.doc_id AND n.lo = least(c.entity1, c.entity2) AND n.hi = greatest(c.entity1, c.entity2) ORDER BY c.doc_id::BIGINT, c.seq LIMIT 100",
        ),
        "pair_tags": _sql(
            _F1,
            """p AS (SELECT arg1, arg2, min(path) AS path, l_orderkey * 10 + l_linenumber AS seq FROM f1 GROUP BY ALL), fw AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY arg1, arg2 ORDER BY seq DESC) = 1),
            bw AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY arg1, arg2 ORDER BY seq) = 1)""",
            """SELECT a.n_name AS entity1, b.n_name AS entity2, CASE WHEN coalesce(fw.path, bw.path) IS NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, coalesce(fw.path, bw.path, 'none') AS frame_agreement
            FROM nation a CROSS JOIN nation b LEFT JOIN fw ON fw.arg1 = a.n_name AND fw.arg2 = b.n_name LEFT JOIN bw ON bw.arg2 = a.n_name AND bw.arg1 = b.n_name""",
        ),
        "consolidate_first_wins": _sql(_F1, "SELECT arg1 AS subject, path AS relation, arg2 AS object, 0.5::DOUBLE AS confidence, path AS evidence, l_orderkey * 10 + l_linenumber AS seq FROM f1 QUALIFY row_number() OVER (PARTITION BY arg1, path, arg2 ORDER BY l_orderkey * 10 + l_linenumber) = 1"),
        "negation_edges": _sql(_F2, "SELECT CASE WHEN length(arg2) % 2 = 0 THEN 'open_ie_induced_negated' ELSE 'open_ie_induced' END AS source, CASE WHEN length(arg2) % 2 = 0 THEN 0.35 ELSE 0.875 END::DOUBLE AS confidence, count(*) AS n FROM f1 GROUP BY ALL"),
        "baseline_cooccurrence": _sql(*sent, "SELECT doc_id, seq, entity1 AS arg1, CASE WHEN context = '' THEN 'RELATED' ELSE context END AS rel, entity2 AS arg2 FROM ctx"),
        "triples_for_kg": _sql(_F2, "SELECT DISTINCT arg1 AS h, path AS r, arg2 AS t FROM f1 WHERE length(arg2) % 3 > 0 AND type1 <> 'BUILDING'"),
        "tfidf_context": _sql(_F1, _TFIDF, "SELECT entity, term, round(weight, 6) AS weight FROM vec"),
        "similar_to_edges": _sql(_F1, _TFIDF, "SELECT a.entity AS a, b.entity AS b, round(sum(a.weight * b.weight), 6) AS cosine FROM vec a JOIN vec b ON a.term = b.term AND a.entity < b.entity GROUP BY ALL HAVING 1 - sum(a.weight * b.weight) <= 0.02 + 1e-12"),
        "cosine_neighbors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
            s AS (SELECT a.vec_id, b.vec_id AS other, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS c FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
            SELECT vec_id, other, round(c, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 12) DESC, other) <= 5""",
    }
