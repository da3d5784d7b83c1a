"""Operator 3 - benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of 13 consecutive words of the benchmark items (an item of fewer words is one window).
Patterns of one length m share a table: the hash of a block of two words gives the shift, how far the search may skip
(up to m - 1 words) because no pattern ends there; at shift 0 the block is some pattern's last and a bucket of
patterns with that suffix is compared, first by all word hashes, then by the bytes themselves.

The search runs over Arrow batches. A batch's words are cut into stretches with a pointer each, and all pointers are
moved together by numpy, so a very long document costs as many steps as many short ones.

The tables are broadcast only up to ``most_bytes`` of benchmark text; a larger benchmark is cut into blocks (a stated
query set against all rows, in blocks), whose hits are merged per document.

Defined results: null text has no words (n_words 0, not contaminated); an item with no words has no window; rows are kept
as they come, repeated rows and null ids too; items that occur more than once in the benchmark under one id count once. Items with a null id are searched as all others;
they count as one item, which the list in items_sha256 leaves out (as SQL does).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.common import forget, lean, load, numbered, others, quoted, slices, stored, utf8_parts, word_hashes, word_spans

WINDOW = 13
MOST_BYTES = 4 << 20  # of benchmark text; its windows take about 40 times as much
_TABLE_BITS = 20
_STRETCH = 192


def _block_hash(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of the block that ends at each word: two words, or one where patterns have one word."""
    if m == 1:
        return h
    out = np.zeros(len(h), np.uint64)
    out[1:] = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return out ^ (out >> np.uint64(29))


def _ordered(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is not None, x or ""))


class Patterns:
    """Shift table and suffix buckets for the windows of one length."""

    def __init__(self, m: int, words: list[list[bytes]], items: list[list[str | None]]):
        self.m, self.items, self.text = m, items, [b" ".join(w) for w in words]
        joined = b" ".join(self.text)
        offs = np.array([0, len(joined)], dtype=np.int64)
        padded, s, e, _ = word_spans(offs, np.frombuffer(joined, np.uint8))
        self.hash = word_hashes(padded, s, e).reshape(len(words), m)
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        b = min(2, m)
        self.shift = np.full(1 << _TABLE_BITS, m - b + 1, dtype=np.int32)
        for j in range(b - 1, m):  # a block that ends at word j of a pattern may be its last after m - 1 - j words
            block = _block_hash(np.ascontiguousarray(self.hash[:, j - b + 1 : j + 1]).reshape(-1), b)[b - 1 :: b]
            np.minimum.at(self.shift, (block & mask).astype(np.int64), m - 1 - j)
        self.last = _block_hash(np.ascontiguousarray(self.hash[:, m - b :]).reshape(-1), b)[b - 1 :: b]
        order = np.argsort(self.last, kind="stable")
        self.sorted_last, self.order = self.last[order], order

    def find(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of first words, and pattern numbers, of all occurrences inside single rows."""
        m, n = self.m, len(h)
        none = np.zeros(0, np.int64)
        if n < m:
            return none, none
        block = _block_hash(h, m)
        slot = (block & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
        # pointers stand on the last word of a possible occurrence
        pieces, limits = [], []
        for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if hi - lo >= m:
                p = np.arange(lo + m - 1, hi, _STRETCH)
                pieces.append(p)
                limits.append(np.minimum(p + _STRETCH, hi))
        if not pieces:
            return none, none
        at, limit = np.concatenate(pieces), np.concatenate(limits)
        stops = []
        while len(at):
            step = self.shift[slot[at]]
            stops.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < limit
            at, limit = at[live], limit[live]
        ends_at = np.concatenate(stops)
        lo = np.searchsorted(self.sorted_last, block[ends_at], "left")
        many = np.searchsorted(self.sorted_last, block[ends_at], "right") - lo
        pos = np.repeat(ends_at, many) - (m - 1)
        which = self.order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        for j in range(m):  # by hashes, a word at a time
            same = h[pos + j] == self.hash[which, j]
            pos, which = pos[same], which[same]
        ok = np.fromiter((self._same(padded, starts, ends, p, w) for p, w in zip(pos.tolist(), which.tolist())), bool, len(pos))
        return pos[ok], which[ok]

    def _same(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: int, w: int) -> bool:
        seen = padded[starts[p] : ends[p + self.m - 1]].tobytes()
        if seen == self.text[w]:
            return True
        return b" ".join(padded[a:b].tobytes() for a, b in zip(starts[p : p + self.m].tolist(), ends[p : p + self.m].tolist())) == self.text[w]


def build_patterns(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[Patterns]:
    """Tables for (item id, text) pairs: one per window length."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        padded, s, e, _ = word_spans(np.array([0, len(raw)], dtype=np.int64), raw)
        words = [padded[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist())]
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
    return [Patterns(m, [list(k) for k in found], [_ordered(v) for v in found.values()]) for m, found in sorted(by_length.items())]


def _scan(col: pa.Array, tables: list[Patterns]) -> tuple[np.ndarray, list[np.ndarray], list[list[str | None]]]:
    """Per row: word count, hit word positions (in the row) and items found."""
    offs, data = utf8_parts(col)
    padded, starts, ends, rows = word_spans(offs, data)
    h = word_hashes(padded, starts, ends)
    cover = np.zeros(len(h) + 1, np.int64)
    items: list[set[str | None]] = [set() for _ in range(len(col))]
    for t in tables:
        pos, which = t.find(padded, starts, ends, rows, h)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + t.m, -1)
        row = np.searchsorted(rows, pos, side="right") - 1
        for r, w in zip(row.tolist(), which.tolist()):
            items[r].update(t.items[w])
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    cut = np.searchsorted(hit, rows)
    return np.diff(rows), [hit[a:b] - lo for a, b, lo in zip(cut[:-1].tolist(), cut[1:].tolist(), rows[:-1].tolist())], [_ordered(x) for x in items]


_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(items: list[str | None]) -> str:
    return hashlib.sha256(",".join(x for x in items if x is not None).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, share: int = 20, most_bytes: int = MOST_BYTES, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` but names of the result (and, if asked, without the text), and n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: n_hit > 0 and ``share`` * n_hit >= n_words.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("_item"), F.coalesce("text", F.lit("")).alias("_text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // most_bytes))
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kept = others(docs.columns, names)
    docs = docs.select(*[F.col(quoted(c)) for c in kept])
    own = next(c for c in kept if c.lower() == text.lower())
    if blocks == 1:
        pairs = [(r[0], r[1]) for r in items.sort("_item", "_text").collect()]  # under most_bytes
        tables = spark.sparkContext.broadcast(build_patterns(pairs, window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, col in slices(batch, f"_{at}"):
                    n, hits, found = _scan(col, tables.value)
                    n_hit = np.array([len(x) for x in hits], dtype=np.int64)
                    more = [n.astype(np.int64), n_hit, np.array([len(x) for x in found], dtype=np.int64), [_digest(x) for x in found], (n_hit > 0) & (share * n_hit >= n)]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *map(pa.array, more)], names=[*(part.schema.names[i] for i in places), *names])

        at = kept.index(own)
        places = [i for i in range(len(kept)) if keep_text or i != at]
        rows, types = numbered(docs)
        return rows.mapInArrow(lean(scan), ", ".join([*(types[i] for i in places), _SCHEMA])).toDF(*(kept[i] for i in places), *names)
    out = _in_blocks(docs, items, own, window, share, blocks)
    return out if keep_text else out.drop(F.col(quoted(own)))


def _in_blocks(docs: DataFrame, items: DataFrame, text: str, window: int, share: int, blocks: int) -> DataFrame:
    """As above for a large benchmark: every block's tables in turn, hits merged per document row. A row's columns travel in one struct."""
    spark = docs.sparkSession
    keyed = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_all"), F.col(quoted(text)).alias("_text"))
    keyed = stored(keyed.withColumn("_row", F.md5(F.to_json("_all").cast("binary"))), "keyed")
    found = []
    for b in range(blocks):
        pairs = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64(F.coalesce("_item", "_text")), F.lit(blocks)) == b).collect()]
        tables = spark.sparkContext.broadcast(build_patterns(pairs, window))

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, col in slices(batch, "_text"):
                    _, hits, names = _scan(col, tables.value)
                    keep = [i for i, x in enumerate(names) if x]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([hits[i] for i in keep], pa.list_(pa.int64())), pa.array([names[i] for i in keep], pa.list_(pa.string()))], names=["_row", "_hits", "_items"])

        found.append(stored(keyed.select("_row", "_text").mapInArrow(lean(scan), "_row string, _hits array<long>, _items array<string>").dropDuplicates(["_row"]), f"hits{b}"))
        tables.destroy()
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("_row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("_hits")))).alias("_k"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    merged = stored(merged, "hits")
    for part in found:
        forget(part)
    words = F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.filter(F.split(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != ""))).cast("long")
    out = keyed.join(merged, "_row", "left").select("_all", words.alias("n"), F.coalesce("_k", F.lit(0)).cast("long").alias("k"), F.coalesce("_items", F.array().cast("array<string>")).alias("i"))
    more = [F.col("n").alias("n_words"), F.col("k").alias("n_hit"), F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), ((F.col("k") > 0) & (share * F.col("k") >= F.col("n"))).alias("contaminated")]
    return out.select(*[F.col(f"_all.{quoted(c)}").alias(c) for c in docs.columns], *more)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, load(spark, sf_dir, "benchmark"), keep_text=False).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
