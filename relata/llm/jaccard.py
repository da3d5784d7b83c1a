"""Operator 6 - n-gram Jaccard join by MinHash banding.

* Each text's set of five-word shingles (words as in WORD_CLASS) gets a MinHash signature. Bands and rows are chosen for a
  target recall at the similarity threshold (0.8): the most selective banding of at most ``most_hashes`` hashes.
* Texts with equal shingle sets are one class, found by a hash of the set; only classes go on.
* Band hashes are shuffled. Inside each bucket members are compared by their signatures (a byte a hash): two are tied where
  the share of equal bytes is within six standard deviations of the threshold, so texts that collide in one band by chance are not
  tied. A bucket with many members is cut into blocks, a pair of blocks is a task's work, and what leaves it is a forest, no pairs.
  The connected parts of these ties are the candidate groups.
* In a group all pairs are verified on the full shingle sets (as sorted hashes): intersections by matrix products in a fixed
  work buffer. A group is cut into blocks, each pair of blocks is a unit of at most 2 * BLOCK_CLASSES sets; per class only its
  number of links and the root of its local part leave the task, so no list of pairs exists however large a group is.

Result: one row per document: doc_id, class_id (smallest id of all documents connected by links), copy_id (smallest id with
an equal shingle set) and n_links (documents other than it with Jaccard similarity >= 0.8 in its group).

Defined results: texts of 1 to 4 words have one shingle, all their words; null, empty and wordless texts have none, are
linked to nothing and are each their own class (class_id = copy_id = doc_id). Repeated rows are copies of each other. A null
id counts as the smallest long. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.common import forget, lean, load, mix, order_key, slices, stored, utf8_parts, word_hashes, word_spans
from relata.llm.components import components

N = 5
THRESHOLD = (4, 5)
BLOCK_CLASSES = 512
BLOCK_SHINGLES = 1_000_000
BLOCK_SIGNATURES = 1024
_CHUNK = 4096


def choose_bands(threshold: float, recall: float = 0.999, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the largest rows whose bands reach the recall at the threshold within the hashes."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        miss = math.log1p(-(threshold**rows)) if threshold < 1 else -math.inf  # of one band, as a logarithm
        bands = max(1, math.ceil(math.log(1 - recall) / miss))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def shingles(col: pa.Array, n: int = N) -> list[np.ndarray]:
    """Distinct shingle hashes (sorted uint64) of each text."""
    offs, data = utf8_parts(col)
    padded, starts, ends, rows = word_spans(offs, data)
    h = word_hashes(padded, starts, ends)
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            grams = grams * np.uint64(0xBF58476D1CE4E5B9) + h[j : len(h) - n + 1 + j]
        grams = mix(grams)
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            key = np.array([hi - lo], np.uint64)
            for x in h[lo:hi]:
                key = key * np.uint64(0x94D049BB133111EB) + x
            out.append(mix(key))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _constants(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240607))
    return r.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, bands * rows, dtype=np.uint64)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (int64) and the low byte of each MinHash (multiply-shift), a row for each non-empty set."""
    a, b = _constants(bands, rows)
    flat = np.concatenate(sets)
    cuts = np.cumsum([0, *map(len, sets)])[:-1]
    out, low_bytes = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), bands * rows), np.uint8)
    with np.errstate(over="ignore"):
        for j in range(bands):
            key = np.full(len(sets), j + 1, np.uint64)
            for i in range(j * rows, (j + 1) * rows):
                low = np.minimum.reduceat((flat * a[i] + b[i]) >> np.uint64(24), cuts)
                low_bytes[:, i] = low & np.uint64(255)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
            out[:, j] = key
    return out.view(np.int64), low_bytes


def text_hash(text: str) -> Column:
    """Tells rows of one id apart; null and '' differ."""
    return F.xxhash64(F.col(text))


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(_d, _t, _set, _n, _bands, _sig) of each document: id, text hash, key and size of its set, band hashes and signature bytes; the
    last four are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, col in slices(batch, "_text", 1 << 19):
                sets = shingles(col, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                marks: list[np.ndarray | None] = [None] * len(sets)
                sigs: list[bytes | None] = [None] * len(sets)
                if full:
                    hashes, low = band_hashes([sets[i] for i in full], bands, rows)
                    for k, i in enumerate(full):
                        keys[i], marks[i], sigs[i] = _set_key(sets[i]), hashes[k], low[k].tobytes()
                cols = [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array([len(s) or None for s in sets], pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["_d", "_t", "_set", "_n", "_bands", "_sig"])

    d = docs.select(order_key("doc_id").alias("_d"), text_hash(text).alias("_t"), F.col(text).alias("_text"))
    return d.mapInArrow(lean(run), "_d long, _t long, _set binary, _n long, _bands array<long>, _sig binary")


def limits(share: float, hashes: int) -> tuple[float, float]:
    """(tied, core): shares of equal signature bytes. Two sets at the threshold are below ``tied`` with a chance of 1e-9. Equal bytes
    are a metric, so what isn't tied to a set is no match of its ``core`` either (five standard deviations)."""
    sigma = math.sqrt(share * (1 - share) / hashes)
    return max(0.0, share - 6 * sigma), 1 - sigma


def tied_parts(sig: np.ndarray, tied: float, core: float) -> np.ndarray:
    """Root (smallest row number) of each signature's part. Each round compares one signature to all that are left; those tied
    to it leave, and of them only the ones beyond its core are compared to the rest."""
    m, hashes = sig.shape
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = int(root[i])
        return i

    def tie(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)

    left = np.arange(m)
    while len(left) > 1:
        equal = (sig[left] == sig[left[0]]).sum(axis=1)
        near = equal >= tied * hashes
        tie(int(left[0]), left[near])
        ring, left = left[near & (equal < core * hashes)], left[~near]
        for r in ring.tolist() if len(left) else ():
            tie(r, left[(sig[left] == sig[r]).sum(axis=1) >= tied * hashes])
    return np.array([find(i) for i in range(m)])


def _blocks_of(df: DataFrame, blocks: Column, by: Column, inner: bool) -> DataFrame:
    """Each row once for every block of its group, as pair (p, q) of blocks, p <= q; b is the row's own. inner: blocks with themselves
    too (else only where there is one block)."""
    d = df.withColumn("_blocks", blocks.cast("int")).withColumn("b", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    if not inner:
        d = d.where((F.col("b") != F.col("_other")) | (F.col("_blocks") == 1))
    return d.withColumns({"p": F.least("b", "_other"), "q": F.greatest("b", "_other")}).drop("_blocks", "_other")


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches, grouped by their first columns."""
    group, rows = None, []
    parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))  # few rows at a time become Python objects
    for part in parts:
        for row in zip(*(c.to_pylist() for c in part.columns)):
            if row[:keys] != group:
                if rows:
                    yield group, rows
                group, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield group, rows


def candidate_ties(classes: DataFrame, share: float, hashes: int) -> DataFrame:
    """(u, v), stored: classes (c, bands, sig) of one bucket whose signatures are tied, as forests."""
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    entry = classes.select("c", F.posexplode("bands").alias("j", "h"))
    many = stored(entry.groupBy("j", "h").agg(F.count("*").alias("k")).where("k > 1"), "buckets")  # so that the join below is a plain one
    member = entry.join(many, ["j", "h"]).join(classes.select("c", "sig"), "c")
    units = _blocks_of(member, F.ceil(F.col("k") / BLOCK_SIGNATURES), F.col("c"), False).select("j", "h", "p", "q", "c", "sig")
    units = units.repartition(parts, "j", "h", "p", "q").sortWithinPartitions("j", "h", "p", "q", "c")
    tied, core = limits(share, hashes)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _units(batches, 4):
            c = np.array([r[0] for r in rows], dtype=np.int64)
            root = tied_parts(np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1), tied, core)
            own = root != np.arange(len(c))
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(c[root[own]])], names=["u", "v"])

    out = stored(units.mapInArrow(lean(compare), "u long, v long").distinct(), "ties")
    forget(many)
    return out


class Verifier:
    """Links between two lists of sets, or inside one, by matrix products in a fixed work buffer."""

    def __init__(self, share: tuple[int, int], most: int = BLOCK_CLASSES):
        self.share, self.work = share, [np.zeros((most, _CHUNK), np.float32) for _ in range(2)]

    def links(self, a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
        """Boolean matrix of the pairs whose similarity reaches the threshold."""
        one = b is None
        sets = a if one else a + b
        size = np.array([len(s) for s in sets], dtype=np.int64)
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(flat)])))
        del flat, order
        row = row[np.repeat(count > 1, count)]
        count = count[count > 1]
        ends = np.concatenate(([0], np.cumsum(count)))
        m, n = len(a), len(sets) - (0 if one else len(a))
        common = np.zeros((m, n), np.float32)  # counts below 2^24 are exact
        for lo in range(0, len(count), _CHUNK):
            hi = min(lo + _CHUNK, len(count))
            r = row[ends[lo] : ends[hi]]
            c = np.repeat(np.arange(hi - lo), count[lo:hi])
            x = self._marked(0, m, r[r < m], c[r < m], hi - lo)
            common += x @ (x if one else self._marked(1, n, r[r >= m] - m, c[r >= m], hi - lo)).T
        wide = common.astype(np.float64)
        union = size[:m, None] + size[len(sets) - n :][None, :] - wide
        link = wide * self.share[1] >= union * self.share[0]
        if one:
            np.fill_diagonal(link, False)
        return link

    def _marked(self, which: int, m: int, r: np.ndarray, c: np.ndarray, width: int) -> np.ndarray:
        x = self.work[which][:m, :width] if m <= len(self.work[which]) else np.empty((m, width), np.float32)
        x[:] = 0
        x[r, c] = 1
        return x


def local_roots(link: np.ndarray, one: bool) -> np.ndarray:
    """Smallest node number of each node's connected part; nodes: rows, then (unless ``one``) columns."""
    m, n = link.shape
    total = m if one else m + n
    root = np.arange(total)
    while True:
        low = np.where(link, (root if one else root[m:])[None, :], total).min(axis=1)
        if not one:
            low = np.concatenate((low, np.where(link, root[:m, None], total).min(axis=0)))
        new = np.minimum(root, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def similar(docs: DataFrame, text: str = "text", n: int = N, share: tuple[int, int] = THRESHOLD, recall: float = 0.999, keep_hash: bool = False) -> DataFrame:
    """One row (doc_id, class_id, copy_id, n_links) per document; see the module.

    keep_hash: also text_hash and root, the number of the class (null without words). Where ids repeat, classes of one
    class_id differ in it.
    """
    spark = docs.sparkSession
    bands, rows = choose_bands(share[0] / share[1], recall)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sig = stored(signatures(docs, text, n, bands, rows), "signatures")
    with_words = sig.where(F.col("_set").isNotNull())
    classes = with_words.groupBy("_set").agg(F.min(F.struct("_d", "_t")).alias("_r"), F.count("*").alias("size"), F.first("_n").alias("n"), F.first("_bands").alias("bands"), F.first("_sig").alias("sig"))
    classes = stored(classes.select("_set", F.col("_r._d").alias("rep"), F.col("_r._t").alias("rep_t"), "size", "n", "bands", "sig", F.monotonically_increasing_id().alias("c")), "classes")
    edges = candidate_ties(classes, share[0] / share[1], bands * rows)
    part = components(edges)
    groups = stored(part.join(classes.select(F.col("c").alias("vertex"), "rep", "rep_t", "size", "n", F.col("_set").alias("_want")), "vertex"), "groups")
    # the texts are shuffled once, by id and text hash (rows of one id that differ do not meet), and go on as shingle hashes; a merge
    # join at every size: members are never broadcast, however few
    d = docs.where(F.col(text).isNotNull()).select(order_key("doc_id").alias("rep"), text_hash(text).alias("rep_t"), F.col(text).alias("_text"))
    found = groups.select("rep", "rep_t", "root", "vertex", "size", "_want").join(d.hint("merge"), ["rep", "rep_t"]).select("root", "vertex", "size", "_want", "_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, col in slices(batch, "_text"):
                sets = shingles(col, n)
                keep = [i for i, (s, want) in enumerate(zip(sets, part.column(3).to_pylist())) if _set_key(s) == want]  # a text hash may clash
                heads = [part.column(i).take(pa.array(keep, pa.int64())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["root", "vertex", "size", "hashes"])

    shape = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    work = found.mapInArrow(lean(hashed), "root long, vertex long, size long, hashes binary").join(shape, "root")
    work = _blocks_of(work, F.col("blocks"), F.col("vertex"), True).select("root", "p", "q", "b", "vertex", "size", "hashes")
    work = work.repartition(parts, "root", "p", "q").sortWithinPartitions("root", "p", "q", "b", "vertex")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = Verifier(share)
        for (_, p, q), found in _units(batches, 3):
            found = [r for i, r in enumerate(found) if not i or r[1] != found[i - 1][1]]  # repeated rows give a class twice
            sets = [np.frombuffer(r[3], np.uint64) for r in found]
            m = sum(r[0] == p for r in found)
            if len(sets) < 2 or p != q and m in (0, len(sets)):
                continue
            link = verifier.links(sets[:m], None if p == q else sets[m:])
            weight = np.array([r[2] for r in found], dtype=np.float64)
            links = link @ weight if p == q else np.concatenate((link @ weight[m:], weight[:m] @ link))
            vertex = np.array([r[1] for r in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(vertex[local_roots(link, p == q)]), pa.array(links.astype(np.int64))], names=["u", "v", "links"])

    checked = stored(work.mapInArrow(lean(verify), "u long, v long, links long"), "links")
    counts = checked.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "c")
    linked = components(checked.where("u <> v").select("u", "v"))
    named = classes.join(linked.withColumnRenamed("vertex", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    low = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    out = named.join(low, "root").join(counts, "c", "left").select("_set", "class_id", F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "root")
    out = stored(out, "classes-linked")
    for old in (edges, part, groups, checked, linked, classes):
        forget(old)
    more = ["text_hash", "root"] if keep_hash else []
    # rows without words have no key: they need no join, and don't meet in one task
    rows_out = with_words.join(out, "_set").select(F.col("_d").alias("doc_id"), "class_id", "copy_id", "n_links", F.col("_t").alias("text_hash"), "root")
    alone = sig.where(F.col("_set").isNull()).select(F.col("_d").alias("doc_id"), F.col("_d").alias("class_id"), F.col("_d").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.col("_t").alias("text_hash"), F.lit(None).cast("long").alias("root"))
    return rows_out.unionByName(alone).select("doc_id", "class_id", "copy_id", "n_links", *more)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(load(spark, sf_dir, "documents").select("doc_id", "text"))
