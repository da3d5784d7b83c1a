"""Operator 10 - quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's features are its hashed words, and hashed 3- and 4-grams of its shape (runs of letters in one case become one sign, digits
one sign; other signs stay, so "THIS!! THAT!!" gives "U!! U!! "). Each kind is weighted by tf-idf (document frequencies over all
documents) and scaled to a length of its own; together they are projected on the leading singular vectors of a labelled sample
(latent semantic analysis). The sample's vectors and labels are broadcast, at most ``most_labelled`` rows; every document's cosines to
all of them are exact, in blocks. Its ``neighbours`` nearest vote with weight cosine^``power``; ties with the last of them (to
six places) vote too, so the order of rows plays no part.

Labels are learnt only from rows with crc32(doc_id as text) mod 3 <> 1. The sample is the labelled rows with the smallest id
hashes; each label's share of the vote is as it stands in the sample.

Defined results: null text is empty; a text that is like no sample row (no positive cosine) gets the sample's mean label; without
any label all scores are 0.5 (predicted 1). Rows of labels with a null label are no sample; of several for one id the smallest
counts. Extra columns pass through, but for those that have the name of a result (in any case): these are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.common import forget, lean, load, mix, numbered, others, quoted, slices, stored, trim, utf8_parts, word_hashes, word_spans

MOST_LABELLED = 4096
WORDS, SHAPES = 2048, 1024  # features: words first
DIMENSIONS = WORDS + SHAPES
WORD_WEIGHT = 0.5
LATENT = 128
NEIGHBOURS = 25
POWER = 12
_ROWS = 512  # of a block

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("l")
_SHAPE[65:91] = ord("U")
_SHAPE[48:58] = ord("0")
_SHAPE[[9, 11, 12, 13]] = ord(" ")
_LETTER = np.zeros(256, bool)
_LETTER[[ord("l"), ord("U"), ord("0")]] = True


def _grams(codes: np.ndarray, row: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and rows of all n-grams inside rows."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(len(codes) - n + 1, salt, np.uint64)
    for j in range(n):
        h = h * np.uint64(257) + codes[j : len(codes) - n + 1 + j].astype(np.uint64)
    ok = row[: len(h)] == row[n - 1 :]
    return WORDS + (mix(h[ok]) % np.uint64(SHAPES)).astype(np.int64), row[: len(h)][ok]


def features(col: pa.Array) -> np.ndarray:
    """Raw feature counts, one float32 row per text."""
    offs, data = utf8_parts(col)
    n = len(col)
    row = np.repeat(np.arange(n), np.diff(offs))
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = ~((shape[1:] == shape[:-1]) & _LETTER[shape[1:]] & (row[1:] == row[:-1]))
    shape, row = shape[keep], row[keep]
    padded, starts, ends, rows = word_spans(offs, data)
    words = (word_hashes(padded, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    out = np.zeros(n * DIMENSIONS, np.float32)
    for f, r in ((words, np.repeat(np.arange(n), np.diff(rows))), _grams(shape, row, 3, 3), _grams(shape, row, 4, 4)):
        at, count = np.unique(r * DIMENSIONS + f, return_counts=True)
        out[at] += count
    return out.reshape(n, DIMENSIONS)


def weigh(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length-free tf-idf: square roots of shares, words and shapes each of length 1 (words times WORD_WEIGHT), rows of length 1."""
    out = np.empty(raw.shape, np.float32)
    for part, weight in ((slice(0, WORDS), WORD_WEIGHT), (slice(WORDS, DIMENSIONS), 1.0)):
        x = np.sqrt(raw[:, part] / np.maximum(raw[:, part].sum(axis=1, keepdims=True), 1)) * idf[part]
        out[:, part] = weight * unit(x)
    return unit(out)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def leading_axes(x: np.ndarray, latent: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    width = min(latent + 16, *x.shape)
    axes = np.random.Generator(np.random.PCG64(11)).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        axes, _ = np.linalg.qr(x.T @ (x @ axes))
    _, _, turn = np.linalg.svd(x @ axes, full_matrices=False)
    return np.ascontiguousarray(axes @ turn[:latent].T)


class Model:
    """raw: feature rows of the sample; frequencies: documents with each feature, of n_documents."""

    def __init__(self, raw: np.ndarray, labels: np.ndarray, frequencies: np.ndarray, n_documents: int, latent: int = LATENT, neighbours: int = NEIGHBOURS, power: float = POWER):
        self.labels, self.neighbours, self.power = labels.astype(np.float64), min(neighbours, len(labels)), power
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        self.idf = (np.log((1 + n_documents) / (1 + np.asarray(frequencies))) + 1).astype(np.float32)
        x = np.empty(raw.shape, np.float32)
        for lo in range(0, len(raw), _ROWS):
            x[lo : lo + _ROWS] = weigh(raw[lo : lo + _ROWS], self.idf)
        self.axes = leading_axes(x, latent)
        self.points = unit(x @ self.axes)

    def scores(self, raw: np.ndarray, block: int = _ROWS) -> np.ndarray:
        out = np.full(len(raw), self.prior)
        if not len(self.labels):
            return out
        for lo in range(0, len(raw), block):
            cosine = np.round(unit(weigh(raw[lo : lo + block], self.idf) @ self.axes) @ self.points.T, 6)
            last = np.partition(cosine, -self.neighbours, axis=1)[:, -self.neighbours]
            row, near = np.nonzero((cosine >= last[:, None]) & (cosine > 0))
            weight = cosine[row, near].astype(np.float64) ** self.power
            total = np.bincount(row, weight, len(cosine))
            vote = np.bincount(row, weight * self.labels[near], len(cosine))
            out[lo : lo + block] = np.where(total > 1e-12, vote / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents, and of those that have each feature. A task's sums are one row a feature; so is what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for _, col in slices(batch, "_text", 1 << 20, _ROWS):
                found[:-1] += np.count_nonzero(features(col), axis=0)
                found[-1] += len(col)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["f", "n"])

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(lean(run), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["f"]] = r["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most_labelled: int = MOST_LABELLED, label: str = "quality") -> Model:
    """The model of a sample of labelled rows that aren't held out; ``most_labelled`` feature rows (sparse) reach the driver."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("_y"))
    known = known.sort(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    d = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(known), "doc_id").select("doc_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, col in slices(batch, "_text", 1 << 20, _ROWS):
                raw = features(col)
                at = [np.flatnonzero(x) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([x[i].astype("<f4").tobytes() for x, i in zip(raw, at)], pa.binary())], names=["doc_id", "y", "f", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    labelled = stored(d.mapInArrow(lean(run), f"doc_id {kind}, y int, f binary, x binary"), "labelled")
    rows = labelled.sort("doc_id", "f", "x").limit(most_labelled).collect()
    forget(labelled)
    raw = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        raw[i, np.frombuffer(r["f"], "<u2")] = np.frombuffer(r["x"], "<f4")
    n, frequencies = document_frequencies(docs, text) if rows else (0, np.zeros(DIMENSIONS))
    out = Model(raw, np.array([r["y"] for r in rows], dtype=np.float32), frequencies, n)
    del raw, rows
    trim()
    return out


def score(docs: DataFrame, labels: DataFrame, text: str = "text", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """All columns of ``docs`` (but names of the result) and held_out, score, predicted."""
    names = ["held_out", "score", "predicted"]
    docs = docs.select(*[F.col(quoted(c)) for c in others(docs.columns, names)])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text.lower())
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, most_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, col in slices(batch, f"_{at}", 1 << 20, _ROWS):
                s = model.value.scores(features(col))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    marked = docs.withColumn("held_out", held_out())
    rows, types = numbered(marked)
    return rows.mapInArrow(lean(run), ", ".join([*types, "score double", "predicted int"])).toDF(*marked.columns, "score", "predicted")


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")).drop("text")
