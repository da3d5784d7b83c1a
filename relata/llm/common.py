"""Helpers shared by the training-data operators: ranges of ids, Arrow text buffers, words.

``stored``, ``forget`` and ``fresh_dir`` are the library's own: lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the
one folder that the driver and all executors share, so a lost executor never takes an intermediate result with it.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.sources.scratch import forget, fresh_dir, shared_dir, stored  # noqa: F401

_LOWEST = -(2**63)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data directory, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def order_key(col: str) -> Column:
    """A non-null long that sorts like the id (null first)."""
    return F.coalesce(F.col(col).cast("long"), F.lit(_LOWEST))


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def others(columns: list[str], names: list[str]) -> list[str]:
    """The columns that don't share a name (in any case) with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns under plain names (_0, _1, ...), which Arrow steps need, and each one's part of a schema."""
    plain = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*plain), [f"{n} {f.dataType.simpleString()}" for n, f in zip(plain, df.schema)]


def key_cuts(df: DataFrame, key: str, rows_per_bucket: int = 2048, splits: int = 512, most: int = 65536) -> tuple[list[int], int, int, int]:
    """(cuts, parts, lowest, highest): approximate percentiles of ``key`` (at most ``splits`` values reach the driver), and into how many
    parts of equal width each range between them is cut further when the table is large, ``most`` ranges at most in all."""
    n = df.count()
    want = max(1, min(most, math.ceil(n / rows_per_bucket)))
    k = min(splits, want)
    if k == 1:
        return [], 1, 0, 0
    q = F.percentile_approx(F.col(key), [i / k for i in range(1, k)], max(1000, 20 * k))
    row = df.agg(q.alias("q"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return sorted({int(x) for x in row["q"]} - {int(row["lo"])}), max(1, want // k), int(row["lo"]), int(row["hi"])


def _range_of(key: Column, cuts: list[int], parts: int, low: int, high: int) -> Column:
    if not cuts:
        return F.lit(0).cast("long")
    cut = F.lit(np.array(cuts, dtype=np.int64))
    i = F.size(F.filter(cut, lambda s: s <= key)).cast("long")
    if parts == 1:
        return i
    edges = F.lit(np.array([low, *cuts, min(high, 2**63 - 2) + 1], dtype=np.int64))
    lo, hi = F.element_at(edges, (i + 1).cast("int")), F.element_at(edges, (i + 2).cast("int"))
    sub = F.floor((key.cast("double") - lo) / (hi.cast("double") - lo) * parts)
    return i * parts + F.least(F.greatest(sub, F.lit(0)), F.lit(parts - 1))


def id_bucket(df: DataFrame, key: str, rows_per_bucket: int = 2048, splits: int = 512, most: int = 65536) -> Column:
    """Expression that numbers ranges of ``key`` in ascending order, of about equal row counts.

    Only the balance depends on the approximation of the bounds: bucket order always agrees with key order.
    """
    return _range_of(F.col(key), *key_cuts(df, key, rows_per_bucket, splits, most))


def _hot(df: DataFrame, keys: list[str], rows: int, most: int) -> list:
    """Keys with more than ``rows`` rows each, or so many more that there are ``most`` of them at most."""
    n = df.count()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max(rows, n // most)).sort(*keys).collect()


def id_ranges(df: DataFrame, key: str = "_key", text: str = "text", rows_per_bucket: int = 2048, most_hot: int = 2048) -> DataFrame:
    """Adds _h (a hash of the text) and _bucket: ranges of about equal row counts, in the order of (key, _h).

    A key with very many rows (a null id, say) has ranges of its own, cut by _h; very many rows of one key and one text are equal, and
    are dealt over ranges by their row number. At most ``most_hot`` of either reach the driver.
    """
    spark = df.sparkSession
    ids = df.select(key)
    cuts, parts, low, high = key_cuts(ids, key, rows_per_bucket)
    d = df.withColumn("_h", F.xxhash64(text))
    hot = _hot(ids, [key], 4 * rows_per_bucket, most_hot)
    if not hot:
        return d.withColumn("_bucket", _range_of(F.col(key), cuts, parts, low, high))
    # hot keys stand alone between two cuts; each range of keys then has a number of places
    alone = {int(r[key]): int(r["n"]) for r in hot}
    cuts = sorted({*cuts, *(k for k in alone if k > low), *(k + 1 for k in alone if k < high)})
    starts = [low, *cuts]
    known = spark.createDataFrame([(k,) for k in alone], "_hk long")
    twice = _hot(d.join(F.broadcast(known), F.col(key) == F.col("_hk")), [key, "_h"], 4 * rows_per_bucket, most_hot)
    again: dict[int, list] = {}
    for r in twice:
        again.setdefault(int(r[key]), []).append((int(r["_h"]), -(-int(r["n"]) // rows_per_bucket)))
    base, table, at = [], [], 0
    for start in starts:
        base.append(at)
        if start not in alone:
            at += parts
            continue
        many = min(4096, -(-alone[start] // rows_per_bucket))
        equal = dict(again.get(start, []))
        inner = sorted({-(2**63) + i * 2**64 // many for i in range(1, many)} | {h for h in equal if h > -(2**63)} | {h + 1 for h in equal if h < 2**63 - 1})
        offs, sizes, own = [], [], 0
        for h in [-(2**63), *inner]:
            offs.append(own)
            sizes.append(equal.get(h, 1))
            own += sizes[-1]
        table.append((start, inner, offs, sizes))
        at += own
    i = F.size(F.filter(F.lit(np.array(cuts, dtype=np.int64)), lambda s: s <= F.col(key))) if cuts else F.lit(0)
    first = F.element_at(F.lit(np.array(base, dtype=np.int64)), (i + 1).cast("int"))
    inside = _range_of(F.col(key), cuts, parts, low, high) - i * parts
    hots = spark.createDataFrame(table, "_hk long, _cuts array<long>, _offs array<long>, _sizes array<long>")
    j = F.size(F.filter("_cuts", lambda s: s <= F.col("_h"))) + 1
    size = F.element_at("_sizes", j)
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), size)  # equal rows: any may stand in any of their places
    place = F.element_at("_offs", j) + F.when(size > 1, deal).otherwise(0)
    out = d.join(F.broadcast(hots), F.col(key) == F.col("_hk"), "left")  # ``most_hot`` rows
    return out.withColumn("_bucket", first + F.when(F.col("_hk").isNull(), inside if parts > 1 else F.lit(0)).otherwise(place)).drop("_hk", "_cuts", "_offs", "_sizes")


def lean(step):
    """Wrap an Arrow step so that its worker gives freed memory back when a partition ends (workers stay and share an
    executor's memory with later stages)."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1, from 0) and bytes of an Arrow string array without nulls, uncopied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return offs - offs[0], data[offs[0] : offs[-1]]


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20, most_rows: int = 4096):
    """Cut a batch by rows so that each part has about ``most_bytes`` of text (one long row may exceed it)."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(text)).fill_null("")
    offs, _ = utf8_parts(col)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + most_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, end - at), col.slice(at, end - at)
        at = end


WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z are lowered: digits, a-z, everything beyond ASCII
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def word_spans(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, word starts and ends (byte positions) and the words' row bounds (n + 1).

    UTF-8 bytes of code points beyond ASCII are all >= 0x80, so the byte classes equal WORD_CLASS.
    """
    low = _LOWER[data]
    # one separator after each row keeps a word from running into the next row
    n = len(offs) - 1
    padded = np.zeros(len(low) + n, dtype=np.uint8)
    shift = np.repeat(np.arange(n), np.diff(offs))
    padded[np.arange(len(low)) + shift] = low
    edge = np.diff(np.concatenate(([0], _IS_WORD[padded].astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    rows = np.searchsorted(starts, offs + np.arange(n + 1))
    return padded, starts, ends, rows


def word_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word's bytes, by wrapping prefix sums (odd base, so invertible)."""
    base = np.uint64(0x9E3779B97F4A7C15)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = (ends - starts).astype(np.int64)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(int(lengths.max()), base))))
    body = padded[np.repeat(starts, lengths) + at].astype(np.uint64) + np.uint64(1)
    body = np.append(body * powers[at], np.uint64(0))  # an empty word's sum is cut to 0 below
    sums = np.where(lengths > 0, np.add.reduceat(body, np.cumsum(lengths) - lengths), np.uint64(0))
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
