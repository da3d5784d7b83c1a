"""Operator 7 - token ids in binary files with Elias-Fano document bounds.

Texts are dealt by ranges of doc_id (one shuffle of the texts; ids are made after it), encoded in order, and each range is
written as one file: a header, the doc ids (less the first) and the bounds of the documents as Elias-Fano sequences with select directories,
and the concatenated ids. A sequence of n numbers up to u takes n * (2 + log2(u / n)) bits and a directory of 32 bits
for each 512, instead of 64 bits each; ids take 16 bits while the vocabulary allows (the header says which).

File: magic "RLEF", u32 version, u32 id width, u32 low bits of doc ids, u32 low bits of bounds, i64 first doc id, u64 documents, u64 ids,
u64 lengths of six sections (low bits, high bits and directory of the doc ids, then of the bounds), then the sections and the ids; all
little-endian.

Defined results: null text is empty (the end id alone); equal doc_ids go by a hash of the text; a null id sorts first and is kept as the
smallest long; an empty table gives no file and no row. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm import files
from relata.llm.common import forget, fresh_dir, id_ranges, lean, load, order_key, slices, stored
from relata.llm.tokens import WORD_VOCABULARY, encoder, with_end

_HEAD = struct.Struct("<4sIIIIqQQ6Q")
_BLOCK_BITS = 512
_MOST_IDS = 32 << 20  # of a file; a longer range goes on in the next file


class EliasFano:
    """A non-decreasing sequence of ``n`` integers: low bits packed, high bits in unary with a select directory."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.width, self.low, self.high, self.directory = n, width, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if width:
            bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = -(-(int(ones[-1]) + 1 if n else 1) // _BLOCK_BITS) * _BLOCK_BITS
        flags = np.zeros(size, np.uint8)
        flags[ones] = 1
        directory = np.concatenate(([0], np.cumsum(flags.reshape(-1, _BLOCK_BITS).sum(axis=1, dtype=np.int64)))).astype("<u4")
        return cls(n, width, low, np.packbits(flags, bitorder="little"), directory)

    def select(self, index: np.ndarray) -> np.ndarray:
        """Values at the places ``index``: the directory finds the block, a scan of that block alone the bit."""
        i = np.asarray(index, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.directory, i, side="right") - 1
        some, back = np.unique(block, return_inverse=True)
        seen = np.unpackbits(self.high.reshape(-1, _BLOCK_BITS // 8)[some], axis=1, bitorder="little").cumsum(axis=1, dtype=np.int32)
        rank = i - self.directory[block].astype(np.int64)
        bit = np.zeros(len(i), np.int64)
        order = np.argsort(back, kind="stable")
        cuts = np.searchsorted(back[order], np.arange(len(some) + 1))
        for k in range(len(some)):
            of = order[cuts[k] : cuts[k + 1]]
            bit[of] = np.searchsorted(seen[k], rank[of] + 1)
        high = block * _BLOCK_BITS + bit - i
        if not self.width:
            return high
        at = (i * self.width)[:, None] + np.arange(self.width)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (high << self.width) | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)


def pack(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """A file's bytes; doc_ids: ascending; bounds: n + 1 from 0."""
    doc_ids = np.asarray(doc_ids, np.int64)
    base = doc_ids[0] if len(doc_ids) else np.int64(0)
    keys, ends = EliasFano.encode(doc_ids.view(np.uint64) - base.view(np.uint64)), EliasFano.encode(bounds)  # modulo 2^64, so the range is no matter
    width = ids.dtype.itemsize
    parts = [x.tobytes() for ef in (keys, ends) for x in (ef.low, ef.high, ef.directory)]
    yield _HEAD.pack(b"RLEF", 2, width, keys.width, ends.width, int(base), len(doc_ids), len(ids), *map(len, parts))
    yield from parts
    yield ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """Random access to a file's documents by range reads."""

    def __init__(self, source):
        self.source = source
        magic, version, self.width, key_width, end_width, self.base, self.n, self.n_ids, *sizes = _HEAD.unpack(source.read_at(_HEAD.size, 0))
        if magic != b"RLEF" or version != 2:
            raise ValueError("not a token file")
        at, parts = _HEAD.size, []
        for size in sizes:
            parts.append(np.frombuffer(source.read_at(size, at), np.uint8))
            at += size
        self.body = at
        self.keys = EliasFano(self.n, key_width, parts[0], parts[1], parts[2].view("<u4"))
        self.bounds = EliasFano(self.n + 1, end_width, parts[3], parts[4], parts[5].view("<u4"))

    @functools.cached_property
    def doc_ids(self) -> np.ndarray:
        return self.ids_of(0, self.n)

    def ids_of(self, start: int, end: int) -> np.ndarray:
        """Ids of the documents at places start to end."""
        return (self.keys.select(np.arange(start, end)).view(np.uint64) + np.int64(self.base).view(np.uint64)).view(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.source.read_at((end - start) * self.width, self.body + start * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds.select(np.array([i, i + 1])).tolist()
        return self.ids(start, end)


def write_ids(docs: DataFrame, folder: str, text: str = "text", vocabulary: str = WORD_VOCABULARY) -> list[tuple[str, int]]:
    """Write all documents; (file name, ids before it) of each file in order of doc_id. One row a file reaches the driver."""
    d = docs.select(order_key("doc_id").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = id_ranges(d, "_key", "_text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = d.repartition(parts, "_bucket").sortWithinPartitions("_bucket", "_key", "_h", "_text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        state: dict = {"bucket": None, "part": 0, "keys": [], "bounds": [np.zeros(1, np.int64)], "ids": [], "n": 0}

        def close() -> pa.RecordBatch:
            name = files.write(folder, f"ids-{state['bucket']:06d}-{state['part']:04d}-{task}", pack(np.concatenate(state["keys"]), np.concatenate(state["bounds"]), np.concatenate(state["ids"])))
            row = pa.RecordBatch.from_pydict({"name": [name], "bucket": pa.array([state["bucket"]], pa.int64()), "part": pa.array([state["part"]], pa.int32()), "n_ids": pa.array([state["n"]], pa.int64())})
            state.update(keys=[], bounds=[np.zeros(1, np.int64)], ids=[], n=0, part=state["part"] + 1)
            return row

        for batch in batches:
            for part, col in slices(batch, "_text"):
                ids, bounds = with_end(*enc.encode(col))
                buckets = part.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if buckets[lo] != state["bucket"]:
                        if state["keys"]:
                            yield close()
                        state.update(bucket=int(buckets[lo]), part=0)
                    state["keys"].append(part.column(0).to_numpy()[lo:hi])
                    state["bounds"].append(bounds[lo + 1 : hi + 1] - bounds[lo] + state["n"])
                    state["ids"].append(ids[bounds[lo] : bounds[hi]])
                    state["n"] += int(bounds[hi] - bounds[lo])
                    if state["n"] >= _MOST_IDS:
                        yield close()
        if state["keys"]:
            yield close()

    made = stored(d.select("_key", "_text", "_bucket").mapInArrow(lean(save), "name string, bucket long, part int, n_ids long"), "token-files")
    out, before = [], 0
    for row in sorted(made.collect(), key=lambda r: (r["bucket"], r["part"])):
        out.append((row["name"], before))
        before += row["n_ids"]
    forget(made)
    return out


def read_documents(spark: SparkSession, folder: str, listing: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listing:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.reader(folder, name) as source:
                    f = TokenFile(source)
                    for lo in range(0, f.n, 1024):
                        at = f.bounds.select(np.arange(lo, min(lo + 1024, f.n) + 1))
                        ids = f.ids(int(at[0]), int(at[-1])).astype("<u4")
                        own = at - at[0]
                        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(f.ids_of(lo, lo + len(crcs))), pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(listing, "name string, before long").repartition(min(len(listing), 4 * spark.sparkContext.defaultParallelism))
    return rows.mapInArrow(lean(read), schema)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "tokens")
    return read_documents(spark, folder, write_ids(load(spark, sf_dir, "documents").select("doc_id", "text"), folder))
