"""Operator 8 - packing into sequences of at most 2048 tokens by minimum bin slack.

Each document is cut into full windows and a rest. Rests are dealt at random (by a hash of their row number) to tasks of about ``group`` pieces and
packed there: a window starts with the longest rest left; a subset-sum dynamic program over the counts of the lengths
left (a bitset of reachable sums, counts split into powers of two) finds the multiset closest to the room; steps are
walked back to counts; and the same filling is used again as often as the counts allow. Lengths are tried from long to
short, and the program ends as soon as the room is filled exactly. Only each task's last windows have padding.

Defined results: null text is empty (a document of the end id alone); every row is packed, repeated rows too; a null id stays
null; an empty table gives no row. Extra columns are ignored. sequence_id is unique, not gapless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.common import lean, load, slices, stored
from relata.llm.tokens import WORD_VOCABULARY, crc, encoder, with_end

CAPACITY = 2048
GROUP = 50_000


def best_fill(room: int, lengths: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(length, count) pairs whose sum is the largest possible up to ``room``. lengths: distinct, descending."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for x, n in zip(lengths, counts):
        if x > room:
            continue
        n, k = min(n, room // x), 1
        while n:
            take = min(k, n)
            steps.append((x, take, reach))
            reach |= (reach << (take * x)) & mask
            n, k = n - take, 2 * k
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    used: dict[int, int] = {}
    for x, take, before in reversed(steps):
        if not before >> left & 1:
            used[x] = used.get(x, 0) + take
            left -= take * x
    return list(used.items())


def fill_windows(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Piece numbers of each window; every piece (1 to capacity long) is in exactly one."""
    order = np.argsort(lengths, kind="stable")
    values, first, many = np.unique(lengths[order], return_index=True, return_counts=True)
    stacks = {int(v): order[a : a + n].tolist() for v, a, n in zip(values, first, many)}
    left = sorted(stacks, reverse=True)
    out: list[list[int]] = []
    while left:
        top = left[0]
        own = len(stacks[top]) - 1  # the seed is not offered to the program
        room = capacity - top
        fill = best_fill(room, left, [own, *(len(stacks[x]) for x in left[1:])]) if room else []
        need = dict(fill)
        need[top] = need.get(top, 0) + 1
        for _ in range(min(len(stacks[x]) // n for x, n in need.items())):
            out.append([stacks[x].pop() for x, n in need.items() for _ in range(n)])
        left = [x for x in left if stacks[x]]
    return out


_PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, text: str, vocabulary: str, capacity: int, keep_ids: bool) -> DataFrame:
    """Full windows and rests of all documents (and, if asked, their ids as little-endian uint16)."""
    d = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part, col in slices(batch, "_text"):
                ids, bounds = with_end(*enc.encode(col))
                size = np.diff(bounds)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * capacity
                length = np.minimum(capacity, size[row] - start)
                spans = [(a, a + n) for a, n in zip((bounds[row] + start).tolist(), length.tolist())]
                cols = [part.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([crc(ids[a:b]) for a, b in spans], pa.int64()), pa.array(size[row])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    cols.append(pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return d.mapInArrow(lean(cut), _PIECE.format(kind=dict(d.dtypes)["doc_id"]) + ", ids binary" * keep_ids)


def pack(docs: DataFrame, text: str = "text", vocabulary: str = WORD_VOCABULARY, capacity: int = CAPACITY, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset."""
    cut = stored(pieces(docs, text, vocabulary, capacity, keep_ids), "pieces")
    parts = max(1, -(-cut.count() // group))
    # by a number of its own for each stored row, so that equal rows spread
    dealt = cut.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, "_row").drop("_row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        whole = whole.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])  # whatever the order of arrival
        length = whole.column("length").to_numpy()
        windows = fill_windows(length, capacity)
        at = np.array([i for w in windows for i in w], dtype=np.int64)
        seq = np.repeat(np.arange(len(windows)), [len(w) for w in windows]) + (TaskContext.get().partitionId() << 33)
        ends = np.cumsum(length[at])
        firsts = np.concatenate(([0], np.cumsum([len(w) for w in windows])[:-1])).astype(np.int64)
        offset = ends - length[at] - np.repeat((ends - length[at])[firsts], [len(w) for w in windows])
        out = whole.take(pa.array(at)).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(lean(place), schema)


def op8_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"))
