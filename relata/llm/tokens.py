"""Exact, fast encoding of Arrow text columns with a word-level vocabulary of the tokenizers library.

The vocabulary's first step drops white space and splits there, so the ids of a text are those of its pieces between ASCII
white space, in order. Pieces repeat, so each is encoded once per worker (a bounded memory, by a 64-bit hash of the piece) and texts are
put together from the memory by numpy. Equal, id for id, to encoding whole texts (tested).
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

from relata.llm.common import utf8_parts, word_hashes

WORD_VOCABULARY = "word_bpe_49k.json"
END_ID = 1
_MOST_PIECES = 3_000_000  # about 40 bytes each
_LONGEST = 64  # bytes; longer pieces are encoded each time
_MARK = "\x01"  # stands between pieces that are encoded together; alone it is one id
_TOGETHER = 4096


class Encoder:
    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)  # of each hash
        self.first = np.zeros(1, np.int64)  # of each slot's ids; the last is the end
        self.ids = np.zeros(0, np.uint16)

    def _learn(self, new: list[str]) -> None:
        """Encode pieces and keep their ids. Many pieces go as one text with marks between (white space and a sign never join a
        piece); where a piece has the mark's sign itself, pieces go one by one."""
        ids, sizes = [], []
        for lo in range(0, len(new), _TOGETHER):
            part = new[lo : lo + _TOGETHER]
            text = f" {_MARK} ".join(part)
            if self.mark is not None and text.count(_MARK) == len(part) - 1:
                flat = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
                at = np.flatnonzero(flat == self.mark)
                if len(at) == len(part) - 1:
                    sizes.append(np.diff(np.concatenate(([-1], at, [len(flat)]))) - 1)
                    ids.append(flat[flat != self.mark])
                    continue
            found = [x.ids for x in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in found]))
            ids.append(np.fromiter((i for x in found for i in x), np.uint16))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))))
        self.ids = np.concatenate((self.ids, *ids))

    def _slots_of(self, pieces: pa.Array) -> np.ndarray:
        """The slot of each distinct piece; new ones are learnt."""
        offs, data = utf8_parts(pieces)
        h = word_hashes(data, offs[:-1], offs[1:])
        # a long piece's slot lives for this batch only: its hash is its place, which no lookup can find again
        odd = np.flatnonzero(np.diff(offs) > _LONGEST)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        known[odd] = False
        out = np.zeros(len(h), np.int64)
        out[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = np.arange(len(self.first) - 1, len(self.first) - 1 + len(new))
            self._learn(pieces.take(pa.array(new)).to_pylist())
            keep = np.setdiff1d(new, odd, assume_unique=True)
            keep = keep[np.argsort(h[keep], kind="stable")]
            spot = np.searchsorted(self.hashes, h[keep])
            self.slots = np.insert(self.slots, spot, out[keep])
            self.hashes = np.insert(self.hashes, spot, h[keep])
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, uint16; number of ids of each row). col: strings without nulls."""
        lists = pc.ascii_split_whitespace(col)
        per_row = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if len(self.first) + len(coded.dictionary) > _MOST_PIECES:
            self.forget()
        at = self._slots_of(coded.dictionary)[coded.indices.to_numpy()]
        many = self.first[at + 1] - self.first[at]
        ends = np.cumsum(many)
        flat = self.ids[np.repeat(self.first[at] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        row_ends = np.concatenate(([0], ends))[np.cumsum(per_row)]
        return flat, np.diff(np.concatenate(([0], row_ends)))


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = WORD_VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


def with_end(flat: np.ndarray, counts: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end`` after each row's, and the row bounds (n + 1)."""
    bounds = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(int(bounds[-1]), end, np.uint16)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = flat
    return out, bounds


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4"))
