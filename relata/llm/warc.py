"""Operator 9 - WARC archives with a two-level capture index.

Pages are written as WARC/1.1 records, a gzip member each. Of records with equal payloads the one with the largest page_id
is the response; the others are revisits that name it and carry no payload (found by an aggregate over SHA-1 digests).

The index has two levels. Entries (reversed-host URL key, page id, file, offset, length) are sorted by ranges and cut into
compressed blocks of lines; a sparse directory keeps the first key of each block. Blocks grow with the index so that the
directory never has more than about ``MOST_BLOCKS`` keys, which bounds what is broadcast. A look-up is a binary search in the
directory, a range read of one block (and of the next ones while keys are equal), a binary search in its lines, and a range
read of the record.

Defined results: null html is an empty payload; null url has an empty key; pages with equal page_id and url are all found by
their look-up; identical rows of a response are all responses. A null page_id is the smallest and has a key of its own; its
record refers to the largest page_id of its payload, or is a response where that is null too. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm import files
from relata.llm.common import forget, fresh_dir, lean, load, slices, stored

DATE = "2024-01-01T00:00:00Z"
BLOCK_LINES = 2000
MOST_BLOCKS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:relata:page:"


def surt(url: str | None) -> str:
    """Reversed-host key: scheme, "www." and fragment go, host labels turn round."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def index_key(url: str | None, page_id: int | None) -> bytes:
    """Sortable bytes: key, then page id; quoting keeps white space and control characters out of lines."""
    return quote(surt(url), safe="!$&'()*+,;=:@/?%-._~[]").encode() + (b" -" if page_id is None else b" %020d" % (page_id + 2**63))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member. The full payload's digest and length stand in the headers of revisits too."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(33) + '#$&()*+,;=:@/?%-._~[]' + chr(39))}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]), f"Content-Length: {len(body)}",
    ]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page id, payload bytes, payload digest, type, refers to); a response's digest and length are checked."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if named["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("damaged record")
    number = lambda x: None if (n := x.strip("<>").removeprefix(_ID)) == "null" else int(n)
    return number(named["WARC-Record-ID"]), size, digest, named["WARC-Type"], number(named["WARC-Refers-To"]) if "WARC-Refers-To" in named else None


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all records; stored entries (key, file, offset, length)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("_sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    same = p.where(F.octet_length("html") >= least_bytes).groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    p = p.join(same, "_sha", "left").select("page_id", "url", "html", F.when(~F.col("_last").eqNullSafe(F.col("page_id")) & (F.octet_length("html") >= least_bytes), F.col("_last")).alias("refers_to"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at = None, None, 0
        for batch in batches:
            for part, _ in slices(batch, "html"):
                if out is None:
                    name, out = files.writer(folder, f"pages-{TaskContext.get().partitionId():06d}")
                rows = []
                for page, url, html, refers in zip(*(c.to_pylist() for c in part.columns)):
                    member = record(page, url, html.encode(), refers)
                    out.write(member)
                    rows.append((index_key(url, page), name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(p.mapInArrow(lean(save), "key binary, file string, offset long, length long"), "captures")


def build_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[bytes, str, int, int]]:
    """Write the sorted, compressed blocks; the directory: (first key, file, offset, length) of each, in order."""
    spark = entries.sparkSession
    lines = max(block_lines, -(-entries.count() // MOST_BLOCKS))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = entries.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, at, block = None, None, 0, []

        def close() -> pa.RecordBatch:
            nonlocal at
            data = zlib.compress(b"\n".join(b"%b %b %d %d" % (k, f.encode(), o, n) for k, f, o, n in block))
            out.write(data)
            row = pa.RecordBatch.from_arrays([pa.array([block[0][0]], pa.binary()), pa.array([name]), pa.array([at]), pa.array([len(data)])], names=["first", "file", "offset", "length"])
            at += len(data)
            block.clear()
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, out = files.writer(folder, f"index-{TaskContext.get().partitionId():06d}")
                block.append(row)
                if len(block) == lines:
                    yield close()
        if block:
            yield close()
        if out is not None:
            out.close()

    made = stored(ranged.mapInArrow(lean(save), "first binary, file string, offset long, length long"), "directory")
    out = sorted((bytes(r[0]), r[1], r[2], r[3]) for r in made.collect())  # about MOST_BLOCKS rows at most
    forget(made)
    return out


class Index:
    """Look-ups by range reads; keeps the last block and open files."""

    def __init__(self, directory: list[tuple[bytes, str, int, int]], folder: str):
        self.directory, self.folder, self.firsts = directory, folder, [d[0] for d in directory]
        self.held: tuple[int, list[list[bytes]]] | None = None
        self.open: dict[str, object] = {}

    def block_of(self, key: bytes) -> int:
        """The first block that may have the key."""
        return max(0, bisect_left(self.firsts, key) - 1)

    def _read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = files.reader(self.folder, name)
        return self.open[name].read_at(length, offset)

    def _lines(self, i: int) -> list[list[bytes]]:
        if self.held is None or self.held[0] != i:
            self.held = (i, [x.rsplit(b" ", 3) for x in zlib.decompress(self._read(*self.directory[i][1:])).split(b"\n")])
        return self.held[1]

    def find(self, key: bytes) -> Iterator[bytes]:
        """The members of all captures with the key."""
        i = self.block_of(key)
        while i < len(self.directory) and self.firsts[i] <= key:
            lines = self._lines(i)
            j = bisect_left(lines, key, key=lambda x: x[0])
            while j < len(lines) and lines[j][0] == key:
                yield self._read(lines[j][1].decode(), int(lines[j][2]), int(lines[j][3]))
                j += 1
            if j < len(lines):
                return
            i += 1


def look_up(wanted: DataFrame, directory: list[tuple[bytes, str, int, int]], folder: str) -> DataFrame:
    """The records of (page_id, url) rows, read from the archives; each distinct row is looked up once."""
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast(directory)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, folder)
        for batch in batches:
            keys = [index_key(u, p) for p, u in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([index.block_of(k) for k in keys], pa.int64())], names=["key", "block"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, folder)
        for batch in batches:
            rows = [parse_record(m) for key in batch.column(0).to_pylist() for m in index.find(key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        for f in index.open.values():
            f.close()

    asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(lean(ask), "key binary, block long").distinct()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return asked.repartition(parts, "block").sortWithinPartitions("block", "key").mapInArrow(lean(fetch), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = fresh_dir(spark, "warc")
    entries = write_archives(pages, folder)
    directory = build_index(entries, folder)
    forget(entries)
    return look_up(pages, directory, folder)
