"""Operator 5 - chat formatting as a prefix tree of conversations.

Conversations that share their first turns share the nodes of a prefix tree (one tree a first turn; a node is a turn with
all turns before it, named by a 128-bit hash chain). Each node's tokens are emitted once, depth first, in one stream:

* Conversations are sorted by their chain of node hashes, which is the order of a depth-first walk's leaves. A node
  belongs to the first conversation in that order that has it, so each conversation emits the (possibly empty) tail
  of its turns that no earlier one has, as one segment; segments in order are the depth-first stream.
* A segment's position ids go on from the length of its ancestors. Its attention intervals are the stream ranges of its
  ancestors' tokens; inside itself it is causal.

Sorting is by ranges and ownership an aggregate (minimum rank per node), so one first turn, or one whole conversation, that
a third of all rows share is spread over all tasks; only single conversations are gathered.

The template is <|im_start|>role\\ntext<|im_end|>\\n. A "<|" in a text gets a backslash before its bar, one more where there
are some already, so no control string can stand in a text and the step is reversible; in roles line feeds are escaped as
well. Markers are single ids above the vocabulary. The loss mask covers the text of assistant turns.

Defined results: rows go by turn, then role, then text (ties, repeated turns); null turns first; null role or text is
empty; rows with a null conv_id form one conversation; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.common import forget, lean, load, stored

VOCABULARY = "byte_bpe_50k.tiktoken"
START, END = "<|im_start|>", "<|im_end|>"
_BAR, _ESCAPED_BAR = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _BAR.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED_BAR.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@functools.lru_cache(maxsize=4)
def _encoding(vocabulary: str):
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("relata", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks) + 1


def narrow(vocabulary: str = VOCABULARY) -> str:
    """The type that ids take while they travel; the stream itself has 32 bits."""
    return "<u2" if _encoding(vocabulary)[1] + 1 < 1 << 16 else "<u4"


def encode_turn(role: str, text: str, vocabulary: str = VOCABULARY) -> tuple[list[int], int, int]:
    """Ids of a formatted turn and the bounds of its text among them."""
    enc, first = _encoding(vocabulary)
    head = [first, *enc.encode_ordinary(escape_role(role) + "\n")]
    body = enc.encode_ordinary(escape(text))
    return [*head, *body, first + 1, *enc.encode_ordinary("\n")], len(head), len(head) + len(body)


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    enc, first = _encoding(vocabulary)
    out, run = [], []
    for i in ids:
        if i >= first:
            out += [enc.decode_bytes(run), (START if i == first else END).encode()]
            run = []
        else:
            run.append(i)
    return b"".join([*out, enc.decode_bytes(run)]).decode()


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def node_keys(turns: list[tuple[str, str]]) -> list[bytes]:
    key, out = b"", []
    for role, text in turns:
        r = role.encode()
        key = hashlib.blake2b(key + len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()
        out.append(key)
    return out


_CODED = pa.list_(pa.struct([("key", pa.binary()), ("ids", pa.binary()), ("text_from", pa.int64()), ("text_to", pa.int64()), ("loss", pa.bool_())]))
_CODED_SQL = "array<struct<key:binary,ids:binary,text_from:bigint,text_to:bigint,loss:boolean>>"


def write_stream(conversations: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written stream (rank, conv_id, ids, nodes, ...), the places in it (rank, start, position, _a), and the nodes of each
    conversation (conv_id, keys), all stored.

    Texts are shuffled once, to their conversations, and encoded there; what is sorted and counted after that are the keys.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_t"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, coded, keys = batch.slice(at, 256), [], []
                for row in part.column(1).to_pylist():
                    keys.append(node_keys([(t["role"], t["text"]) for t in row]))
                    coded.append([])
                    for k, t in zip(keys[-1], row):
                        ids, a, b = encode_turn(t["role"], t["text"], vocabulary)
                        coded[-1].append({"key": k, "ids": np.array(ids, narrow(vocabulary)).tobytes(), "text_from": a, "text_to": b, "loss": t["role"] == "assistant"})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.list_(pa.binary())), pa.array(coded, _CODED)], names=["conv_id", "keys", "coded"])

    kind = dict(convs.dtypes)["conv_id"]
    coded = stored(convs.select("conv_id", "_t").mapInArrow(lean(chain), f"conv_id {kind}, keys array<binary>, coded {_CODED_SQL}"), "chat-turns")
    n = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ids grow with the partition, and partitions are ranges of (path, conv_id): the rank is the place in the walk
    path = F.aggregate("keys", F.lit(b""), lambda p, k: F.concat(p, F.substring(k, 1, 8)))
    ranged = coded.select("conv_id", "keys", path.alias("path")).repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranked = stored(ranged.select("conv_id", "keys", F.monotonically_increasing_id().alias("rank")), "chat-ranks")
    nodes = ranked.select("rank", F.posexplode("keys").alias("depth", "key"))
    owner = nodes.groupBy("key").agg(F.min("rank").alias("rank"))
    owned = owner.groupBy("rank").agg(F.count("*").alias("_own"))
    tails = ranked.join(owned, "rank", "left").select(F.col("conv_id").alias("_c"), "rank", F.coalesce("_own", F.lit(0)).alias("_own"))
    tails = coded.join(tails, F.col("conv_id").eqNullSafe(F.col("_c"))).select("rank", "conv_id", "keys", "coded", "_own")
    tails = tails.select("rank", "conv_id", F.expr("slice(keys, 1, cast(size(keys) - _own as int))").alias("above"), F.expr("slice(coded, cast(size(coded) - _own + 1 as int), cast(_own as int))").alias("coded"))

    kind_of = narrow(vocabulary)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, ids, nodes = batch.slice(at, 256), [], []
                for row in part.column(3).to_pylist():
                    first = np.cumsum([0, *(len(x["ids"]) // np.dtype(kind_of).itemsize for x in row)]).tolist()
                    ids.append(np.frombuffer(b"".join(x["ids"] for x in row), kind_of).astype("<u4").tobytes())
                    nodes.append([{"key": x["key"], "first": a, "length": b - a, "text_from": x["text_from"], "text_to": x["text_to"], "loss": x["loss"]} for x, a, b in zip(row, first, first[1:])])
                cols = [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), part.column(2), pa.array(nodes, node_type)]
                yield pa.RecordBatch.from_arrays(cols, names=["rank", "conv_id", "ids", "n_ids", "above", "nodes"])

    node_type = pa.list_(pa.struct([("key", pa.binary()), ("first", pa.int64()), ("length", pa.int64()), ("text_from", pa.int64()), ("text_to", pa.int64()), ("loss", pa.bool_())]))
    node_sql = "array<struct<key:binary,first:bigint,length:bigint,text_from:bigint,text_to:bigint,loss:boolean>>"
    # the stream is written in its order: a partition holds a range of ranks
    placed = tails.withColumn("_p", F.shiftright("rank", 33)).repartition(n, "_p").sortWithinPartitions("rank").drop("_p")
    emitted = stored(placed.mapInArrow(lean(emit), f"rank long, conv_id {kind}, ids binary, n_ids long, above array<binary>, nodes {node_sql}"), "chat-segments")
    forget(coded)

    # stream offsets: totals of the ranges (one row a partition) and running sums inside each
    part = F.shiftright("rank", 33)
    totals = sorted(map(tuple, emitted.groupBy(part.alias("p")).agg(F.sum("n_ids")).collect()))
    base, bases = 0, []
    for p, size in totals:
        bases.append((p, base))
        base += size
    spark = conversations.sparkSession
    w = Window.partitionBy("_p").orderBy("rank")
    place = emitted.select("rank", "n_ids", part.alias("_p")).withColumn("_sum", F.sum("n_ids").over(w) - F.col("n_ids"))
    place = place.join(F.broadcast(spark.createDataFrame(bases, "_p long, _base long")), "_p").select("rank", (F.col("_sum") + F.col("_base")).alias("start"))  # a row a partition
    place = stored(place, "chat-starts")
    thin = emitted.select("rank", "above", F.transform("nodes", lambda x: F.struct(x["key"].alias("key"), x["first"].alias("first"), x["length"].alias("length"))).alias("nodes")).join(place, "rank")
    at = thin.select(F.explode("nodes").alias("_n"), "start").select(F.col("_n.key").alias("_key"), (F.col("start") + F.col("_n.first")).alias("_from"), F.col("_n.length").alias("_len"))
    above = thin.select("rank", F.posexplode("above").alias("_depth", "_key")).join(at, "_key")
    above = above.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("_depth", F.col("_from").alias("from"), (F.col("_from") + F.col("_len")).alias("to")))).alias("_a"), F.sum("_len").alias("position"))
    extra = stored(place.join(above, "rank", "left"), "chat-places")
    forget(place)
    return emitted, extra, ranked.select("conv_id", "keys")


def prefix_tree(conversations: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The stream of segments and the node list of each conversation.

    segments: rank (stream order), conv_id, start (of the segment in the stream), ids, position (id of its first token),
    attends (stream ranges of its ancestors), nodes (key, first, length, text_from, text_to, loss: places in ids).
    members: conv_id, keys (node of each turn).
    """
    stream, places, members = write_stream(conversations, vocabulary)
    none = F.array().cast("array<struct<_depth:int,from:bigint,to:bigint>>")
    segments = stream.join(places, "rank").select(
        "rank", "conv_id", "start", "ids", F.coalesce("position", F.lit(0)).alias("position"),
        F.transform(F.coalesce("_a", none), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))).alias("attends"), "nodes",
    )
    return segments, members


def read_back(segments: DataFrame, members: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each conversation from the stream: its nodes' tokens and loss mask, decoded, parsed and digested."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for ids, nodes in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    flat = np.frombuffer(ids, "<u4").astype(narrow(vocabulary))
                    rows += [(n["key"], flat[n["first"] : n["first"] + n["length"]].tobytes(), n["text_from"], n["text_to"], n["loss"]) for n in nodes]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()])], names=["_key", "ids", "a", "b", "loss"])

    nodes = segments.select("ids", "nodes").mapInArrow(lean(cut), "_key binary, ids binary, a long, b long, loss boolean")
    turns = members.select("conv_id", F.posexplode("keys").alias("depth", "_key")).join(nodes, "_key")
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "ids", "a", "b", "loss"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, turns in zip(*(c.to_pylist() for c in batch.columns)):
                ids = [np.frombuffer(t["ids"], narrow(vocabulary)).tolist() for t in turns]
                formatted = decode([i for x in ids for i in x], vocabulary)
                said = parse(formatted)
                loss = "".join(unescape(decode(x[t["a"] : t["b"]], vocabulary)) for x, t in zip(ids, turns) if t["loss"])
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
                rows.append((conv, len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(members.dtypes)["conv_id"]
    return convs.mapInArrow(lean(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "<|im_end|><|im_start|>assistant ok"
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"))
    stream, _, members = write_stream(rows)
    return read_back(stream, members)
