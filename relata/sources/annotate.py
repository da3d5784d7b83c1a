"""Producers of annotated sentences (relata.schemas.SENTENCES): a rule on shapes, a reader of token tables, plug-in parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relata.functions.text import PRONOUNS
from relata.operators import text as X
from relata.schemas import CHUNK, MENTION, SENTENCES, TOKEN

# fixed values: function words of the shape annotator
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "is", "it", "as", "on", "by", "for", "with", "that", "this", "be", "at", "are", "was", "he", "or")
MENTION_LETTERS = 9


def shape_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """English-like text by shape alone, in array expressions: sentences end at "." or a line's end, tokens are runs of a-z, words
    of nine letters or more are mentions, each token's head is the one before, function words carry no content."""
    s = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[.\n]")).alias("sent_id", "sentence"))
    words = F.regexp_extract_all("sentence", F.lit("[a-z]+"), F.lit(0))
    s = s.select("*", F.explode(F.array(words)).alias("_w")).where(F.size("_w") > 0)  # a generator: the optimizer can't copy the words into each use
    stop = lambda w: w.isin(*FUNCTION_WORDS)
    token = lambda w, i: F.struct(
        i.alias("i"), F.lit(-1).alias("idx"), w.alias("text"), w.alias("lemma"), F.when(stop(w), "DET").otherwise("NOUN").alias("pos"),
        F.when(i == 0, "ROOT").otherwise("dep").alias("dep"), F.greatest(i - 1, F.lit(0)).alias("head"), stop(w).alias("is_stop"), F.lit(False).alias("is_punct"),
    )
    places = F.filter(F.transform("_w", lambda w, i: F.when(F.char_length(w) >= MENTION_LETTERS, i)), lambda i: i.isNotNull())
    mention = lambda i, w: F.struct(i.alias("start"), (i + 1).alias("end"), i.alias("root"), w.alias("text"), F.when(F.char_length(w) >= 12, "LONG").otherwise("SHORT").alias("label"))
    # the structs are made in their final types: a cast would copy each token once more
    return s.select("doc_id", "sent_id", "sentence", F.transform("_w", token).alias("tokens"), F.transform(places, lambda i: mention(i, F.get(F.col("_w"), i))).alias("mentions"), F.array().cast(f"array<{CHUNK}>").alias("chunks"))


def shape_kept(docs: DataFrame) -> DataFrame:
    """``X.kept_sentences(shape_sentences(docs))`` of documents (doc_id, text), made of the bytes of many texts at once."""
    kind = X.kept_sentences(shape_sentences(docs)).schema
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(_kept_of, kind)


shape_sentences.kept = shape_kept  # for those who keep no more of the sentences


def _kept_of(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """About ``most`` bytes of text at a time."""
    for b in batches:
        size = np.frombuffer(b.column("text").buffers()[1], np.int32)[b.column("text").offset :][: b.num_rows + 1].astype(np.int64) if b.num_rows else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield _kept_shapes(b.column("doc_id").slice(at, end - at), b.column("text").slice(at, end - at))
            at = end


def _codes(words: tuple[str, ...]) -> np.ndarray:
    return np.array([int.from_bytes(w.encode(), "little") for w in words], np.uint64)


def _cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Strings of bytes of data."""
    ends = np.concatenate([[0], np.cumsum(length)])
    cut = data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cut)))


def _kept_shapes(ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """The rows of :func:`shape_kept`; texts are in lower case, none is null."""
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset :][: len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    breaks = np.zeros(len(data) + 1, bool)
    breaks[bounds] = True
    letter = (data >= ord("a")) & (data <= ord("z"))
    start = np.flatnonzero(letter & (breaks[:-1] | ~np.concatenate([[False], letter[:-1]])[: len(data)]))
    length = np.flatnonzero(letter & (breaks[1:] | ~np.concatenate([letter[1:], [False]])[: len(data)])) + 1 - start
    stops = np.flatnonzero((data == ord(".")) | (data == ord("\n")))
    doc = np.repeat(np.arange(len(ids)), np.diff(np.searchsorted(start, bounds)))
    said = np.searchsorted(stops, start)  # how many sentence ends of the batch are before a word
    head = np.flatnonzero((np.diff(said, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))  # first words of sentences
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(start))))
    i = np.arange(len(start)) - head[of]

    most = max(map(len, FUNCTION_WORDS + PRONOUNS))
    code, padded = np.zeros(len(start), np.uint64), np.concatenate([data, np.zeros(most, np.uint8)])
    for k in range(most):
        code |= np.where(length > k, padded[start + k], 0).astype(np.uint64) << np.uint64(8 * k)
    code[length > most] = 0
    stop, pronoun, named = np.isin(code, _codes(FUNCTION_WORDS)), np.isin(code, _codes(PRONOUNS)), length >= MENTION_LETTERS
    count = lambda what: np.bincount(of[what], minlength=len(head))
    n, events = count(named), count(pronoun)
    kept = (n > 0) | (events > 0)
    row = np.flatnonzero(kept)

    none = lambda many, kind: pa.nulls(many, kind)
    word = lambda at: _cut(data, start[at], length[at])
    number = lambda x: pa.array(x, pa.int32())
    either = lambda what, yes, no: pa.array([no, yes]).take(pa.array(what.astype(np.int8)))
    ends = lambda per: np.concatenate([[0], np.cumsum(per[row])])

    def lists(per: np.ndarray, fields: dict[str, pa.Array], null: np.ndarray | None = None) -> pa.Array:
        values = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        return pa.ListArray.from_arrays(number(ends(per)), values, mask=None if null is None else pa.array(null))

    t = np.flatnonzero((n > 0)[of])
    tokens = {"i": number(i[t]), "idx": none(len(t), pa.int32()), "text": none(len(t), pa.string()), "lemma": word(t), "pos": either(stop[t], "DET", "NOUN"), "dep": either(i[t] == 0, "ROOT", "dep"), "head": number(np.maximum(i[t] - 1, 0)), "is_stop": pa.array(stop[t]), "is_punct": pa.array(np.zeros(len(t), bool))}
    m = np.flatnonzero(named)
    mentions = {"start": number(i[m]), "end": number(i[m] + 1), "root": number(i[m]), "text": word(m), "label": either(length[m] >= 12, "LONG", "SHORT")}
    p = np.flatnonzero(pronoun)
    said_by = {"i": number(i[p]), "_kind": number(np.zeros(len(p))), "idx": number(np.full(len(p), -1)), "text": word(p), "_e": none(len(p), pa.string()), "_person": none(len(p), pa.bool_())}
    nothing = {"start": number([]), "text": none(0, pa.string()), "lemma": none(0, pa.string())}

    home, before = doc[head[row]], said[head[row]]
    base = np.searchsorted(stops, bounds[:-1])[home]  # sentence ends before the document
    fence = np.concatenate([[-1], stops, [len(data)]])
    lo, hi = np.maximum(fence[before] + 1, bounds[home]), np.minimum(fence[before + 1], bounds[home + 1])
    shown = n[row] > 1
    sentence = _cut(data, lo, np.where(shown, hi - lo, 0))
    sentence = pa.StringArray.from_buffers(len(row), *sentence.buffers()[1:], pa.array(shown).buffers()[1])
    whole = np.bincount(of, minlength=len(head)) * (n > 0)
    columns = {"doc_id": ids.take(pa.array(home)), "sent_id": number(before - base), "sentence": sentence, "tokens": lists(whole, tokens, n[row] == 0), "mentions": lists(n, mentions), "chunks": lists(np.zeros(len(head), int), nothing), "events": lists(events, said_by)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def from_token_table(tokens: DataFrame, mentions: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Sentences from flat rows: tokens (doc_id, sent_id, i, idx, text, lemma, pos, dep, head, is_stop, is_punct), mentions (doc_id,
    sent_id, start, end, root, text, label), chunks (doc_id, sent_id, start, text, lemma)."""
    names = lambda t: [x.split(":")[0] for x in t[7:-1].split(",")]
    nest = lambda df, kind, out: df.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct(*names(kind)))).cast(f"array<{kind}>").alias(out))
    s = nest(tokens, TOKEN, "tokens").join(nest(mentions, MENTION, "mentions"), ["doc_id", "sent_id"], "left")
    s = s.join(nest(chunks, CHUNK, "chunks"), ["doc_id", "sent_id"], "left") if chunks is not None else s.withColumn("chunks", F.lit(None).cast(f"array<{CHUNK}>"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return s.select("doc_id", "sent_id", F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("sentence"), "tokens", empty("mentions", MENTION), empty("chunks", CHUNK))


def with_parser(docs: DataFrame, load: Callable[[], Callable[[str], list[dict]]], text: str = "text") -> DataFrame:
    """Sentences from any parser. ``load`` runs once per worker and returns a function from a text to sentence rows (dicts of
    sentence, tokens, mentions, chunks); what it raises, fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = load()
        for b in batches:
            rows = [{"doc_id": str(d), "sent_id": i, **s} for d, t in zip(b.doc_id, b[text]) for i, s in enumerate(parse(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_id", "sentence", "tokens", "mentions", "chunks"])

    return docs.select("doc_id", text).mapInPandas(run, SENTENCES)


def load_spacy(preferred: str = "en_core_web_lg", fallback: str = "en_core_web_sm") -> Callable[[], Callable[[str], list[dict]]]:
    """A loader for :func:`with_parser`: the preferred model, else the fallback, else an error when it is first used."""

    def load() -> Callable[[str], list[dict]]:
        try:
            import spacy
        except ImportError as e:
            raise RuntimeError("spacy isn't installed; use shape_sentences or from_token_table") from e
        try:
            nlp = spacy.load(preferred)
        except OSError:
            nlp = spacy.load(fallback)

        def parse(text: str) -> list[dict]:
            out = []
            for s in nlp(text).sents:
                tok = [dict(i=t.i - s.start, idx=t.idx, text=t.text, lemma=t.lemma_, pos=t.pos_, dep=t.dep_, head=t.head.i - s.start, is_stop=t.is_stop, is_punct=t.is_punct) for t in s]
                ments = [dict(start=e.start - s.start, end=e.end - s.start, root=e.root.i - s.start, text=e.text, label=e.label_) for e in s.ents]
                out.append(dict(sentence=s.text, tokens=tok, mentions=ments, chunks=[dict(start=c.start - s.start, text=c.text, lemma=c.lemma_) for c in s.noun_chunks]))
            return out

        return parse

    return load
