"""Operator 2 - line deduplication by a suffix array over line-ID sequences. [native: DataFrame functions only]

Each text is a sequence of lines; a line's ID is its 128-bit hash. A run of lines that occurred earlier (in an
earlier document by id, or earlier in the same one) and that has ``min_words`` words or more is deleted; the first
copy stays.

* Up: prefix doubling. The rank class of a suffix at level k names its first 2^k lines, by the pair of its classes
  for the first and the second 2^(k-1). Only suffixes whose class is shared go on to the next level, so the work is in
  proportion to the repeated lines and ends after log2(longest repeated run) levels. Runs never cross documents.
* Down: longest-common-prefix intervals. A suffix's longest earlier match lies between two powers of two. Suffixes that
  are the first of their class at the longer power are compared at the middle length: those that are not the first of
  their group there have their answer in the upper half, the firsts (and lone ones) in the lower half. Each level of this
  bisection is one aggregation over all groups of all sizes at once; a group's first member goes both ways, all others
  one way, so rows stay linear in the suffixes. No pair of suffixes is ever formed.

Classes are aggregated (partial sums first), written, and joined back, never gathered: a line that a third of all documents
share is a skewed key of a plain join, which adaptive execution broadcasts or splits. Suffixes that end have no class there
and are joined to nothing.

Words are counted where lines are hashed, and a run's are a difference of sums over its document's repeated lines; so only runs that are
deleted meet the texts. A bit set of bounded size tells which texts may have some: these are shuffled, once each, and the others stay where they are.

Defined results: null text stays null and has no lines; rows with the same id and text are one document and get the same
result; null ids sort first; blank lines count as lines of no words. Extra columns pass through unchanged, but for those that
have the name of an added one (in any case): these are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.common import forget, load, order_key, others, quoted, stored

MIN_WORDS = 50
_ID = ["_d", "_t"]  # a document: id and text hash
_MOST_LEVELS = 40
_PLACES = 1 << 22  # of the bit set of documents with runs: 65,536 rows at most are broadcast


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d = docs.where(F.col(text).isNotNull()).select(order_key(doc_id).alias("_d"), F.xxhash64(F.col(text)).alias("_t"), F.split(F.col(text), "\n").alias("_l"))
    d = d.select(*_ID, F.posexplode("_l").alias("_i", "_x"))
    return d.select(*_ID, "_i", F.xxhash64(F.lit(3), F.col("_x")).alias("_a"), F.xxhash64(F.lit(5), F.col("_x")).alias("_b"), F.regexp_count("_x", F.lit(r"\S+")).alias("_w"))


def _at() -> Column:
    return F.struct(*_ID, "_i")


def _shared_classes(ranks: DataFrame, name: str, repeats: bool = False) -> DataFrame:
    """The suffixes whose class (_a, _b) others have too, and whether each is the first of its class. repeats: rows may repeat (documents
    of one id and text); they count as others here, and one of each stays."""
    groups = stored(ranks.groupBy("_a", "_b").agg(F.count("*").alias("_n"), F.min(_at()).alias("_first")).where("_n > 1"), f"{name}-classes")
    shared = ranks.join(groups, ["_a", "_b"]).select(*ranks.columns, (F.col("_first") < _at()).alias("_later"))
    out = stored(shared.dropDuplicates([*_ID, "_i"]) if repeats else shared, name)
    forget(groups)
    return out


def suffix_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[DataFrame]:
    """Level k: (_d, _t, _i, class _a _b, _later) of all suffixes whose first 2^k lines occur elsewhere too; level 0 has the words _w of each line."""
    levels = [_shared_classes(_lines(docs, doc_id, text), "runs0", repeats=True)]
    while len(levels) < _MOST_LEVELS and not levels[-1].isEmpty():
        step = 2 ** (len(levels) - 1)
        w = Window.partitionBy(*_ID).orderBy("_i").rangeBetween(step, step)
        after = levels[-1].withColumns({"_a2": F.max("_a").over(w), "_b2": F.max("_b").over(w)}).where(F.col("_a2").isNotNull())
        pair = after.select(*_ID, "_i", F.xxhash64(F.lit(3), "_a", "_b", "_a2", "_b2").alias("_a"), F.xxhash64(F.lit(5), "_b2", "_a2", "_b", "_a").alias("_b"))
        levels.append(_shared_classes(pair, f"runs{len(levels)}"))
    return levels[:-1] if len(levels) > 1 and levels[-1].isEmpty() else levels


def longest_earlier(levels: list[DataFrame]) -> DataFrame:
    """(_d, _t, _i, _length), stored: the longest run of lines that starts at a suffix and has an earlier occurrence."""
    open_groups = None
    for k in range(len(levels) - 1, -1, -1):
        # suffixes that are alone or first at 2^(k+1) enter here with the group of their first 2^k lines
        here = levels[k]
        if k + 1 < len(levels):
            here = here.join(levels[k + 1].where("_later").select(*_ID, "_i"), [*_ID, "_i"], "left_anti")
        entering = here.select("_a", "_b", *_ID, "_i", F.lit(2**k).alias("_lo"))
        groups = entering if open_groups is None else open_groups.unionByName(entering)
        if k == 0:
            keys = ["_a", "_b", "_lo"]
            first = stored(groups.groupBy(*keys).agg(F.min(_at()).alias("_first")), "firsts")
            out = stored(groups.join(first, keys).where(F.col("_first") < _at()).select(*_ID, "_i", F.col("_lo").alias("_length")), "longest")
            for old in (first, *([] if open_groups is None else [open_groups])):
                forget(old)
            return out
        half = 2 ** (k - 1)
        after = levels[k - 1].select(*_ID, F.col("_i").alias("_j"), F.col("_a").alias("_a2"), F.col("_b").alias("_b2"))
        g = groups.withColumn("_j", F.col("_i") + F.col("_lo")).join(after, [*_ID, "_j"], "left").drop("_j")
        sub = [F.xxhash64(F.lit(3), "_a", "_b", "_a2", "_b2", "_lo").alias("_ua"), F.xxhash64(F.lit(5), "_b2", "_a2", "_lo", "_b", "_a").alias("_ub")]
        g = stored(g.select("_a", "_b", *_ID, "_i", "_lo", *[F.when(F.col("_a2").isNotNull(), s).alias(n) for s, n in zip(sub, ("_ua", "_ub"))]), f"split{k}")
        going = g.where("_ua is not null")
        together = stored(going.groupBy("_ua", "_ub").agg(F.count("*").alias("_n"), F.min(_at()).alias("_first")).where("_n > 1"), f"split{k}-groups")
        met = going.join(together, ["_ua", "_ub"], "left")
        same = ["_a", "_b", *_ID, "_i", "_lo"]
        up = F.struct(F.col("_ua").alias("_a"), F.col("_ub").alias("_b"), *_ID, "_i", (F.col("_lo") + half).alias("_lo"))
        ways = F.filter(F.array(F.when(F.col("_n") > 1, up), F.when(F.col("_n").isNull() | (F.col("_first") == _at()), F.struct(*same))), lambda x: x.isNotNull())
        ended = g.where("_ua is null").select(*same)
        moved = stored(met.select(F.inline(ways)).unionByName(ended), f"open{k}")
        for old in (g, together, *([] if open_groups is None else [open_groups])):
            forget(old)
        open_groups = moved
    raise ValueError("no level")


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _t, _runs), stored: for each document that has some, the maximal line runs of ``min_words`` words or more that occurred earlier,
    as (start, length)."""
    levels = suffix_classes(docs, doc_id, text)
    longest = longest_earlier(levels)
    # the repeated lines with their words, and the runs, in one shuffle; every line of a run is a repeated line
    none = F.lit(None).cast("int")
    both = longest.select(*_ID, "_i", "_length", none.alias("_w")).unionByName(levels[0].select(*_ID, "_i", none.alias("_length"), "_w"))
    w = Window.partitionBy(*_ID).orderBy("_i")
    upto, here = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, 0)
    end = F.col("_i") + F.col("_length")
    both = both.withColumns({"_before": F.max(end).over(w.rangeBetween(-1, -1)), "_place": F.count("_w").over(upto), "_sum": F.sum("_w").over(upto), "_own": F.sum("_w").over(here)})
    # a suffix's match reaches at least as far as the one before it: keep those that reach further
    further = F.col("_length").isNotNull() & (F.col("_before").isNull() | (F.col("_before") < end))
    run = F.when(further, F.struct(F.col("_i").alias("s"), F.col("_length").alias("n"), "_place", (F.col("_sum") - F.col("_own")).alias("_less")))
    line = F.when(F.col("_w").isNotNull(), F.struct("_i", "_sum"))
    found = both.groupBy(*_ID).agg(F.sort_array(F.collect_list(run)).alias("_runs"), F.sort_array(F.collect_list(line)).alias("_sums"))
    many = lambda r: F.element_at("_sums", (r["_place"] + r["n"] - 1).cast("int"))["_sum"] - r["_less"] >= min_words
    runs = F.transform(F.filter("_runs", many), lambda r: F.struct(r["s"].alias("s"), r["n"].alias("n")))
    out = stored(found.where(F.exists("_runs", many)).select(*_ID, runs.alias("_runs")), "runs")
    for old in (*levels, longest):
        forget(old)
    return out


def _place() -> Column:
    return F.pmod(F.xxhash64(*_ID), F.lit(_PLACES))


def _with_runs(docs: DataFrame, kept: list[str], doc_id: str, text: str, runs: DataFrame) -> DataFrame:
    """(_row, _text, _runs) of every row; _runs is null where there are none. The columns kept travel in one struct, so that no name of theirs
    meets one of these; the text travels beside it, not in it too. Rows whose bit is not set have no runs and are not joined; a bit that
    other documents set (more of them, the larger the table) only costs a row's shuffle."""
    row = F.struct(*[F.col(quoted(c)) for c in others(kept, [text])])
    d = docs.select(row.alias("_row"), F.col(text).alias("_text"), order_key(doc_id).alias("_d"), F.xxhash64(F.col(text)).alias("_t"))
    word, bit = F.floor(_place() / 64), (_place() % 64).cast("int")
    bits = runs.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    d = d.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(bits), F.col("_at") == F.col("_word"), "left")
    may = F.col("_text").isNotNull() & F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))
    of = runs.withColumnsRenamed({"_d": "_rd", "_t": "_rt"})
    met = d.where(may).join(of, (F.col("_d") == F.col("_rd")) & (F.col("_t") == F.col("_rt")), "left").select("_row", "_text", "_runs")
    return met.unionByName(d.where(~may).select("_row", "_text", F.lit(None).cast(runs.schema["_runs"].dataType).alias("_runs")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with later copies of repeated runs deleted from ``text``.

    Added columns: n_lines long, n_deleted long, deleted_runs array of (start, length) in the old text.
    """
    runs = repeated_runs(docs, doc_id, text, min_words)
    kept = others(docs.columns, ["n_lines", "n_deleted", "deleted_runs"])
    d = _with_runs(docs, kept, doc_id, text, runs).withColumn("_lines", F.when(F.col("_runs").isNotNull(), F.split(F.col("_text"), "\n")))
    gone = F.array_distinct(F.flatten(F.transform("_runs", lambda r: F.sequence(r["s"], r["s"] + r["n"] - 1))))
    d = d.withColumn("_gone", F.when(F.col("_runs").isNotNull(), F.map_from_arrays(gone, gone)))
    left = F.filter("_lines", lambda x, i: ~F.array_contains(F.map_keys("_gone"), i))
    cut = F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("_text"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.split(F.col("_text"), "\n"))).cast("long")
    same = [cut.alias(c) if c.lower() == text.lower() else F.col(f"_row.{quoted(c)}").alias(c) for c in kept]
    n_deleted = F.coalesce(F.size(F.map_keys("_gone")), F.lit(0)).cast("long")
    return d.select(*same, n_lines.alias("n_lines"), n_deleted.alias("n_deleted"), F.coalesce("_runs", F.array().cast("array<struct<s:int,n:int>>")).alias("deleted_runs"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "text", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_lines", "n_deleted")
