"""Operator 1 - I-Match document fingerprints. [native: DataFrame functions only]

Terms whose document frequency lies in a band (the lexicon) are kept; a document's distinct terms in each of
several random lexicon subsets are sorted and hashed (64 bits). Subsets come at several sampling rates, so that short and
long documents both have subsets that hold about one of their terms: a local edit then changes some
subset hashes and leaves others. The likeness of two fingerprints is the share of the subsets that either has terms in whose
hashes agree.

Lexicon size is bounded: at most (mean distinct terms a document) / ``df_low`` terms can reach the band's
lower edge, whatever the corpus size; it is checked before the broadcast.

Defined results: null text is empty; a text without lexicon terms is fingerprinted by its own hash
("t" + 16 hex digits), so equal texts always have equal fingerprints; two different fingerprints
share nothing in that case (likeness 0). A text with fewer than ``FEW`` terms in the band (in a large group of copies the
terms of the group are above it) also uses the terms above the band; two texts are compared in that way if either needs it. Equal ids are ordered by a hash of the text (descending, as ids are). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.llm.common import id_ranges, load, order_key, stored

RATES = (16, 64, 256, 1024)  # a subset holds one lexicon term in so many
SUBSETS = 16  # of each rate: 64 in all, a bit each in a long
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_LEXICON = 2_000_000
FEW = 8  # terms in the band


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), NON_WORD))


def lexicon(docs: DataFrame, text: str = "text", df_low: float = 0.001, df_high: float = 0.05) -> DataFrame:
    """Terms (as 64-bit hashes) in the document-frequency band or above it (_over), with the random subsets that hold each.

    df_low / df_high are shares of all documents (idf between ln(1/df_high) and ln(1/df_low)).
    """
    n = docs.count()
    low, high = max(2, df_low * n), max(2, df_high * n)
    t = docs.select(F.explode(_terms(F.coalesce(F.col(text), F.lit("")))).alias("_term"))
    df = t.where("_term <> ''").select(F.xxhash64("_term").alias("_h")).groupBy("_h").agg(F.count("*").alias("_df"))
    lex = df.where(F.col("_df") >= low).select("_h", (F.col("_df") > high).alias("_over"))
    draws = []
    for i, rate in enumerate(RATES):
        cell = F.pmod(F.xxhash64(F.lit(i + 1), F.col("_h")), F.lit(rate))
        draws.append(F.when(cell < SUBSETS, cell.cast("int") + i * SUBSETS))
    return lex.select("_h", "_over", F.explode(F.array_compact(F.array(*draws))).alias("_subset"))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with terms in either document whose hashes agree. a, b: structs of hashes and subset bits."""
    either = F.bit_count(a["bits"].bitwiseOR(b["bits"]))
    return F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.greatest(either, F.lit(1))


def _printed(hashes: Column, own: Column) -> Column:
    digits = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.when(F.size(hashes) > 0, F.array_join(F.transform(hashes, digits), "-")).otherwise(F.concat(F.lit("t"), digits(own)))


def fingerprint_versions(rows: DataFrame, versions: list[str], keys: list[str], more: Column, lex: DataFrame) -> DataFrame:
    """Hash of each subset's sorted terms, for several text columns of each row: of terms in the band (_c; _k of them) and of all (_all).

    ``keys`` (numbers) identify a row and begin with its partition key; ``more`` comes along once a row (_more), with the empty term of
    the first version. The lexicon is broadcast after its size was checked; the exploded terms never leave their task.
    """
    size = lex.count()
    if size <= MOST_LEXICON:
        lex = F.broadcast(lex)
    both = F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).alias("t")) for i, c in enumerate(versions)])
    t = rows.select(*keys, more.alias("_m"), F.explode(both).alias("_x"))
    t = t.select(*keys, "_m", F.col("_x.v").alias("_v"), F.explode(_terms(F.col("_x.t"))).alias("_term"))
    t = t.select(*keys, "_v", F.xxhash64("_term").alias("_h"), F.when((F.col("_term") == "") & (F.col("_v") == 0), F.col("_m")).alias("_m"))
    hit = t.join(lex, "_h")
    # one list a subset: a term's hash with its last bit set where it is above the band
    marked = F.when(F.col("_over"), F.col("_h").bitwiseOR(F.lit(1))).otherwise(F.col("_h").bitwiseAND(F.lit(-2)))
    in_band = lambda h: h.bitwiseAND(F.lit(1)) == 0
    a = hit.groupBy(*keys, "_v", "_subset").agg(F.sort_array(F.collect_list(marked)).alias("_sa"), F.first("_m", True).alias("_more"))
    a = a.withColumn("_s", F.filter("_sa", in_band))
    hashed = lambda s: F.when(F.size(s) > 0, F.xxhash64("_subset", s))
    k = F.when(F.col("_subset").between(0, SUBSETS - 1), F.size("_s")).otherwise(0)
    return a.select(*keys, "_v", "_subset", hashed("_s").alias("_c"), hashed("_sa").alias("_all"), k.alias("_k"), "_more")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document beside the text of the next one in descending id (after the last: the first).

    Ids are cut into ranges; a window inside each range finds the successor, and the first row of the
    following range is added as a border row (``_extra`` = 1): no global sort, one shuffle of the texts.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_key", order_key("doc_id"))
    d = id_ranges(d)
    tops = sorted((r[0], r[1][0], r[1][1]) for r in d.groupBy("_bucket").agg(F.max(F.struct("_key", "_h"))).collect())  # a row a range, about 65536 at most
    after = [(b, *tops[i - 1]) for i, (b, _, _) in enumerate(tops)]  # the range below; for the lowest, the highest
    heads = F.broadcast(spark.createDataFrame(after, "_of long, _b long, _k long, _t long"))
    border = d.join(heads, (F.col("_bucket") == F.col("_b")) & (F.col("_key") == F.col("_k")) & (F.col("_h") == F.col("_t")))
    border = border.groupBy("_of", "doc_id", "_key", "_h").agg(F.max("text").alias("text")).select("doc_id", "text", "_key", "_h", F.col("_of").alias("_bucket"), F.lit(1).alias("_extra"))
    both = d.select("doc_id", "text", "_key", "_h", "_bucket", F.lit(0).alias("_extra")).unionByName(border)
    w = Window.partitionBy("_bucket").orderBy("_extra", F.desc("_key"), F.desc("_h"), F.desc("text"))
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("_rn", F.row_number().over(w))


def imatch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", df_low: float = 0.001, df_high: float = 0.05) -> DataFrame:
    """Fingerprints of all documents and of their half-replaced texts, with likenesses (see the module)."""
    lex = stored(lexicon(docs, text, df_low, df_high), "lexicon")  # its size is checked, then it is broadcast: one count of terms serves both
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, doc_id, text)
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 2) as int))"))
    rows = rows.withColumn("_edited", F.when(half > 0, F.coalesce(edited, F.col("text"))).otherwise(F.col("text")))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2("_edited", 256), "_own": F.xxhash64("text"), "_own_edited": F.xxhash64("_edited")})
    keys, more = ["_bucket", "_rn", "_extra"], F.struct("doc_id", "n_chars", "edited_sha256", "_own", "_own_edited")
    # a row of its own for each document, so that one without lexicon terms stays: the empty term is in the lexicon as subset -1
    mark = lex.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("_h"), F.lit(False).alias("_over"), F.lit(-1).alias("_subset"))
    rows = rows.withColumns({"text": F.concat(F.lit(" "), "text"), "_edited": F.concat(F.lit(" "), "_edited")})
    codes = fingerprint_versions(rows, ["text", "_edited"], keys, more, lex.unionByName(mark))
    given = lambda v, c: (F.col("_v") == v) & (F.col("_subset") >= 0) & F.col(c).isNotNull()
    hashes = lambda v, c: F.transform(F.sort_array(F.collect_list(F.when(given(v, c), F.struct("_subset", F.col(c).alias("h"))))), lambda x: x["h"])
    bits = lambda v, c: F.coalesce(F.bit_or(F.when(given(v, c), F.expr("shiftleft(1L, _subset)"))), F.lit(0).cast("long"))
    print_ = lambda v, c: F.struct(hashes(v, c).alias("hashes"), bits(v, c).alias("bits"))
    few = lambda v: F.sum(F.when(F.col("_v") == v, F.col("_k")).otherwise(0)) < FEW
    of = lambda v: F.struct(few(v).alias("few"), print_(v, "_c").alias("band"), print_(v, "_all").alias("all"))
    fp = codes.groupBy(*keys).agg(of(0).alias("_a"), of(1).alias("_b"), F.first("_more", True).alias("_m")).select(*keys, "_a", "_b", "_m.*")
    w = Window.partitionBy("_bucket").orderBy("_rn")
    fp = fp.withColumns({"_n": F.lead("_a").over(w), "_next_own": F.lead("_own").over(w)}).where("_extra = 0")
    none = lambda x: x["all"]["bits"] == 0
    near = lambda x, own_x, y, own_y: F.when(none(x) & none(y), (own_x == own_y).cast("double")).when(x["few"] | y["few"], likeness(x["all"], y["all"])).otherwise(likeness(x["band"], y["band"]))
    shown = lambda x: F.when(x["few"], x["all"]["hashes"]).otherwise(x["band"]["hashes"])
    return fp.select(
        "doc_id", "n_chars", "edited_sha256",
        _printed(shown(F.col("_a")), F.col("_own")).alias("fingerprint"), _printed(shown(F.col("_b")), F.col("_own_edited")).alias("edited_fingerprint"),
        near(F.col("_a"), F.col("_own"), F.col("_b"), F.col("_own_edited")).alias("near_edited"),
        near(F.col("_a"), F.col("_own"), F.col("_n"), F.col("_next_own")).alias("near_next"),
    )


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(load(spark, sf_dir, "documents"))
