"""A corpus pipeline: each stage reads the documents that the one before it wrote.

1. quality classifier: documents it rejects go.
2. line dedup: later copies of repeated line runs are deleted; a document of which nothing is left goes.
3. n-gram Jaccard join: of each class of near copies the document with the smallest id stays.
4. benchmark decontamination: contaminated documents go.
5. packing: the rest is packed into sequences; one row per piece.

Stages 1 to 4 return the columns of documents; n_chars follows the text. No stage can be told in SQL as a whole (the classifier
is learnt), so ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.common import forget, load, order_key, quoted, stored
from relata.llm.decontam import contamination
from relata.llm.jaccard import similar, text_hash
from relata.llm.linededup import dedup_lines
from relata.llm.packing import pack
from relata.llm.quality import score

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score(docs, load(spark, sf_dir, "labels")).where("predicted = 1").select(*[F.col(quoted(c)) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = dedup_lines(docs)
    kept = cut.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    changed = kept.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(quoted(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each class: the smallest id's, of equal ids the smallest text hash's. A null id counts as the smallest.

    Rows are told apart by id and text hash; a text without words is a class of its own.
    """
    classes = similar(docs, keep_hash=True)
    alone = F.col("root").isNull()
    first = classes.groupBy("root", F.when(alone, F.col("doc_id")).alias("_d"), F.when(alone, F.col("text_hash")).alias("_h")).agg(F.min(F.struct("doc_id", "text_hash")).alias("_first")).select(F.col("_first.doc_id").alias("_k"), F.col("_first.text_hash").alias("_t"))
    rows = docs.withColumns({"_k": order_key("doc_id"), "_t": text_hash("text")})
    return rows.join(first, ["_k", "_t"], "left_semi").dropDuplicates(["_k", "_t"]).select(*[F.col(quoted(c)) for c in docs.columns])  # by the join's own keys: no second shuffle


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination(docs, load(spark, sf_dir, "benchmark")).where("not contaminated").select(*[F.col(quoted(c)) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)  # the first stage's is the table itself, which stays
    return STAGES[-1][1](spark, docs, sf_dir)
