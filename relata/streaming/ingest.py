"""Continuous ingestion: documents stream in, each batch is annotated, counted once per digest and induced on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config
from relata.operators import induce, pathstats
from relata.operators import text as X
from relata.sources.annotate import shape_sentences
from relata.sources.scratch import stored
from relata.sources.stores import PathStore, load_state, save_state


class Ingest:
    """Owns the stores. ``annotate`` turns documents (doc_id, text) into sentences."""

    def __init__(self, spark: SparkSession, path: str | None = None, annotate: Callable[[DataFrame], DataFrame] = shape_sentences, cfg: Config = DEFAULT):
        self.spark, self.path, self.annotate, self.cfg = spark, path if cfg.persist else None, annotate, cfg
        self.store = PathStore(spark, self.path and f"{self.path}/paths", cfg.compact_every)
        self.state = load_state(self.path and f"{self.path}/state", spark)
        self.passes: list[str] = []

    def batch(self, docs: DataFrame, batch_id: int = 0) -> DataFrame:
        """Ingest documents; those seen before (by digest) count for nothing, so a batch that runs twice changes nothing.
        Returns the propositions of the new ones with their labels."""
        fresh = stored(pathstats.new_documents(docs.select("doc_id", "text"), self.store.digests()), "fresh")
        sents = stored(self.annotate(fresh), "sentences")
        found = X.proposition_candidates(sents, self.cfg)
        props = X.propositions(found, X.name_map(fresh.withColumn("doc_id", F.col("doc_id").cast("string")), X.mentions(sents)))
        props = stored(props, "propositions")
        if not fresh.isEmpty():
            self.store.add(props, fresh)
            counts = stored(self.store.slot_counts(), "counts")
            self.state, kind = induce.fit(counts, self.state, self.cfg)
            self.passes.append(kind)
            if self.path:
                save_state(self.state, f"{self.path}/state", self.spark)
        return induce.annotate(props, induce.label_table(self.spark, self.state))

    def stream(self, docs: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Start a query over a streaming frame (doc_id, text); the ledger makes each batch idempotent."""
        writer = docs.writeStream.foreachBatch(lambda df, i: self.batch(df, i) and None).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

