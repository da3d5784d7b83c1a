"""The whole pipeline behind one object: run, ask, label, last, status."""

from __future__ import annotations

import contextlib
import io
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, NO_RELATION, SIMILAR_TO, Config
from relata.functions import text as T
from relata.operators import active, induce, kg, labels, metrics, pathstats, schema, similarity
from relata.operators import text as X
from relata.schemas import LABELS
from relata.sources import coref
from relata.sources.annotate import shape_sentences
from relata.sources.export import clean
from relata.sources.scratch import forget, scope, stored
from relata.sources.stores import PathStore, append_label_log, compact_label_log, load_state, log_exists, read_label_log, save_state

log = logging.getLogger("relata")

SAMPLE = "Ada Byron met Charles Babbage in London. She wrote about the Analytical Engine (AE). It was never built."


@contextlib.contextmanager
def captured() -> Iterator[list[str]]:
    """Log records and printed text of a run, as lines."""
    lines: list[str] = []

    class Keep(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            lines.append(self.format(record))

    handler, out = Keep(), io.StringIO()
    logging.getLogger().addHandler(handler)
    try:
        with contextlib.redirect_stdout(out):
            yield lines
    finally:
        logging.getLogger().removeHandler(handler)
        lines += out.getvalue().splitlines()


class Learner:
    """Documents in, concepts, propositions, schema, relations and graph out. All tables carry doc_id, so a run takes one document or
    a corpus. ``annotate`` turns documents (doc_id, text) into sentences; ``resolver`` turns documents into documents with
    pronouns resolved: a function, None for the first model of ``coref.CHAIN`` that can be loaded (else the rules), or "rules"."""

    def __init__(
        self, spark: SparkSession, annotate: Callable[[DataFrame], DataFrame] = shape_sentences, cfg: Config = DEFAULT, path: str | None = None, labels_path: str | None = None,
        aliases: DataFrame | None = None, resolver: Callable[[DataFrame], DataFrame] | str | None = None,
    ):
        self.spark, self.annotate, self.cfg, self.aliases = spark, annotate, cfg, aliases
        self.path = path if cfg.persist else None
        self.labels_path = labels_path if cfg.persist else None
        kind = coref.choose() if resolver is None else None
        self.coref_backend = "own" if callable(resolver) else coref.name_of(kind)
        self.resolver = resolver if callable(resolver) else coref.with_model(kind) if kind else self._rules
        self.store = PathStore(spark, self.path and f"{self.path}/paths", cfg.compact_every)
        self.state = load_state(self.path and f"{self.path}/state", spark)
        self.records = self._load_labels()
        self._model: active.Model | None = active.Model()  # None: to be trained when it is asked for
        self.result: dict[str, Any] | None = None
        self.asked: dict[str, dict] = {}

    @classmethod
    def for_evaluation(cls, spark: SparkSession, **kw: Any) -> Learner:
        """Nothing read or written outside the session."""
        return cls(spark, cfg=replace(kw.pop("cfg", DEFAULT), persist=False), **kw)

    @property
    def model(self) -> active.Model:
        """The classifier of the records as they are now, trained when it is first asked for."""
        if self._model is None:
            self._model = active.train(self.records, self.cfg)
        return self._model

    def _can_fit(self) -> bool:
        """What ``model.is_fitted`` will be, without training."""
        return self._model.is_fitted if self._model is not None else self.records.select("label").distinct().limit(2).count() == 2

    def _load_labels(self) -> DataFrame:
        """The log's records, none where there is no log. A log that can't be read is an error: a run would replace it."""
        if self.labels_path and log_exists(self.spark, self.labels_path):
            return stored(read_label_log(self.spark, self.labels_path), "records")
        return self.spark.createDataFrame([], LABELS)

    def _rules(self, docs: DataFrame) -> DataFrame:
        return self._annotated(docs, self._rules)[0]

    def _sentences(self, docs: DataFrame, part: int = 0) -> DataFrame:
        """Sentences as far as extraction reads them, each with a key of its own."""
        key = F.monotonically_increasing_id()
        own = getattr(self.annotate, "kept", None)  # an annotator's shorter way to the same rows
        rows = own(docs) if own else X.kept_sentences(self.annotate(docs))
        return stored(rows.withColumn("key", -1 - key if part else key), "sentences")

    def _annotated(self, docs: DataFrame, resolver: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
        """Resolved documents and their sentences. The rules need sentences themselves: those of documents that they leave as they are
        stay, only the others are annotated again."""
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        if resolver != self._rules:
            text = resolver(docs) if resolver else docs
            return text, self._sentences(text)
        sents = self._sentences(docs)
        edits = stored(X.pronoun_edits(sents), "edits")
        if edits.isEmpty():
            forget(edits)
            return docs, sents
        text = X.spliced(docs, edits).select("doc_id", F.col("resolved").alias("text"))
        changed = stored(edits.select("doc_id").distinct(), "changed")
        again = self._sentences(text.join(changed, "doc_id", "left_semi"), part=1).join(changed, "doc_id", "left_semi")
        return text, sents.join(changed, "doc_id", "left_anti").unionByName(again)

    def run(self, docs: DataFrame, resolve_coreference: bool = True, oracle: Any = None, use_active_learning: bool = False, train_model: bool = True, graph: bool = True) -> dict[str, Any]:
        """All stages over documents (doc_id, text). The tables of the result are lazy or cached DataFrames."""
        began = time.time()
        docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        # stages are written to the shared folder: later ones read them several times, and plans stay short
        text, sents = self._annotated(docs, self.resolver if resolve_coreference else None)
        self._said = sents.where("sentence is not null").select(F.col("key").alias("_key"), "sentence")
        sents = sents.withColumn("sentence", F.col("key"))  # rows carry the key; whoever shows a sentence looks it up
        ments = X.mentions(sents)
        names = stored(X.name_map(text, ments), "names")
        concepts = X.concepts(X.canonical(ments, "text", names, self.aliases), sents.select("doc_id", "sent_id", F.explode("chunks").alias("c")).select("doc_id", "sent_id", "c.*"), self.cfg)
        order = Window.partitionBy("doc_id").orderBy("sent_id", "pair_idx")
        pairs = X.entity_pairs(sents, self.cfg)
        for c in ("entity1", "entity2"):
            pairs = X.canonical(pairs, c, names, self.aliases, "_c").withColumn(c, F.col("_c")).drop("_c")
        pairs = pairs.withColumn("seq", F.row_number().over(order).cast("long"))
        found = stored(X.proposition_candidates(sents, self.cfg), "candidates")
        props = stored(X.propositions(found, names, self.aliases).withColumn("seq", F.row_number().over(order).cast("long")), "propositions")
        negatives = stored(X.structural_negatives(found, names, self.aliases), "negatives")
        forget(found)

        digests = stored(pathstats.new_documents(text, self.store.digests()).select("doc_id", "digest"), "digests")
        if not digests.isEmpty():
            self.store.add(props.join(digests, "doc_id", "left_semi"), digests)
        forget(digests)
        counts = stored(self.store.slot_counts(), "counts")
        self.state, kind = induce.fit(counts, self.state, self.cfg)
        label = stored(induce.label_table(self.spark, self.state), "labels")
        support = pathstats.support_of(counts)
        bare, props = props, stored(labels.with_raw_confidence(induce.annotate(props, label), support, label, self.state.median, self.cfg), "propositions")
        forget(bare)
        with scope() as keep:
            patterns = keep(stored(similarity.similarity_patterns(stored(X.context_profiles(sents), "profiles"), self.cfg), "patterns"))

        pairs = stored(labels.tag_pairs(pairs, props.withColumn("confidence", F.col("raw"))), "pairs")
        examples = labels.induced_examples(props.withColumn("confidence", F.col("raw")))
        if train_model:
            with scope() as keep:
                self.records = keep(stored(labels.seed(self.records, pairs, examples, negatives), "records"))
            if use_active_learning and oracle is not None:
                self.records, _ = active.run_rounds(self._with_sentence(pairs), self.records, oracle, 1, self.cfg.al_batch, self.cfg)
            self._model = None
        with scope() as keep:
            parents = keep(stored(schema.parents(label, counts, self.cfg), "schema"))
        self._bare = dict(pairs=pairs, propositions=props)
        self.result = dict(concepts=concepts, pairs=self._with_sentence(pairs), propositions=self._with_sentence(props), patterns=patterns, negatives=negatives, schema=schema.with_depth(parents), pass_kind=kind, documents=text, raw=docs)
        self._calibrate()
        self._consolidate()
        if graph:
            self._graph()
        self._save()
        self.result["elapsed_seconds"] = round(time.time() - began, 3)
        return self.result

    def _with_sentence(self, rows: DataFrame, column: str = "sentence") -> DataFrame:
        """Rows with the text of the sentence whose key they carry."""
        said = self._said.withColumnRenamed("sentence", "_text")
        return rows.join(said, F.col(column) == F.col("_key"), "left").withColumn(column, F.col("_text")).drop("_key", "_text")

    def _graph(self) -> None:
        """Embeddings of the relations' graph; where enough triples are there, also ones trained without the held-out part."""
        t = stored(labels.triples(self.result["relations"], self.cfg), "triples")
        self.result["triples"] = t
        try:
            self.result["entities"], self.result["rotations"] = kg.train(t, self.cfg)
        except ValueError as e:
            log.warning("no graph embeddings: %s", e)

    def _calibrate(self) -> None:
        bins = {r["bucket"]: (r["correct"], r["total"]) for r in labels.calibration_bins(labels.calibration_samples(self.records), self.cfg).collect()}
        if bins:
            self.state.calibration = bins

    def _consolidate(self) -> None:
        r = self.result
        by = ("doc_id",)
        similar = similarity.similar_to(r["patterns"], self.cfg)
        if labels.has_human(self.records) and self.model.is_fitted:  # without human labels the model decides nothing, and isn't trained
            first = labels.consolidate(labels.model_edges(self.model.predict(self._bare["pairs"]), self.model.n_train, self.cfg), by=by)
        else:
            bins = self.spark.createDataFrame([(b, *v) for b, v in self.state.calibration.items()], "bucket int, correct int, total int")
            main = labels.proposition_edges(labels.calibrate(self._bare["propositions"], bins, cfg=self.cfg), self.cfg)
            first = self._with_sentence(labels.consolidate(main, by=by), "evidence")
        r["similarity_hypotheses"] = similar
        with scope() as keep:
            r["relations"] = keep(stored(labels.followed(stored(first, "facts"), similar, SIMILAR_TO, by), "relations"))

    def _save(self) -> None:
        if self.path:
            save_state(self.state, f"{self.path}/state", self.spark)
        if self.labels_path:
            compact_label_log(self.records, self.labels_path)

    # ---- active learning -------------------------------------------------------------------------------------------

    def queries(self, k: int = 6) -> list[dict]:
        """The most uncertain pairs with their key, the induced suggestion and the model's prediction."""
        self._need_run()
        self._model = None
        chosen = self.model.predict(self._with_sentence(active.select_queries(self._bare["pairs"], self.records, self.model, k, self.cfg).drop("probabilities", "prediction", "probability")))
        self.asked = {r["key"]: r.asDict() for r in chosen.drop("probabilities").collect()}
        return [clean(q | {"suggestion": q["frame_agreement"]}) for q in self.asked.values()]

    def label(self, key: str, answer: str) -> list[dict]:
        """Record a person's answer (blank: no relation), train and calibrate again; the relations that follow."""
        self._need_run()
        example = self.asked.get(key)
        if example is None:
            keyed = self._bare["pairs"].withColumn("key", T.label_key(F.col("entity1"), F.col("entity2"), F.col("context")))
            row = keyed.where(F.col("key") == key).orderBy("doc_id", "seq").limit(1).collect()
            if not row:
                raise KeyError(key)
            example = row[0].asDict()
        cols = [c.split()[0] for c in LABELS.split(", ")]
        given = example | {"key": key, "label": answer.strip() or NO_RELATION, "source": labels.ORACLE}
        new = self.spark.createDataFrame([tuple(given.get(c) for c in cols)], LABELS)
        self.records = stored(labels.latest(self.records.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))).drop("seq"), "records")
        if self.labels_path:
            append_label_log(new, self.labels_path)
        self._model = None
        self._calibrate()
        self._consolidate()
        return [clean(r) for r in self.result["relations"].collect()]

    def active_loop(self, oracle: Any, rounds: int = 3, k: int = 5) -> list[dict]:
        self._need_run()
        self.records, history = active.run_rounds(self.result["pairs"], self.records, oracle, rounds, k, self.cfg)
        self._model = None
        self._calibrate()
        self._consolidate()
        self._save()
        return history

    def _need_run(self) -> None:
        if self.result is None:
            raise RuntimeError("run documents first")

    # ---- results ------------------------------------------------------------------------------------------------------

    def status(self) -> dict:
        return {
            "ready": self.result is not None, "mode": "persistent" if self.path else "memory", "has_run": self.result is not None, "annotator": getattr(self.annotate, "__name__", type(self.annotate).__name__),
            "coref_backend": self.coref_backend, "evaluation": True, "model_fitted": self._can_fit(), "n_train": self.records.count(), "graph_model": self.cfg.kg_model, "no_relation": NO_RELATION,
        }

    @staticmethod
    def sample() -> str:
        return SAMPLE

    def last(self) -> dict:
        self._need_run()
        return self.payload()

    def payload(self, rows: int = 200) -> dict:
        """A JSON-safe summary: counts, and the first rows of each table."""
        r = self.result
        part = lambda name: [clean(x) for x in r[name].limit(rows).collect()]
        tables = ("concepts", "pairs", "propositions", "patterns", "schema", "relations")
        return {"counts": {t: r[t].count() for t in tables}, "pass": r["pass_kind"], "elapsed_seconds": r.get("elapsed_seconds"), **{t: part(t) for t in tables}}

    def graph_summary(self, entities: int = 12, near: int = 3, links: int = 10) -> dict:
        if not self.result or "entities" not in self.result:
            return {}
        emb = kg.magnitudes(self.result["entities"])
        names = [x["entity"] for x in emb.orderBy("entity").limit(entities).collect()]
        return {
            "similar": [clean(x) for x in kg.similar_entities(emb, names, near).orderBy("entity", "rank").collect()],
            "links": [clean(x) for x in kg.predict_links(self.result["entities"], self.result["rotations"], self.result["triples"], links, self.cfg).collect()],
        }

    def summary(self) -> str:
        """Ten concepts and relations, twelve types, six propositions, and how many more there are."""
        r, out = self.result, []
        for name, n in (("concepts", 10), ("relations", 10), ("schema", 12), ("propositions", 6)):
            total = r[name].count()
            out.append(f"{name}: {total}")
            out += [f"  {x}" for x in (clean(y) for y in r[name].limit(n).collect())]
            out += [f"  ... and {total - n} more"] * (total > n)
        return "\n".join(out)

    def evaluate(
        self, gold: DataFrame | None = None, gold_partition: DataFrame | None = None, gold_hierarchy: DataFrame | None = None, judged: DataFrame | None = None, compare_no_coref: bool = False,
    ) -> dict:
        """All metrics of a run. A metric that fails is reported as its error, the others stay.

        Always: pronoun counts, pronoun-free share, drift, baseline pairs, calibration, hits at 10 (None for a small graph) and
        entity similarity. With gold (doc_id, seq, arg1, rel, arg2): tuple scores; gold_partition (arg1, arg2, label): B-cubed, pairwise and
        confusion; gold_hierarchy (label, parent); judged (subject, relation, object, correct): labelled precision;
        compare_no_coref: the pronoun-free share of a run without resolution beside this one's.
        """
        self._need_run()
        r = self.result
        words = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
        one = lambda df: (df.first() or {}) and clean(df.first())
        jobs: dict[str, Callable[[], Any]] = {
            "coreference": lambda: one(X.pronoun_counts(r["raw"], r["documents"], words)),
            "pronoun_free": lambda: one(metrics.pronoun_free(r["relations"])),
            "drift": lambda: one(self.drift()),
            "baseline_pairs": lambda: {"pairs": labels.cooccurrence_tuples(r["pairs"]).count()},
            "calibration": lambda: one(metrics.calibration_report(labels.calibration_samples(self.records))),
            "calibration_curve": lambda: [clean(x) for x in metrics.calibration_curve(labels.calibration_samples(self.records)).orderBy("bucket").collect()],
            "hits_at_10": lambda: {"hits_at_10": self._hits()},
            "similarity": lambda: one(metrics.top_similarity(kg.magnitudes(r["entities"]))) if "entities" in r else {"avg_top1_similarity": None, "sampled_entities": 0},
        }
        if gold is not None:
            pred = r["propositions"].select("doc_id", "seq", "arg1", F.col("label").alias("rel"), "arg2")
            jobs["tuples"] = lambda: one(metrics.evaluate_tuples(pred, gold))
        if gold_partition is not None:
            own = metrics.pair_partition(r["propositions"].withColumn("seq", F.struct("doc_id", "seq"))).withColumnRenamed("label", "pred")
            items = own.join(gold_partition.withColumnRenamed("label", "gold"), ["arg1", "arg2"])
            jobs["bcubed"] = lambda: one(metrics.bcubed(items))
            jobs["pairwise"] = lambda: one(metrics.pairwise_prf(items))
            jobs["confusion"] = lambda: [clean(x) for x in metrics.confusion_cells(items).collect()]
        if gold_hierarchy is not None:
            jobs["hierarchy"] = lambda: one(metrics.hierarchy_prf(r["schema"], gold_hierarchy))
        if judged is not None:
            jobs["labelled_precision"] = lambda: one(metrics.labelled_precision(r["relations"], judged))
        if compare_no_coref:
            jobs["coref_off_vs_on"] = lambda: self._without_coref(judged)
        out = {}
        for name, job in jobs.items():
            try:
                out[name] = job()
            except Exception as e:  # noqa: BLE001 - one metric's failure is no reason to lose the others
                out[name] = {"error": str(e)[:300]}
        return out

    def _hits(self) -> float | None:
        """Hits at 10 of a graph trained without the held-out triples; None without a graph, or below the minimum."""
        if "triples" not in self.result:
            return None
        train, test, valid = kg.split_triples(self.result["triples"], self.cfg)
        if not valid:
            return None
        return kg.hits_at(*kg.train(train, self.cfg), test, 10, self.cfg)

    def _without_coref(self, judged: DataFrame | None) -> dict:
        other = Learner.for_evaluation(self.spark, annotate=self.annotate, cfg=self.cfg, aliases=self.aliases, resolver="rules")
        off = other.run(self.result["raw"], resolve_coreference=False, train_model=False, graph=False)["relations"]
        both = (("off", off), ("on", self.result["relations"]))
        out = {f"pronoun_free_{n}": metrics.pronoun_free(x).first()[0] for n, x in both}
        if judged is not None:
            out |= {f"labelled_{n}": metrics.labelled_precision(x, judged).first()[0] for n, x in both}
        return out

    def drift(self) -> DataFrame:
        """Agreement of the labels in use with those of a fresh full pass."""
        fresh = induce.full_pass(self.store.slot_counts(), None, self.cfg).table(self.spark, "labels")
        now = self.state.table(self.spark, "labels").select("path", F.col("label").alias("pred"))
        return metrics.partition_agreement(now.join(fresh.select("path", F.col("label").alias("gold")), "path", "left"))


def measure(job: Callable[[], Any]) -> dict:
    """A call's result, seconds and the driver's peak of Python memory."""
    import tracemalloc

    tracemalloc.start()
    began = time.perf_counter()
    try:
        result = job()
        return {"result": result, "seconds": round(time.perf_counter() - began, 4), "peak_kb": round(tracemalloc.get_traced_memory()[1] / 1024, 1)}
    finally:
        tracemalloc.stop()


def ablations(make: Callable[[Config], Learner], docs: DataFrame, gold: DataFrame, base: Config = DEFAULT, changes: dict[str, dict] | None = None) -> dict[str, dict]:
    """Tuple scores and cost of the base settings and of each set of changes."""
    out = {}
    for name, change in {"base": {}, **(changes or {})}.items():
        learner = make(replace(base, persist=False, **change))
        cost = measure(lambda: learner.run(docs, train_model=False))
        pred = learner.result["propositions"].select("doc_id", "seq", "arg1", F.col("label").alias("rel"), "arg2")
        out[name] = clean(metrics.evaluate_tuples(pred, gold).first()) | {k: cost[k] for k in ("seconds", "peak_kb")}
    return out


def before_after_coreference(make: Callable[[], Learner], docs: DataFrame, gold: DataFrame | None = None) -> dict:
    """Pronoun-free shares, and tuple scores with gold, with and without resolution."""
    out = {}
    for name, on in (("with", True), ("without", False)):
        learner = make()
        learner.run(docs, resolve_coreference=on, train_model=False)
        out[name] = learner.evaluate(gold)
    return out
