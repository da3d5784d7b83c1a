"""Memory between runs: path statistics, labels, induction state. Logs are read as JSON lines; own stores are Parquet.

A store is a folder of batches and a manifest that lists them. Batches are written by Spark and become part of the store
when their name is in the manifest, which is replaced as a whole; a lost executor or driver leaves unlisted files and no
half batch. Compaction lists one batch in place of all; files of the version before stay until the next one, for those who read them.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.operators.pathstats import SLOTS, slot_counts
from relata.sources.scratch import stored

log = logging.getLogger("relata")

_LOG = "path string, support long, x map<string,long>, y map<string,long>, tx map<string,long>, ty map<string,long>, doc_id string"
_LABEL = "key string, label string, source string, entity1 string, entity2 string, type1 string, type2 string, context string, frame_agreement string, confidence double"


def read_path_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(slot counts, ledger) of a JSON-lines log: count lines per path and document markers, repeated lines add up, blank and
    broken lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", _LOG, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    paths = lines.where("path is not null")
    parts = [paths.select("path", F.lit(s).alias("slot"), F.explode(F.col(s)).alias("filler", "n")) for s in SLOTS]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    ledger = lines.where("path is null and doc_id is not null").select(F.col("doc_id").alias("digest")).distinct()
    return counts.groupBy("path", "slot", "filler").agg(F.sum("n").alias("n")), ledger


def read_path_support(spark: SparkSession, path: str) -> DataFrame:
    """(path, support) of such a log; a line without support counts its x fillers."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", _LOG, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("path is not null")
    own = F.aggregate(F.map_values("x"), F.lit(0).cast("long"), lambda s, v: s + v)
    return lines.groupBy("path").agg(F.sum(F.coalesce("support", own, F.lit(0))).alias("support"))


def write_path_log(counts: DataFrame, ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Slot counts and markers as JSON lines, one line a path."""
    per = counts.groupBy("path").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("slot") == s, F.struct("filler", "n")))).alias(s) for s in SLOTS], F.sum(F.when(F.col("slot") == "x", F.col("n"))).alias("support"))
    per.select(F.to_json(F.struct("path", "support", *SLOTS)).alias("value")).unionByName(ledger.select(F.to_json(F.struct(F.col("digest").alias("doc_id"))).alias("value"))).write.mode(mode).text(path)


def read_label_log(spark: SparkSession, path: str) -> DataFrame:
    """Label records, the last line of each key; broken lines and lines without a key are skipped."""
    from relata.operators.labels import latest

    # appended files in order of time, lines in order inside each
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("seq")).where(F.trim("value") != "")
    r = lines.select(F.from_json("value", _LABEL).alias("r"), "seq").select("r.*", "seq").where("key is not null")
    return latest(r).drop("seq")


def append_label_log(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct(*[c.split()[0] for c in _LABEL.split(", ")])).alias("value")).write.mode("append").text(path)


def log_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file in a log. Any other trouble than its absence is an error, not an empty log."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target) and (not fs.getFileStatus(target).isDirectory() or any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(target)))


def compact_label_log(records: DataFrame, path: str) -> None:
    """Replace a log by one line per key: that of ``records``, or the log's own where records lack the key, or have no human label and
    the log has. The new lines are complete in files of their own before the old ones go; a reader of the folder finds either."""
    spark = records.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(target)] if log_exists(spark, path) else []
    if old:
        cols = [c.split()[0] for c in _LABEL.split(", ")]
        here = records.select(*cols, F.lit(1).alias("_here")).unionByName(read_label_log(spark, path).select(*cols, F.lit(0).alias("_here")))
        best = here.groupBy("key").agg(F.max_by(F.struct(*cols[1:]), F.struct((F.col("source") == "oracle").cast("int"), "_here")).alias("_r"))
        records = stored(best.select("key", "_r.*"), "label-log")
    append_label_log(records, path)  # the same keys and labels once more: a reader still takes the last line of each
    for f in old:
        fs.delete(f, True)


class Manifest:
    """Names of the batches of one or more tables of a folder, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> dict[str, list[str]]:
        _, p, fs = self.file("manifest.json")
        if not fs.exists(p):
            return {}
        s = fs.open(p)
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def publish(self, listed: dict[str, list[str]]) -> None:
        jvm, tmp, fs = self.file(f"manifest-{uuid.uuid4().hex}.tmp")
        _, target, _ = self.file("manifest.json")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, target, options)

    def replace(self, listed: dict[str, list[str]]) -> None:
        """Publish a new version; what the one before lists stays until the next, what went out before that is deleted."""
        try:
            now = self.read()
        except ValueError:  # a broken listing: what it had can't be known, so nothing is deleted
            now = {}
        gone = now.pop("out", [])
        self.publish({**listed, "out": [n for names in now.values() for n in names]})
        for name in gone:
            _, p, fs = self.file(name)
            fs.delete(p, True)


class Store:
    """Batches of one table of a folder. ``manifest`` None keeps everything in the session."""

    def __init__(self, spark: SparkSession, manifest: Manifest | None, table: str, schema: str):
        self.spark, self.manifest, self.table, self.schema = spark, manifest, table, schema
        self.parts: list[DataFrame] = []

    def batches(self) -> list[str]:
        return self.manifest.read().get(self.table, []) if self.manifest else []

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        if self.manifest is None:
            for p in self.parts:
                empty = empty.unionByName(p)
            return empty
        names = self.batches()
        return self.spark.read.schema(empty.schema).parquet(*[f"{self.manifest.path}/{n}" for n in names]) if names else empty

    def write(self, df: DataFrame) -> str:
        """A new batch, not listed yet."""
        name = f"{self.table}-{uuid.uuid4().hex[:12]}"
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.manifest.path}/{name}")
        return name

    def append(self, df: DataFrame) -> None:
        if self.manifest is None:
            self.parts.append(stored(df.select(*self.spark.createDataFrame([], self.schema).columns), self.table))
            return
        name = self.write(df)
        listed = self.manifest.read()
        self.manifest.publish({**listed, self.table: [*listed.get(self.table, []), name]})


class PathStore:
    """Slot counts and the document ledger; each digest is counted once. Both tables have one manifest, so a batch of counts and its
    ledger entries are listed at once."""

    def __init__(self, spark: SparkSession, path: str | None = None, compact_every: int = 200):
        self.manifest, self.compact_every = Manifest(spark, path) if path else None, compact_every
        self.counts = Store(spark, self.manifest, "counts", "path string, slot string, filler string, n long, batch string")
        self.ledger = Store(spark, self.manifest, "ledger", "digest string, batch string")

    def slot_counts(self) -> DataFrame:
        """Counts of batches whose ledger entry exists: a batch without one was not finished."""
        done = self.ledger.read().select("batch").distinct()
        return self.counts.read().join(F.broadcast(done), "batch", "left_semi").groupBy("path", "slot", "filler").agg(F.sum("n").alias("n"))  # ``compact_every`` names

    def digests(self) -> DataFrame:
        return self.ledger.read().select("digest").distinct()

    def add(self, props: DataFrame, digests: DataFrame) -> None:
        batch = uuid.uuid4().hex[:16]
        counts, entries = slot_counts(props).withColumn("batch", F.lit(batch)), digests.select("digest", F.lit(batch).alias("batch"))
        if self.manifest is None:
            self.counts.append(counts)
            self.ledger.append(entries)
            return
        new = {"counts": self.counts.write(counts), "ledger": self.ledger.write(entries)}
        listed = self.manifest.read()
        self.manifest.publish({**listed, **{t: [*listed.get(t, []), name] for t, name in new.items()}})
        if len(self.counts.batches()) >= self.compact_every:
            self.compact()

    def compact(self) -> None:
        """One batch of the finished counts, and one of all ledger entries, in place of all others."""
        batch = F.lit(f"compact-{uuid.uuid4().hex[:12]}").alias("batch")
        counts, entries = self.slot_counts().withColumn("batch", batch), self.digests().select("digest", batch)
        self.manifest.replace({"counts": [self.counts.write(counts)], "ledger": [self.ledger.write(entries)]})


_SCALARS = "thresholds array<struct<sx:string,sy:string,t:double>>, smoothed array<struct<sx:string,sy:string,t:double>>, calibration array<struct<b:int,c:long,t:long>>, reference double, median double, n_medoids long, fits long, singletons long"


def save_state(state, path: str, spark: SparkSession) -> None:
    """An induction state as a new version: a folder of its tables and one row of scalars. The pointer is replaced last."""
    from relata.operators.induce import TABLES

    files, name = Manifest(spark, path), f"state-{uuid.uuid4().hex[:12]}"
    for table in TABLES:
        state.table(spark, table).write.parquet(f"{path}/{name}/{table}")
    limits = lambda d: [(*k, float(v)) for k, v in d.items()]
    row = (limits(state.thresholds), limits(state.smoothed), [(b, int(c), int(t)) for b, (c, t) in state.calibration.items()], state.reference, float(state.median), state.n_medoids, state.fits, state.singletons)
    spark.createDataFrame([row], _SCALARS).coalesce(1).write.parquet(f"{path}/{name}/scalars")
    files.replace({"state": [name]})  # tables in use may come from the version before


def load_state(path: str | None, spark: SparkSession):
    """The saved state; a fresh one where there is none or it can't be read."""
    from relata.operators.induce import TABLES, State

    out = State()
    if not path:
        return out
    files = Manifest(spark, path)
    try:
        names = files.read().get("state", [])
        if not names:
            return out
        r = spark.read.parquet(f"{path}/{names[0]}/scalars").first()
        tables = {t: spark.read.schema(TABLES[t]).parquet(f"{path}/{names[0]}/{t}") for t in TABLES}
    except Exception:  # noqa: BLE001 - whatever is wrong with a saved state, a full pass makes a new one; the files stay
        log.warning("the state in %s can't be read; a full pass makes a new one", path, exc_info=True)
        return out
    limits = lambda rows: {(x["sx"], x["sy"]): x["t"] for x in rows}
    return State(**tables, thresholds=limits(r["thresholds"]), smoothed=limits(r["smoothed"]), calibration={x["b"]: (x["c"], x["t"]) for x in r["calibration"]}, reference=r["reference"], median=r["median"], n_medoids=r["n_medoids"], fits=r["fits"], singletons=r["singletons"])
