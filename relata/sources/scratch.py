"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``); they cut lineage and survive a lost
executor."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_OPEN = threading.local()
#: Shuffle files of an execution go at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` if set; else, on a single machine (master local), one folder per process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="relata-"))
    return _OWN_DIR[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/relata-{uuid.uuid4().hex[:12]}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back. Zstandard: texts take half the disk that the default codec needs."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._relata_path = path
    for tables in getattr(_OPEN, "scopes", [])[-1:]:
        tables.append(out)
    return out


def is_stored(df: DataFrame) -> bool:
    return hasattr(df, "_relata_path")


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread stores inside go at the end, but those given to ``keep`` (they belong to the scope around, if any)."""
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    tables: list[DataFrame] = []
    kept: list[DataFrame] = []
    scopes.append(tables)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        for t in tables:
            if not any(t is k for k in kept):
                forget(t)
            elif scopes:
                scopes[-1].append(t)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    path = getattr(df, "_relata_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
