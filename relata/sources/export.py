"""Sinks: CSV files, JSON payloads, text reports."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; ``single`` only for results known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def concepts_csv(concepts: DataFrame, path: str) -> None:
    write_csv(concepts.select("concept", "type", "surface", "confidence", F.array_join("sources", ",").alias("sources")), path)


def relations_csv(relations: DataFrame, path: str) -> None:
    write_csv(relations.select("subject", "relation", "object", "confidence", "source", "evidence"), path)


def propositions_csv(props: DataFrame, path: str) -> None:
    write_csv(props.select("arg1", "type1", F.col("label").alias("relation"), "arg2", "type2", "path", "negated", "sentence"), path)


def similarity_hypotheses_csv(relations: DataFrame, path: str) -> None:
    relations_csv(relations.where("source = 'distributional_similarity'"), path)


def embeddings_csv(embeddings: DataFrame, path: str, dims: int = 50) -> None:
    write_csv(embeddings.select("entity", *[F.get("embedding", F.lit(i)).alias(f"dim_{i}") for i in range(dims)]), path)


def link_predictions_csv(links: DataFrame, path: str, k: int = 20) -> None:
    write_csv(links.orderBy(F.desc("score")).limit(k), path, single=True)


def similarity_csv(similar: DataFrame, path: str) -> None:
    write_csv(similar.select("entity", F.col("other").alias("similar_entity"), F.round("similarity", 4).alias("similarity")), path)


def clean(value: Any) -> Any:
    """A JSON-safe copy: sets and tuples as lists, NaN and infinities as null, other objects as text."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if hasattr(value, "asDict"):
        return clean(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return [clean(v) for v in sorted(value, key=str)]
    if hasattr(value, "tolist"):
        return clean(value.tolist())
    return str(value)


def report(sections: Any, indent: int = 0) -> str:
    """Nested results as indented text."""
    pad = "  " * indent
    if isinstance(sections, dict):
        return "".join(f"{pad}{k}:\n{report(v, indent + 1)}" if isinstance(v, (dict, list)) else f"{pad}{k}: {v}\n" for k, v in sections.items())
    if isinstance(sections, list):
        return "".join(report(x, indent) + f"{pad}---\n" for x in sections)
    return f"{pad}{sections}\n"


def confusion_text(cells: DataFrame) -> str:
    """The cells of confusion_cells (at most top x top) as a table; labels by frequency."""
    rows = cells.collect()
    if not rows:
        return "(no overlapping items)"
    size: dict[tuple[str, str], int] = {}
    for r in rows:
        for side in ("gold", "pred"):
            size[side, r[side]] = size.get((side, r[side]), 0) + r["n"]
    names = lambda side: sorted({x for s, x in size if s == side}, key=lambda x: (-size[side, x], x))
    n = {(r["gold"], r["pred"]): r["n"] for r in rows}
    out = "gold\\pred".ljust(16) + "".join(p[:12].ljust(13) for p in names("pred")) + "\n"
    for g in names("gold"):
        out += g[:15].ljust(16) + "".join(str(n.get((g, p), 0)).ljust(13) for p in names("pred")) + "\n"
    return out
