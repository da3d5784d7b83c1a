"""Graph embeddings: training, similar entities, link prediction, held-out ranks.

Two models: rotations (head * e^(i phase) close to the tail) and complex products (real part of head * relation * conjugate tail).
A graph of up to ``triples_per_task`` triples is trained in one task. A larger one is cut by a hash of its entities into
parts; a pair of parts (with the triples between them) is a task's work, the pairs of one round share no part and run at once, and after a
round the relations' vectors, which all tasks change, are averaged. Nothing of the size of the entities reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relata.config import DEFAULT, Config
from relata.functions.scores import cosine
from relata.sources.scratch import forget, stored

TRIPLES_PER_TASK = 2_000_000
PASSES = 5  # over all pairs of parts
_BATCH = 256
_ENTITIES, _ASKED = 2048, 256  # rows of a block
_VECTOR = "array<double>"


def split_triples(triples: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, bool]:
    """(training, testing, whether a held-out evaluation is valid): by a hash of the triple, none below the minimum."""
    if triples.count() < cfg.min_triples_for_eval:
        return triples, triples, False
    held = F.pmod(F.xxhash64("h", "r", "t"), F.lit(1000)) < int(1000 * cfg.kg_test_ratio)
    return triples.where(~held), triples.where(held), True


@dataclass
class Vectors:
    """Entities and relations as complex rows, and the sums of squared steps that slow them down."""

    entity: np.ndarray
    relation: np.ndarray
    seen_e: np.ndarray
    seen_r: np.ndarray

    @classmethod
    def fresh(cls, n: int, k: int, dim: int, seed: int, rotate: bool) -> Vectors:
        g = np.random.default_rng(seed)
        draw = lambda rows: (g.normal(size=(rows, dim)) + 1j * g.normal(size=(rows, dim))) / np.sqrt(dim)
        entity = draw(n)
        return cls(entity, np.exp(1j * g.uniform(-np.pi, np.pi, (k, dim))) if rotate else draw(k), np.full((n, dim), 1e-8), np.full((k, dim), 1e-8))


def _step(x: np.ndarray, seen: np.ndarray, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """An adaptive step of the rows that a batch touches, and of these only."""
    some, at = np.unique(rows, return_inverse=True)
    g = np.zeros((len(some), x.shape[1]), grad.dtype)
    np.add.at(g, at, grad)
    seen[some] += np.abs(g) ** 2
    x[some] -= rate * g / np.sqrt(seen[some])


def train_epochs(v: Vectors, h: np.ndarray, r: np.ndarray, t: np.ndarray, epochs: int, rotate: bool, seed: int = 42, rate: float = 0.1, margin: float = 2.0) -> None:
    """Draw heads to their tails and away from random entities, in batches, by the log loss."""
    g = np.random.default_rng(seed)
    for _ in range(epochs):
        order = g.permutation(len(h))
        for lo in range(0, len(order), _BATCH):
            b = order[lo : lo + _BATCH]
            for tail, sign in ((t[b], 1.0), (g.integers(0, len(v.entity), len(b)), -1.0)):
                head, turn, end = v.entity[h[b]], v.relation[r[b]], v.entity[tail]
                if rotate:
                    diff = head * turn - end
                    size = np.abs(diff) + 1e-9
                    push = sign / (1 + np.exp(-(size.sum(axis=1) - margin) * sign))  # gradient of the log loss of margin - distance
                    grad = push[:, None] * diff / size
                    of_head, of_tail = grad * np.conj(turn), -grad
                    of_turn = np.real(np.conj(grad) * (1j * head * turn))
                else:
                    score = np.real((head * turn * np.conj(end)).sum(axis=1))
                    push = (-sign / (1 + np.exp(np.clip(sign * score, -50, 50))))[:, None]
                    of_head, of_tail, of_turn = push * np.conj(turn) * end, push * head * turn, push * np.conj(head) * end
                _step(v.entity, v.seen_e, np.concatenate((h[b], tail)), np.concatenate((of_head, of_tail)), rate)
                if rotate:
                    some, at = np.unique(r[b], return_inverse=True)
                    phase, seen = np.angle(v.relation[some]), v.seen_r[some]
                    _step(phase, seen, at, of_turn, rate)
                    v.relation[some], v.seen_r[some] = np.exp(1j * phase), seen
                else:
                    _step(v.relation, v.seen_r, r[b], of_turn, rate)


def scores(head: np.ndarray, relation: np.ndarray, tail: np.ndarray, rotate: bool) -> np.ndarray:
    """Score matrix of asked (head, relation) rows and tails; larger is likelier."""
    asked = head * relation
    if not rotate:
        return np.real(asked @ np.conj(tail).T)
    return -np.stack([np.abs(a - tail).sum(axis=1) for a in asked])


def _complex(re, im) -> np.ndarray:
    return np.stack(list(re)) + 1j * np.stack(list(im))


def _rows(kind: str, names: list[str], x: np.ndarray, seen: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "name": names, "re": list(x.real), "im": list(x.imag), "seen": list(seen)})


_OUT = f"kind string, name string, re {_VECTOR}, im {_VECTOR}, seen {_VECTOR}"


def _train_part(pdf: pd.DataFrame, cfg: Config, epochs: int, start: dict[str, pd.DataFrame] | None = None) -> pd.DataFrame:
    """Vectors after training on triples (h, r, t): from fresh ones, or from ``start`` (e: entities, r: relations; name, re, im, seen)."""
    pdf, rotate = pdf.sort_values(["h", "r", "t"]), cfg.kg_model == "rotate"
    if start is None:
        names, rels = sorted({*pdf.h, *pdf.t}), sorted({*pdf.r})
        v = Vectors.fresh(len(names), len(rels), cfg.kg_dim, 42, rotate)
    else:
        e, r = start["e"].sort_values("name"), start["r"].sort_values("name")
        names, rels = list(e.name), list(r.name)
        v = Vectors(_complex(e.re, e.im), _complex(r.re, r.im), np.stack(list(e.seen)), np.stack(list(r.seen)))
    at, of = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(rels)}
    if len(pdf):
        train_epochs(v, pdf.h.map(at).to_numpy(), pdf.r.map(of).to_numpy(), pdf.t.map(at).to_numpy(), epochs, rotate)
    return pd.concat([_rows("e", names, v.entity, v.seen_e), _rows("r", rels, v.relation, v.seen_r)])


def rounds_of(parts: int) -> list[list[tuple[int, int]]]:
    """Rounds of pairs of parts that share none, each pair once (the circle method); an even number of parts."""
    ring = list(range(parts))
    out = []
    for _ in range(parts - 1):
        out.append([tuple(sorted((ring[i], ring[-1 - i]))) for i in range(parts // 2)])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def _train_in_parts(t: DataFrame, n: int, cfg: Config, triples_per_task: int) -> DataFrame:
    """(kind, name, re, im, seen) of a graph that one task can't hold."""
    spark = t.sparkSession
    parts = max(4, 2 * -(-n // (2 * triples_per_task)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    t = stored(t.select("h", "r", "t", part("h").alias("_h"), part("t").alias("_t")), "kg-triples")
    rotate, dim = cfg.kg_model == "rotate", cfg.kg_dim

    def fresh(kind: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                made = [Vectors.fresh(int(kind == "e"), int(kind == "r"), dim, s % 2**63, rotate) for s in b.seed]
                x = np.concatenate([m.entity if kind == "e" else m.relation for m in made]) if made else np.zeros((0, dim), complex)
                yield _rows(kind, list(b.name), x, np.full((len(b), dim), 1e-8))

        return run

    named = lambda df: df.distinct().withColumn("seed", F.xxhash64("name"))
    ent = stored(named(t.select(F.col("h").alias("name")).unionByName(t.select(F.col("t").alias("name")))).mapInPandas(fresh("e"), _OUT), "kg-entities")
    rel = named(t.select(F.col("r").alias("name"))).mapInPandas(fresh("r"), _OUT).toPandas()  # the relation inventory
    epochs = max(1, cfg.kg_epochs // PASSES)
    for _ in range(PASSES):
        for turn, pairs in enumerate(rounds_of(parts)):
            of = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(pairs) for x in (a, i, b, i)])
            # a triple between two parts is in the round of that pair; one inside a part could be in every round, and is in one by its hash
            inside = (F.col("_h") != F.col("_t")) | (F.pmod(F.xxhash64("h", "r", "t"), F.lit(parts - 1)) == turn)
            own = t.where(inside & (of[F.col("_h")] == of[F.col("_t")])).select(of[F.col("_h")].alias("_g"), "h", "r", "t")
            shared = spark.sparkContext.broadcast(rel)

            def run(key, triples: pd.DataFrame, entities: pd.DataFrame) -> pd.DataFrame:
                return _train_part(triples[["h", "r", "t"]], cfg, epochs, {"e": entities, "r": shared.value})

            out = own.groupBy("_g").cogroup(ent.withColumn("_g", of[part("name")]).groupBy("_g")).applyInPandas(run, _OUT)
            out = stored(out, "kg-round")
            new = out.where("kind = 'r'").select("name", F.posexplode(F.arrays_zip("re", "im", "seen")).alias("i", "x"))
            new = new.groupBy("name", "i").agg(*[F.avg(f"x.{c}").alias(c) for c in ("re", "im", "seen")])
            got = new.groupBy("name").agg(*[F.sort_array(F.collect_list(F.struct("i", F.col(c).alias("x")))).getField("x").alias(c) for c in ("re", "im", "seen")]).toPandas()
            if rotate:  # back on the unit circle
                x = _complex(got.re, got.im)
                x /= np.maximum(np.abs(x), 1e-12)
                got["re"], got["im"] = list(x.real), list(x.imag)
            rel = got.assign(kind="r")
            shared.destroy()
            forget(ent)
            ent = stored(out.where("kind = 'e'"), "kg-entities")
            forget(out)
    forget(t)
    return ent.unionByName(spark.createDataFrame([("r", x.name, list(map(float, x.re)), list(map(float, x.im)), list(map(float, x.seen))) for x in rel.itertuples(index=False)], _OUT))


def train(triples: DataFrame, cfg: Config = DEFAULT, triples_per_task: int = TRIPLES_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(entities: entity, re, im; relations: relation, re, im), stored; three triples at least are needed. ``cfg.kg_model``: rotate or complex."""
    if cfg.kg_model not in ("rotate", "complex"):
        raise ValueError(f"no model {cfg.kg_model!r}")
    t = triples.where("h <> '' and r <> '' and t <> ''").distinct()
    n = t.count()
    if n < 3:
        raise ValueError("three triples at least are needed")
    if n <= triples_per_task:
        out = t.select("h", "r", "t", F.lit(1).alias("_g")).groupBy("_g").applyInPandas(lambda pdf: _train_part(pdf[["h", "r", "t"]], cfg, cfg.kg_epochs), _OUT)  # a checked number of rows
    else:
        out = _train_in_parts(t, n, cfg, triples_per_task)
    out = stored(out.drop("seen"), "kg-vectors")
    return tuple(out.where(F.col("kind") == k).select(F.col("name").alias(name), "re", "im") for k, name in (("e", "entity"), ("r", "relation")))


def magnitudes(entities: DataFrame) -> DataFrame:
    """(entity, embedding): absolute values of the complex coordinates."""
    return entities.select("entity", F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b)).alias("embedding"))


def similar_entities(embeddings: DataFrame, wanted: list[str], k: int = 5) -> DataFrame:
    """(entity, other, similarity, rank): the k most similar entities to each of a stated list, by cosine; unknown names give no row."""
    q = F.broadcast(embeddings.where(F.col("entity").isin(wanted)).select(F.col("entity"), F.col("embedding").alias("_q")))  # the stated list
    pairs = embeddings.select(F.col("entity").alias("other"), "embedding").join(q, F.col("entity") != F.col("other"))
    s = pairs.select("entity", "other", cosine(F.col("_q"), F.col("embedding")).alias("similarity"))
    w = Window.partitionBy("entity").orderBy(F.desc("similarity"), "other")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, dims: int = 64) -> DataFrame:
    """(vec_id, other, similarity): the exact k nearest of each query vector among all vectors, by blocked matrix products.

    queries is a stated set and is broadcast in blocks of rows; each block keeps k candidates per query before the final ranking,
    so the shuffle carries k rows per query and task.
    """
    rows = queries.select("vec_id", "embedding").orderBy("vec_id").collect()
    spark = vectors.sparkSession
    schema = "vec_id long, other long, similarity double"
    if not rows:
        return spark.createDataFrame([], schema)
    qid = np.array([r["vec_id"] for r in rows])
    q = np.array([r["embedding"] for r in rows], dtype=np.float64)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((qid, q))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = shared.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b.embedding.to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            s = m @ x.T
            other = b.vec_id.to_numpy()
            s[ids[:, None] == other[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(other, s.shape), -np.round(s, 12)), axis=1)[:, :k]
            got = np.take_along_axis(s, order, axis=1)
            keep = np.isfinite(got)
            yield pd.DataFrame({"vec_id": np.repeat(ids, order.shape[1])[keep.ravel()], "other": other[order].ravel()[keep.ravel()], "similarity": got.ravel()[keep.ravel()]})

    found = vectors.select("vec_id", "embedding").mapInPandas(best, schema)
    w = Window.partitionBy("vec_id").orderBy(F.desc(F.round("similarity", 12)), "other")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _blocked(df: DataFrame, key: str, rows: int, name: str) -> tuple[DataFrame, int]:
    """(block, rows): about ``rows`` rows a block, by a hash of the key; and the number of blocks."""
    n = max(1, -(-df.count() // rows))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(f"{name}_block")).agg(F.collect_list(F.struct(*df.columns)).alias(name)), n


def _against_all(entities: DataFrame, asked: DataFrame, step, schema: str) -> DataFrame:
    """``step`` (asked rows, entity rows) of each block of asked rows with each block of entities; blocks travel, single pairs don't exist."""
    e, n = _blocked(entities, "entity", _ENTITIES, "e")
    a, _ = _blocked(asked.withColumn("_k", F.concat_ws("\u0001", *[c for c, k in asked.dtypes if k == "string"])), "_k", _ASKED, "a")
    pairs = a.withColumn("e_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(e, "e_block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, e in zip(batch.a, batch.e):
                yield step(pd.DataFrame(list(a)), pd.DataFrame(list(e)))

    return pairs.select("a", "e").mapInPandas(run, schema)


def _with_vectors(asked: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Asked rows (h, r, ...) with the vectors of head and relation; unknown names drop out."""
    e = entities.select(F.col("entity").alias("h"), F.col("re").alias("h_re"), F.col("im").alias("h_im"))
    return asked.join(e, "h").join(relations.select(F.col("relation").alias("r"), F.col("re").alias("r_re"), F.col("im").alias("r_im")), "r")


def link_scores(entities: DataFrame, relations: DataFrame, heads: DataFrame, k: int = 10, cfg: Config = DEFAULT, over_all: bool = False) -> DataFrame:
    """(h, r, t, score): the k best tails of each asked (h, r); over_all: the k best of all."""
    rotate = cfg.kg_model == "rotate"

    def step(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("entity")
        s = scores(_complex(a.h_re, a.h_im), _complex(a.r_re, a.r_im), _complex(e.re, e.im), rotate)
        if over_all:
            row, col = np.unravel_index(np.argsort(-s, axis=None, kind="stable")[:k], s.shape)
        else:
            col = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row, col = np.repeat(np.arange(len(a)), col.shape[1]), col.ravel()
        return pd.DataFrame({"h": a.h.to_numpy()[row], "r": a.r.to_numpy()[row], "t": e.entity.to_numpy()[col], "score": s[row, col]})

    found = _against_all(entities, _with_vectors(heads.select("h", "r").distinct(), entities, relations), step, "h string, r string, t string, score double")
    if over_all:
        return found.orderBy(F.desc("score"), "h", "r", "t").limit(k)
    w = Window.partitionBy("h", "r").orderBy(F.desc("score"), "t")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def predict_links(entities: DataFrame, relations: DataFrame, triples: DataFrame, k: int = 10, cfg: Config = DEFAULT) -> DataFrame:
    """The k best triples over all heads, relations and tails (a top-k report); known ones are marked."""
    asked = relations.agg(F.collect_list("relation").alias("r"))  # one row: the relation inventory
    heads = entities.select(F.col("entity").alias("h")).crossJoin(F.broadcast(asked)).select("h", F.explode("r").alias("r"))
    best = link_scores(entities, relations, heads, k, cfg, over_all=True)
    known = triples.select("h", "r", "t").distinct().withColumn("known", F.lit(True))
    return best.join(known, ["h", "r", "t"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def hits_at(entities: DataFrame, relations: DataFrame, test: DataFrame, k: int = 10, cfg: Config = DEFAULT) -> float | None:
    """Share of held-out triples whose tail, or head, ranks among the first k (ties count half); None without any."""
    rotate = cfg.kg_model == "rotate"
    tails = entities.select(F.col("entity").alias("t"), F.col("re").alias("t_re"), F.col("im").alias("t_im"))
    asked = _with_vectors(test.select("h", "r", "t"), entities, relations).join(tails, "t")
    asked = asked.withColumn("id", F.monotonically_increasing_id().cast("string"))
    asked = stored(asked, "kg-asked")

    def step(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        h, r, t, x = _complex(a.h_re, a.h_im), _complex(a.r_re, a.r_im), _complex(a.t_re, a.t_im), _complex(e.re, e.im)
        if rotate:
            own = -np.abs(h * r - t).sum(axis=1)
            of_tail, of_head = scores(h, r, x, True), -np.stack([np.abs(x * b - c).sum(axis=1) for b, c in zip(r, t)])
        else:
            own = np.real((h * r * np.conj(t)).sum(axis=1))
            of_tail, of_head = scores(h, r, x, False), np.real((r * np.conj(t)) @ x.T)
        more = {f"{n}_{c}": op(s, own[:, None]).sum(axis=1) for n, s in (("t", of_tail), ("h", of_head)) for c, op in (("over", lambda s, o: s > o + 1e-12), ("same", lambda s, o: np.abs(s - o) <= 1e-12))}
        return pd.DataFrame({"id": a.id, **more})

    n = _against_all(entities, asked, step, "id string, t_over long, t_same long, h_over long, h_same long").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("t_over", "t_same", "h_over", "h_same")])
    hit = lambda s: (F.col(f"{s}_over") + (F.col(f"{s}_same") + 1) / 2 <= k).cast("int")
    return n.agg(F.avg((hit("t") + hit("h")) / 2)).first()[0]
