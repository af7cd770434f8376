"""Approximate nearest neighbours by learned partitions.

A bounded sample gives a neighbour graph, which is cut into balanced parts (spectral bisection, then
swaps that lower the cut). A small network learns to tell, from a vector, in which parts its neighbours
lie; it assigns every vector to its most probable part and sends each query to parts in order of
probability until their mass reaches a level calibrated on the sample. Candidates there are reranked by
the exact distance. Equal vectors are indexed once with their smallest ids, as no answer needs more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import stored

#: Vectors that shape the partitions; vectors a part aims at; most parts; vectors of one rerank task.
SAMPLE, PART, MAX_PARTS, CHUNK, QUERIES = 5000, 1500, 256, 20_000, 4096
#: Neighbours in the graph and the recall asked for on the sample.
GRAPH_K, TARGET = 10, 0.96


def usable(vec: Column) -> Column:
    """Not null or zero, every component present and finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def nearest(x: np.ndarray, y: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Positions in ``y`` of the ``k`` nearest to each row of ``x``, in blocks."""
    out, sq = [], (y * y).sum(axis=1)
    for i in range(0, len(x), 1024):
        d = sq - 2 * (x[i:i + 1024] @ y.T)
        if skip_self:
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def bisect(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which half each of ``nodes`` falls in: the median of a smooth function on their graph (a, b)."""
    n = len(nodes)
    at = np.full(len(x), -1)
    at[nodes] = np.arange(n)
    inside = (at[a] >= 0) & (at[b] >= 0)
    p, q = at[a[inside]], at[b[inside]]
    deg = np.maximum(np.bincount(p, minlength=n), 1)
    own = x[nodes] - x[nodes].mean(axis=0)
    f = own @ np.linalg.svd(own, full_matrices=False)[2][0]
    for _ in range(60):
        f = (f + np.bincount(p, f[q], minlength=n) / deg) / 2
        f -= (f * deg).sum() / deg.sum()
        f /= np.abs(f).max() or 1
    half = np.zeros(n, bool)
    half[np.argsort(f, kind="stable")[n // 2:]] = True
    return half


def balanced_parts(x: np.ndarray, nbr: np.ndarray, levels: int, passes: int = 4) -> np.ndarray:
    """``2^levels`` parts of equal size that cut few edges of the neighbour graph."""
    n, k = nbr.shape
    a, b = np.repeat(np.arange(n), k), nbr.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        nxt = part * 2
        for c in np.unique(part):
            nodes = np.flatnonzero(part == c)
            if len(nodes) > 1:
                nxt[nodes] += bisect(nodes, a, b, x)
        part = nxt
    parts = 1 << levels
    for _ in range(passes if parts > 1 else 0):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (a, part[b]), 1)
        own = votes[np.arange(n), part]
        votes[np.arange(n), part] = -1
        to = votes.argmax(axis=1)
        gain = votes[np.arange(n), to] - own
        want = np.flatnonzero(gain > 0)
        want = want[np.argsort(-gain[want], kind="stable")]
        old = part.copy()
        for i in range(parts):  # swap equal numbers each way, so sizes stay
            for j in range(i):
                ij, ji = (want[(old[want] == s) & (to[want] == t)] for s, t in ((i, j), (j, i)))
                m = min(len(ij), len(ji))
                part[ij[:m]], part[ji[:m]] = j, i
    return part


class Router:
    """One hidden layer; softmax over parts, trained on the shares of a vector's neighbours in them."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 15, seed: int = 3):
        rng, (n, d), p = np.random.default_rng(seed), x.shape, target.shape[1]
        self.mean, self.scale = x.mean(axis=0), x.std() or 1.0
        z = ((x - self.mean) / self.scale).astype(np.float32)
        self.w = [rng.normal(0, d ** -0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, (hidden, p)), np.zeros(p)]
        self.w = [v.astype(np.float32) for v in self.w]
        m, s, t = [np.zeros_like(v) for v in self.w], [np.zeros_like(v) for v in self.w], 0
        for e in range(epochs):
            rate = 3e-3 * (1 - e / epochs) + 1e-4
            for i in np.array_split(rng.permutation(n), max(1, n // 128)):
                h = np.maximum(z[i] @ self.w[0] + self.w[1], 0)
                g = (self._soft(h @ self.w[2] + self.w[3]) - target[i]) / len(i)
                gh = (g @ self.w[2].T) * (h > 0)
                grads, t = [z[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], t + 1
                for v, dv, mv, sv in zip(self.w, grads, m, s):
                    mv += 0.1 * (dv - mv)
                    sv += 0.001 * (dv * dv - sv)
                    v -= rate * (mv / (1 - 0.9 ** t)) / (np.sqrt(sv / (1 - 0.999 ** t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def proba(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).astype(np.float32)
        return self._soft(np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def probes(p: np.ndarray, mass: float, sizes: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
    """Parts per query, most probable first, until ``mass`` is reached and they hold ``least`` rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    cum = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
    n = (cum < mass).sum(axis=1) + 1
    if sizes is not None:
        n = np.maximum(n, (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1)
    return [o[:i] for o, i in zip(order, np.minimum(n, p.shape[1]))]


class Partitioner:
    """The learned partitions: part of a vector, and parts to probe for a query."""

    def __init__(self, sample: np.ndarray, n: int, target: float = TARGET):
        levels = max(0, min(MAX_PARTS, n // PART, len(sample) // 16).bit_length() - 1)
        self.parts, self.router, self.mass = 1 << levels, None, 1.0
        if not levels:
            return
        x = sample.astype(np.float64)
        x = x - x.mean(axis=0)
        nbr = nearest(x, x, min(GRAPH_K, len(x) - 1), skip_self=True)
        part = balanced_parts(x, nbr, levels)
        share = np.zeros((len(x), self.parts), np.float32)
        np.add.at(share, (np.repeat(np.arange(len(x)), nbr.shape[1]), part[nbr].ravel()), 1 / nbr.shape[1])
        share = 0.9 * share + 0.1 * np.eye(self.parts, dtype=np.float32)[part]
        # calibrate on vectors that the router has not seen, then learn from all
        held = np.arange(len(x)) % 5 == 0
        p = Router(sample[~held], share[~held]).proba(sample)
        at = p.argmax(axis=1)[nbr[held]]
        for self.mass in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 0.9999):
            got = [np.isin(a, o).mean() for a, o in zip(at, probes(p[held], self.mass))]
            if np.mean(got) >= target:
                break
        self.router = Router(sample, share)

    def proba(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), 1)) if self.router is None else self.router.proba(x)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 1)


def search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest rows to each query row, itself excluded.

    ``is_query`` is a condition on ``df``. Distances are Euclidean in double precision on the original
    vectors; ties go to the smaller id; queries with fewer than ``k`` other rows get all of them. Rows with
    a null id, or whose vector is null, empty, zero, has null or non-finite components or another length
    than most rows, take no part. Rows that repeat id and vector count once; one id with several vectors is
    several rows, and its first vector is the query. An empty table gives no rows; other columns are
    ignored. The sample that shapes the partitions is bounded by SAMPLE; every row is indexed.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    if sizes is None:
        return empty
    rows = rows.filter(F.size("v") == sizes["d"]).groupBy("id", "v").agg(F.max("q").alias("q"))
    queries = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    # a vector's k + 1 smallest ids answer every query, so equal vectors never gather in one place
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    points = stored(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n = points.count()
    sample = points.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    model = Partitioner(_matrix(sample), n)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            part = shared.value.proba(_matrix(b.column(0))).argmax(axis=1) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32), pa.int32())], ["v", "ids", "part"])

    points = stored(points.mapInArrow(assign, "v array<double>, ids array<long>, part int"), "parts")
    # at most MAX_PARTS rows
    held = {r["part"]: r for r in points.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    ids = np.array([held[p]["ids"] if p in held else 0 for p in range(model.parts)])
    salts = F.array(*[F.lit(-(-held[p]["n"] // CHUNK) if p in held else 0) for p in range(model.parts)])

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            to = probes(shared.value.proba(_matrix(b.column(1))), shared.value.mass, ids, k + 2) if len(b) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t.tolist() for t in to], pa.list_(pa.int32()))], ["id", "v", "to"])

    points = points.withColumn("salt", F.pmod(F.xxhash64("v"), salts[F.col("part")]).cast("int"))
    asked = stored(queries.select("id", "v").mapInArrow(route, "id long, v array<double>, to array<int>"), "routed")
    # both sides of a group are bounded: a chunk of a part's vectors meets the part's queries block by block
    load = {r["part"]: r["count"] for r in asked.select(F.explode("to").alias("part")).groupBy("part").count().collect()}
    blocks = F.array(*[F.lit(-(-load.get(p, 0) // QUERIES)) for p in range(model.parts)])
    asked = asked.select("id", "v", F.explode("to").alias("part")).withColumn("block", F.pmod(F.xxhash64("id"), blocks[F.col("part")]).cast("int"))
    asked = asked.withColumn("salt", F.explode(F.when(salts[F.col("part")] > 0, F.sequence(F.lit(0), salts[F.col("part")] - 1))))
    points = points.filter(blocks[F.col("part")] > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)))

    def rerank(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            y = np.array(c["v"].tolist(), np.float64)
            for qid, v in zip(q["id"], q["v"]):
                d = np.sqrt(((y - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                m = min(k + 1, len(d))
                near = np.flatnonzero(d <= np.partition(d, m - 1)[m - 1])
                got = sorted((d[i], i2) for i in near for i2 in c["ids"].iat[i] if i2 != qid)
                out += [(qid, i2, s) for s, i2 in got[:k]]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    found = asked.groupBy("part", "salt", "block").cogroup(points.groupBy("part", "salt", "block")).applyInPandas(
        rerank, "query_id long, id long, score double")
    # an id may have several vectors, and a query's probes never share a vector
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")
