"""Boosted rankers trained on Spark: one list of items per user, a ranking loss, splits from summed gradients.

A user's rows become one array after a single shuffle. The pairwise loss is ``log(1 + exp(s_neg - s_pos))`` over all pairs
of a positive and a negative row of the user, so its gradients need no join; the pointwise loss is the usual log loss.

Features are cut into bins, and rows with equal bins share a cell, of which there are at most CELLS. A tree tells cells
apart and nothing finer, so a model in training is one score per cell, and a round is one pass over the lists: each task
sums its users' gradients by cell, Spark adds the tasks' sums, and the driver grows the tree on that bounded table.
Gradients are summed as whole numbers, so trees do not depend on partitions.

Rounds go on from the scores reached so far, nothing is fitted twice: after each block of rounds one pass gives every
validation user's NDCG after each of them, and training ends when ``patience`` rounds bring no better one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.treemodel import Tree, TreeModel, feature_value
from basketry.session import ensure_checkpoint_dir

#: Gradients are summed in this unit; the most cells.
UNIT, CELLS = 2.0 ** -24, 1 << 18


@dataclass(frozen=True)
class Params:
    objective: str = "pairwise"  # or pointwise
    rounds: int = 500
    patience: int = 30
    depth: int = 4
    rate: float = 0.1
    l2: float = 1.0
    least_rows: int = 20
    bins: int = 32
    block: int = 10
    at: int = 10


# ---------------------------------------------------------------- lists of cells

def bin_edges(ds: DataFrame, features: list[str], bins: int, cells: int = CELLS) -> list[list[float]]:
    """Cut points of each feature: quantiles (``percentile_approx``) without the largest value, as many as keep the number of
    cells in bounds. Nulls and NaN count as 0, as in scoring."""
    x = {c: feature_value(F.col(c)) for c in features}
    q = [i / bins for i in range(1, bins)]
    row = ds.agg(*[F.percentile_approx(v, q, 10_000).alias(f"q_{c}") for c, v in x.items()], *[F.max(v).alias(f"m_{c}") for c, v in x.items()]).first()
    edges = [sorted(v for v in set(row[f"q_{c}"] or []) if v < row[f"m_{c}"]) for c in features]
    while prod(len(e) + 1 for e in edges) > cells:  # every second cut of the finest feature goes
        i = max(range(len(edges)), key=lambda j: len(edges[j]))
        edges[i] = edges[i][1::2]
    return edges


def user_lists(ds: DataFrame, split: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """(split, cells, labels) of each user, items in the order in which equal scores rank; stored once."""
    cell = F.lit(0)
    for c, e in zip(features, edges):
        x = feature_value(F.col(c))
        cell = cell * (len(e) + 1) + sum([(x > v).cast("int") for v in e], F.lit(0))
    label = F.col("label").cast("int")
    items = ds.select("customer_id", F.struct("article_id", (-label).alias("no"), cell.alias("cell")).alias("x"))
    lists = items.groupBy("customer_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.join(split.select("customer_id", "split"), "customer_id").select(
        "split", F.transform("x", lambda i: i["cell"]).alias("cells"), F.transform("x", lambda i: -i["no"]).alias("labels")).checkpoint(eager=True)


def _users(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and labels of each user."""
    for b in batches:
        cells, labels = b.column("cells"), b.column("labels")
        c, y, cut = cells.flatten().to_numpy(), labels.flatten().to_numpy(), cells.value_lengths().to_numpy().cumsum()
        for lo, hi in zip([0, *cut[:-1]], cut):
            yield c[lo:hi], y[lo:hi]


def pairwise(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope towards a lower loss, and curvature, of the pairwise loss of one user."""
    g, h, pos = np.zeros(len(s)), np.zeros(len(s)), y == 1
    p = 1.0 / (1.0 + np.exp(s[pos][:, None] - s[~pos][None, :]))
    q = p * (1.0 - p)
    g[pos], g[~pos], h[pos], h[~pos] = p.sum(axis=1), -p.sum(axis=0), q.sum(axis=1), q.sum(axis=0)
    return g, h


def pointwise(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-s))
    return y - p, p * (1.0 - p)


LOSSES = {"pairwise": pairwise, "pointwise": pointwise}


def ndcg(s: np.ndarray, y: np.ndarray, k: int) -> float:
    """NDCG of labels 0 and 1 ranked by score, equal scores in the order given; 0 without a positive."""
    discount = 1.0 / np.log2(np.arange(2, k + 2))
    top = y[np.argsort(-s, kind="stable")[:k]]
    n = min(int(y.sum()), k)
    return float((top * discount[:len(top)]).sum() / discount[:n].sum()) if n else 0.0


def gradients(lists: DataFrame, scores: np.ndarray, objective: str) -> np.ndarray:
    """(cell, slope, curvature, rows) summed over all lists, the sums in UNITs."""
    loss, shared = LOSSES[objective], lists.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        total = np.zeros((3, len(s)), np.int64)
        for cells, y in _users(batches):
            g, h = loss(s[cells], y)
            np.add.at(total[0], cells, np.rint(g / UNIT).astype(np.int64))
            np.add.at(total[1], cells, np.rint(h / UNIT).astype(np.int64))
            np.add.at(total[2], cells, 1)
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(t[at]) for t in total)], ["cell", "g", "h", "n"])

    part = lists.select("cells", "labels").mapInArrow(run, "cell long, g long, h long, n long")
    rows = part.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow().sort_by("cell")
    shared.destroy()
    return np.stack([c.to_numpy() for c in rows.columns], axis=1)


def mean_ndcg(lists: DataFrame, stages: np.ndarray, k: int) -> list[float]:
    """Mean NDCG of all lists under each row of ``stages`` (scores by cell), in one pass; empty without lists."""
    shared = lists.sparkSession.sparkContext.broadcast(stages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, total, n = shared.value, np.zeros(len(shared.value)), 0
        for cells, y in _users(batches):
            total += [ndcg(x, y, k) for x in s[:, cells]]
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s))), pa.array(np.rint(total / UNIT).astype(np.int64)), pa.array(np.full(len(s), n))],
                                         ["stage", "total", "n"])

    part = lists.select("cells", "labels").mapInArrow(run, "stage long, total long, n long")
    rows = sorted(map(tuple, part.groupBy("stage").agg(F.sum("total"), F.sum("n")).collect()))
    shared.destroy()
    return [t * UNIT / n for _, t, n in rows if n]


# ---------------------------------------------------------------- trees on cells

def grow(bins: np.ndarray, sums: np.ndarray, p: Params) -> tuple[Tree, np.ndarray]:
    """A tree on cells: ``bins`` (cell, feature) and ``sums`` (slope, curvature, rows) of the cells that have rows. Returns it,
    with bins for thresholds, and the value of each of these cells."""
    split, threshold, left, right, gain, leaves, value = [], [], [], [], [], [], np.zeros(len(bins))

    def node(at: np.ndarray, depth: int) -> int:
        best = _best_split(bins[at], sums[at], p) if depth else None
        if best is None:
            g, h, _ = sums[at].sum(axis=0)
            value[at] = p.rate * (g * UNIT) / (h * UNIT + p.l2)
            leaves.append(float(value[at][0]) if len(at) else 0.0)
            return ~(len(leaves) - 1)
        f, b, won = best
        i = len(split)
        for column, x in ((split, f), (threshold, float(b)), (left, 0), (right, 0), (gain, won)):
            column.append(x)
        low = bins[at, f] <= b
        left[i], right[i] = node(at[low], depth - 1), node(at[~low], depth - 1)
        return i

    node(np.arange(len(bins)), p.depth)
    return Tree(split, threshold, left, right, leaves, gain), value


def _best_split(bins: np.ndarray, sums: np.ndarray, p: Params) -> tuple[int, int, float] | None:
    """(feature, bin, gain) with the largest gain, ties to the first; None if no split gains."""
    score = lambda g, h: (g * UNIT) ** 2 / (h * UNIT + p.l2)
    best, whole = None, score(*sums[:, :2].sum(axis=0))
    for f in range(bins.shape[1]):
        by_bin = np.zeros((int(bins[:, f].max(initial=0)) + 1, 3), np.int64)
        np.add.at(by_bin, bins[:, f], sums)
        low = by_bin.cumsum(axis=0)[:-1]
        high = by_bin.sum(axis=0) - low
        won = score(low[:, 0], low[:, 1]) + score(high[:, 0], high[:, 1]) - whole
        won[(low[:, 2] < p.least_rows) | (high[:, 2] < p.least_rows)] = -np.inf
        if len(won) and won.max() > max(1e-9, best[2] if best else 0.0):
            best = f, int(won.argmax()), float(won.max())
    return best


@dataclass
class Booster:
    """A model in training: its trees, the score of each cell, and NDCG on the validation users after each round."""

    features: list[str]
    edges: list[list[float]]
    lists: DataFrame
    params: Params
    trees: list[Tree] = field(default_factory=list)
    ndcg: list[float] = field(default_factory=list)
    done: bool = False

    def __post_init__(self):
        self.shape = [len(e) + 1 for e in self.edges]
        self.scores = np.zeros(prod(self.shape))
        self.bins = np.stack(np.unravel_index(np.arange(len(self.scores)), self.shape), axis=1)

    def best_round(self) -> int:
        """Rounds up to the best NDCG (the first such); all of them without validation users."""
        return 1 + max(range(len(self.ndcg)), key=lambda i: (self.ndcg[i], -i)) if self.ndcg else len(self.trees)

    def model(self) -> TreeModel:
        return TreeModel(self.features, self.trees[:self.best_round()])

    def best(self) -> float | None:
        return max(self.ndcg, default=None)

    def train(self, rounds: int) -> "Booster":
        """Up to ``rounds`` more rounds."""
        p, end = self.params, min(len(self.trees) + rounds, self.params.rounds)
        learn, check = (self.lists.filter(F.col("split") == s) for s in ("train", "val"))
        while len(self.trees) < end and not self.done:
            stages = []
            for _ in range(min(p.block, end - len(self.trees))):
                sums = gradients(learn, self.scores, p.objective)
                tree, _ = grow(self.bins[sums[:, 0]], sums[:, 1:], p)
                real = [self.edges[f][int(b)] for f, b in zip(tree.split_feature, tree.threshold)]
                self.scores = self.scores + _value(tree, self.bins)
                self.trees.append(replace(tree, threshold=real))
                stages.append(self.scores)
            self.ndcg += mean_ndcg(check, np.array(stages), p.at)
            self.done = len(self.trees) >= p.rounds or bool(self.ndcg) and len(self.trees) - self.best_round() >= p.patience
        return self


def _value(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The tree's value for every cell, also those without training rows."""
    out = np.empty(len(bins))
    todo = [(0 if tree.split_feature else ~0, np.arange(len(bins)))]
    while todo:
        i, at = todo.pop()
        if i < 0:
            out[at] = tree.leaf_value[~i]
        else:
            low = bins[at, tree.split_feature[i]] <= tree.threshold[i]
            todo += [(tree.left_child[i], at[low]), (tree.right_child[i], at[~low])]
    return out


# ---------------------------------------------------------------- entry points

def prepared(ds: DataFrame, split: DataFrame, features: list[str], bins: int) -> tuple[list[list[float]], DataFrame]:
    """Cut points from the training users, and the lists of all users."""
    ensure_checkpoint_dir(ds.sparkSession)
    learn = ds.join(split.filter("split = 'train'").select("customer_id"), "customer_id", "left_semi")
    edges = bin_edges(learn, features, bins)
    return edges, user_lists(ds, split, features, edges)


def boost(ds: DataFrame, split: DataFrame, features: list[str], params: Params = Params()) -> Booster:
    """Train a ranker on the users whose ``split`` is train, stopped early on those whose ``split`` is val."""
    return Booster(features, *prepared(ds, split, features, params.bins), params).train(params.rounds)


def successive_halving(ds: DataFrame, split: DataFrame, features: list[str], grid: dict[str, list], rounds: int = 10,
                       base: Params = Params()) -> list[tuple[dict, Booster]]:
    """Every grid point trains ``rounds`` rounds, the better half goes on to twice as many, and so on to the last one.

    All points share one table of lists, and a point that goes on continues from its own scores: ``n`` points take at most
    ``rounds * n * (1 + log2(n) / 2)`` rounds in all. Returns the points, the last one standing first, then by NDCG."""
    edges, lists = prepared(ds, split, features, base.bins)
    keys = sorted(grid)
    points = [dict(zip(keys, v)) for v in product(*[grid[k] for k in keys])]
    every = [(p, Booster(features, edges, lists, replace(base, **p))) for p in points]
    order = lambda x: (-(x[1].best() or 0.0), points.index(x[0]))
    alive, total = every, rounds
    while True:
        for _, b in alive:
            b.train(total - len(b.trees))
        if len(alive) == 1:
            return sorted(every, key=lambda x: (x[0] is not alive[0][0], *order(x)))
        alive, total = sorted(alive, key=order)[:(len(alive) + 1) // 2], 2 * total
