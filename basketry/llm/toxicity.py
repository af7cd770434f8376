"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a text's distinct words, word pairs and pairs with one or two words skipped, hashed to
2^18 places. Per-coordinate rates and L1 leave few weights, which are broadcast as index and value.
"""

from __future__ import annotations

from math import log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored, utf8

BITS = 18
#: Bounds of the training sample: rows of each class, and the bytes of all its feature lists together (a list has
#: at most 4 x 2^18 bytes, however long the text).
POSITIVES, NEGATIVES, SAMPLE_BYTES = 3000, 6000, 256 << 20
#: Strengths of the L1 penalty, of which held-out rows of the sample choose one.
PENALTIES = (0.5, 1.0, 2.0, 4.0, 8.0)
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def grams(text: bytes) -> np.ndarray:
    """Hashed words, pairs and skip pairs of the whole text, repeats included."""
    words = text.translate(_CLEAN).split()
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap in (1, 2, 3):
        parts.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F) + h[gap:] + np.uint64(gap)) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal logistic regression on binary features with an unpenalised bias."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Indices and values of the nonzero weights, and the bias."""
        w = self.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def train(data: list[tuple[np.ndarray, int]], l1: float, epochs: int, seed: int) -> Ftrl:
    """The model after ``epochs`` passes over (feature indices, label) rows, each in an order of its own."""
    model, rng = Ftrl(l1=l1), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            model.learn(*data[i])
    return model


def log_loss(model: Ftrl, data: list[tuple[np.ndarray, int]]) -> float:
    """Summed log loss of the labels."""
    at, w, bias = model.sparse()
    dense = np.zeros(1 << BITS)
    dense[at] = w
    s = np.array([bias + dense[x].sum() for x, _ in data])
    return float(np.logaddexp(0, np.where([y == 1 for _, y in data], -s, s)).sum())


def choose_penalty(data: list[tuple[np.ndarray, int]], seed: int) -> float:
    """The penalty with the least log loss on every fifth row after two passes over the others (ties: the largest)."""
    rest = [d for i, d in enumerate(data) if i % 5]
    return min(sorted(PENALTIES, reverse=True), key=lambda l1: log_loss(train(rest, l1, 2, seed), data[::5]))


def sample(df: DataFrame, one: DataFrame, text_col: str, id_col: str) -> list[tuple[np.ndarray, int]]:
    """(feature indices, label) of the bounded sample in the order of the hash ``o``, whole texts of any length.

    Feature lists are made where the texts are and stored; the driver reads their sizes (a bounded number of
    rows), cuts the order where SAMPLE_BYTES is reached, and fetches the lists before the cut part by part. Of rows with one id the longest, then greatest list counts."""
    pick = stored(one.filter("label = 1").orderBy("o").limit(POSITIVES).unionAll(
        one.filter("label <> 1").orderBy("o").limit(NEGATIVES)), "toxic-sample")
    rows = df.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))

    def vectors(it):
        for b in it:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                x = pa.array([np.unique(grams(t)).tobytes() for t in part.column(0).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([x, part.column(1), part.column(2)], ["x", "label", "o"])

    # the sample is bounded by POSITIVES + NEGATIVES rows
    got = rows.join(F.broadcast(pick), "id").select("text", "label", "o").mapInArrow(vectors, "x binary, label int, o long")
    # rows that repeat an id meet before the shuffle
    best = got.groupBy("o").agg(F.max(F.struct(F.octet_length("x").alias("n"), "x", "label")).alias("v"))
    kept = stored(best.select("o", "v.n", "v.x", "v.label"), "toxic-vectors")
    sizes = kept.select("o", "n").orderBy("o").collect()
    if not sizes:
        return []
    end = int(np.searchsorted(np.cumsum([r.n for r in sizes]), SAMPLE_BYTES, side="right"))
    some = kept.filter(F.col("o") <= sizes[max(end, 1) - 1].o)
    data = {r.o: (np.frombuffer(r.x, np.int32), r.label) for r in some.toLocalIterator()}
    return [data[o] for o in sorted(data)]


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, epochs: int = 5, seed: int = 5):
    """Sparse weights learned from a bounded sample of labelled rows, or None without labels of both classes.

    ``labels`` (id, label: 1 or 0; null ids and labels are ignored; of several labels the largest counts).
    Null and empty texts train with no features, texts of any length with all of theirs; of rows that repeat an
    id that with the most features counts. The penalty is chosen on held-out rows of the sample. The classes are
    sampled apart, so the bias is moved by the logit of their rate among all labels less that in the sample: a
    score is the probability at the labels' own rate, whatever the size of the table.
    """
    one = labels.filter("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    one = one.withColumn("o", F.xxhash64("id", F.lit(seed)))
    ones, zeros = one.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    data = sample(df, one, text_col, id_col)
    taken = sum(y == 1 for _, y in data)
    if taken in (0, len(data)):
        return None
    at, w, bias = train(data, choose_penalty(data, seed), epochs, seed).sparse()
    return at, w, bias + log(ones / zeros) - log(taken / (len(data) - taken))


def score_column(df: DataFrame, text_col: str, weights) -> Column:
    """Column of scores in 0 to 1; null and empty texts have that of no words; 0 without a model."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series(np.zeros(len(texts)))
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w

        def one(text: bytes) -> float:
            g = grams(text)
            g = g[dense[g] != 0]
            return bias + float(dense[np.unique(g)].sum(dtype=np.float64)) if len(g) else bias

        s = np.fromiter(map(one, texts), np.float64, len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(s, -700, 700))))

    return score(utf8(text_col))


def score_toxicity(df: DataFrame, weights, id_col: str, text_col: str) -> DataFrame:
    """(id, score) per row; repeated rows score alike, null ids stay, an empty table gives no rows."""
    return df.select(F.col(id_col).alias("id"), score_column(df, text_col, weights).alias("score"))
