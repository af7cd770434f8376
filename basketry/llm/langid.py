"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Documents are square-rooted, L2-normalised counts of hashed byte 1- to 3-grams. Families are learned:
languages are merged by the cosine of their mean vectors (average linkage) until about the square root
of their number is left. Families, and the languages inside each, are told apart by one linear SVM per
pair (squared hinge, accelerated gradient); a logistic scale per pair turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import utf8

DIM_BITS = 12
DIM = 1 << DIM_BITS
#: Bounds of the training sample: rows in all and rows a language; every language has one at least.
SAMPLE_ROWS, PER_LANGUAGE = 4000, 600
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalpha() else c for c in range(256))


def features(text: bytes) -> np.ndarray:
    """Unit vector of the whole text's hashed byte n-grams; digits and ASCII marks count as blanks."""
    b = np.frombuffer(b" " + text.translate(_CLEAN) + b" ", np.uint8).astype(np.uint32)
    x = np.zeros(DIM, np.float32)
    g = b + 1
    for n in range(3):
        if n:
            g = g[:-1] * np.uint32(259) + b[n:] + np.uint32(1)
        h = (g * np.uint32(2654435761) + np.uint32(n * 97)) >> np.uint32(32 - DIM_BITS)
        x += np.bincount(h, minlength=DIM)[:DIM]
    x = np.sqrt(x)
    return x / np.linalg.norm(x)


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float, float]:
    """Weights, bias and logistic scale of a linear SVM for y in (-1, 1); classes weigh alike."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb, t = w.copy(), 0.0, 1.0
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 1 / (reg + 4)
    for _ in range(rounds):
        slack = c * np.maximum(0, 1 - y * (x @ vw + vb)) * y
        nw, nb = vw - step * (reg * vw - 2 * (slack @ x)), vb + step * 2 * float(slack.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    m, a = y * (x @ w + b), 1.0
    for _ in range(30):  # Newton steps for the scale, with a weak pull towards 2
        p = 1 / (1 + np.exp(a * m))
        a = float(np.clip(a + ((c * m * p).sum() - 1e-3 * (a - 2)) / ((c * m * m * p * (1 - p)).sum() + 1e-3), 0.1, 50))
    return w.astype(np.float32), float(b), a


def families(means: np.ndarray, count: int) -> list[list[int]]:
    groups = [[i] for i in range(len(means))]
    unit = means / np.linalg.norm(means, axis=1, keepdims=True)
    sim = unit @ unit.T
    while len(groups) > max(1, count):
        i, j = max(combinations(range(len(groups)), 2), key=lambda p: sim[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[i] += groups.pop(j)
    return [sorted(g) for g in groups]


class Pairwise:
    """One SVM per pair of classes; the class with the most wins is chosen, its least win is how certain it is.

    The least win is the probability against the nearest rival: 1 for a certain choice and at most 0.5 for a
    guess, whatever the number of classes."""

    def __init__(self, x: np.ndarray, y: np.ndarray, k: int):
        self.k, self.pairs = k, list(combinations(range(k), 2))
        got = []
        for i, j in self.pairs:
            at = (y == i) | (y == j)
            got.append(fit_svm(x[at], np.where(y[at] == i, 1, -1).astype(np.float32)))
        self.w = np.array([g[0] for g in got], np.float32).reshape(len(got), x.shape[1])
        self.b, self.a = np.array([g[1] for g in got]), np.array([g[2] for g in got])

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen class of each row and its certainty."""
        if self.k == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        wins, least = np.zeros((len(x), self.k)), np.ones((len(x), self.k))
        p = 1 / (1 + np.exp(-np.clip(self.a * (x @ self.w.T + self.b), -40, 40)))
        for c, (i, j) in enumerate(self.pairs):
            for k, q in ((i, p[:, c]), (j, 1 - p[:, c])):
                wins[:, k] += q
                least[:, k] = np.minimum(least[:, k], q)
        best = wins.argmax(axis=1)
        return best, least[np.arange(len(x)), best]


class LanguageModel:
    """Family classifier and, per family, its languages' classifier."""

    def __init__(self, x: np.ndarray, y: list[str]):
        self.names = sorted(set(y))
        code = np.array([self.names.index(v) for v in y])
        means = np.array([x[code == i].mean(axis=0) for i in range(len(self.names))])
        self.families = families(means, round(len(self.names) ** 0.5)) if self.names else []
        fam = np.array([next(f for f, g in enumerate(self.families) if c in g) for c in code])
        self.top = Pairwise(x, fam, len(self.families))
        self.inner = [Pairwise(x[fam == f], np.searchsorted(g, code[fam == f]), len(g)) for f, g in enumerate(self.families)]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score: the certainty of the family times that of the language inside it."""
        fam, sure = self.top.choose(x)
        lang, score = np.empty(len(x), object), np.empty(len(x))
        for f, members in enumerate(self.families):
            at = np.flatnonzero(fam == f)
            if len(at):
                best, own = self.inner[f].choose(x[at])
                lang[at] = [self.names[members[i]] for i in best]
                score[at] = sure[at] * own
        return list(lang), score


def fit(df: DataFrame, text_col: str, lang_col: str, order: Column) -> LanguageModel | None:
    """Learn from a bounded sample of the labelled rows of ``df``; None without any.

    ``order`` is a pseudo-random long that picks the sample: rows under a share of its range, then the
    first by it. SAMPLE_ROWS, dealt evenly, and PER_LANGUAGE bound the sample, but every language with a labelled text that
    has a letter is learned, from one text at least; more languages make more families, not larger ones.
    """
    rows = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        utf8(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), order.alias("o"))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return None
    per = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // len(sizes)))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, 2.0 * per / r["count"]))])
    picked = rows.filter(F.pmod("o", F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [(features(t).astype(np.float16).tobytes() if has_letter(t) else None, lang, o)
                   for t, lang, o in zip(*(c.to_pylist() for c in b.columns))]
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                                             ["x", "lang", "o"])

    got = picked.mapInArrow(vectors, "x binary, lang string, o long").filter("x IS NOT NULL")
    sample: dict[str, list] = {}
    # the shares make this about 2 * per rows a language; the window keeps just ``per`` of each
    w = Window.partitionBy("lang").orderBy("o", "x")
    first = got.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per).drop("r")
    for r in first.orderBy("o", "lang").toLocalIterator():
        if len(sample.setdefault(r["lang"], [])) < per:
            sample[r["lang"]].append(np.frombuffer(r["x"], np.float16))
    if not sample:
        return None
    return LanguageModel(np.array([v for s in sample.values() for v in s], np.float32), [k for k, s in sample.items() for _ in s])


def with_language(df: DataFrame, text_col: str, model: LanguageModel | None, out: str) -> DataFrame:
    """``df`` with a struct column ``out`` (lang, score).

    ``und`` with score 0 where the text is null, empty or has no letter, or no language was learned. All
    other columns pass untouched; equal texts get equal results; whole texts count.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        m, lang, score = shared.value, [UND] * len(texts), np.zeros(len(texts))
        at = [i for i, t in enumerate(texts) if has_letter(t)] if m is not None else []
        for i in range(0, len(at), 512):
            part = at[i:i + 512]
            got, s = m.predict(np.array([features(texts.iloc[j]) for j in part]))
            for j, v in zip(part, got):
                lang[j] = v
            score[part] = s
        return pd.DataFrame({"lang": lang, "score": score})

    return df.withColumn(out, predict(utf8(text_col)))
