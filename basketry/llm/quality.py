"""Quality rules whose cutoff comes with a bound on false rejection.

Every rule maps a document to a bin. A quarter of the labelled good documents tells how rare each bin and those above it are
among good ones; a document's risk level is that of its rarest rule. The other labelled documents are the holdout: per
stratum, cutoffs on the level are tested from the most lenient on with the exact binomial test of "more than ``risk`` of
the good documents go" (a Clopper-Pearson upper bound) until one fails. Fixed-sequence testing needs no correction inside
a stratum; over strata the error level is divided (Bonferroni), so with probability ``1 - delta`` no stratum loses more than
``risk`` of its good documents. Among the cutoffs that passed, the one is taken that rejects the most labelled bad
documents, weighed against the good ones it costs.

A test can only pass with enough good documents (``least_holdout``: 228 at a risk of 0.02, a delta of 0.05 and five
tests). Strata with fewer, or without labels, use the cutoff of all strata together, whose bound holds for the whole
table, not for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import fold, stored, utf8

BINS, MAX_STRATA, RISK, DELTA, COST = 200, 256, 0.02, 0.05, 10.0
#: One in so many labelled documents tells how rare a bin is; levels of risk per power of ten.
LEARN, SCALE = 4, 40
SYMBOLS = b"#*$%&|<>"
_SPACE = b"\x20\t\n\x0b\x0c\r"
_CONT = bytes(range(0x80, 0xC0))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found at least twice, the first find included."""
    n = len(words)
    if n < 4:
        return 0
    code = {w: i for i, w in enumerate(set(words))}
    v = len(code)
    a = np.fromiter(map(code.__getitem__, words), np.int64, n)
    pair = a[:-1] * v + a[1:]
    if v > 2_000_000:  # keep v^3 inside 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    g = pair[:-1] * v + a[2:]
    order = np.argsort(g)
    equal = g[order[1:]] == g[order[:-1]]
    if not equal.any():
        return 0
    cover = np.zeros(n, bool)
    start = np.concatenate([order[1:][equal], order[:-1][equal]])
    for i in range(3):
        cover[start + i] = True
    return int(cover.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` of one text."""
    words = text.split()
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            lines += 1
            dup += line in seen
            seen.add(line)
    size = len(text)
    return (len(words), len(text.translate(None, _SPACE + _CONT)), size - len(text.translate(None, SYMBOLS)), dup,
            repeat_words(words), lines, size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _MARKS)))


def text_counts(df: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """(id, stratum, the counts) per row; a null text is empty, a null stratum is one of its own."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = list(zip(*map(counts, b.column(2).to_pylist()))) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)],
                                             ["id", "stratum", *COUNTS])

    rows = df.select(F.col(id_col).alias("id"),
                     F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"),
                     utf8(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def rule_bins() -> dict[str, Column]:
    """Every rule's bin, 0 (best) to BINS; the worse the document, the higher."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    mean = F.col("word_chars") / words
    score = {
        "long_words": mean / 50.0, "short_words": F.greatest(F.lit(0.0), 1 - mean / 10.0),
        "symbols": F.col("n_symbols") / words, "upper": F.col("n_upper") / chars, "marks": F.col("n_marks") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / words,
    }
    return {k: F.least(F.floor(v * BINS), F.lit(BINS)).cast("int") for k, v in score.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly up to floating point."""
    if k >= n:
        return 1.0
    i = np.arange(0, k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    return float(min(1.0, np.exp(logs + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float, cost: float = COST) -> int:
    """Cutoff bin for counts per bin (0..BINS) of good and bad holdout documents; BINS + 1 rejects none."""
    n, n_bad, best, cut = int(good.sum()), max(1, int(bad.sum())), (0.0, BINS + 1), BINS + 1
    lost = hit = 0
    while cut > 0 and n:
        cut -= 1
        lost, hit = lost + int(good[cut]), hit + int(bad[cut])
        if lost > risk * n or binomial_tail(lost, n, risk) > delta:
            break
        best = max(best, (hit / n_bad - cost * lost / n, cut))
    return best[1]


def least_holdout(risk: float, delta: float) -> int:
    """Good documents below which no cutoff can pass, not even one that none of them reaches."""
    return math.ceil(math.log(delta) / math.log1p(-risk))


class Verdicts:
    """Levels of every rule's bins, and the cutoff level of each stratum (``*``: all others)."""

    def __init__(self, levels: dict[str, list[int]], cut: dict[str, int]):
        self.levels, self.cut = levels, cut

    def level(self) -> Column:
        return F.greatest(*[F.element_at(F.array(*map(F.lit, self.levels[k])), b + 1) for k, b in rule_bins().items()])

    def passed(self) -> Column:
        known = F.create_map(*[F.lit(x) for sc in self.cut.items() for x in sc])
        return self.level() < F.coalesce(known[F.col("stratum")], known[F.lit("*")])


def rule_levels(good: np.ndarray) -> list[int]:
    """A level for each bin from counts of good documents per bin: SCALE times the decimal logarithm of how rare it is that a
    good document has this bin or a worse one (one more document is thought to have each)."""
    share = (good[::-1].cumsum()[::-1] + 1) / (good.sum() + 1)
    return np.minimum(BINS, np.floor(-SCALE * np.log10(share) + 1e-9)).astype(int).tolist()


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> Verdicts:
    """Levels and cutoffs from all labelled rows that pass the base rules.

    ``rows`` are ``text_counts``; ``labels`` (id, good: 1 or 0, null ignored; of several labels the smallest counts). Of the
    strata that have ``least_holdout`` good documents or more, the MAX_STRATA largest have cutoffs of their own. Only counts
    per bin reach the driver: rules x bins, and bins for the strata that can pass.
    """
    one = labels.filter("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"))
    held = stored(rows.filter(~base_failed()).join(one, "id").withColumn("learn", fold("id", LEARN) == 0), "holdout")
    bins = rule_bins()
    learn = held.filter(F.col("learn") & (F.col("good") == 1)).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("bin")) for k, v in bins.items()])).alias("x"))
    table = {k: np.zeros(BINS + 1, np.int64) for k in bins}
    for rule, b, n in learn.groupBy("x.rule", "x.bin").count().collect():
        table[rule][b] = n
    out = Verdicts({k: rule_levels(v) for k, v in table.items()}, {})
    good, bad = (F.sum(F.when(F.col("good") == g, 1).otherwise(0)) for g in (1, 0))
    hist = stored(held.filter("NOT learn").groupBy("stratum", out.level().alias("level")).agg(good.alias("g"), bad.alias("b")), "levels")
    sizes = hist.groupBy("stratum").agg(F.sum("g").alias("n")).filter(F.col("n") >= least_holdout(risk, delta / 2)).orderBy(
        F.desc("n"), "stratum").limit(MAX_STRATA).collect()
    # as many strata as can pass when the error level is shared by them and the whole
    own = max((i for i in range(len(sizes) + 1) if i == 0 or sizes[i - 1]["n"] >= least_holdout(risk, delta / (i + 1))), default=0)
    names = [r["stratum"] for r in sizes[:own]]
    hists = {s: np.zeros((2, BINS + 1), np.int64) for s in [*names, "*"]}
    for level, g, b in hist.groupBy("level").agg(F.sum("g"), F.sum("b")).collect():
        hists["*"][:, level] = g, b
    for s, level, g, b in hist.filter(F.col("stratum").isin(names) if names else F.lit(False)).collect():
        hists[s][:, level] = g, b
    out.cut = {s: choose_cutoff(*h, risk, delta / len(hists)) for s, h in hists.items()}
    return out


def quality_verdicts(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str, risk: float = RISK,
                     delta: float = DELTA) -> DataFrame:
    """One row per row of ``df``: id, stratum, the counts, base_failed, kept.

    A null or empty text has no words and fails the base rules; a null id is kept as it is and has no
    label; repeated rows are judged alike; without labels only the base rules reject; an empty table gives
    no rows; other columns are ignored.
    """
    rows = stored(text_counts(df, id_col, text_col, stratum_col), "quality-counts")
    passed = cutoffs(rows, labels, risk, delta).passed()
    return rows.select("id", "stratum", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & passed).alias("kept"))
