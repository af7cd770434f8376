import math
import random
import re

import numpy as np
import pytest

from basketry.llm import quality
from basketry.llm.queries import op10_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The contract's five counts, straight from their definition."""
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    cover = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


@pytest.mark.parametrize("seed", range(6))
def test_counts(seed):
    rnd = random.Random(seed)
    t = "".join(rnd.choice(["a ", "b ", "é c ", "#&", "\n", "\t", "a b c\n", "\r\n", "漢|字 ", "\x1f"]) for _ in range(rnd.randint(0, 120)))
    assert quality.counts(t.encode())[:5] == plain(t)


def test_binomial_tail_and_bound():
    for n, k, p in ((20, 3, 0.1), (500, 2, 0.02), (5, 5, 0.3), (7, 0, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoff_bounds_false_rejection():
    """Over many drawn holdouts, cutoffs whose true false rejection exceeds the risk come up at most about delta often."""
    rng, risk, delta, broken = np.random.default_rng(4), 0.05, 0.1, 0
    p = np.exp(-np.arange(quality.BINS + 1) / 12.0)
    p /= p.sum()
    bad = np.zeros(quality.BINS + 1, int)
    bad[5:] = 10
    for _ in range(300):
        cut = quality.choose_cutoff(rng.multinomial(2000, p), bad, risk, delta, cost=0.0)
        broken += p[cut:].sum() > risk
    assert broken <= 300 * delta * 1.5
    good = np.zeros(quality.BINS + 1, int)
    good[0] = 5000
    assert quality.choose_cutoff(good, bad, 0.01, 0.05) == 5
    assert quality.choose_cutoff(good // 5000 * 3, bad, 0.01, 0.05) == quality.BINS + 1  # too few labels


def test_verdicts(spark, docs):
    rnd = random.Random(1)
    words = [a + b for a in "abcdefgh" for b in "stuvwxyz"]
    rows = [(i, " ".join(rnd.choice(words) + ("###" if i % 10 == 0 else "") for _ in range(80)), "en") for i in range(3000)]
    rows += [(9001, None, "en"), (9002, "", None), (None, " ".join(words), None), (9003, "same words here " * 40_000, "xx"),
             (9004, " ".join(words), "en"), (9004, " ".join(words), "en")]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(3000)] + [(None, 1), (5, None), (70000, 0)], "id long, good int")
    df = docs(rows, extra="stratum")
    got = [(r.id, r.base_failed, r.kept) for r in quality.quality_verdicts(df, labels, "doc_id", "text", "lang", risk=0.05).collect()]
    by = {i: (f, k) for i, f, k in got}
    assert len(got) == len(rows)
    assert all(by[i] == (False, i % 10 > 0) for i in range(3000))
    assert by[9001] == by[9002] == by[9003] == (True, False) and by[None] == by[9004] == (False, True)
    bare = quality.quality_verdicts(df, labels.filter("false"), "doc_id", "text", "lang").collect()
    assert all(r.kept != r.base_failed for r in bare)
    assert quality.quality_verdicts(docs([]), labels, "doc_id", "text", "lang").count() == 0


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_quality_rules(spark, sf).collect():
        n, chars, sym, dup, rep = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.kept and r.base_failed)


def plain_verdicts(rows, labels, risk=quality.RISK, delta=quality.DELTA):
    """Kept documents by plain code, from rows (id, stratum, counts) and one label per id."""
    import zlib
    from math import comb, floor, log10

    def bins(c):
        w, ch = max(1, c["n_words"]), max(1, c["word_chars"])
        m = c["word_chars"] / w
        x = [m / 50.0, max(0.0, 1 - m / 10.0), c["n_symbols"] / w, c["n_upper"] / ch, c["n_marks"] / ch, c["n_dup_lines"] / max(1, c["n_lines"]), c["n_repeat_words"] / w]
        return [min(200, floor(v * 200)) for v in x]

    failed = lambda c: c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
    held = [(i, s, bins(c), labels[i]) for i, s, c in rows if not failed(c) and labels.get(i) is not None]
    learn = [b for i, _, b, good in held if good and zlib.crc32(str(i).encode()) % 4 == 0]
    rare = [[(1 + sum(b[k] >= v for b in learn)) / (1 + len(learn)) for v in range(201)] for k in range(7)]
    level = lambda b: max(min(200, floor(-40 * log10(rare[k][b[k]]) + 1e-9)) for k in range(7))
    test = [(s, level(b), good) for i, s, b, good in held if zlib.crc32(str(i).encode()) % 4]
    n_good = {s: sum(g for t, _, g in test if t == s) for s in {s for s, _, _ in test}}
    need = lambda d: next(n for n in range(1, 10_000) if (1 - risk) ** n <= d)
    order = sorted(n_good, key=lambda s: (-n_good[s], s))
    own = max([0, *(i for i in range(1, len(order) + 1) if n_good[order[i - 1]] >= need(delta / (i + 1)))])
    cut = {}
    for name in [*order[:own], "*"]:
        part = [(v, g) for s, v, g in test if name in ("*", s)]
        n, n_bad, best = sum(g for _, g in part), max(1, sum(1 - g for _, g in part)), (0.0, 201)
        for c in range(200, -1, -1):
            lost = sum(g for v, g in part if v >= c)
            if not n or lost > risk * n or sum(comb(n, j) * risk ** j * (1 - risk) ** (n - j) for j in range(lost + 1)) > delta / (own + 1):
                break
            best = max(best, (sum(1 - g for v, g in part if v >= c) / n_bad - 10 * lost / n, c))
        cut[name] = best[1]
    return cut, {i: not failed(c) and level(bins(c)) < cut.get(s, cut["*"]) for i, s, c in rows}


def test_the_method_rejects_and_equals_plain_cutoffs(spark):
    """On the test tables bad documents go that the base rules keep; cutoffs, verdicts and the holdout bound by plain code."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id AS id", "quality AS good")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = quality.quality_verdicts(docs, labels, "doc_id", "text", "lang").collect()
    known = {r.id: r.good for r in labels.collect()}
    cut, kept = plain_verdicts([(r.id, r.stratum, r.asDict()) for r in got], known)
    assert {r.id: r.kept for r in got} == kept and len(cut) > 2
    gone = [r for r in got if not r.base_failed and not r.kept]
    assert len(gone) > 100
    for s in [s for s in cut if s != "*"]:
        good = [r.kept for r in got if r.stratum == s and not r.base_failed and known.get(r.id) == 1]
        assert good.count(False) <= quality.RISK * len(good)


def test_least_holdout():
    for risk, delta in ((0.02, 0.01), (0.05, 0.1), (0.5, 0.001)):
        n = quality.least_holdout(risk, delta)
        assert quality.binomial_tail(0, n, risk) <= delta < quality.binomial_tail(0, n - 1, risk)
    assert quality.least_holdout(0.02, 0.01) == 228
