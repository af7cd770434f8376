import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import neighbours
from basketry.llm.neighbours import balanced_parts, nearest, search


def brute(rows, queries, k=10):
    """rows {id: vector} -> {query: [(id, distance)]}, nearest first, ties to the smaller id."""
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.float64(v) - np.float64(rows[q])) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = [(i, s) for s, i in d[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r[2], r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def test_balanced_parts_follow_the_graph():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 8)) * 6
    x = np.concatenate([c + rng.normal(size=(100, 8)) for c in centre])
    nbr = nearest(x, x, 8, skip_self=True)
    part = balanced_parts(x, nbr, 2)
    assert np.bincount(part).tolist() == [100] * 4
    assert (part[nbr] == part[:, None]).mean() > 0.97


@pytest.mark.parametrize("chunk", [20_000, 300])
def test_recall_and_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "QUERIES", 1000 if chunk > 300 else 50)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(10, 24)) * 0.6
    x = (centre[rng.integers(0, 10, 8000)] + rng.normal(size=(8000, 24))).astype(np.float32)
    x[3000:5000] = x[7]  # a hot vector
    rows = {i: x[i] for i in range(len(x))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, e array<float>").repartition(4)
    got = found(search(df, "vec_id", "e", F.col("vec_id") % 100 == 0))
    want = brute(rows, range(0, 8000, 100))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, v in got.items():
        for i, s in v:
            assert s == pytest.approx(float(np.linalg.norm(np.float64(rows[i]) - np.float64(rows[q]))), rel=1e-12)
    assert got[3000] == [(i, 0.0) for i in (7, *range(3001, 3010))]


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []),
            (9, [None, 1.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 1.0]), (11, [2.0, 0.0]), (200, [None, None]),
            (11, [3.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, e array<float>, score string")
    got = found(search(df, "vec_id", "e", F.col("vec_id") % 100 == 0))
    assert [i for i, _ in got[0]] == [10, 100, 11, 11] and got[0][0][1] == 0.0
    assert [i for i, _ in got[100]] == [0, 10, 11, 11] and got.keys() == {0, 100}
    assert search(df.filter("vec_id = 0"), "vec_id", "e", F.lit(True)).count() == 0
    assert search(df.filter("false"), "vec_id", "e", F.lit(True)).count() == 0


def test_query_recall(spark):
    from basketry.llm.queries import op8_learned_partitions
    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = found(op8_learned_partitions(spark, sf))
    want = brute(rows, [i for i in rows if i % 100 == 0])
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
