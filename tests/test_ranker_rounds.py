"""Boosted rankers: gradients, trees on cells, early stopping on NDCG, halving, and models by path."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions.treemodel import SAVED_RANKER, load_model, model_nodes, model_text, parse_model_text, save_model, tree_score
from basketry.operators import boosting as bo
from basketry.operators import ranking as rk
from basketry.operators.metrics import evaluate_ranking


def made(spark, label, users=80, n=12, seed=0):
    rnd = random.Random(seed)
    rows = []
    for u in range(users):
        for i in range(n):
            r = (u, f"{i:03d}", rnd.random(), rnd.random() * 50, rnd.random() * 9, rnd.randrange(3), rnd.randrange(1, 200), rnd.randrange(100))
            rows.append((*r, int(label(r))))
    ds = spark.createDataFrame(rows, "customer_id long, article_id string, u double, purchase_count double, recency double, "
                                     "purchase_frequency_encoded int, popularity_rank int, sales_count int, label int")
    split = ds.select("customer_id").distinct().withColumn("split", F.when(F.col("customer_id") % 4 == 0, "val").otherwise("train"))
    return ds, split


def test_gradients_are_the_slopes_of_the_loss():
    rnd = np.random.default_rng(1)
    s, y = rnd.normal(size=9), np.array([1, 0, 0, 1, 0, 0, 0, 1, 0])
    loss = {"pairwise": lambda s: sum(math.log1p(math.exp(s[j] - s[i])) for i in range(9) for j in range(9) if y[i] and not y[j]),
            "pointwise": lambda s: sum(math.log1p(math.exp(-s[i] if y[i] else s[i])) for i in range(9))}
    for name, f in loss.items():
        g, h = bo.LOSSES[name](s, y)
        for i in range(9):
            e = np.eye(9)[i] * 1e-4
            assert g[i] == pytest.approx((f(s - e) - f(s + e)) / 2e-4, abs=1e-6)
            assert h[i] == pytest.approx((f(s + e) - 2 * f(s) + f(s - e)) / 1e-8, abs=1e-3)


def test_trees_are_the_best_splits_of_plain_code():
    rnd = np.random.default_rng(2)
    bins, sums = rnd.integers(0, 5, (60, 3)), np.c_[rnd.integers(-9, 9, (60, 1)) << 22, rnd.integers(1, 9, (60, 1)) << 22, rnd.integers(1, 6, (60, 1))]
    p = bo.Params(depth=3, least_rows=4)
    tree, value = bo.grow(bins, sums, p)

    def plain(at, depth):
        score = lambda a: (sums[a, 0].sum() * bo.UNIT) ** 2 / (sums[a, 1].sum() * bo.UNIT + 1)
        best = (1e-9, None)
        for f in range(3):
            for b in range(4):
                lo, hi = at[bins[at, f] <= b], at[bins[at, f] > b]
                if depth and min(sums[lo, 2].sum(), sums[hi, 2].sum()) >= 4:
                    gain = score(lo) + score(hi) - score(at)
                    best = max(best, (gain, (f, b)), key=lambda x: x[0])
        if best[1] is None:
            return {int(i): 0.1 * sums[at, 0].sum() * bo.UNIT / (sums[at, 1].sum() * bo.UNIT + 1) for i in at}
        lo = bins[at, best[1][0]] <= best[1][1]
        return plain(at[lo], depth - 1) | plain(at[~lo], depth - 1)

    assert value == pytest.approx([plain(np.arange(60), 3)[i] for i in range(60)])
    assert (bo._value(tree, bins) == value).all()


def test_scores_on_cells_are_the_models_scores(spark):
    """The model of thresholds scores every row as its cell; NDCG after the best round is that of the metric; nulls count as 0."""
    ds, split = made(spark, lambda r: 2 * r[3] > r[6] or r[7] > 90)
    ds = ds.withColumn("sales_count", F.when(F.col("sales_count") % 11 != 0, F.col("sales_count"))).cache()
    b = bo.boost(ds, split, rk.FEATURES, bo.Params(rounds=25, depth=3))
    assert len(b.trees) == 25 and b.ndcg[-1] > b.ndcg[0] > 0.5
    scored = rk.score_with_model(ds.join(split, "customer_id"), b.model()).filter("split = 'val'")
    assert evaluate_ranking(scored, [10], ("ndcg",)).first()["value"] == pytest.approx(b.best(), abs=1e-6)
    again = bo.boost(ds.repartition(7), split, rk.FEATURES, bo.Params(rounds=25, depth=3))
    assert again.trees == b.trees and again.ndcg == b.ndcg
    fast = bo.boost(ds, split, rk.FEATURES, bo.Params(rounds=25, depth=3, objective="pointwise"))
    assert fast.trees != b.trees and fast.best() > 0.8


def test_training_stops_on_validation_ndcg(spark):
    """Labels without a signal end the training early; without validation users all rounds are trained."""
    ds, split = made(spark, lambda r: r[2] < 0.3)
    b = bo.boost(ds, split, rk.FEATURES, bo.Params(rounds=200, patience=10, depth=2))
    assert len(b.trees) < 100 and b.model().getNumTrees == b.best_round() <= len(b.trees) - 10
    model, rows = rk.train_ranker(ds, split.withColumn("split", F.lit("train")), max_iter=3)
    assert model.getNumTrees == 3 and rows.count() == 0
    assert (rk.ROUNDS, rk.PATIENCE) == (500, 30)


def test_pairwise_beats_popularity_and_pointwise(spark):
    """Users buy at very different rates, and items of middling rank: the pairwise loss spends its splits on the items."""
    rnd = random.Random(5)
    rows = []
    for u in range(160):
        rate, recency, seen = rnd.random() * 50, rnd.random() * 28, rnd.randrange(3)
        for i in range(15):
            rank, sales = rnd.randrange(1, 200), rnd.randrange(100)
            wants = rnd.gauss(0, 25) - abs(rank - 90) + 6 * (rate - 25)
            rows.append((u, f"{i:03d}", rate, recency, seen, rank, sales, int(wants > 0)))
    ds = spark.createDataFrame(rows, "customer_id long, article_id string, purchase_count double, recency double, "
                                     "purchase_frequency_encoded int, popularity_rank int, sales_count int, label int")
    split = ds.select("customer_id").distinct().withColumn("split", F.when(F.col("customer_id") % 4 == 0, "val").otherwise("train"))
    got = {}
    for objective in ("pairwise", "pointwise"):
        _, m = rk.train_ranker(ds, split, max_iter=10, max_depth=2, objective=objective)
        got |= {r["model"]: r["value"] for r in m.filter("metric = 'ndcg@10'").collect()}
    assert got["pairwise"] > got["pointwise"] > 0 and got["pairwise"] > got["popularity"], got


def test_successive_halving_goes_on_without_refitting(spark):
    ds, split = made(spark, lambda r: 2 * r[3] > r[6], users=40)
    points = bo.successive_halving(ds, split, rk.FEATURES, {"depth": [1, 3], "rate": [0.02, 0.3]}, rounds=4, base=bo.Params(patience=99))
    assert sorted(len(b.trees) for _, b in points) == [4, 4, 8, 16]
    assert len(points[0][1].trees) == 16 and len({id(b.lists) for _, b in points}) == 1
    alone = bo.boost(ds, split, rk.FEATURES, bo.Params(rounds=16, patience=99, **points[0][0]))
    assert alone.trees == points[0][1].trees
    rows = rk.tune_ranker(ds, split, {"depth": [2], "rate": [0.1, 0.2]}, rounds=2).collect()
    assert [r["rounds"] for r in rows] == [4, 2] and rows[0]["params"].startswith("depth=2,rate=")


def test_cells_stay_in_bounds(spark):
    ds, _ = made(spark, lambda r: True)
    edges = bo.bin_edges(ds, rk.FEATURES, 32, cells=1000)
    assert np.prod([len(e) + 1 for e in edges]) <= 1000 and all(edges)
    assert [len(e) for e in bo.bin_edges(ds.limit(0), rk.FEATURES, 32)] == [0] * 5


def test_model_by_path_and_importance(spark, tmp_path):
    """Saved and loaded models are equal, as a node table and as text, and score like the original."""
    ds, split = made(spark, lambda r: 2 * r[3] > r[6], users=40)
    trained = bo.boost(ds, split, rk.FEATURES, bo.Params(rounds=6)).model()
    for i, model in enumerate([trained, SAVED_RANKER]):
        save_model(spark, model, f"{tmp_path}/m{i}")
        back = load_model(spark, f"{tmp_path}/m{i}")
        assert back == model and parse_model_text(model_text(model)) == model
        assert ds.filter(~tree_score(model, rk.FEATURES).eqNullSafe(tree_score(back, rk.FEATURES))).count() == 0
        imp = {r["feature"]: (r["gain"], r["n_splits"]) for r in rk.feature_importance(model_nodes(spark, model)).collect()}
        for f, name in enumerate(rk.FEATURES):
            gains = [g for t in model.trees for k, g in zip(t.split_feature, t.split_gain) if k == f]
            assert imp[name] == (pytest.approx(sum(gains)), len(gains))
    assert imp["popularity_rank"][0] > 8651


def test_training_reads_its_rows_from_one_table(spark):
    """The many passes of training, tuning and their report neither sample users nor join features again."""
    from basketry.plans import registry as R
    from basketry.sources.tables import load_tables
    t = load_tables(spark, "/root/testdata/sf0.001")
    for df in (R._split(t), R._train_rows(t)):
        p = df._jdf.queryExecution().optimizedPlan().toString()
        assert p.count("Relation [") == 1 and "Join" not in p and "Aggregate" not in p, p
    assert sorted(map(tuple, R._train_rows(t).collect())) == sorted(map(tuple, R._rds(t).collect()))
