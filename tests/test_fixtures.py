"""Hand-checked micro-fixtures (FIXTURES.md §4) for every semantic edge."""

import math

import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates as cand
from basketry.operators import cycles as cyc
from basketry.operators import experiments as exp
from basketry.operators import features as feat
from basketry.operators import metrics as met
from basketry.operators import patterns as pat
from basketry.operators import quality as qual
from basketry.operators import ranking as rk
from basketry.operators import segments as seg

TX = "customer_id string, article_id string, t_dat date, price double"
ART = "article_id string, prod_name string, product_group_name string, product_type_name string"
ITF = "article_id string, popularity_rank long"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_window_edge_inclusive(mk):
    tx = mk(TX, [("u", "a", "2020-01-29", 0.01), ("u", "b", "2020-01-01", 0.01), ("v", "c", "2019-12-31", 0.01)])
    uf = feat.user_features(tx, 28)
    assert rows(uf, "customer_id", "purchase_count") == [("u", 2)]


def test_strict_edge_key78(mk):
    art = mk(ART, [("a", "n", "g", "t")])
    tx = mk(TX, [("u", "a", "2020-03-01", 0.01), ("u", "a", "2020-01-01", 0.01), ("u", "a", "2020-02-29", 0.01)])
    # max 2020-03-01; 60 days before is 2020-01-01: dropped by the strict '>'
    out = qual.sparse_users(tx, art, 2, 10, 60)
    assert rows(out, "customer_id", "cnt") == [("u", 2)]


def test_frequency_bands_and_recency_zero(mk):
    data = []
    for user, n in [("h", 10), ("m1", 9), ("m2", 5), ("l", 4)]:
        data += [(user, f"i{j}", "2020-01-10", 0.01) for j in range(n)]
    uf = feat.user_features(mk(TX, data), 28)
    assert rows(uf, "customer_id", "purchase_frequency", "recency") == [
        ("h", "high", 0), ("l", "low", 0), ("m1", "medium", 0), ("m2", "medium", 0)]


def test_item_not_in_articles_and_rank_ties(mk):
    tx = mk(TX, [("u", "10", "2020-01-10", 0.01), ("u", "9", "2020-01-10", 0.01), ("u", "100", "2020-01-10", 0.01),
                 ("u", "x", "2020-01-10", 0.01), ("v", "x", "2020-01-10", 0.01), ("u", "zz", "2020-01-10", 0.01)])
    art = mk(ART, [(i, i, "g", "t") for i in ["10", "9", "100", "x"]])
    itf = feat.item_features(tx, art, 7)
    assert rows(itf, "popularity_rank", "article_id") == [(1, "x"), (2, "10"), (3, "100"), (4, "9")]


def test_null_rank_score(mk):
    itf = mk(ITF, [("a", 1), ("b", None)])
    out = cand.popularity_scored(itf, 5)
    got = {r.article_id: (r.pos, r.score) for r in out.collect()}
    assert got["a"] == (1, 0.5)
    assert got["b"][0] == 2 and got["b"][1] == pytest.approx(1 / (1 + 1e12))


def test_segment_edges(mk):
    tx = mk(TX, [("a3", "i", "2020-03-01", 0.01)] * 3 + [("b2", "i", "2020-03-01", 0.01)] * 2)
    uf = feat.user_features(tx, 28)
    m = seg.user_activity_metrics(uf, tx, 3, 60)
    users = mk("customer_id string", [("a3",), ("b2",), ("zz",)])
    s = seg.user_segments(users, m)
    assert rows(s, "customer_id", "segment") == [("a3", "active"), ("b2", "low_activity"), ("zz", "low_activity")]


def _copurchase_tx(mk, day="2020-01-31"):
    return mk(TX, [("u", "a", day, 0.01), ("v", "a", day, 0.01), ("v", "b", day, 0.01),
                   ("w", "a", day, 0.01), ("w", "b", day, 0.01), ("w", "c", day, 0.01)])


def test_copurchase_scores(mk):
    cfw = cand.cf_window(_copurchase_tx(mk), 28)
    itf = mk(ITF, [("zz", 1)])
    cf = cand.cf_candidates(cfw, itf, top_k=10).filter("customer_id = 'u'")
    assert [(r.article_id, r.score_cf) for r in cf.orderBy("pos").collect()] == [("b", 2.0), ("c", 1.0)]
    ranked = mk(ITF, [("b", 2), ("c", 3)])
    cf2 = cand.cf_candidates(cfw, ranked, top_k=10, popularity_penalty_alpha=0.2).filter("customer_id = 'u'")
    got = {r.article_id: r.score_cf for r in cf2.collect()}
    assert got["b"] == pytest.approx(1.6397172876, abs=1e-9)
    assert got["c"] == pytest.approx(0.7829266422, abs=1e-9)


def test_half_life(mk):
    base = _copurchase_tx(mk, "2020-01-17")  # 14 days before the max set by another row
    tx = base.unionByName(mk(TX, [("q", "zzz", "2020-01-31", 0.01)]))
    cf = cand.cf_candidates(cand.cf_window(tx, 28), mk(ITF, [("zz", 1)]), top_k=10).filter("customer_id = 'u'")
    got = {r.article_id: r.score_cf for r in cf.collect()}
    assert got == {"b": pytest.approx(0.5), "c": pytest.approx(0.25)}  # seed 0.5 x pair 0.5


def test_duplicate_seed_rows(mk):
    tx = _copurchase_tx(mk).unionByName(mk(TX, [("u", "a", "2020-01-31", 0.01)]))
    cf = cand.cf_candidates(cand.cf_window(tx, 28), mk(ITF, [("zz", 1)]), top_k=10).filter("customer_id = 'u'")
    got = {r.article_id: r.score_cf for r in cf.collect()}
    assert got == {"b": 4.0, "c": 2.0}  # seed weight doubles


def test_day_gap(mk):
    tx = mk(TX, [("u", "a", "2020-01-31", 0.01), ("v", "a", "2020-01-30", 0.01), ("v", "b", "2020-01-31", 0.01)])
    cfw = cand.cf_window(tx, 28)
    same = cand.item_cooccurrence(cfw, True)
    assert same.filter("seed_item = 'a'").count() == 0
    gap = cand.item_cooccurrence(cfw, False, 1)
    assert rows(gap.filter("seed_item = 'a'"), "cand_item", "score") == [("b", 1.0)]


def test_tiny_scores_keep_their_order(mk):
    """Scores far below 1e-10 neither vanish nor lose their order, and equal scores go by id."""
    old = [("w", "a", "2020-01-01", 0.01), ("w", "c", "2020-01-01", 0.01), ("w", "d", "2020-01-01", 0.01),
           ("x", "a", "2020-01-02", 0.01), ("x", "b", "2020-01-02", 0.01), ("end", "z", "2020-02-10", 0.01)]
    c = cand.item_cooccurrence(cand.cf_window(mk(TX, old), 60), half_life_days=1)
    assert rows(c.filter("seed_item = 'a'").orderBy("rr"), "cand_item", "score", "rr") == [
        ("b", 0.5 ** 39, 1), ("c", 0.5 ** 40, 2), ("d", 0.5 ** 40, 3)]
    assert 0.5 ** 40 < 1e-12
    tx = mk(TX, [*old, ("u", "a", "2020-01-01", 0.01)])
    cf = cand.cf_candidates(cand.cf_window(tx, 60), mk(ITF, [("zz", 1)]), top_k=10, half_life_days=1).filter("customer_id = 'u'")
    got = rows(cf.orderBy("pos"), "article_id", "score_cf")
    assert [a for a, _ in got] == ["b", "c", "d"] and all(0 < v < 1e-20 for _, v in got)


def test_fill_bound_at_the_edge(mk):
    """total_k = pop_top + 1 with a CF list that equals the first expansion items: the fill still finds its item."""
    users, cfw, itf, cf = _merge_inputs(mk, [(f"p{i}", i) for i in range(1, 9)], [("u", 1, "p3"), ("u", 2, "p4")])
    out = cand.merged_candidates(users, cfw, itf, total_k=5, pop_top=2, cf_top=2, cf=cf, fallback_pop_expand=8)
    assert {r.article_id for r in out.collect()} == {"p1", "p2", "p3", "p4", "p5"}


def test_basket_split_with_day_gap_is_exact(mk):
    data = [("big", f"i{j:02d}", f"2020-01-{28 + j % 3}", 0.01) for j in range(30)] + [("s", "i00", "2020-01-31", 0.01)]
    cfw = cand.cf_window(mk(TX, data), 28)
    cols = ("seed_item", "cand_item", "score", "rr")
    assert rows(cand.item_cooccurrence(cfw, False, 2, basket_split=10_000), *cols) == rows(
        cand.item_cooccurrence(cfw, False, 2, basket_split=4), *cols)


def test_graded_labels_ndcg(mk):
    r = mk("customer_id string, article_id string, label int, score double",
           [("u", "a", 1, 0.9), ("u", "b", 3, 0.8), ("u", "c", 0, 0.7), ("u", "d", 2, 0.1)])
    got = met.metric_at_k(r, "ndcg", [3]).collect()[0].value
    log = math.log2
    assert math.isclose(got, (1 + 3 / log(3)) / (3 + 2 / log(3) + 1 / log(4)), rel_tol=1e-9)


def test_experiment_log_has_one_row_per_user(mk):
    from basketry.sources.tables import experiment_log, exposures_from_events
    ev = mk("user_id long, ts timestamp, event_type string", [])
    import datetime as dt
    spark = ev.sparkSession
    ev = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), "view"), (1, dt.datetime(2020, 1, 2), "click"),
                                (1, dt.datetime(2020, 1, 2, 5), "purchase"), (2, dt.datetime(2020, 1, 3), "view")],
                               "user_id long, ts timestamp, event_type string")
    log = experiment_log(exposures_from_events(ev)).orderBy("user_id").collect()
    assert [(r.user_id, r.clicked, r.purchase_count, r.num_items) for r in log] == [("1", True, 1, 3), ("2", False, 0, 1)]


def test_changed_input_gets_new_tables(spark, tmp_path):
    from basketry.sources import load_tables
    root = str(tmp_path)
    for n, t in (("orders", "o_orderkey long, o_custkey long, o_orderdate date"), ("lineitem", "l_orderkey long, l_partkey long, l_extendedprice double")):
        import datetime as dt
        rows_ = [(1, 2, dt.date(2020, 1, 1))] if n == "orders" else [(1, 3, 5.0)]
        spark.createDataFrame(rows_, t).write.parquet(f"{root}/{n}.parquet")
    assert load_tables(spark, root).tx.count() == 1
    spark.createDataFrame([(1, 4, 6.0)], "l_orderkey long, l_partkey long, l_extendedprice double").write.mode("append").parquet(f"{root}/lineitem.parquet")
    assert load_tables(spark, root).tx.count() == 2


def test_two_refreshes_before_reading(spark):
    from basketry.plans.registry import QUERIES
    a = QUERIES["refresh_features"](spark, "/root/testdata/sf0.001")
    b = QUERIES["refresh_features"](spark, "/root/testdata/sf0.01")
    na, nb = ({r.table_name: r.row_count for r in x.collect()} for x in (a, b))
    assert na["item_features"] < nb["item_features"]


def test_basket_salting_is_exact(mk):
    day = "2020-01-31"
    data = [("big", f"i{j:03d}", day, 0.01) for j in range(40)] + [("s", "i000", day, 0.01), ("s", "i001", day, 0.01)]
    cfw = cand.cf_window(mk(TX, data), 28)
    plain = cand.item_cooccurrence(cfw, basket_split=10_000)
    salted = cand.item_cooccurrence(cfw, basket_split=7)
    cols = ("seed_item", "cand_item", "score", "rr")
    assert rows(plain, *cols) == rows(salted, *cols)
    assert plain.count() == 40 * 39


def _merge_inputs(mk, itf_rows, cf_rows):
    itf = mk(ITF, itf_rows)
    cf = mk("customer_id string, pos long, article_id string", cf_rows)
    users = mk("customer_id string", [("u",)])
    cfw = mk("customer_id string, article_id string, t_dat date", [("u", "q", "2020-01-01")])
    return users, cfw, itf, cf


def test_rrf_fusion(mk):
    users, cfw, itf, cf = _merge_inputs(mk, [("x", 1), ("y", 2)], [("u", 1, "y"), ("u", 2, "z")])
    out = cand.merged_candidates(users, cfw, itf, total_k=3, pop_top=2, fallback_pop_expand=2, cf=cf)
    got = [(r.article_id, r.final_score) for r in out.orderBy("pos").collect()]
    assert [a for a, _ in got] == ["y", "z", "x"]
    assert [s for _, s in got] == pytest.approx([0.0138947648, 0.0112903226, 0.0024590164], abs=1e-9)


def test_fill_and_total_k_zero(mk):
    users, cfw, itf, cf = _merge_inputs(mk, [("x", 1), ("p2", 2), ("p3", 3)], [("u", 1, "y")])
    out = cand.merged_candidates(users, cfw, itf, total_k=3, pop_top=1, fallback_pop_expand=3, cf=cf)
    got = [(r.article_id, r.pop_rrf) for r in out.orderBy("pos").collect()]
    assert [a for a, _ in got] == ["y", "x", "p2"]
    assert got[2][1] == pytest.approx(1 / 62)
    assert cand.merged_candidates(users, cfw, itf, total_k=0, cf=cf).count() == 0


def test_popularity_recency(mk):
    tx = mk(TX, [("u", "a", "2020-01-31", 0.01)] * 3 + [("v", "b", "2020-01-31", 0.01)])
    itf = mk(ITF, [("a", 1), ("b", 2)])
    out = cand.popularity_recency(itf, cand.cf_window(tx, 28), 2, 30, 0.6, 0.4)
    got = {r.article_id: r.score for r in out.collect()}
    # a: 0.6 * 1/2 + 0.4 * 3/4 = 0.6 ; b: 0.6 * 1/3 + 0.4 * 1/4 = 0.3
    assert got == {"a": pytest.approx(0.6), "b": pytest.approx(0.3)}


def test_metrics_demo(mk):
    r = mk("customer_id string, article_id string, label int, score double",
           [("u", str(i), y, s) for i, (y, s) in enumerate(zip([0, 1, 0, 1, 0], [.1, .9, .2, .8, .3]))])
    got = {(x.metric, x.k): x.value for x in met.per_user_metrics(r, [3]).collect()}
    assert got[("ndcg", 3)] == pytest.approx(1.0)
    assert got[("hit_rate", 3)] == 1.0
    assert got[("precision", 3)] == pytest.approx(2 / 3)
    assert got[("recall", 3)] == 1.0


def test_metrics_short_group_and_no_positives(mk):
    r = mk("customer_id string, article_id string, label int, score double",
           [("s", "a", 1, .9), ("s", "b", 0, .1), ("z", "a", 0, .5), ("z", "b", 0, .4)])
    got = {(x.customer_id, x.metric): x.value for x in met.per_user_metrics(r, [5]).collect()}
    assert got[("s", "precision")] == pytest.approx(0.2)
    assert (got[("z", "ndcg")], got[("z", "recall")], got[("z", "hit_rate")]) == (0.0, 0.0, 0.0)
    ev = {(x.metric, x.k): x.value for x in met.evaluate_ranking(r, [5]).collect()}
    assert ev[("ndcg", 5)] == pytest.approx(0.5)  # users without positives stay in the mean


def test_positives_need_exactly_p(mk):
    tx = mk(TX, [("two", "a", "2020-01-31", 0.01), ("two", "b", "2020-01-30", 0.01)]
             + [("three", x, "2020-01-31", 0.01) for x in "abc"])
    sampled = mk("customer_id string", [("two",), ("three",)])
    pos = rk.ranking_positives(tx, sampled, 3, 28)
    assert rows(pos, "customer_id", "rn", "article_id") == [("three", 1, "a"), ("three", 2, "b"), ("three", 3, "c")]
    itf = mk(ITF, [("p1", 1), ("p2", 2)])
    neg = rk.ranking_negatives(tx, sampled, itf, 1, 2, 2, 28)
    assert sorted(r.customer_id for r in neg.collect()) == ["three", "three", "two", "two"]


def test_cycle(mk):
    tx = mk(TX, [("u", "a", "2020-01-01", 0.01), ("u", "b", "2020-01-01", 0.01), ("u", "c", "2020-01-08", 0.01)])
    uc = cyc.user_cycles(tx).collect()[0]
    assert (uc.avg_cycle, uc.n_rows) == (3.5, 3)
    d = cyc.cycle_distribution(tx).collect()[0]
    assert (d.bucket, d.user_count) == (1, 1)
    rec = cyc.cycle_recent_users(tx, 30).collect()[0]
    assert (rec.active_users, rec.avg_cycle, rec.median_cycle) == (1, 3.5, 3.5)


def test_frequency_class(mk):
    tx = mk(TX, [("w", "a", "2020-01-01", 0.01)] * 3 + [("w", "a", "2020-01-31", 0.01),
                                                         ("one", "a", "2020-01-05", 0.01)])
    f = pat.user_frequency(tx)
    assert rows(f, "customer_id", "frequency") == [("w", "weekly")]


def test_category_order_and_age_edges(mk):
    art = mk(ART, [("1", "n", "g", "Top Dress")])
    assert pat.category_groups(art).collect()[0].category_group == "tops"
    cust = mk("customer_id string, age int", [(str(a), a) for a in [17, 18, 25, 26, 100, 101]] + [("n", None)])
    got = rows(pat.adult_users(cust), "customer_id", "age_group")
    assert got == [("100", "51-65"), ("18", "18-25"), ("25", "18-25"), ("26", "26-35")]


def _log(mk, a, b):
    rows_ = [("A", i < a[0]) for i in range(a[1])] + [("B", i < b[0]) for i in range(b[1])]
    return mk("grp string, clicked boolean", rows_).withColumn("purchase_count", F.lit(0))


def test_chi_square_published(mk):
    out = exp.ab_chi_square(_log(mk, (399, 511), (362, 489))).collect()[0]
    assert out.chi2 == pytest.approx(2.04009, abs=1e-5) and out.dof == 1
    from basketry.functions.stats import chi2_1dof_p
    assert chi2_1dof_p(out.chi2) == pytest.approx(0.15320, abs=1e-5)
    none = exp.ab_chi_square(_log(mk, (0, 5), (0, 4))).collect()[0]
    assert (none.chi2, none.dof) == (0.0, 0)


def test_t_test_and_lift(mk):
    log = mk("grp string, clicked boolean, purchase_count long",
             [("A", False, 1), ("A", False, 0), ("A", False, 2), ("B", False, 0), ("B", False, 1), ("B", False, 0)])
    t = exp.ab_t_test(log).collect()[0]
    assert (t.t_stat, t.dof) == (pytest.approx(1.0), 4)
    from basketry.functions.stats import t_two_sided_p
    assert t_two_sided_p(1.0, 4) == pytest.approx(0.3739, abs=1e-4)
    assert t_two_sided_p(1.2683, 998) == pytest.approx(0.20499, abs=1e-5)
    assert t_two_sided_p(1.5089, 998) == pytest.approx(0.13164, abs=1e-5)
    assert exp.ab_basic_stats(log).collect()[0].ctr_lift == 0.0


def test_sample_sizes_published(spark):
    from basketry.functions.stats import sample_size_proportion_expr, z_alpha, z_quantile

    def n(p, lift, power):
        df = spark.range(1).select(sample_size_proportion_expr(F.lit(p), F.lit(p * lift), z_alpha(0.05), z_quantile(power)))
        return df.collect()[0][0]
    assert (n(0.75, 0.05, 0.80), n(0.375, 0.05, 0.80)) == (1984, 10565)
    assert (n(0.75, 0.02, 0.80), n(0.375, 0.02, 0.80)) == (12815, 65664)
    assert (n(0.75, 0.05, 0.90), n(0.375, 0.05, 0.90)) == (2655, 14143)
    df = spark.range(1).select(sample_size_proportion_expr(F.lit(0.7808), F.lit(0.0405), z_alpha(0.05), z_quantile(0.8)))
    assert df.collect()[0][0] == 1525


def test_tree_score(mk):
    df = mk("purchase_count long, recency long, purchase_frequency_encoded long, popularity_rank long, sales_count long",
            [(1, 1, 0, 2000, 60), (1, 1, 0, 2000, 61)])
    got = [r.score for r in rk.score_with_model(df).collect()]
    assert got[0] == pytest.approx(0.02) and got[1] == pytest.approx(0.011316084950859709)


def test_predictions_and_recommendations(mk):
    p = mk("score double", [(0.8,), (0.6,), (0.3,), (0.9,)])
    ok = {r.check_name: r.passed for r in qual.validate_predictions(p, "score", 4).collect()}
    assert all(ok.values())
    bad = mk("score double", [(float("nan"),), (1.2,)])
    got = {r.check_name: r.passed for r in qual.validate_predictions(bad, "score", 2).collect()}
    assert got["nan"] is False and got["range_max"] is False
    recs = mk("customer_id string, article_id string",
              [("many", str(i)) for i in range(101)] + [("dup", "a"), ("dup", "a"), ("empty", "")])
    users = mk("customer_id string", [("many",), ("dup",), ("empty",), ("none",)])
    v = {(r.customer_id, r.check_name): r.passed for r in qual.validate_recommendations(recs, 1, 100, users).collect()}
    assert v[("none", "min_items")] is False and v[("many", "max_items")] is False
    assert v[("dup", "duplicates")] is False and v[("empty", "empty_ids")] is False


def test_reply_parsers(mk):
    resp = mk("event_id long, text string", [
        (0, "no json here"),
        (1, 'Here: {"style":"casual","frequency":"weekly","budget":"low","categories":["a","b","c","d"]} ok'),
        (2, '{"style":"punk","budget":"high"}'), (3, "{broken"),
        (4, "Purchase: 12, Satisfaction: 8"), (5, "  Yes, I would"), (6, "NO."), (7, "maybe")])
    js = {r.event_id: (r.style, r.frequency, r.budget, r.categories, r.rejected)
          for r in qual.salvage_json_column(resp).collect()}
    assert js[0] == ("casual", "occasionally", "medium", "tops,bottoms", True)
    assert js[1] == ("casual", "weekly", "low", "a,b,c", False)
    assert js[2] == ("casual", "occasionally", "high", "tops,bottoms", False)
    assert js[3][4] is True
    rt = {r.event_id: (r.purchase, r.satisfaction) for r in qual.rating_reply_parse(resp, 10).collect()}
    assert rt[4] == (10, 5) and rt[0] == (0, 3)
    yn = {r.event_id: r.answer for r in qual.yes_no_reply_parse(resp).collect()}
    assert (yn[5], yn[6], yn[7]) == ("yes", "no", "undecided")


def test_profile_text(mk):
    prof = mk("customer_id string, age_group string, purchase_frequency string, avg_price double, recency long",
              [("u", "30s", "high", 0.035, 3), ("v", "??", "x", 0.05, 45)])
    out = {r.customer_id: r.prompt for r in seg.profile_prompt_text(prof).collect()}
    assert seg.AGE_TRAITS["30s"] in out["u"] and "0.0350" in out["u"] and seg.RECENCY_WEEK in out["u"]
    assert seg.AGE_TRAIT_DEFAULT in out["v"] and "45" + seg.RECENCY_DAYS_SUFFIX in out["v"]


def test_percentile_exact(mk, spark):
    from basketry.functions.order import exact_percentile
    df = spark.range(0, 1001).select((F.col("id") * 1.5).alias("v"))
    assert exact_percentile(df, "v", 0.5).collect()[0][0] == 750.0
    even = spark.range(0, 10).select(F.col("id").cast("double").alias("v"))
    assert exact_percentile(even, "v", 0.5).collect()[0][0] == 4.5
    assert exact_percentile(even, "v", 0.5, method="histogram").collect()[0][0] == 4.5
    assert math.isclose(exact_percentile(even, "v", 0.25).collect()[0][0], 2.25)
