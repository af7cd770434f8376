"""Distributions, drift and experiment readouts from one scan; p-values without Python."""

import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from basketry.functions.stats import chi2_1dof_p, chi2_p_value, t_p_value, t_two_sided_p
from basketry.operators import patterns as pat
from basketry.plans import registry as R

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_scan_of_the_transactions(spark):
    """Only the transactions have a price; the drift's second scan reads the date alone, for its maximum."""
    for key, dates in (("shopping_patterns_rows", 1), ("shopping_patterns_json", 1), ("distribution_drift", 2)):
        lines = [x for x in optimized(E.queries()[key](spark, SF)).splitlines() if "Relation [" in x and "t_dat" in x]
        assert len(lines) == dates, key


def test_report_reads_the_log_once(spark):
    log = R.load_tables(spark, SF).experiment_log
    from basketry.operators.experiments import ab_report
    p = optimized(ab_report(log))
    assert p.count("Relation [") == optimized(log).count("Relation [")


@pytest.mark.parametrize("key", ["ab_chi_square", "ab_t_test", "ab_report"])
def test_tails_run_without_python(spark, key):
    assert "Python" not in E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tails_match_plain_forms(spark):
    stats = [0.0, 1e-9, 0.01, 0.5, 1.0, 2.04009, 3.841458820694124, 10.0, 40.0, 300.0]
    df = spark.createDataFrame([(x,) for x in stats], "x double")
    for x, p in df.select("x", chi2_p_value(F.col("x"), F.lit(1))).collect():
        assert p == pytest.approx(chi2_1dof_p(x), rel=1e-12), x
    cases = [(t, n) for t in (0.0, 0.01, 0.3, 1.2683, -1.5089, 2.5, 8.0, 30.0) for n in (1.0, 2.0, 4.0, 30.0, 998.0, 20_000.0)]
    df = spark.createDataFrame(cases, "t double, n double")
    for t, n, p in df.select("t", "n", t_p_value(F.col("t"), F.col("n"))).collect():
        assert p == pytest.approx(t_two_sided_p(t, n), rel=1e-10, abs=1e-300), (t, n)
    # closed forms, and the normal limit for more users than a continued fraction with 400 steps can follow
    one = spark.createDataFrame([(2.0, 1.0, 1 - 2 / math.pi * math.atan(2.0)), (3.0, 2.0, 1 - 3 / math.sqrt(11)),
                                 # a tiny t, where the incomplete beta's argument rounds to 1
                                 (1e-6, 30.0, 1 - 2e-6 * math.exp(math.lgamma(15.5) - math.lgamma(15.0)) / math.sqrt(30 * math.pi)),
                                 (1.7, 4e9, math.erfc(1.7 / math.sqrt(2)))], "t double, n double, p double")
    for r in one.select("p", t_p_value(F.col("t"), F.col("n")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=1e-8 if r.p < 0.09 else 1e-9)


def test_tails_of_nothing_are_nan_or_one(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, 1), (inf, 1), (None, 1), (2.0, 0)], "x double, n int")
    got = [r[0] for r in df.select(chi2_p_value(F.col("x"), F.col("n"))).collect()]
    assert all(math.isnan(v) for v in got[:3]) and got[3] == 1.0
    df = spark.createDataFrame([(nan, 3.0), (inf, 3.0), (None, 3.0), (2.0, 0.0), (2.0, None)], "t double, n double")
    assert all(math.isnan(r[0]) for r in df.select(t_p_value(F.col("t"), F.col("n"))).collect())


def tables(mk, tx):
    tx = mk("customer_id string, article_id string, t_dat date, price double", tx)
    customers = mk("customer_id string, age int", [("a", 20), ("b", 40), ("c", None), ("d", 15)])
    articles = mk("article_id string, product_type_name string", [("1", "Dress"), ("2", "Boot"), ("3", "Lamp")])
    return tx, customers, articles


def day(n):
    import datetime
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_counts_of_a_small_table(mk):
    """Unknown items, customers, ages, prices and dates take part where they are not needed."""
    rows = [("a", "1", day(0), 0.01), ("a", "1", day(0), 0.01), ("a", "2", day(15), 0.05), ("b", "3", day(3), 0.03),
            ("b", "9", day(3), 0.03), ("c", "1", day(0), None), ("c", "2", day(60), 0.0), (None, "2", day(1), 0.02),
            ("d", None, None, 0.03), ("zz", "1", day(5), 0.01)]
    tx, customers, articles = tables(mk, rows)
    got = {(r.section, r.outer_key, r.inner_key): r.cnt for r in pat.pattern_counts(tx, customers, articles).collect()}
    assert got == {
        ("age_price_distribution", "18-25", "low"): 2, ("age_price_distribution", "18-25", "high"): 1,
        ("age_price_distribution", "36-50", "medium"): 2,
        ("age_category_distribution", "18-25", "dresses"): 2, ("age_category_distribution", "18-25", "shoes"): 1,
        ("price_frequency_distribution", "medium", "weekly"): 1,
        ("purchase_frequency_distribution", None, "weekly"): 1, ("purchase_frequency_distribution", None, "monthly"): 1,
        ("category_distribution", None, "dresses"): 4, ("category_distribution", None, "shoes"): 3,
        ("transactions", None, None): 10}
    # the single distributions agree
    for df, section, outer, inner, n in (
            (pat.age_price_distribution(tx, customers), "age_price_distribution", "age_group", "price_tier", "cnt"),
            (pat.age_category_distribution(tx, customers, articles), "age_category_distribution", "age_group", "category_group", "cnt"),
            (pat.price_frequency_distribution(tx), "price_frequency_distribution", "price_tier", "frequency", "cnt")):
        assert {(section, r[outer], r[inner]): r[n] for r in df.collect()} == {k: v for k, v in got.items() if k[0] == section}
    doc = pat.shopping_patterns_json(tx, customers, articles).first()
    assert (doc.transactions, doc.users, doc.items) == (10, 2, 3)
    assert json.loads(doc.patterns)["overall_category"] == {"dresses": 400 / 7, "shoes": 300 / 7}


def test_drift_axes(mk):
    old = [("a", "1", day(i), 0.01) for i in (0, 30)] + [("b", "2", day(1), 0.05)]
    new = [("a", "2", day(500 + i), 0.05) for i in (0, 1, 2)] + [("b", "2", day(502), 0.05), ("b", "2", None, 0.01)]
    tx, customers, articles = tables(mk, old + new)
    got = {(r.section, r.outer_key, r.inner_key): (r.share_a, r.share_b, r["diff"]) for r in
           pat.distribution_drift(tx, customers, articles, 100).collect()}
    assert got[("age_price_distribution", "18-25", "low")] == (100.0, 0.0, -100.0)
    assert got[("age_price_distribution", "18-25", "high")] == (0.0, 100.0, 100.0)
    assert got[("purchase_frequency_distribution", None, "monthly")] == (100.0, 0.0, -100.0)
    assert got[("purchase_frequency_distribution", None, "weekly")] == (0.0, 100.0, 100.0)
    assert got[("category_distribution", None, "shoes")] == (pytest.approx(100 / 3), 100.0, pytest.approx(200 / 3))
    # a tier without a classified user in one half has no share there
    assert got[("price_frequency_distribution", "low", "monthly")] == (100.0, None, None)


def test_empty_tables(mk):
    tx, customers, articles = tables(mk, [])
    assert pat.shopping_patterns_rows(tx, customers, articles).count() == 0
    assert pat.distribution_drift(tx, customers, articles).count() == 0
    doc = pat.shopping_patterns_json(tx, customers, articles).first()
    assert doc.transactions == 0 and set(map(len, json.loads(doc.patterns).values())) == {0}
