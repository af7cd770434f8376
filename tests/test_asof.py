"""Features as of a date, catalogue-wide negatives, retail tables from files and from the catalog, profiles without Expand."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import asof
from basketry.operators import quality as qual
from basketry.operators.features import item_features, user_features
from basketry.plans import registry as R
from basketry.sources import load_catalog, load_files, load_tables, save_catalog, write_csv, write_parquet

SF = "/root/testdata/sf0.001"
TX = "customer_id string, article_id string, t_dat date, price double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_asof_today_is_the_plain_table_and_loads_merge(spark):
    t = load_tables(spark, SF)
    today = t.tx.agg(F.max("t_dat")).first()[0]
    daily = asof.daily_purchases(t.tx)
    assert rows(asof.user_features_asof(daily, F.lit(today))) == rows(user_features(t.tx))
    assert rows(asof.item_features_asof(daily, t.articles, F.lit(today))) == rows(item_features(t.tx, t.articles))
    even = F.dayofmonth("t_dat") % 2 == 0
    loads = asof.daily_purchases(t.tx.filter(even)).unionByName(asof.daily_purchases(t.tx.filter(~even)))
    assert rows(asof.user_features_asof(loads, F.lit(today))) == rows(user_features(t.tx))


def test_labels_never_enter_features(spark):
    """Other purchases after the date leave every feature as it is; the labels follow them."""
    t = load_tables(spark, SF)
    last = t.tx.agg(F.max("t_dat")).first()[0]
    end = F.date_sub(F.lit(last), 28)
    late = t.tx.filter(F.col("t_dat") > end)
    changed = t.tx.filter(F.col("t_dat") <= end).unionByName(late.withColumn("price", F.col("price") * 9)).unionByName(
        late.withColumn("article_id", F.lit("1")).withColumn("t_dat", F.lit(last)))
    for f in (lambda tx: asof.user_features_asof(asof.daily_purchases(tx), end),
              lambda tx: asof.item_features_asof(asof.daily_purchases(tx), t.articles, end)):
        assert rows(f(t.tx)) == rows(f(changed))
    ds = asof.ranking_dataset_asof(changed, asof.daily_purchases(changed), t.articles)
    feats = ["customer_id", "purchase_count", "recency", "purchase_frequency_encoded"]
    before = asof.user_features_asof(asof.daily_purchases(t.tx), end)
    seen = {r["customer_id"]: r for r in before.collect()}
    for r in ds.select(feats).distinct().collect():
        assert r["purchase_count"] == (seen[r["customer_id"]]["purchase_count"] if r["customer_id"] in seen else 0)
        assert r["recency"] == (seen[r["customer_id"]]["recency"] if r["customer_id"] in seen else 29)
    per = ds.groupBy("customer_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert per and all(r["p"] == 3 and r["n"] == 18 for r in per)


@pytest.mark.parametrize("n", [0, 3, 50])
def test_catalogue_negatives(spark, mk, n):
    """Every user gets n new items, or all there are; buyers of everything none; users without purchases too."""
    articles = spark.createDataFrame([(f"i{k:02d}",) for k in range(20)] * 2 + [(None,)], "article_id string")
    tx = mk(TX, [("a", f"i{k:02d}", "2024-01-05", 1.0) for k in range(12)] + [("a", "i01", "2024-01-04", 1.0), ("a", "gone", "2024-01-05", 1.0)]
            + [("all", f"i{k:02d}", "2024-01-05", 1.0) for k in range(20)] + [("old", "i03", "2020-01-01", 1.0)])
    users = spark.createDataFrame([("a",), ("all",), ("old",), ("new",), ("new",)], "customer_id string")
    got = {}
    for u, i, label in asof.catalogue_negatives(tx, users, articles, n).collect():
        got.setdefault(u, []).append(i)
        assert label == 0
    assert all(len(v) == len(set(v)) for v in got.values())
    assert len(got.get("a", [])) == min(n, 8) and len(got.get("new", [])) == len(got.get("old", [])) == min(n, 20) and "all" not in got
    assert not set(got.get("a", [])) & {f"i{k:02d}" for k in range(12)}


def test_negatives_grow_with_the_sample_not_the_catalogue(spark):
    t = load_tables(spark, SF)
    plan = asof.catalogue_negatives(t.tx, t.customers, t.articles, 15)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Cross" not in plan and "collect_list" not in plan
    users = t.customers.select("customer_id")
    assert asof.catalogue_negatives(t.tx, users, t.articles, 15).groupBy("customer_id").count().filter("count <> 15").count() == 0


def test_files_and_catalog_give_the_same_answers(spark, tmp_path):
    t = load_tables(spark, SF)
    write_csv(t.tx.select("t_dat", "customer_id", "article_id", "price"), f"{tmp_path}/tx")
    write_parquet(t.articles, f"{tmp_path}/articles", partition_by=None)
    for name, df in (("articles_csv", t.articles), ("customers", t.customers)):
        write_csv(df, f"{tmp_path}/{name}")
    files = load_files(spark, str(tmp_path), "tx", "articles_csv", "customers")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shop LOCATION '{tmp_path}/shop'")
    try:
        save_catalog(t, "shop", buckets=4)
        catalog = load_catalog(spark, "shop")
        for other in (files, catalog):
            for q in (R._uf, R._itf, R._segments, R._rds, lambda x: R._cooc(x, 365), R._recs):
                assert rows(q(other)) == rows(q(t))
        # the bucketed side of a group or join on the customer needs no exchange
        p = user_features(catalog.tx)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" not in p
        with pytest.raises(KeyError):
            catalog.exposures
    finally:
        spark.sql("DROP DATABASE shop CASCADE")


def test_profile_without_expand(spark):
    df = spark.createDataFrame([(1, 0.0, "a", None), (2, -0.0, "b", None), (None, float("nan"), "a", None), (1, None, "", None)],
                               "`a.b` int, d double, s string, z string")
    p = qual.column_profile(df)
    got = {r["column_name"]: (r["data_type"], r["n_unique"], r["nulls"], r["min_value"], r["max_value"]) for r in p.collect()}
    assert got == {"a.b": ("int", 2, 1, "1", "2"), "d": ("double", 2, 1, got["d"][3], "NaN"), "s": ("string", 3, 0, "", "b"), "z": ("string", 0, 4, None, None)}
    assert "Expand" not in p._jdf.queryExecution().optimizedPlan().toString()
    assert qual.column_profile(df.limit(0)).filter("n_unique <> 0").count() == 0
