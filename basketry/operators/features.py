"""Feature tables and feature-store operators (user and item features over trailing windows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.order import global_row_number
from basketry.functions.windows import day_diff, max_date, round_half_away, trailing_window

# Purchase-frequency bands and their numeric encoding.
FREQ_HIGH_MIN = 10
FREQ_MEDIUM_MIN = 5
FREQ_ENCODING = {"low": 0, "medium": 1, "high": 2}


def frequency_band(count: Column, high: int = FREQ_HIGH_MIN, medium: int = FREQ_MEDIUM_MIN) -> Column:
    return F.when(count >= high, "high").when(count >= medium, "medium").otherwise("low")


def frequency_encoded(freq: Column) -> Column:
    """low 0, medium 1, high 2; anything else (or NULL) 0."""
    e = F.lit(0)
    for name, code in FREQ_ENCODING.items():
        e = F.when(freq == name, F.lit(code)).otherwise(e)
    return e.cast("long")


def user_features(tx: DataFrame, lookback_days: int = 28) -> DataFrame:
    """Key 1: per-customer purchase statistics over ``t_dat >= max(t_dat) - lookback_days``."""
    win = trailing_window(tx.select("customer_id", "article_id", "t_dat", "price"), lookback_days)
    dmax = max_date(tx)  # the window's max is the table max
    stats = win.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("purchase_count"),
        F.countDistinct("article_id").alias("unique_items"),
        F.avg("price").alias("avg_price_raw"),
        F.max("t_dat").alias("last_purchase_date"),
        F.min("t_dat").alias("first_purchase_date"))
    return stats.select(
        "customer_id", "purchase_count", "unique_items",
        round_half_away(F.col("avg_price_raw"), 2).alias("avg_price"),
        day_diff(dmax, F.col("last_purchase_date")).alias("recency"),
        frequency_band(F.col("purchase_count")).alias("purchase_frequency"),
        "last_purchase_date", "first_purchase_date")


def user_feature_stats(uf: DataFrame) -> DataFrame:
    """Key 2: one row of totals and users per frequency band."""
    band = F.col("purchase_frequency")
    return uf.agg(
        F.count(F.lit(1)).alias("total_users"),
        F.avg(F.col("purchase_count").cast("double")).alias("avg_purchases"),
        F.count(F.when(band == "high", 1)).alias("high_freq_users"),
        F.count(F.when(band == "medium", 1)).alias("medium_freq_users"),
        F.count(F.when(band == "low", 1)).alias("low_freq_users"))


def item_features(tx: DataFrame, articles: DataFrame, lookback_days: int = 7) -> DataFrame:
    """Key 3: per-item sales over the trailing window, restricted to known articles, with a global
    popularity rank (sales desc, then article_id asc as the tie-break)."""
    win = trailing_window(tx.select("customer_id", "article_id", "t_dat", "price"), lookback_days)
    stats = win.groupBy("article_id").agg(
        F.count(F.lit(1)).alias("sales_count"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.avg("price").alias("avg_price_raw"),
        F.max("t_dat").alias("last_sold_date"))
    known = stats.join(articles.select("article_id", "prod_name"), "article_id", "inner")
    ranked = global_row_number(known, [F.col("sales_count").desc(), F.col("article_id").asc()],
                               "popularity_rank")
    return ranked.select("article_id", "prod_name", "popularity_rank", "sales_count", "unique_customers",
                         round_half_away(F.col("avg_price_raw"), 2).alias("avg_price"), "last_sold_date")


def item_feature_stats(itf: DataFrame, top_n: int = 100) -> DataFrame:
    """Key 4."""
    return itf.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.avg(F.col("sales_count").cast("double")).alias("avg_sales"),
        F.max("sales_count").alias("max_sales"),
        F.min("sales_count").alias("min_sales"),
        F.count(F.when(F.col("popularity_rank") <= top_n, 1)).alias("top_100_items"))


def user_feature_lookup(uf: DataFrame, user_ids: DataFrame | None = None) -> DataFrame:
    """Key 5: all user features, or those whose id appears in ``user_ids`` (column ``customer_id``),
    with ``purchase_frequency_encoded``. The id list is applied as a left-semi join, so it can be any
    size (Spark broadcasts it only when AQE measures it small)."""
    out = uf if user_ids is None else uf.join(user_ids.select("customer_id"), "customer_id", "left_semi")
    return out.withColumn("purchase_frequency_encoded", frequency_encoded(F.col("purchase_frequency")))


def item_feature_lookup(itf: DataFrame, item_ids: DataFrame | None = None) -> DataFrame:
    """Key 6."""
    return itf if item_ids is None else itf.join(item_ids.select("article_id"), "article_id", "left_semi")


def top_items(itf: DataFrame, top_k: int = 100) -> DataFrame:
    """Key 7: ``popularity_rank <= top_k`` (a filter, not a sort: ranks are already global)."""
    return itf.filter(F.col("popularity_rank") <= int(top_k))


def feature_store_stats(uf: DataFrame, itf: DataFrame) -> DataFrame:
    """Key 8: user and item totals in one row. The item side enters as scalar subqueries, which
    Spark merges into a single aggregate over the item table."""
    sales = F.col("sales_count")
    return uf.agg(F.count(F.lit(1)).alias("total_users"),
                  round_half_away(F.avg(F.col("purchase_count").cast("double")), 2).alias("avg_purchases")).select(
        "total_users", "avg_purchases",
        itf.select(F.count(F.lit(1))).scalar().alias("total_items"),
        itf.select(round_half_away(F.avg(sales.cast("double")), 2)).scalar().alias("avg_sales"),
        itf.select(F.max(sales)).scalar().alias("max_sales"))


def refresh_features(tx: DataFrame, articles: DataFrame, out_dir: str,
                     user_lookback_days: int = 28, item_lookback_days: int = 7) -> DataFrame:
    """Key 9: rebuild both feature tables, write them as Parquet and report row counts read back."""
    spark = tx.sparkSession
    out_dir = out_dir.rstrip("/")
    user_features(tx, user_lookback_days).write.mode("overwrite").parquet(f"{out_dir}/user_features.parquet")
    item_features(tx, articles, item_lookback_days).write.mode("overwrite").parquet(
        f"{out_dir}/item_features.parquet")
    counts = [spark.read.parquet(f"{out_dir}/{name}.parquet").agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("table_name"), "row_count")
              for name in ("user_features", "item_features")]
    return counts[0].unionByName(counts[1])
