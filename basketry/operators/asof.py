"""Features as of a date and ranking data without leaks, on daily partial aggregates that merge.

``daily_purchases`` is the table that a daily load appends to: one row per customer, item and day. Every feature of any
window that ends on any day is an aggregate of these rows, so a training set can be built for an earlier date without
reading the transactions again. Labels come from the days after that date alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.order import global_row_number, hash_key
from basketry.functions.windows import day_diff, max_date, round_half_away, trailing_window
from basketry.operators.features import frequency_band, frequency_encoded
from basketry.operators.ranking import FEATURES, ranking_positives, ranking_user_sample


def daily_purchases(tx: DataFrame) -> DataFrame:
    """(customer_id, article_id, t_dat, n, spent): rows and money per customer, item and day. Tables of separate days are
    put together by ``unionByName``; rows of one key from several loads add up in every reader."""
    return tx.groupBy("customer_id", "article_id", "t_dat").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("spent"))


def _window(daily: DataFrame, end: Column, days: int) -> DataFrame:
    return daily.filter((F.col("t_dat") <= end) & (F.col("t_dat") >= F.date_sub(end, int(days))))


def user_features_asof(daily: DataFrame, end: Column, lookback_days: int = 28) -> DataFrame:
    """Key 1 as of ``end``: nothing after that day counts, and recency is measured from it."""
    stats = _window(daily, end, lookback_days).groupBy("customer_id").agg(
        F.sum("n").alias("purchase_count"), F.countDistinct("article_id").alias("unique_items"), F.sum("spent").alias("spent"),
        F.max("t_dat").alias("last_purchase_date"), F.min("t_dat").alias("first_purchase_date"))
    return stats.select("customer_id", "purchase_count", "unique_items", round_half_away(F.col("spent") / F.col("purchase_count"), 2).alias("avg_price"),
                        day_diff(end, F.col("last_purchase_date")).alias("recency"),
                        frequency_band(F.col("purchase_count")).alias("purchase_frequency"), "last_purchase_date", "first_purchase_date")


def item_features_asof(daily: DataFrame, articles: DataFrame, end: Column, lookback_days: int = 7) -> DataFrame:
    """Key 3 as of ``end``."""
    stats = _window(daily, end, lookback_days).groupBy("article_id").agg(
        F.sum("n").alias("sales_count"), F.countDistinct("customer_id").alias("unique_customers"), F.sum("spent").alias("spent"),
        F.max("t_dat").alias("last_sold_date"))
    known = stats.join(articles.select("article_id", "prod_name"), "article_id")
    ranked = global_row_number(known, [F.col("sales_count").desc(), F.col("article_id").asc()], "popularity_rank")
    return ranked.select("article_id", "prod_name", "popularity_rank", "sales_count", "unique_customers",
                         round_half_away(F.col("spent") / F.col("sales_count"), 2).alias("avg_price"), "last_sold_date")


def catalogue_negatives(tx: DataFrame, users: DataFrame, articles: DataFrame, n: int = 15, window_days: int = 28,
                        seed: int | str = 42) -> DataFrame:
    """``n`` items per user (fewer if the catalogue has no more) from the whole catalogue that the user did not buy in the window.

    The catalogue is shuffled once, by md5 of item and seed, and numbered across all partitions. A user starts at a place
    given by the md5 of the user and takes the run of items from there on, around the end, without those bought. A run of
    ``n`` plus the number of items bought always has enough, so a user makes that many rows and never meets the catalogue.
    Columns: customer_id, article_id, label (0)."""
    items = articles.select("article_id").filter("article_id IS NOT NULL").distinct()
    size = items.agg(F.count(F.lit(1))).scalar()
    placed = global_row_number(items.withColumn("_h", hash_key("article_id", seed=seed)), [F.col("_h").asc(), F.col("article_id").asc()], "place")
    bought = (trailing_window(tx.select("customer_id", "article_id", "t_dat"), window_days).select("customer_id", "article_id").distinct()
              .join(users.select("customer_id"), "customer_id", "left_semi").join(items, "article_id", "left_semi"))
    many = bought.groupBy("customer_id").agg(F.count(F.lit(1)).alias("b"))
    start = F.conv(F.substring(hash_key("customer_id", seed=seed), 1, 8), 16, 10).cast("long")
    runs = users.select("customer_id").distinct().join(many, "customer_id", "left").withColumn("size", size).filter("size > 0").select(
        "customer_id", (start % F.col("size")).alias("start"), "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(int(n)) + F.coalesce("b", F.lit(0)), F.col("size")) - 1)).alias("j"))
    reached = runs.withColumn("place", (F.col("start") + F.col("j")) % F.col("size") + 1).join(placed.select("place", "article_id"), "place")
    new = reached.join(bought, ["customer_id", "article_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("customer_id").orderBy("j"))
    return new.withColumn("nth", nth).filter(F.col("nth") <= int(n)).select("customer_id", "article_id", F.lit(0).alias("label"))


def ranking_dataset_asof(tx: DataFrame, daily: DataFrame, articles: DataFrame, label_days: int = 28, sample_users: int | None = 10000,
                         pos_per_user: int = 3, negative_per_user: int = 5, user_lookback_days: int = 28, item_lookback_days: int = 7,
                         seed: int | str = 42, drop_without_positives: bool = True) -> DataFrame:
    """Key 31 without leaks: labels from the last ``label_days`` days, features as of the day before them.

    Negatives come from the whole catalogue, so rank does not give the label away. Users with fewer than ``pos_per_user``
    purchases have no positives and are left out, unless ``drop_without_positives`` is false. A user without a purchase by
    then has count 0, the recency of one day before the window and frequency 0; an item without sales ranks behind all sold."""
    last = int(label_days) - 1  # days back from the newest that hold labels
    end = F.date_sub(max_date(tx), int(label_days))
    users = ranking_user_sample(tx, sample_users, last, seed)
    pos = ranking_positives(tx, users, pos_per_user, last).select("customer_id", "article_id", "label")
    if drop_without_positives:
        users = pos.select("customer_id").distinct()
    neg = catalogue_negatives(tx, users, articles, int(negative_per_user) * int(pos_per_user), last, seed)
    uf = user_features_asof(daily, end, user_lookback_days).select(
        "customer_id", "purchase_count", "recency", frequency_encoded(F.col("purchase_frequency")).alias("purchase_frequency_encoded"))
    itf = item_features_asof(daily, articles, end, item_lookback_days).select("article_id", "popularity_rank", "sales_count")
    unsold = itf.agg(F.count(F.lit(1)) + 1).scalar()
    rows = pos.unionByName(neg).join(uf, "customer_id", "left").join(itf, "article_id", "left")
    default = {"purchase_count": F.lit(0), "recency": F.lit(int(user_lookback_days) + 1), "purchase_frequency_encoded": F.lit(0),
               "popularity_rank": unsold, "sales_count": F.lit(0)}
    return rows.select("customer_id", "article_id", "label", *[F.coalesce(c, default[c]).cast("long").alias(c) for c in FEATURES])
