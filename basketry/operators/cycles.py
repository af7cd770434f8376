"""Purchase-cycle analysis: days between consecutive purchase rows per customer.

The mean of a customer's consecutive gaps telescopes to ``(last - first) / (rows - 1)``, so per-user
means need no window at all: one partial aggregate per customer, immune to a hot customer. Only the
median of individual gaps needs the gaps themselves; there rows are first collapsed to distinct
(customer, day) pairs, so a customer's window partition is bounded by calendar days, not purchases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.order import exact_percentile, merge_rows
from basketry.functions.windows import round_half_away, trailing_window

# Cycle buckets (upper bound in days, label) and purchase-count segments.
CYCLE_BUCKETS = [(7, "1주 이내"), (14, "1-2주"), (30, "2주-1개월"), (60, "1-2개월"), (90, "2-3개월")]
CYCLE_BUCKET_LAST = "3개월 이상"
FREQUENCY_SEGMENTS = [(20, "VIP (20회 이상)"), (10, "고빈도 (10-19회)"), (5, "중빈도 (5-9회)")]
FREQUENCY_SEGMENT_LAST = "저빈도 (2-4회)"


def user_cycles(tx: DataFrame, drop_null_customers: bool = True) -> DataFrame:
    """Per customer with >= 2 purchase rows: mean gap in days and the number of rows."""
    t = tx.select("customer_id", "t_dat")
    if drop_null_customers:
        t = t.filter(F.col("customer_id").isNotNull())
    g = t.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.min("t_dat").alias("first"), F.max("t_dat").alias("last"))
    return (g.filter(F.col("n_rows") >= 2)
             .select("customer_id", "n_rows",
                     (F.datediff("last", "first").cast("double") / (F.col("n_rows") - 1)).alias("avg_cycle")))


def cycle_overall(tx: DataFrame) -> DataFrame:
    """Key 48: users with repeat purchases; mean, median, min, max, sample stddev of per-user means."""
    uc = user_cycles(tx)
    med = exact_percentile(uc, "avg_cycle", 0.5, method="sort", alias="median_raw")
    stats = uc.agg(F.count(F.lit(1)).alias("users"), F.avg("avg_cycle").alias("a"),
                   F.min("avg_cycle").alias("mn"), F.max("avg_cycle").alias("mx"),
                   F.stddev_samp("avg_cycle").alias("sd"))
    return merge_rows(stats, med).select(
        "users", round_half_away(F.col("a"), 2).alias("avg_cycle"),
        round_half_away(F.col("median_raw"), 2).alias("median_cycle"),
        round_half_away(F.col("mn"), 2).alias("min_cycle"),
        round_half_away(F.col("mx"), 2).alias("max_cycle"),
        round_half_away(F.col("sd"), 2).alias("stddev_cycle"))


def _bucket_cols(value, bounds, last_label):
    num = F.lit(len(bounds) + 1)
    label = F.lit(last_label)
    for i, (b, lab) in reversed(list(enumerate(bounds, start=1))):
        num = F.when(value <= b, F.lit(i)).otherwise(num)
        label = F.when(value <= b, F.lit(lab)).otherwise(label)
    return num.cast("long"), label


def cycle_distribution(tx: DataFrame) -> DataFrame:
    """Key 49: users per bucket of mean cycle, percent of all users, mean cycle in the bucket."""
    uc = user_cycles(tx)
    num, label = _bucket_cols(F.col("avg_cycle"), CYCLE_BUCKETS, CYCLE_BUCKET_LAST)
    g = (uc.select(num.alias("bucket"), label.alias("cycle_range"), "avg_cycle")
           .groupBy("bucket", "cycle_range")
           .agg(F.count(F.lit(1)).alias("user_count"), F.avg("avg_cycle").alias("a")))
    # at most 6 rows: the global window is over the aggregated buckets only
    total = F.sum("user_count").over(Window.partitionBy(F.lit(1)))
    return g.select("bucket", "cycle_range", "user_count",
                    (F.col("user_count").cast("double") * 100.0 / total).alias("pct"),
                    round_half_away(F.col("a"), 2).alias("avg_cycle"))


def cycle_by_frequency(tx: DataFrame) -> DataFrame:
    """Key 50: users banded by purchase rows (gaps + 1)."""
    uc = user_cycles(tx)
    n = F.col("n_rows")
    num = F.lit(len(FREQUENCY_SEGMENTS) + 1)
    label = F.lit(FREQUENCY_SEGMENT_LAST)
    for i, (b, lab) in reversed(list(enumerate(FREQUENCY_SEGMENTS, start=1))):
        num = F.when(n >= b, F.lit(i)).otherwise(num)
        label = F.when(n >= b, F.lit(lab)).otherwise(label)
    return (uc.select(num.cast("long").alias("bucket"), label.alias("segment"), "avg_cycle")
              .groupBy("bucket", "segment")
              .agg(F.count(F.lit(1)).alias("user_count"),
                   round_half_away(F.avg("avg_cycle"), 2).alias("avg_cycle"),
                   round_half_away(F.min("avg_cycle"), 2).alias("min_cycle"),
                   round_half_away(F.max("avg_cycle"), 2).alias("max_cycle")))


def gap_histogram(tx: DataFrame) -> DataFrame:
    """(customer_id, gap, n): how many consecutive-row gaps of each length every customer has.

    Same-day repeats give ``rows_that_day - 1`` zero gaps; consecutive distinct days give one gap each.
    """
    days = tx.groupBy("customer_id", "t_dat").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("customer_id").orderBy("t_dat")
    steps = (days.withColumn("prev", F.lag("t_dat").over(w))
                 .filter(F.col("prev").isNotNull())
                 .select("customer_id", F.datediff("t_dat", "prev").cast("long").alias("gap"), F.lit(1).alias("n")))
    zeros = (days.filter(F.col("c") > 1)
                 .select("customer_id", F.lit(0).cast("long").alias("gap"), (F.col("c") - 1).alias("n")))
    return steps.unionByName(zeros).groupBy("customer_id", "gap").agg(F.sum("n").alias("n"))


def cycle_recent_users(tx: DataFrame, recent_days: int = 30) -> DataFrame:
    """Key 51: customers with a purchase in the last N days; count, mean and median of their gaps."""
    recent = trailing_window(tx.select("customer_id", "t_dat"), recent_days).select("customer_id").distinct()
    t = tx.select("customer_id", "t_dat").join(recent, "customer_id", "left_semi")
    hist = gap_histogram(t)
    by_gap = hist.groupBy("gap").agg(F.sum("n").alias("n"))  # small: one row per distinct gap length
    med = exact_percentile(by_gap, "gap", 0.5, method="histogram", alias="med", weight="n")
    # count and mean need no gaps: per customer, gaps sum to last - first and number rows - 1
    per = (t.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("t_dat").alias("first"),
                                        F.max("t_dat").alias("last"))
            .filter(F.col("n_rows") >= 2))
    stats = per.agg(F.count("customer_id").alias("active_users"),  # NULL customers are not counted as users
                    (F.sum(F.datediff("last", "first")).cast("double") / F.sum(F.col("n_rows") - 1)).alias("a"))
    return merge_rows(stats, med).select("active_users", round_half_away(F.col("a"), 2).alias("avg_cycle"),
                                         round_half_away(F.col("med"), 2).alias("median_cycle"))
