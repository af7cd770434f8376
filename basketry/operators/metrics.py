"""Ranking metrics per user (DCG, NDCG, hit rate, precision, recall, MRR) and their means.

One window pass ranks every user's rows by score; one aggregate per user computes all metrics for all
k at once. The ideal DCG of graded labels ranks the same rows by label in a second window over the same
partitioning. Discounts ``1 / log2(i + 1)`` come from a small table built from the largest k.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.windows import round_half_away

K_VALUES = [5, 10, 20, 50]
METRIC_DIGITS = 12


def _discounts(max_k: int) -> list[float]:
    return [1.0 / math.log2(i + 1) for i in range(1, max_k + 1)]


def per_user_metrics(rows: DataFrame, k_values: list[int] = K_VALUES, score: str = "score",
                     label: str = "label", item: str = "article_id", user: str = "customer_id") -> DataFrame:
    """Long table (customer_id, metric, k, value) for metric in dcg, ndcg, hit_rate, precision, recall, mrr."""
    max_k = max(k_values)
    disc_arr = F.array(*[F.lit(x) for x in _discounts(max_k)])
    w = Window.partitionBy(user).orderBy(F.col(score).desc(), F.col(item).asc(), F.col(label).desc())
    ideal = Window.partitionBy(user).orderBy(F.col(label).desc(), F.col(score).desc(), F.col(item).asc())
    r = rows.select(user, F.col(label).cast("long").alias("_l"), F.row_number().over(w).alias("_p"),
                    F.row_number().over(ideal).alias("_i"))
    gain = lambda place, k: F.sum(F.when(place <= k, F.col("_l") * F.element_at(disc_arr, place)))
    aggs = [F.sum(F.when(F.col("_l") > 0, 1).otherwise(0)).alias("_npos"), F.min(F.when(F.col("_l") > 0, F.col("_p"))).alias("_first")]
    for k in k_values:
        top = F.col("_p") <= k
        aggs += [gain(F.col("_p"), k).alias(f"_dcg{k}"), gain(F.col("_i"), k).alias(f"_idcg{k}"),
                 F.sum(F.when(top & (F.col("_l") > 0), 1).otherwise(0)).alias(f"_hit{k}")]
    g = r.groupBy(user).agg(*aggs)
    npos = F.col("_npos")
    out = []
    for k in k_values:
        dcg = F.coalesce(F.col(f"_dcg{k}"), F.lit(0.0))
        hits = F.coalesce(F.col(f"_hit{k}"), F.lit(0)).cast("double")
        idcg = F.coalesce(F.col(f"_idcg{k}"), F.lit(0.0))
        vals = {
            "dcg": dcg,
            "ndcg": F.when(idcg > 0, dcg / idcg).otherwise(F.lit(0.0)),
            "hit_rate": F.when(hits > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
            "precision": hits / F.lit(float(k)),
            "recall": F.when(npos > 0, hits / npos.cast("double")).otherwise(F.lit(0.0)),
            "mrr": F.when(F.col("_first") <= k, F.lit(1.0) / F.col("_first").cast("double")).otherwise(F.lit(0.0)),
        }
        out += [F.struct(F.lit(m).alias("metric"), F.lit(k).cast("long").alias("k"),
                         round_half_away(v, METRIC_DIGITS).alias("value")) for m, v in vals.items()]
    return g.select(user, F.inline(F.array(*out)))


def metric_at_k(rows: DataFrame, metric: str, k_values: list[int] = K_VALUES, **kw) -> DataFrame:
    """Keys 41-45, 47: one metric per user and k. Columns: customer_id, k, value."""
    return per_user_metrics(rows, k_values, **kw).filter(F.col("metric") == metric).drop("metric")


def evaluate_ranking(rows: DataFrame, k_values: list[int] = K_VALUES,
                     metrics: tuple[str, ...] = ("ndcg", "hit_rate", "precision", "recall"), **kw) -> DataFrame:
    """Key 46: unweighted mean over users of each metric at each k. Columns: metric, k, value."""
    pu = per_user_metrics(rows, k_values, **kw).filter(F.col("metric").isin(list(metrics)))
    return pu.groupBy("metric", "k").agg(round_half_away(F.avg("value"), METRIC_DIGITS).alias("value"))
