"""A/B experiments: hash sampling and assignment, readouts, tests and power planning.

Exposure logs are reduced by one aggregate per group (or per segment) and every statistic is a
column expression over that handful of rows; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.order import hash_key, top_k_list
from basketry.functions.stats import (
    chi2_p_value, sample_size_mean_expr, sample_size_proportion_expr, t_p_value, yates_term, z_alpha, z_quantile,
)

SIGNIFICANCE = 0.05
P_DIGITS = 9  # decimals of reported p-values


def experiment_user_sample(users: DataFrame, num_users: int, seed: int | str = 42) -> DataFrame:
    """Key 59: ``num_users`` users in md5(id || seed) order, with their position (repeatable)."""
    keyed = users.select("customer_id", hash_key("customer_id", seed=seed).alias("_h"))
    return top_k_list(keyed, [F.col("_h").asc(), F.col("customer_id").asc()], num_users).select("pos", "customer_id")


def experiment_assignment(users: DataFrame, experiment: str = "exp1") -> DataFrame:
    """Key 60: A/B by the first hex digit of md5(id || ':' || experiment); stable under repartitioning."""
    h = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(":" + experiment)))
    return users.select("customer_id", F.when(F.substring(h, 1, 1) < "8", "A").otherwise("B").alias("grp"))


def _group_sums(log: DataFrame, metric: str = "purchase_count", ts: str | None = None) -> DataFrame:
    """One row with everything the readouts need, from one pass over the log."""
    clk, x = F.col("clicked").cast("double"), F.col(metric).cast("double")
    out = [F.count(F.lit(1)).alias("n")]
    for g in ("A", "B"):
        on, k = F.col("grp") == g, g.lower()
        out += [F.count(F.when(on, 1)).alias(f"n_{k}"), F.avg(F.when(on, clk)).alias(f"ctr_{k}"),
                F.count(F.when(on & F.col("clicked"), 1)).alias(f"click_{k}"),
                F.count(F.when(on & ~F.col("clicked"), 1)).alias(f"noclick_{k}"),
                F.avg(F.when(on, x)).alias(f"mean_{k}"), F.var_samp(F.when(on, x)).alias(f"var_{k}")]
    if ts is not None:
        out += [F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    return log.agg(*out)


def _basic() -> dict[str, Column]:
    """Basic readouts as expressions over the row of ``_group_sums``."""
    a, b = F.col("ctr_a"), F.col("ctr_b")
    return {"total_users": F.col("n"), "group_a_size": F.col("n_a"), "group_b_size": F.col("n_b"), "group_a_ctr": a, "group_b_ctr": b,
            "ctr_difference": b - a, "ctr_lift": F.when(a > 0, (b - a) / a * 100.0).otherwise(F.lit(0.0)),
            "group_a_avg_purchases": F.col("mean_a"), "group_b_avg_purchases": F.col("mean_b")}


def _chi() -> dict[str, Column]:
    """Yates-corrected chi-square of the group × clicked table as expressions over the row of ``_group_sums``."""
    table = [[F.col("click_a"), F.col("noclick_a")], [F.col("click_b"), F.col("noclick_b")]]
    rows, cols = [x + y for x, y in table], [x + y for x, y in zip(*table)]
    n = rows[0] + rows[1]
    filled = lambda sums: sum(((s > 0).cast("int") for s in sums[1:]), (sums[0] > 0).cast("int"))
    dof = ((filled(rows) - 1) * (filled(cols) - 1)).cast("long")
    cells = [yates_term(table[i][j].cast("double"), rows[i].cast("double") * cols[j].cast("double") / n.cast("double"))
             for i in range(2) for j in range(2)]
    stat = F.when(dof > 0, cells[0] + cells[1] + cells[2] + cells[3]).otherwise(F.lit(0.0))
    return {"chi2": stat, "dof": dof, "a_click": table[0][0], "a_noclick": table[0][1], "b_click": table[1][0],
            "b_noclick": table[1][1]} | _p(chi2_p_value(stat, dof))


def _t() -> dict[str, Column]:
    """Pooled-variance t as expressions over the row of ``_group_sums``."""
    na, nb, ma, mb = (F.col(c) for c in ("n_a", "n_b", "mean_a", "mean_b"))
    dof = na + nb - 2
    sp2 = ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / dof
    t = (ma - mb) / F.sqrt(sp2 * (1.0 / na + 1.0 / nb))
    return {"t_stat": t, "dof": dof.cast("long"), "group_a_mean": ma, "group_b_mean": mb, "difference": mb - ma} | _p(
        t_p_value(t, dof.cast("double")))


def _p(p: Column) -> dict[str, Column]:
    """Whether a p-value is below the significance level, and the p-value with P_DIGITS decimals."""
    return {"significant": p < SIGNIFICANCE, "p_value": F.round(p, P_DIGITS)}


def _read(sums: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return sums.select(*[c.alias(k) for k, c in columns.items()])


def ab_basic_stats(log: DataFrame) -> DataFrame:
    """Key 62: users and CTR per group, difference, relative lift (%) and mean purchases per group."""
    return _read(_group_sums(log), _basic())


def ab_chi_square(log: DataFrame) -> DataFrame:
    """Key 63: group × clicked contingency table, chi-square with Yates' correction (2×2), dof, p-value, significance."""
    return _read(_group_sums(log), _chi())


def ab_t_test(log: DataFrame, metric: str = "purchase_count") -> DataFrame:
    """Key 64: pooled-variance two-sample t (A minus B) on ``metric``; difference is B − A; p-value, significance."""
    return _read(_group_sums(log, metric), _t())


def experiment_log_span(log: DataFrame, ts: str = "first_ts") -> DataFrame:
    """Key 66: records, first and last timestamp, and the span in minutes."""
    s = log.agg(F.count(F.lit(1)).alias("records"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    # wall-clock difference: independent of the session time zone for TIMESTAMP_NTZ input
    micros = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts"))
    return s.select("records", "first_ts", "last_ts", (micros.cast("double") / 60e6).alias("minutes"))


def ab_report(log: DataFrame, ts: str = "first_ts") -> DataFrame:
    """Key 65: every readout as (section, metric, value) rows, unfolded from the one row of one pass over the log."""
    micros = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts"))
    chi, t = _chi(), _t()
    parts = {"basic_stats": _basic(), "chi_square_test": {k: chi[k] for k in ("chi2", "p_value", "dof", "significant")},
             "t_test_purchases": {k: t[k] for k in ("t_stat", "p_value", "significant", "group_a_mean", "group_b_mean", "difference")},
             "data_summary": {"records": F.col("n"), "minutes": micros.cast("double") / 60e6}}
    return _group_sums(log, ts=ts).select(F.inline(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(k).alias("metric"), c.cast("double").alias("value"))
        for section, columns in parts.items() for k, c in columns.items()])))


def sample_size_proportion(log: DataFrame, seg_col, relative_lift: float = 0.05, alpha: float = 0.05,
                           power: float = 0.80, two_tailed: bool = True) -> DataFrame:
    """Key 67: per segment, the observed CTR as baseline and n per group for a relative lift."""
    za, zb = z_alpha(alpha, two_tailed), z_quantile(power)
    g = log.groupBy(seg_col.alias("seg")).agg(F.avg(F.col("clicked").cast("double")).alias("baseline"))
    mde = F.col("baseline") * F.lit(relative_lift)
    n = sample_size_proportion_expr(F.col("baseline"), mde, za, zb)
    return g.select("seg", "baseline", mde.alias("mde"), (F.col("baseline") + mde).alias("expected"),
                    n.alias("n_per_group"), (n * 2).alias("n_total"),
                    F.when(F.col("baseline") > 0, mde / F.col("baseline") * 100.0).otherwise(F.lit(0.0))
                    .alias("relative_lift"))


def sample_size_mean(log: DataFrame, seg_col, metric: str = "purchase_count", relative_lift: float = 0.05,
                     alpha: float = 0.05, power: float = 0.80, two_tailed: bool = True) -> DataFrame:
    """Key 68: per segment, mean and sample sd of ``metric`` and n per group for a relative lift."""
    za, zb = z_alpha(alpha, two_tailed), z_quantile(power)
    x = F.col(metric).cast("double")
    g = log.groupBy(seg_col.alias("seg")).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    mde = F.col("mean") * F.lit(relative_lift)
    n = sample_size_mean_expr(F.col("sd"), mde, za, zb)
    return g.select("seg", "mean", "sd", mde.alias("mde"),
                    F.when(F.col("sd") > 0, mde / F.col("sd")).otherwise(F.lit(0.0)).alias("cohen_d"),
                    n.alias("n_per_group"), (n * 2).alias("n_total"))


def experiment_power_plan(log: DataFrame, seg_col, target_lift: float = 0.05, alpha: float = 0.05,
                          power: float = 0.80, conversion_share: float = 0.5) -> DataFrame:
    """Key 69: per segment, CTR and conversion (share × CTR) plans; the larger n wins; compare it with
    the smaller observed group."""
    za, zb = z_alpha(alpha, True), z_quantile(power)
    g = log.groupBy(seg_col.alias("seg")).agg(
        F.avg(F.col("clicked").cast("double")).alias("ctr"),
        F.count(F.when(F.col("grp") == "A", 1)).alias("na"), F.count(F.when(F.col("grp") == "B", 1)).alias("nb"))
    ctr = F.col("ctr")
    conv = ctr * F.lit(conversion_share)
    n_ctr = sample_size_proportion_expr(ctr, ctr * F.lit(target_lift), za, zb)
    n_conv = sample_size_proportion_expr(conv, conv * F.lit(target_lift), za, zb)
    rec = F.greatest(n_ctr, n_conv)
    observed = F.least(F.col("na"), F.col("nb"))
    return g.select("seg", n_ctr.alias("n_ctr"), n_conv.alias("n_conversion"), rec.alias("n_recommended"),
                    (rec * 2).alias("n_total"), observed.alias("n_observed"),
                    (observed >= rec).alias("sufficient"))
