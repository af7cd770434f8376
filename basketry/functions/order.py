"""Deterministic orderings and exact global ranks/percentiles without a single-partition window.

``row_number().over(Window.orderBy(...))`` with no partition key plans ``Exchange SinglePartition``:
the whole table goes through one task. ``global_row_number`` instead range-sorts the data across all
partitions, records each row's partition and position, checkpoints that (so the partition layout is
fixed even if executors are lost and stages re-run), and adds the size of all earlier partitions,
taken from a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir


def hash_key(*cols: Column | str, seed: str | int | None = None) -> Column:
    """md5 hex of the concatenated columns (and seed): a repeatable pseudo-random order key.

    Equal in Spark and DuckDB, independent of partitioning, unlike ``rand()``.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    parts = [p.cast("string") for p in parts]
    if seed is not None:
        parts.append(F.lit(str(seed)))
    return F.md5(F.concat(*parts))


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact 1-based ``row_number() OVER (ORDER BY order)`` for the whole table, computed in parallel.

    ``order`` must end in a unique key so the result is deterministic. ``total`` names an optional
    column with the table's row count (the sum of the partition sizes, no extra pass).
    """
    ensure_checkpoint_dir(df.sparkSession)
    pos = (df.orderBy(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id())
             .checkpoint(eager=True))
    sizes = pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the partition count, so the tiny window and broadcast are safe
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding,
                                                              Window.unboundedFollowing)).alias("_total"))
    out = pos.join(F.broadcast(offsets), "_pid").withColumn(
        name, (F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33) + 1).cast("long"))
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_pid", "_mid", "_off", "_total")


def exact_percentile(df: DataFrame, col: str, p: float = 0.5, method: str = "sort",
                     alias: str | None = None, weight: str | None = None) -> DataFrame:
    """Exact ``percentile_cont(p)`` of ``col`` over the whole table as a one-row DataFrame.

    ``method='histogram'`` groups equal values first (right for integer days: the distinct-value table
    is small); ``method='sort'`` groups them too and ranks the distinct values across all partitions, for
    arbitrary doubles. ``weight`` names a column of row multiplicities.
    """
    alias = alias or f"p{int(p * 100)}_{col}"
    w_col = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    vals = df.select(F.col(col).cast("double").alias("v"), w_col.alias("_w")).filter(F.col("v").isNotNull())
    if method == "histogram":
        # the histogram has one row per distinct value (small by the method's precondition), so the
        # two windows below run over it, not over the data; no scalar subquery is needed
        hist = vals.groupBy("v").agg(F.sum("_w").alias("c"))
        cum_w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        all_w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        hist = (hist.withColumn("cum", F.sum("c").over(cum_w)).withColumn("n", F.sum("c").over(all_w))
                    .withColumn("start", F.col("cum") - F.col("c"))
                    .withColumn("x", (F.col("n") - 1) * F.lit(p)))
        lo, hi = F.floor(F.col("x")), F.ceil(F.col("x"))
        pick = lambda pos: F.max(F.when((F.col("start") <= pos) & (pos < F.col("cum")), F.col("v")))
        return hist.agg(pick(lo).alias("vlo"), pick(hi).alias("vhi"), F.max(F.col("x") - lo).alias("frac")).select(
            (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias(alias))
    # equal values become one row first, so a value that many rows share never meets in one range
    runs = global_running_sum(vals.groupBy("v").agg(F.sum("_w").alias("c")), [F.col("v").asc()], "c", "end", "n")
    x = (F.col("n") - 1) * F.lit(p)
    pick = lambda pos: F.max(F.when((F.col("end") - F.col("c") < pos) & (pos <= F.col("end")), F.col("v")))
    return runs.agg(pick(F.floor(x) + 1).alias("vlo"), pick(F.ceil(x) + 1).alias("vhi"),
                    F.max(x - F.floor(x)).alias("frac")).select(
        (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias(alias))


def global_running_sum(df: DataFrame, order: list[Column], value: str, name: str, total: str) -> DataFrame:
    """Exact ``sum(value) OVER (ORDER BY order)`` and the total, computed in parallel like
    ``global_row_number``: running sums per range partition plus the sums of earlier partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    pos = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    offsets = pos.groupBy("_pid").agg(F.sum(value).alias("_s")).select(
        "_pid", F.coalesce(F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    # a window per range partition: bounded by the partition's size
    inside = F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pos.withColumn(name, inside).join(F.broadcast(offsets), "_pid").withColumn(
        name, F.col(name) + F.col("_off")).drop("_pid", "_off")


def top_k_list(df: DataFrame, order: list[Column], k: int, pos: str = "pos") -> DataFrame:
    """First ``k`` rows in ``order`` with a 1-based position column.

    ``orderBy().limit(k)`` plans TakeOrderedAndProject (per-partition top-k, then a merge of at most
    k rows per partition), so the result is bounded by ``k`` and safe to broadcast afterwards.
    """
    top = df.orderBy(*order).limit(int(k))
    w = Window.orderBy(*order)
    # the window runs over at most k rows (already reduced by the limit)
    return top.withColumn(pos, F.row_number().over(w).cast("long"))


def merge_rows(*dfs: DataFrame) -> DataFrame:
    """Put one-row DataFrames with disjoint columns side by side, without a join: union them with
    NULLs for the missing columns and take ``max`` of each column (NULLs are ignored)."""
    fields = {}
    for df in dfs:
        for f in df.schema.fields:
            fields.setdefault(f.name, f.dataType)
    parts = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()])
             for df in dfs]
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.agg(*[F.max(c).alias(c) for c in fields])
