"""Trailing-window helpers built on uncorrelated scalar subqueries (evaluated once per query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def max_date(df: DataFrame, col: str = "t_dat") -> Column:
    """``(SELECT max(col) FROM df)`` as a Column; Spark runs it once as a scalar subquery."""
    return df.select(F.max(F.col(col))).scalar()


def trailing_window(df: DataFrame, days: int, col: str = "t_dat", strict: bool = False,
                    anchor: DataFrame | None = None, dmax: Column | None = None) -> DataFrame:
    """Rows with ``col >= max(col) - days`` (inclusive: days + 1 calendar days).

    ``anchor`` is the table whose max defines the window end (defaults to ``df`` itself), or pass the
    end date itself as ``dmax``; ``strict`` switches to ``>`` for the one operator that uses it.
    """
    end = dmax if dmax is not None else max_date(anchor if anchor is not None else df, col)
    start = F.date_sub(end, int(days))
    cond = F.col(col) > start if strict else F.col(col) >= start
    return df.filter(cond)


def day_diff(end: Column, start: Column) -> Column:
    """Calendar-day difference as BIGINT (DATE inputs)."""
    return F.datediff(end, start).cast("long")


def round_half_away(x: Column, digits: int) -> Column:
    """``ROUND(x, d)`` on a DOUBLE the way the reference's engine does it: ``round(x * 10^d) / 10^d``.

    Spark's ``round`` works on the decimal text of the double (so 0.075 → 0.08), while scaling first
    rounds the binary value (0.075 * 100 = 7.4999… → 0.07). Using the scaled form keeps results equal.
    """
    scale = float(10 ** digits)
    return F.round(x.cast("double") * F.lit(scale), 0) / F.lit(scale)


def significant(x: Column, drop_bits: int = 12) -> Column:
    """``x`` rounded to ``53 - drop_bits`` significant bits, at any magnitude, for a report (after ranking and cutting).

    The same three operations on doubles give the same value in every engine, halves included, which a
    decimal format does not."""
    c = x.cast("double") * F.lit(2.0 ** drop_bits + 1.0)
    return c - (c - x)
