"""Data-quality checks, column profiles and cleaning of free-text replies.

Every validator makes one aggregate pass over its input and returns a violations table
``(check_name, column_name, severity, observed, limit_value, passed)``: the checks are data, not
exceptions, so they run inside a distributed job and can be stored or joined like any other result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def _check(name: str, column: str, severity: str, observed: Column, limit: Column | float | None,
           passed: Column) -> Column:
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    return F.struct(F.lit(name).alias("check_name"), F.lit(column).alias("column_name"),
                    F.lit(severity).alias("severity"), observed.cast("double").alias("observed"),
                    lim.cast("double").alias("limit_value"), passed.alias("passed"))


def _rows(agg_row: DataFrame, checks: list[Column]) -> DataFrame:
    return agg_row.select(F.inline(F.array(*checks)))


def validate_table(df: DataFrame, required_columns: list[str], min_rows: int = 1,
                   check_nulls: bool = True) -> DataFrame:
    """Key 70: row minimum (error), required columns present (error), NULLs per column (warn)."""
    present = [c for c in required_columns if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{i}") for i, c in enumerate(present)]
    a = df.agg(*aggs)
    checks = [_check("min_rows", "*", "error", F.col("_n"), float(min_rows), F.col("_n") >= min_rows)]
    for c in required_columns:
        ok = c in df.columns
        checks.append(_check("required_column", c, "error", F.lit(1.0 if ok else 0.0), 1.0, F.lit(ok)))
    if check_nulls:
        for i, c in enumerate(present):
            nulls = F.col(f"_null_{i}")
            checks.append(_check("nulls", c, "warn", nulls, 0.0, nulls == 0))
    return _rows(a, checks)


def validate_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Key 71: column min/max inside [lo, hi] (error); an absent column is a warning."""
    present = [c for c in ranges if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(present):
        aggs += [F.min(F.col(c)).cast("double").alias(f"_mn_{i}"), F.max(F.col(c)).cast("double").alias(f"_mx_{i}")]
    a = df.agg(*aggs)
    checks = []
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            i = present.index(c)
            mn, mx = F.col(f"_mn_{i}"), F.col(f"_mx_{i}")
            checks.append(_check("range_min", c, "error", mn, float(lo), F.coalesce(mn >= lo, F.lit(True))))
            checks.append(_check("range_max", c, "error", mx, float(hi), F.coalesce(mx <= hi, F.lit(True))))
        else:
            checks.append(_check("column_present", c, "warn", F.lit(0.0), 1.0, F.lit(False)))
    return _rows(a, checks)


USER_REQUIRED = ["customer_id", "purchase_count", "recency"]
USER_RANGES = {"purchase_count": (0.0, INF), "recency": (0.0, INF)}
ITEM_REQUIRED = ["article_id", "popularity_rank", "sales_count"]
ITEM_RANGES = {"popularity_rank": (1.0, INF), "sales_count": (0.0, INF)}


def validate_user_features(uf: DataFrame) -> DataFrame:
    """Key 72 (the never-written hour column is not required)."""
    return validate_table(uf, USER_REQUIRED, 1).unionByName(validate_ranges(uf, USER_RANGES))


def validate_item_features(itf: DataFrame) -> DataFrame:
    """Key 73."""
    return validate_table(itf, ITEM_REQUIRED, 1).unionByName(validate_ranges(itf, ITEM_RANGES))


def validate_predictions(preds: DataFrame, col: str, expected_length: Column | int,
                         check_range: bool = True) -> DataFrame:
    """Key 74: length equals the expected count, no NaN, no ±Inf (errors); outside [0, 1] warns."""
    x = F.col(col).cast("double")
    a = preds.agg(F.count(F.lit(1)).alias("_n"),
                  F.count(F.when(F.isnan(x), 1)).alias("_nan"),
                  F.count(F.when(F.abs(x) == F.lit(INF), 1)).alias("_inf"),
                  F.min(F.when(~F.isnan(x), x)).alias("_mn"), F.max(F.when(~F.isnan(x), x)).alias("_mx"))
    exp_len = expected_length if isinstance(expected_length, Column) else F.lit(int(expected_length))
    checks = [_check("length", col, "error", F.col("_n"), exp_len, F.col("_n") == exp_len),
              _check("nan", col, "error", F.col("_nan"), 0.0, F.col("_nan") == 0),
              _check("inf", col, "error", F.col("_inf"), 0.0, F.col("_inf") == 0)]
    if check_range:
        checks += [_check("range_min", col, "warn", F.col("_mn"), 0.0, F.coalesce(F.col("_mn") >= 0, F.lit(True))),
                   _check("range_max", col, "warn", F.col("_mx"), 1.0, F.coalesce(F.col("_mx") <= 1, F.lit(True)))]
    return _rows(a, checks)


def validate_recommendations(recs: DataFrame, min_items: int = 1, max_items: int = 100,
                             users: DataFrame | None = None) -> DataFrame:
    """Key 75: per user, list length within [min, max] (error), duplicates (warn), empty ids (error).

    ``users`` (optional) lists users that should have a list, so users with none get a failing row.
    """
    item = F.col("article_id")
    per_user = recs.groupBy("customer_id").agg(
        F.count(item).alias("_n"), F.countDistinct(item).alias("_d"),
        F.count(F.when(item.isNull() | (item == ""), 1)).alias("_empty"))
    if users is not None:
        per_user = users.select("customer_id").distinct().join(per_user, "customer_id", "left").fillna(
            0, ["_n", "_d", "_empty"])
    checks = [_check("min_items", "article_id", "error", F.col("_n"), float(min_items), F.col("_n") >= min_items),
              _check("max_items", "article_id", "error", F.col("_n"), float(max_items), F.col("_n") <= max_items),
              _check("duplicates", "article_id", "warn", F.col("_n") - F.col("_d"), 0.0, F.col("_n") == F.col("_d")),
              _check("empty_ids", "article_id", "error", F.col("_empty"), 0.0, F.col("_empty") == 0)]
    return per_user.select("customer_id", F.inline(F.array(*checks)))


def column_profile(df: DataFrame) -> DataFrame:
    """Key 76: per column its type, distinct count, NULL count, min and max (as strings).

    Distinct values are counted as (column, value) pairs that each task puts together first, so a row is not repeated
    for every column with all its other columns, and no column's values meet in one task."""
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggs, values = [], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(F.when(c.isNull(), 1)).alias(f"_z{i}"), F.min(c).cast("string").alias(f"_mn{i}"), F.max(c).cast("string").alias(f"_mx{i}")]
        # one text per value: both zeros of a float are one
        text = (c + F.lit(0.0).cast(f.dataType)) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c
        values.append(F.struct(F.lit(i).alias("i"), text.cast("string").alias("v")))
    pairs = df.select(F.inline(F.array(*values))).filter("v IS NOT NULL").groupBy("i", "v").agg(F.lit(1).alias("one"))
    distinct = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique"))
    rows = [F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.col(f"_z{i}").alias("nulls"), F.col(f"_mn{i}").alias("min_value"), F.col(f"_mx{i}").alias("max_value"))
            for i, f in enumerate(fields)]
    return df.agg(*aggs).select(F.inline(F.array(*rows))).join(distinct, "i", "left").select(
        "column_name", "data_type", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"), "nulls", "min_value", "max_value")


def sparse_users(tx: DataFrame, articles: DataFrame, min_count: int = 2, max_count: int = 10,
                 window_days: int = 60) -> DataFrame:
    """Key 78: users with ``min..max`` purchases strictly after max − N days, with their categories.

    Purchases are counted by (customer, item) before they meet the items, then by category, so a user is
    one short list of (category, count); it is spelled out only for users that pass the count filter.
    """
    from basketry.functions.windows import trailing_window
    recent = trailing_window(tx.select("customer_id", "article_id", "t_dat"), window_days, strict=True)
    bought = recent.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    per_cat = (bought.join(articles.select("article_id", F.col("product_group_name").alias("cat")), "article_id")
                     .groupBy("customer_id", "cat").agg(F.sum("n").alias("n")))
    users = per_cat.groupBy("customer_id").agg(F.sum("n").alias("cnt"), F.sort_array(F.collect_list(F.struct("cat", "n"))).alias("list"))
    spelled = F.flatten(F.transform(F.filter("list", lambda x: x["cat"].isNotNull()),
                                    lambda x: F.array_repeat(x["cat"], x["n"].cast("int"))))
    return users.filter(F.col("cnt").between(min_count, max_count)).select("customer_id", "cnt", F.array_join(spelled, ",").alias("cats"))


# ---------------------------------------------------------------------------------------------
# Free-text replies. Allowed enums and defaults of the profile JSON.
# ---------------------------------------------------------------------------------------------
STYLES = ["casual", "formal", "sporty", "trendy", "vintage"]
FREQUENCIES = ["weekly", "monthly", "occasionally"]
BUDGETS = ["low", "medium", "high"]
DEFAULT_STYLE, DEFAULT_FREQUENCY, DEFAULT_BUDGET = "casual", "occasionally", "medium"
DEFAULT_CATEGORIES = ["tops", "bottoms"]
MAX_CATEGORIES = 3

PROFILE_JSON_SCHEMA = T.StructType([
    T.StructField("style", T.StringType()), T.StructField("frequency", T.StringType()),
    T.StructField("budget", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())),
])


def _names(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def salvage_json_column(responses: DataFrame, text: str = "text", key: str | list[str] = "event_id") -> DataFrame:
    """Key 82: take the first '{' .. last '}' of each reply, parse it, force enums to their defaults,
    keep at most 3 categories; unparseable replies get the defaults and ``rejected = true``."""
    body = F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0)
    ok = (body != "") & F.try_parse_json(body).isNotNull()
    parsed = F.from_json(F.when(ok, body), PROFILE_JSON_SCHEMA)

    def enum(field, allowed, default):
        v = parsed.getField(field)
        return F.when(ok & v.isin(allowed), v).otherwise(F.lit(default))

    cats = parsed.getField("categories")
    cats = F.when(ok & cats.isNotNull() & (F.size(cats) >= 1), F.slice(cats, 1, MAX_CATEGORIES)).otherwise(
        F.array(*[F.lit(c) for c in DEFAULT_CATEGORIES]))
    return responses.select(*_names(key), enum("style", STYLES, DEFAULT_STYLE).alias("style"),
                            enum("frequency", FREQUENCIES, DEFAULT_FREQUENCY).alias("frequency"),
                            enum("budget", BUDGETS, DEFAULT_BUDGET).alias("budget"),
                            F.array_join(cats, ",").alias("categories"), (~ok).alias("rejected"))


def rating_reply_parse(responses: DataFrame, n_items: int = 10, text: str = "text",
                       key: str | list[str] = "event_id") -> DataFrame:
    """Key 83: ``Purchase: N`` capped at n (default 0), ``Satisfaction: N`` clamped to 1..5 (default 3)."""
    p = F.regexp_extract(F.col(text), r"Purchase:\s*(\d+)", 1)
    s = F.regexp_extract(F.col(text), r"Satisfaction:\s*(\d+)", 1)

    def as_int(d):  # digits only; a number of more than 18 digits counts as 10^18: both results are clamped far below
        return F.when(F.length(d) > 18, F.lit(10 ** 18)).otherwise(d.try_cast("long"))

    purchase = F.when(p != "", F.least(as_int(p), F.lit(n_items))).otherwise(F.lit(0)).cast("long")
    sat = F.when(s != "", F.greatest(F.lit(1), F.least(as_int(s), F.lit(5)))).otherwise(F.lit(3)).cast("long")
    return responses.select(*_names(key), purchase.alias("purchase"), sat.alias("satisfaction"),
                            ((p == "") | (s == "")).alias("defaulted"))


def yes_no_reply_parse(responses: DataFrame, text: str = "text", key: str | list[str] = "event_id") -> DataFrame:
    """Key 84: trimmed, lower-cased reply starting with yes / no, else undecided."""
    t = F.lower(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    ans = F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no").otherwise("undecided")
    return responses.select(*_names(key), ans.alias("answer"))
