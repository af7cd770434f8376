"""Shopping-pattern analysis: age × price tier, age × category, purchase frequency, price × frequency.

Transactions are reduced before every join: per (customer, price tier) for age × price, per
(customer, category group) for age × category, per customer for the frequency classes. The joins to
``customers`` therefore see at most a few rows per customer, and a customer holding a large share of
the rows costs no more than any other. ``pattern_counts`` gives all of them from one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.windows import max_date

# ---------------------------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------------------------
# Category groups by substring of product_type_name (SQL LIKE '%x%'), first match wins.
DEFAULT_CATEGORY_PATTERNS = [
    ("tops", ["T-shirt", "Top", "Blouse"]),
    ("bottoms", ["Trouser", "Jeans", "Shorts"]),
    ("dresses", ["Dress"]),
    ("shoes", ["Shoe", "Sneaker", "Boot"]),
    ("accessories", ["Bag", "Belt", "Hat", "Jewellery"]),
    ("outerwear", ["Jacket", "Coat", "Cardigan"]),
]
OTHER = "other"
# Age bands over ages 18..100 (the last label covers 51..100).
AGE_MIN, AGE_MAX = 18, 100
AGE_BANDS = [(25, "18-25"), (35, "26-35"), (50, "36-50")]
AGE_BAND_LAST = "51-65"
# Price tiers: < 0.02 low, < 0.04 medium, else high.
PRICE_TIERS = [(0.02, "low"), (0.04, "medium")]
PRICE_TIER_LAST = "high"
# Purchases per 30 days: >= 4 weekly, >= 1 monthly, else occasionally.
FREQUENCY_CLASSES = [(4.0, "weekly"), (1.0, "monthly")]
FREQUENCY_CLASS_LAST = "occasionally"


def category_group_of(name: Column, patterns=DEFAULT_CATEGORY_PATTERNS) -> Column:
    e = F.lit(OTHER)
    for group, subs in reversed(patterns):
        cond = None
        for sub in subs:
            c = name.contains(sub)
            cond = c if cond is None else (cond | c)
        e = F.when(cond, F.lit(group)).otherwise(e)
    return e


def category_groups(articles: DataFrame, patterns=DEFAULT_CATEGORY_PATTERNS) -> DataFrame:
    """Key 52: article_id → category_group."""
    return articles.select("article_id",
                           category_group_of(F.col("product_type_name"), patterns).alias("category_group"))


def age_band_of(age: Column) -> Column:
    e = F.lit(AGE_BAND_LAST)
    for b, lab in reversed(AGE_BANDS):
        e = F.when(age <= b, F.lit(lab)).otherwise(e)
    return e


def price_tier_of(price: Column) -> Column:
    e = F.lit(PRICE_TIER_LAST)
    for b, lab in reversed(PRICE_TIERS):
        e = F.when(price < b, F.lit(lab)).otherwise(e)
    return e


def frequency_class_of(per_month: Column) -> Column:
    e = F.lit(FREQUENCY_CLASS_LAST)
    for b, lab in reversed(FREQUENCY_CLASSES):
        e = F.when(per_month >= b, F.lit(lab)).otherwise(e)
    return e


def adult_users(customers: DataFrame) -> DataFrame:
    age = F.col("age")
    return (customers.filter(age.isNotNull() & age.between(AGE_MIN, AGE_MAX))
                     .select("customer_id", age_band_of(age).alias("age_group")))


def _pct_within(df: DataFrame, group_col: str, cnt: str = "cnt") -> Column:
    # df is already aggregated to a handful of rows per group
    return F.col(cnt).cast("double") * 100.0 / F.sum(cnt).over(Window.partitionBy(group_col))


def age_price_distribution(tx: DataFrame, customers: DataFrame) -> DataFrame:
    """Key 53: purchases per (age band, price tier) and percent within the band."""
    p = F.col("price")
    per_user = (tx.filter(p.isNotNull() & (p > 0))
                  .groupBy("customer_id", price_tier_of(p).alias("price_tier")).agg(F.count(F.lit(1)).alias("c")))
    g = (per_user.join(adult_users(customers), "customer_id")
                 .groupBy("age_group", "price_tier").agg(F.sum("c").alias("cnt")))
    return g.select("age_group", "price_tier", "cnt", _pct_within(g, "age_group").alias("pct"))


def age_category_distribution(tx: DataFrame, customers: DataFrame, articles: DataFrame,
                              patterns=DEFAULT_CATEGORY_PATTERNS) -> DataFrame:
    """Key 54: purchases per (age band, category group), ``other`` excluded, percent within the band."""
    items = category_groups(articles, patterns).filter(F.col("category_group") != OTHER)
    # purchases are counted by (customer, item) before they meet the items
    bought = tx.groupBy("customer_id", "article_id").agg(F.count(F.lit(1)).alias("n"))
    per_user = bought.join(items, "article_id").groupBy("customer_id", "category_group").agg(F.sum("n").alias("c"))
    g = (per_user.join(adult_users(customers), "customer_id")
                 .groupBy("age_group", "category_group").agg(F.sum("c").alias("cnt")))
    return g.select("age_group", "category_group", "cnt", _pct_within(g, "age_group").alias("pct"))


def user_frequency(tx: DataFrame) -> DataFrame:
    """Per customer with more than one active day: purchases per 30 days and the class."""
    g = tx.groupBy("customer_id").agg(F.count(F.lit(1)).alias("purchase_count"),
                                      F.datediff(F.max("t_dat"), F.min("t_dat")).alias("days_active"))
    per_month = F.col("purchase_count").cast("double") / (F.col("days_active").cast("double") / F.lit(30.0))
    return (g.filter(F.col("days_active") > 0)
             .select("customer_id", "purchase_count", "days_active",
                     frequency_class_of(per_month).alias("frequency")))


def purchase_frequency_distribution(tx: DataFrame) -> DataFrame:
    """Key 55: users per frequency class and percent of all classified users."""
    g = user_frequency(tx).groupBy("frequency").agg(F.count(F.lit(1)).alias("user_count"))
    total = F.sum("user_count").over(Window.partitionBy(F.lit(1)))  # <= 3 rows
    return g.select("frequency", "user_count", (F.col("user_count").cast("double") * 100.0 / total).alias("pct"))


def price_frequency_distribution(tx: DataFrame) -> DataFrame:
    """Key 56: users per (mean-price tier, frequency class), percent within the tier."""
    p = F.col("price")
    tiers = (tx.filter(p.isNotNull() & (p > 0)).groupBy("customer_id")
               .agg(price_tier_of(F.avg(p)).alias("price_tier")))
    g = (tiers.join(user_frequency(tx).select("customer_id", "frequency"), "customer_id")
              .groupBy("price_tier", "frequency").agg(F.count(F.lit(1)).alias("cnt")))
    return g.select("price_tier", "frequency", "cnt", _pct_within(g, "price_tier").alias("pct"))


def category_distribution(tx: DataFrame, articles: DataFrame, patterns=DEFAULT_CATEGORY_PATTERNS) -> DataFrame:
    """Key 57: purchases per category group (``other`` excluded) and percent of them."""
    per_item = tx.groupBy("article_id").agg(F.count(F.lit(1)).alias("c"))
    items = category_groups(articles, patterns).filter(F.col("category_group") != OTHER)
    g = per_item.join(items, "article_id").groupBy("category_group").agg(F.sum("c").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(F.lit(1)))  # one row per group
    return g.select("category_group", "cnt", (F.col("cnt").cast("double") * 100.0 / total).alias("pct"))


def pattern_counts(tx: DataFrame, customers: DataFrame, articles: DataFrame, patterns=DEFAULT_CATEGORY_PATTERNS,
                   period: Column | None = None) -> DataFrame:
    """(period, section, outer_key, inner_key, cnt): the counts behind every distribution, from one scan of ``tx``.

    Purchases are reduced to (customer, item, period), meet the catalogue, and become one row per customer and
    period, with a column per tier and category group. That row meets the customer's age band and unfolds into
    rows tagged with their section, which one last aggregate counts. ``period`` splits the purchases (null: all
    are one). Section ``transactions`` counts the rows of ``tx``. ``articles`` and ``customers`` have unique ids.
    Purchases without a customer count where no user is told apart; counts of 0 give no row.
    """
    p, n = F.col("price"), F.col("n")
    tiers = [t for _, t in PRICE_TIERS] + [PRICE_TIER_LAST]
    groups = [g for g, _ in patterns]
    bought = (tx.select("customer_id", "article_id", "t_dat", "price", (F.lit(0) if period is None else period).alias("period"))
                .groupBy("customer_id", "article_id", "period")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(p > 0, p)).alias("spent"),
                     F.min("t_dat").alias("first"), F.max("t_dat").alias("last"),
                     *[F.count_if((p > 0) & (price_tier_of(p) == t)).alias(f"tier_{i}") for i, t in enumerate(tiers)]))
    items = category_groups(articles, patterns).filter(F.col("category_group") != OTHER)
    users = (bought.join(items, "article_id", "left").groupBy("customer_id", "period")
                   .agg(F.sum("n").alias("n"), F.sum("spent").alias("spent"),
                        F.datediff(F.max("last"), F.min("first")).alias("days"),
                        *[F.sum(f"tier_{i}").alias(f"tier_{i}") for i in range(len(tiers))],
                        *[F.sum(F.when(F.col("category_group") == g, n)).alias(f"group_{i}") for i, g in enumerate(groups)])
                   .join(adult_users(customers), "customer_id", "left"))
    band, known = F.col("age_group"), F.col("customer_id").isNotNull()
    paid = sum((F.col(f"tier_{i}") for i in range(1, len(tiers))), F.col("tier_0"))
    tier = F.when(paid > 0, price_tier_of(F.col("spent") / F.nullif(paid, F.lit(0))))
    per_month = n.cast("double") / (F.nullif(F.col("days"), F.lit(0)).cast("double") / F.lit(30.0))
    frequency = F.when(F.col("days") > 0, frequency_class_of(per_month))

    def tagged(section, outer, inner, cnt):
        return F.struct(F.lit(section).alias("section"), (F.lit(None) if outer is None else outer).cast("string").alias("outer_key"),
                        inner.cast("string").alias("inner_key"), cnt.cast("long").alias("cnt"))

    rows = [tagged("age_price_distribution", band, F.lit(t), F.when(band.isNotNull(), F.col(f"tier_{i}"))) for i, t in enumerate(tiers)]
    rows += [tagged("age_category_distribution", band, F.lit(g), F.when(band.isNotNull(), F.col(f"group_{i}"))) for i, g in enumerate(groups)]
    rows += [tagged("price_frequency_distribution", tier, frequency, F.when(known & tier.isNotNull() & frequency.isNotNull(), 1)),
             tagged("purchase_frequency_distribution", None, frequency, F.when(frequency.isNotNull(), 1))]
    rows += [tagged("category_distribution", None, F.lit(g), F.col(f"group_{i}")) for i, g in enumerate(groups)]
    rows += [tagged("transactions", None, F.lit(None), n)]
    return (users.select("period", F.inline(F.array(*rows))).filter("cnt > 0")
                 .groupBy("period", "section", "outer_key", "inner_key").agg(F.sum("cnt").alias("cnt")))


def shopping_patterns_rows(tx: DataFrame, customers: DataFrame, articles: DataFrame,
                           patterns=DEFAULT_CATEGORY_PATTERNS) -> DataFrame:
    """Key 58 as rows: (section, outer_key, inner_key, pct) of every distribution, from one scan of ``tx``."""
    c = pattern_counts(tx, customers, articles, patterns).filter("section <> 'transactions'")
    total = F.sum("cnt").over(Window.partitionBy("section", "outer_key"))  # a few rows per section
    return c.select("section", "outer_key", "inner_key", (F.col("cnt").cast("double") * 100.0 / total).alias("pct"))


def shopping_patterns_json(tx: DataFrame, customers: DataFrame, articles: DataFrame,
                           patterns=DEFAULT_CATEGORY_PATTERNS) -> DataFrame:
    """Key 58: all distributions in one JSON document (plus the input sizes), from one scan of ``tx``.

    The lists are bounded by bands × tiers or groups. Entries are sorted by key, so the document does not
    depend on the order of tasks. Empty input gives empty sections.
    """
    c = pattern_counts(tx, customers, articles, patterns)
    total = F.sum("cnt").over(Window.partitionBy("section", "outer_key"))  # a few rows per section
    c = c.select("section", "outer_key", "inner_key", "cnt", (F.col("cnt").cast("double") * 100.0 / total).alias("pct"))
    lists = c.groupBy("section", "outer_key").agg(
        F.array_sort(F.collect_list(F.struct("inner_key", "pct"))).alias("entries"), F.sum("cnt").alias("cnt"))

    def one_level(section):
        return F.map_from_entries(F.flatten(F.collect_list(F.when(F.col("section") == section, F.col("entries")))))

    def two_level(section):
        outer = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("outer_key", "entries"))))
        return F.map_from_entries(F.transform(outer, lambda x: F.struct(x["outer_key"], F.map_from_entries(x["entries"]))))

    doc = F.struct(two_level("age_price_distribution").alias("age_price_distribution"),
                   two_level("age_category_distribution").alias("age_category_distribution"),
                   two_level("price_frequency_distribution").alias("price_frequency_distribution"),
                   one_level("purchase_frequency_distribution").alias("overall_frequency"),
                   one_level("category_distribution").alias("overall_category"))
    out = lists.filter("section <> 'transactions' OR cnt > 0").agg(
        F.coalesce(F.sum(F.when(F.col("section") == "transactions", F.col("cnt"))), F.lit(0)).alias("transactions"),
        F.to_json(doc).alias("patterns"))
    return out.select("transactions", adult_users(customers).select(F.count(F.lit(1))).scalar().alias("users"),
                      articles.select(F.count(F.lit(1))).scalar().alias("items"), "patterns")


def distribution_drift(tx: DataFrame, customers: DataFrame, articles: DataFrame, split_days: int = 365,
                       patterns=DEFAULT_CATEGORY_PATTERNS) -> DataFrame:
    """Key 81: every distribution before (a) and within (b) the last ``split_days`` days, and b less a.

    Returns (section, outer_key, inner_key, share_a, share_b, diff), shares in percent within section and outer
    key. A customer's frequency class and mean-price tier are those of the period. A key seen in one period has
    share 0 in the other; a section or outer key without any count in a period has null shares there.
    """
    start = F.date_sub(max_date(tx), int(split_days))
    c = pattern_counts(tx.filter("t_dat IS NOT NULL"), customers, articles, patterns, F.when(F.col("t_dat") >= start, "b").otherwise("a"))
    c = c.filter("section <> 'transactions'").groupBy("section", "outer_key", "inner_key").agg(
        *[F.coalesce(F.sum(F.when(F.col("period") == k, F.col("cnt"))), F.lit(0)).alias(f"n{k}") for k in "ab"])
    w = Window.partitionBy("section", "outer_key")  # a few rows per section
    a, b = (F.col(f"n{k}").cast("double") * 100.0 / F.nullif(F.sum(f"n{k}").over(w), F.lit(0)) for k in "ab")
    return c.select("section", "outer_key", "inner_key", a.alias("share_a"), b.alias("share_b"), (b - a).alias("diff"))
