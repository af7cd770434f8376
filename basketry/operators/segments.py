"""User activity segments, profiles and profile texts, for all users in one plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.windows import trailing_window

ACTIVE = "active"
LOW_ACTIVITY = "low_activity"

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------------------------
# age band by md5 percent: < 25 → 20s, < 50 → 30s, < 75 → 40s, else 50s+
AGE_BANDS = [(25, "20s"), (50, "30s"), (75, "40s")]
AGE_BAND_LAST = "50s+"
# profile defaults for users with missing values
PROFILE_DEFAULT_FREQUENCY = "medium"
PROFILE_DEFAULT_AVG_PRICE = 0.03
PROFILE_DEFAULT_RECENCY = 7
# price sensitivity thresholds: < 0.02 budget, < 0.04 moderate, else premium
PRICE_BUDGET_BELOW = 0.02
PRICE_MODERATE_BELOW = 0.04
# trait phrases used in the profile text
AGE_TRAITS = {
    "20s": "트렌디하고 새로운 스타일을 추구하는",
    "30s": "실용적이면서도 품질을 중시하는",
    "40s": "클래식하고 안정적인 스타일을 선호하는",
    "50s+": "편안함과 품질을 최우선으로 하는",
}
FREQUENCY_TRAITS = {
    "high": "패션에 관심이 많아 자주 쇼핑하는",
    "medium": "필요할 때 계획적으로 구매하는",
    "low": "신중하게 선택하여 가끔 구매하는",
}
PRICE_TRAITS = {
    "budget": "가성비를 중요하게 생각하는",
    "moderate": "적절한 가격대의 상품을 선호하는",
    "premium": "품질을 위해 프리미엄 가격도 기꺼이 지불하는",
}
AGE_TRAIT_DEFAULT = "일반적인"
FREQUENCY_TRAIT_DEFAULT = "고객"
PRICE_TRAIT_DEFAULT = "적절한 가격대의 상품을 선호하는"
NO_RECENT_ITEMS = "없음"
NO_PREFERRED_CATEGORY = "다양함"
RECENCY_WEEK = "최근 일주일 내에 구매한"
RECENCY_MONTH = "최근 한 달 내에 구매한"
RECENCY_DAYS_SUFFIX = "일 전에 마지막으로 구매한"
PROFILE_TEMPLATE = """당신은 다음과 같은 특성을 가진 H&M 고객입니다:

**기본 정보**:
- 연령대: {age_group}
- 쇼핑 성향: {age_trait} {frequency_trait} 고객
- 가격 선호도: {price_trait}

**쇼핑 패턴**:
- 구매 빈도: {purchase_frequency}
- 마지막 구매: {recency_desc}
- 평균 구매 가격: {avg_price_4}

**최근 관심사**:
- 주로 구매하는 카테고리: {preferred_category}
- 최근 구매 상품: {recent_items}

당신의 쇼핑 성향과 선호도를 바탕으로 솔직하게 행동해주세요.
푸시 알림을 받았을 때, 상품이 당신의 취향에 맞는지, 시간대가 적절한지 고려하여 판단하세요."""


def user_activity_metrics(uf: DataFrame, tx: DataFrame, activity_threshold: int = 3,
                          activity_window_days: int = 60) -> DataFrame:
    """Key 10: per user of the feature table, purchase rows in the last N days (0 if none) and segment.

    The 60-day rows are pre-aggregated per customer before the join, so the join sees one row per user.
    """
    recent = (trailing_window(tx.select("customer_id", "article_id", "t_dat"), activity_window_days)
              .groupBy("customer_id").agg(F.count("article_id").alias("n60")))
    m = uf.select("customer_id", "purchase_count", "recency").join(recent, "customer_id", "left")
    n60 = F.coalesce(F.col("n60"), F.lit(0)).cast("long")
    return m.select("customer_id", "purchase_count", n60.alias("purchase_count_60d"), "recency",
                    F.when(n60 >= activity_threshold, F.lit(ACTIVE)).otherwise(F.lit(LOW_ACTIVITY)).alias("segment"))


def user_segments(users: DataFrame, metrics: DataFrame) -> DataFrame:
    """Key 11: segment for every requested user; ids without features are ``low_activity``."""
    return (users.select("customer_id").distinct()
            .join(metrics.select("customer_id", "segment"), "customer_id", "left")
            .select("customer_id", F.coalesce(F.col("segment"), F.lit(LOW_ACTIVITY)).alias("segment")))


def hash_percent(id_col: Column) -> Column:
    """0..99 from the first 8 hex digits of md5(id): same value in Spark and DuckDB."""
    return F.pmod(F.conv(F.substring(F.md5(id_col.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))


def age_group_of(id_col: Column) -> Column:
    pct = hash_percent(id_col)
    e = F.lit(AGE_BAND_LAST)
    for bound, label in reversed(AGE_BANDS):
        e = F.when(pct < bound, F.lit(label)).otherwise(e)
    return e


def user_profile(uf: DataFrame) -> DataFrame:
    """Key 12: one profile row per user with defaults for missing values."""
    return uf.select(
        "customer_id",
        age_group_of(F.col("customer_id")).alias("age_group"),
        F.coalesce(F.col("purchase_frequency"), F.lit(PROFILE_DEFAULT_FREQUENCY)).alias("purchase_frequency"),
        F.coalesce(F.col("avg_price"), F.lit(PROFILE_DEFAULT_AVG_PRICE)).alias("avg_price"),
        F.coalesce(F.col("recency"), F.lit(PROFILE_DEFAULT_RECENCY)).cast("long").alias("recency"))


def price_sensitivity_of(avg_price: Column, budget_below: float = PRICE_BUDGET_BELOW,
                         moderate_below: float = PRICE_MODERATE_BELOW) -> Column:
    return (F.when(avg_price < budget_below, F.lit("budget"))
             .when(avg_price < moderate_below, F.lit("moderate")).otherwise(F.lit("premium")))


def price_sensitivity(uf: DataFrame, budget_below: float = PRICE_BUDGET_BELOW,
                      moderate_below: float = PRICE_MODERATE_BELOW) -> DataFrame:
    """Key 13."""
    return uf.select("customer_id", "avg_price",
                     price_sensitivity_of(F.col("avg_price"), budget_below, moderate_below).alias("price_sensitivity"))


def _lookup(mapping: dict, key: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def _template_concat(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            parts.append(values[piece])
    return F.concat(*parts)


def profile_prompt_text(profile: DataFrame) -> DataFrame:
    """Key 14: one profile text per user. Optional columns ``preferred_category`` (string) and
    ``recent_items`` (array<string>) are used when present; otherwise the 'none' words are used."""
    cols = set(profile.columns)
    rec = F.col("recency")
    recent = (F.when(F.size(F.col("recent_items")) > 0, F.array_join(F.slice(F.col("recent_items"), 1, 3), ", "))
              .otherwise(F.lit(NO_RECENT_ITEMS))) if "recent_items" in cols else F.lit(NO_RECENT_ITEMS)
    pref = (F.coalesce(F.col("preferred_category"), F.lit(NO_PREFERRED_CATEGORY))
            if "preferred_category" in cols else F.lit(NO_PREFERRED_CATEGORY))
    values = {
        "age_group": F.col("age_group"),
        "age_trait": _lookup(AGE_TRAITS, F.col("age_group"), AGE_TRAIT_DEFAULT),
        "frequency_trait": _lookup(FREQUENCY_TRAITS, F.col("purchase_frequency"), FREQUENCY_TRAIT_DEFAULT),
        "price_trait": _lookup(PRICE_TRAITS, price_sensitivity_of(F.col("avg_price")), PRICE_TRAIT_DEFAULT),
        "purchase_frequency": F.col("purchase_frequency"),
        "recency_desc": (F.when(rec <= 7, F.lit(RECENCY_WEEK)).when(rec <= 30, F.lit(RECENCY_MONTH))
                         .otherwise(F.concat(rec.cast("string"), F.lit(RECENCY_DAYS_SUFFIX)))),
        "avg_price_4": F.format_string("%.4f", F.col("avg_price")),
        "preferred_category": pref,
        "recent_items": recent,
    }
    return profile.select("customer_id", _template_concat(PROFILE_TEMPLATE, values).alias("prompt"))


def profile_prompt_sql(src: str = "prof") -> str:
    """The same text as SQL (used by the oracle): built from the same fixed values."""
    def case(mapping, key, default):
        whens = " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in mapping.items())
        return f"(CASE {whens} ELSE '{default}' END)"
    sens = ("(CASE WHEN avg_price < 0.02 THEN 'budget' WHEN avg_price < 0.04 THEN 'moderate' ELSE 'premium' END)")
    values = {
        "age_group": "age_group",
        "age_trait": case(AGE_TRAITS, "age_group", AGE_TRAIT_DEFAULT),
        "frequency_trait": case(FREQUENCY_TRAITS, "purchase_frequency", FREQUENCY_TRAIT_DEFAULT),
        "price_trait": case(PRICE_TRAITS, sens, PRICE_TRAIT_DEFAULT),
        "purchase_frequency": "purchase_frequency",
        "recency_desc": (f"(CASE WHEN recency <= 7 THEN '{RECENCY_WEEK}' WHEN recency <= 30 THEN '{RECENCY_MONTH}' "
                         f"ELSE CAST(recency AS VARCHAR) || '{RECENCY_DAYS_SUFFIX}' END)"),
        "avg_price_4": "printf('%.4f', avg_price)",
        "preferred_category": f"'{NO_PREFERRED_CATEGORY}'",
        "recent_items": f"'{NO_RECENT_ITEMS}'",
    }
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", PROFILE_TEMPLATE)):
        if i % 2 == 0:
            if piece:
                parts.append("'" + piece.replace("'", "''") + "'")
        else:
            parts.append(values[piece])
    return f"SELECT customer_id, {' || '.join(parts)} AS prompt FROM {src}"
