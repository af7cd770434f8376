"""Co-purchase scores are exact: ties at 2^-18 and its last-bit neighbours rank alike in any order of addition."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates as cand

TX = "customer_id string, article_id string, t_dat date"


def day(n):
    import datetime
    return datetime.date(2024, 12, 31) - datetime.timedelta(days=n)


def test_units_are_exact_powers_of_two(spark):
    df = spark.range(0, 366).select(F.col("id").cast("int").alias("age"), F.lit(26).alias("h"))
    got = df.select("age", cand.decay_units(F.col("age"), 14, F.col("h")).alias("u"), cand.from_units(
        cand.decay_units(F.col("age"), 14, F.col("h")), F.col("h")).alias("x")).collect()
    u = {r["age"]: int(r["u"]) for r in got}
    assert all(u[a] == 2 * u[a + 14] for a in range(0, 352)) and u[0] == 1 << 66
    assert all(r["x"] == pytest.approx(0.5 ** (r["age"] / 14), rel=1e-11) for r in got)
    old = spark.range(1).select(cand.decay_units(F.lit(14 * 70), 14, F.lit(62)).alias("u")).first()["u"]
    assert int(old) == (1 << 40) >> 8  # beyond the most halvings a weight loses its last bits, not its size


@pytest.mark.parametrize("parts", [1, 5])
def test_equal_sums_tie_whatever_their_order(spark, parts):
    """x: one old basket of weight 2^-18; y: two of 2^-19; z: 2^-18 and a trifle. Ties go to the smaller id."""
    rows = [("end", "other", day(0))]
    rows += [("c1", i, day(14 * 18)) for i in ("s", "x")]
    for c in ("c2", "c3"):
        rows += [(c, i, day(14 * 19)) for i in ("s", "y")]
    rows += [("c4", i, day(14 * 18)) for i in ("s", "z")] + [("c5", i, day(14 * 26)) for i in ("s", "z")]
    rows += [("c6", i, day(14 * 18)) for i in ("s", "a")]
    tx = spark.createDataFrame(rows, TX).repartition(parts)
    cfw = cand.cf_window(tx, 365)
    got = cand.item_cooccurrence(cfw).filter("seed_item = 's'").orderBy("rr").collect()
    assert [r["cand_item"] for r in got] == ["z", "a", "x", "y"]
    assert [Fraction(r["score"]) for r in got] == [Fraction(1, 1 << 18) + Fraction(1, 1 << 26)] + [Fraction(1, 1 << 18)] * 3
    assert got[1]["score"] == 3.814697265625e-06
    # a user's list: unranked items of equal score by id, the sum over seeds in one fixed order
    itf = spark.createDataFrame([("s", 1)], "article_id string, popularity_rank long")
    cf = cand.cf_candidates(cfw, itf, top_k=10).filter("customer_id = 'c2'").orderBy("pos").collect()
    assert [r["article_id"] for r in cf] == ["z", "a", "x"]
    assert cf[1]["score_cf"] == cf[2]["score_cf"]
