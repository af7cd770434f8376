from pyspark.sql import functions as F

from basketry.llm.common import HOT, join_spread


def test_hot_and_null_keys_are_spread(spark):
    """A third of the rows has one key, a tenth none; the join finds every match and no task gets them all."""
    n = 6000
    rows = spark.range(0, n, 1, 6).select("id", F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 10 == 1, None)
                                          .otherwise(F.col("id") % 2000).alias("k"))
    table = rows.filter("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("c")).withColumns(
        {"half": F.when(F.col("k") % 5 != 0, F.col("k") / 2), "word": F.col("k").cast("string")})
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        out = join_spread(rows, table, "k", "c", n, "id")
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out.columns == ["id", "k", "half", "word"] and len(got) == n
    for r in got:
        assert r.word == (None if r.k is None else str(r.k))
        assert r.half == (None if r.k is None or r.k % 5 == 0 else r.k / 2)
    sizes = [sum(r.task == t for r in got) for t in range(4)]
    assert max(sizes) < 1.3 * n / 4, sizes


def test_no_more_hot_keys_than_the_bound(spark):
    n = 3 * HOT
    rows = spark.range(n).select("id", (F.col("id") % (2 * HOT)).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c")).withColumn("v", F.col("k") + 1)
    assert table.filter(F.col("c") * HOT >= n).count() <= HOT
    assert join_spread(rows, table, "k", "c", n, "id").filter("v = k + 1").count() == n
    none = rows.filter("id < 0")
    assert join_spread(none, table.filter("k < 0"), "k", "c", 0, "id").count() == 0
