import pytest
from oracle import same

from basketry.llm.mixing import mix, source_targets, systematic_copies


def plain_targets(size, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = share * sum(size.values()), set()
    while True:
        rest = sum(w[s] for s in names if s not in capped)
        rate = (left - sum(cap * size[s] for s in capped)) / rest if rest else 0
        over = {s for s in names if s not in capped and w[s] * rate > cap * size[s]}
        if not over:
            return {s: cap * size[s] if s in capped else w[s] * rate for s in names}
        capped |= over


@pytest.mark.parametrize("size", [{"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 0, "b": 0}, {"é": 5, "z": 70, "Z": 9, "": 1}])
def test_targets(spark, size):
    df = spark.createDataFrame(list(size.items()), "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(size))


ROWS = [(i, "w " * (i % 9), None, "s" if i % 3 else "t") for i in range(300)] + [
    (None, "a b", None, "t"), (None, None, None, None), (1, None, None, None), (1, "", None, None),
    (2, "x " * 30_000, None, None), (2, "x " * 30_000, None, None), (7, "same", None, "u"), (7, "same", None, "u"),
    (8, "", None, "empty")]


def test_copies_and_mix(spark, docs):
    df = docs(ROWS, extra="copies")
    got = systematic_copies(df, "doc_id", "text", "source").collect()
    assert len(got) == len(ROWS)
    for s in ("s", "t", "u", None, "empty"):
        part = [r for r in got if r.source == s]
        assert {r.source_size for r in part} == {sum(r.size for r in part)}
        assert sum(r.copies * r.size for r in part) == pytest.approx(part[0].target, abs=2 * max(r.size for r in part))
        assert max(r.copies for r in part) <= 2
    again = systematic_copies(df.repartition(7), "doc_id", "text", "source").collect()
    key = lambda r: (r.id is None, r.id or 0, r.text_key, str(r.source), r.copies)
    assert sorted(got, key=key) == sorted(again, key=key)
    out = mix(df, "doc_id", "text", "source")
    assert out.columns == df.columns
    total = sum(r.copies for r in got)
    assert out.count() == total
    assert systematic_copies(docs([]), "doc_id", "text", "source").count() == 0 and mix(docs([]), "doc_id", "text", "source").count() == 0


def test_oracle(spark):
    same(spark, "op5_systematic_mix", "/root/testdata/sf0.01")


def test_mix_with_clashing_names_and_a_thousand_equal_rows(spark, docs):
    """Any column names; the copies of equal rows are made in several tasks."""
    from pyspark.sql import functions as F
    df = docs([(5, "one two three four", "en", "s")] * 1000 + [(6, "other words", "en", "t")] * 5, extra="of_id")
    for c in ("of_key", "of_source", "row", "of", "copies", "copy", "text_key", "id", "size"):
        df = df.withColumn(c, F.lit(c))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mix(df.repartition(4), "doc_id", "text", "source")
        per_task = out.filter("doc_id = 5").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == df.columns
    copies = systematic_copies(df, "doc_id", "text", "source").filter("id = 5").agg(F.sum("copies")).first()[0]
    assert sum(r[1] for r in per_task) == copies >= 1000 and len(per_task) >= 3 and max(r[1] for r in per_task) < copies / 2
    assert out.first()["of_key"] == "of_key"
