"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one pre-aggregated ``min`` per node and one join, so no node's neighbours are ever
collected; edges only get fewer. Rounds are O(log n) in practice and each is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir


def _star(e: DataFrame, large: bool) -> DataFrame:
    if large:
        e = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    m = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = e.join(m, "a")
    if large:
        out = j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                         F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> one row (node, comp) per node with an edge; comp is its smallest node.

    Null ends and self-loops are dropped, repeated edges count once, an empty table gives no rows.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select("a", "b").filter("a <> b").distinct().checkpoint(eager=True)
    mark = None
    while True:
        e = _star(_star(e, large=True), large=False).checkpoint(eager=True)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
