"""Mix sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. Documents are ranked by size
inside their source across all partitions, their expected copies are prefix-summed in that order, one
random offset per source is added, and a document is emitted once per integer boundary crossed. As
neighbours in the order have like sizes, the words taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.order import global_row_number, hash_key
from basketry.llm.common import WORD_RE, fresh, stored, with_row

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, 7


def n_words(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD_RE)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, size) -> (source, source_size, docs, target), one row per source.

    Sources take ``weights`` in turn by code point, null last. ``share`` of all sizes is dealt by weight;
    a target stops at ``cap`` times its source's size and the excess is dealt again by weight until none
    is above. Only sums reach the driver.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    ranked = global_row_number(s, [F.col("source").isNull(), F.col("source")], "rn")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    s = stored(ranked.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(cap)).drop("rn"), "sources")
    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    rate, n_capped = 0.0, -1
    over = F.lit(False)
    while True:
        capped, most, rest = s.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)),
                                   F.sum(F.when(~over, F.col("w")))).first()
        if capped == n_capped:
            break
        n_capped, rate = capped, (total - most) / rest if rest else 0.0
        over = F.col("w") * F.lit(rate) > F.col("most")
    return s.select("source", "source_size", "docs",
                    F.when(over, F.col("most")).otherwise(F.col("w") * F.lit(rate)).alias("target"))


def systematic_copies(df: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS,
                      share: float = SHARE, cap: float = CAP, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: id, text_key, source, size, source_size, target, copies.

    ``text_key`` (xxhash64 of the text) tells rows of one id apart; ``row_col``, a column that tells all rows apart,
    is carried along as ``row``. A null text has size 0; a null source
    is a source of its own and comes last; a null id is ordered as the empty text; repeated rows are
    separate rows; a source without words has target 0 and no copies; an empty table gives no rows; other
    columns are ignored. The same rows give the same copies whatever the partitions.
    """
    own = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = stored(df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"),
                            n_words(text_col).alias("size"), own.alias("row")), "sizes")
    targets = source_targets(rows, weights, share, cap)
    h = hash_key(F.coalesce(F.col("id").cast("string"), F.lit("")), seed=seed)
    ranked = global_row_number(rows, [F.col("source").isNull(), F.col("source"), F.col("size"), h, F.col("id"),
                                      F.col("text_key"), F.col("row")], "rn")  # the row number also parts equal rows
    first = stored(ranked.groupBy("source").agg((F.min("rn") - 1).alias("before")), "first")
    u = F.conv(F.substring(hash_key(F.coalesce("source", F.lit("")), F.col("source").isNull().cast("int"),
                                    seed=seed), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    first = first.join(targets, first.source.eqNullSafe(targets.source)).select(
        first.source.alias("of"), "before", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    first = stored(first.withColumn("source", F.col("of")).withColumn("u", u).drop("source"), "rates")
    j = ranked.join(first, F.col("source").eqNullSafe(F.col("of")))
    k = (F.col("rn") - F.col("before")).cast("double")
    copies = F.floor(k * F.col("rate") + F.col("u")) - F.floor((k - 1) * F.col("rate") + F.col("u"))
    return j.select("id", "text_key", "source", "size", "source_size", "target",
                    F.least(copies, F.ceil("rate")).cast("long").alias("copies"), *(["row"] if row_col else []))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE,
        cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``df`` as often as ``systematic_copies`` says, with its columns.

    Nulls, repeated rows and empty tables are treated as there; any column names are allowed. Rows meet their copies by
    their places in the table: no key is shared by two rows, so copies of a text stay spread over the tasks, and a text
    is shuffled once and never sorted."""
    row, of, copies, n = fresh(df, "row", "of", "copies", "copy")
    placed = with_row(df, row)
    per = systematic_copies(placed, id_col, text_col, source_col, weights, share, cap, seed, row)
    per = per.filter("copies > 0").select(F.col("row").alias(of), F.col("copies").alias(copies))
    j = placed.join(per.hint("shuffle_hash"), F.col(row) == F.col(of))
    return j.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*df.columns)
