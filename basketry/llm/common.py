"""Helpers shared by the text operators: words, folds, row keys and tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import ensure_checkpoint_dir

#: A word: a run of code points other than blank, tab, newline, vertical tab, form feed and return.
#: ``bytes.split()`` splits at exactly these bytes.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: A key with at least this part (one over it) of all rows is a hot one; there are at most this many.
HOT = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def utf8(text_col: Column | str) -> Column:
    """The text's UTF-8 bytes; null is the empty text."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage with files every executor sees, so a lost executor costs a re-read, never a
    second run of the Python code above it.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return the free memory of this process to the system, for the end of a task: Spark keeps its Python worker, and others
    beside it, for later ones."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that do not clash with the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def with_row(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name`` that tells all its rows apart and stays the same however often ``df`` is read.

    A table read from files has its rows' places there (file and row in it); anything else is numbered and written once."""
    if "_metadata" not in df.columns:
        try:
            return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        except AnalysisException:
            pass
    return stored(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "numbered")


def join_spread(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, spread: str) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique ``key``; nulls where it has no row), no key in one task.

    ``n`` is the number of rows with the key, of ``total``. Hot keys, at most HOT, are broadcast; their rows go
    through the shuffle of the others under a salt from column ``spread`` and the input's part, and match nothing
    there. So do null keys. ``rows`` is read once; clashing names are the caller's matter.
    """
    cols = [c for c in table.columns if c not in (key, n)]
    is_hot = F.col(n) * HOT >= total
    hot = table.filter(is_hot).select(F.col(key).alias("_hot"), F.struct(*cols).alias("_of_hot"))
    # the zero of the table's side depends on a row, so that it stays a key of the shuffle
    rest = table.filter(~is_hot).select(F.col(key).alias("_key"), F.struct(*cols).alias("_of_rest"),
                                        F.when(F.col(n) < 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("_zero"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    cold = F.col("_hot").isNull() & F.col(key).isNotNull()
    marked = marked.withColumn("_salt", F.when(cold, F.lit(0).cast("long")).otherwise(F.xxhash64(spread, F.spark_partition_id())))
    joined = marked.join(rest, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_of_hot.{c}", f"_of_rest.{c}").alias(c) for c in cols])
