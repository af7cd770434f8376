"""Typed sources.

Two families:

* native retail files (transactions, articles, customers as CSV or Parquet) read with an explicit
  schema, never inferred; ids stay strings because every tie-break on ``article_id`` is lexicographic;
* adapters that derive the same four logical tables (``tx``, ``articles``, ``customers``,
  ``exposures``) and the text replies from the test tables.

All adapters are lazy projections/joins, so Catalyst prunes columns into the Parquet scans and pushes
the trailing-window filters through the ``lineitem`` ⋈ ``orders`` join to the ``orders`` side.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TX_SCHEMA = T.StructType([
    T.StructField("t_dat", T.DateType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("article_id", T.StringType()),
    T.StructField("price", T.DoubleType()),
])
ARTICLES_SCHEMA = T.StructType([
    T.StructField("article_id", T.StringType()),
    T.StructField("prod_name", T.StringType()),
    T.StructField("product_group_name", T.StringType()),
    T.StructField("product_type_name", T.StringType()),
])
CUSTOMERS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read with a fixed schema. ``fmt`` is ``csv`` (header row) or ``parquet`` (columns cast to the
    schema); ``auto`` picks parquet only for a ``.parquet`` suffix."""
    if fmt == "auto":
        fmt = "parquet" if path.rstrip("/").endswith(".parquet") else "csv"
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_transactions_csv(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """``transactions_train``-style file: t_dat, customer_id, article_id, price."""
    return _read(spark, path, TX_SCHEMA, fmt).select("customer_id", "article_id", "t_dat", "price")


def read_articles_csv(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, ARTICLES_SCHEMA, fmt)


def read_customers_csv(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, CUSTOMERS_SCHEMA, fmt)


# ---------------------------------------------------------------------------
# Adapters from the TPC-H-style tables
# ---------------------------------------------------------------------------

def tx_from_tpch(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per line item: (customer_id, article_id, t_dat, price). Rows have no natural key."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_extendedprice")
    o = orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
              .select(F.col("o_custkey").cast("string").alias("customer_id"),
                      F.col("l_partkey").cast("string").alias("article_id"),
                      F.col("o_orderdate").cast("date").alias("t_dat"),
                      (F.col("l_extendedprice") / F.lit(1e6)).alias("price")))


def articles_from_tpch(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").cast("string").alias("article_id"),
                       F.col("p_name").alias("prod_name"),
                       F.col("p_type").alias("product_group_name"),
                       F.col("p_name").alias("product_type_name"))


def customers_from_tpch(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    age = F.when(k % 50 == 0, F.lit(None).cast("int")).otherwise((F.lit(15) + (k * 37) % 90).cast("int"))
    return customer.select(k.cast("string").alias("customer_id"), age.alias("age"))


def experiment_group(user_id: Column, experiment: str = "exp1") -> Column:
    """Deterministic 50:50-ish split on the md5 of ``user_id:experiment`` (first hex digit < 8 → A)."""
    h = F.md5(F.concat(user_id.cast("string"), F.lit(":" + experiment)))
    return F.when(F.substring(h, 1, 1) < F.lit("8"), F.lit("A")).otherwise(F.lit("B"))


def exposures_from_events(events: DataFrame, experiment: str = "exp1") -> DataFrame:
    """One row per user and day: group, clicked, purchase_count, num_items, first_ts."""
    ev = events.select("user_id", "ts", "event_type")
    return (ev.groupBy(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("date").alias("day"))
              .agg(F.max(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("_clk"),
                   F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("long").alias("purchase_count"),
                   F.count(F.lit(1)).alias("num_items"),
                   F.min("ts").alias("first_ts"))
              .select("user_id", "day", experiment_group(F.col("user_id"), experiment).alias("grp"),
                      (F.col("_clk") == 1).alias("clicked"), "purchase_count", "num_items", "first_ts"))


def experiment_log(exposures: DataFrame) -> DataFrame:
    """One row per user, the unit of every test: clicked on any day, purchases and items of all days, and
    the first day seen (used for segments)."""
    return exposures.groupBy("user_id", "grp").agg(
        F.max("clicked").alias("clicked"), F.sum("purchase_count").alias("purchase_count"),
        F.sum("num_items").alias("num_items"), F.min("day").alias("day"), F.min("first_ts").alias("first_ts"))


def input_fingerprint(spark: SparkSession, root: str) -> str:
    """Names, sizes and times of the files under ``root``, so that changed input gets new derived tables.

    Read through the store's own listing in the JVM; where there is none (Spark Connect), the path alone counts."""
    import hashlib
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # Spark Connect has no JVM gateway
        return hashlib.md5(root.encode()).hexdigest()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs, seen, todo = path.getFileSystem(conf), [], [path]
    while todo:
        for f in fs.listStatus(todo.pop()):
            if f.isDirectory():
                todo.append(f.getPath())
            else:
                seen.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.md5("\n".join([root, *sorted(seen)]).encode()).hexdigest()


_MATERIALIZED: dict[tuple[str, str, str], str] = {}
_LOCK = threading.RLock()  # re-entrant: building one table may read another


def materialized(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """A derived table written once per application under the checkpoint folder and read back.

    Used for the ``lineitem`` ⋈ ``orders`` transactions adapter (every operator and every window max
    would otherwise re-run the join) and for the feature tables that downstream operators read, as a
    feature pipeline writes them once and serves them many times. The files live in the shared folder
    the session names in ``spark.checkpoint.dir``, so they survive executor loss.
    """
    from basketry.session import application_id, ensure_checkpoint_dir
    app = application_id(spark)
    mark = input_fingerprint(spark, root)
    key = (app, mark, name)
    with _LOCK:  # one writer per table even when queries are submitted from several threads
        if key not in _MATERIALIZED:
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketry-tables/{app}/{mark[:16]}/{name}"
            build().write.mode("overwrite").parquet(path)
            _MATERIALIZED[key] = path
    return spark.read.parquet(_MATERIALIZED[key])


def materialized_tx(spark: SparkSession, root: str, build) -> DataFrame:
    return materialized(spark, root, "tx", build)


@dataclass
class Tables:
    """The logical inputs of every operator, built lazily from one data directory.

    ``materialize`` (default on) writes the derived transactions table once per application.
    """

    spark: SparkSession
    root: str
    _cache: dict = field(default_factory=dict)
    materialize: bool = True

    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[key]

    @property
    def tx(self) -> DataFrame:
        build = lambda: tx_from_tpch(self.raw("lineitem"), self.raw("orders"))
        if not self.materialize:
            return build()
        if "tx" not in self._cache:
            self._cache["tx"] = materialized_tx(self.spark, self.root, build)
        return self._cache["tx"]

    def derived(self, name: str, build) -> DataFrame:
        """A table derived from this directory, written once per application (or built lazily
        when ``materialize`` is off). ``name`` must encode every parameter of ``build``."""
        if not self.materialize:
            return build()
        if name not in self._cache:
            self._cache[name] = materialized(self.spark, self.root, name, build)
        return self._cache[name]

    @property
    def articles(self) -> DataFrame:
        return articles_from_tpch(self.raw("part"))

    @property
    def customers(self) -> DataFrame:
        return customers_from_tpch(self.raw("customer"))

    @property
    def exposures(self) -> DataFrame:
        return exposures_from_events(self.raw("events"))

    @property
    def experiment_log(self) -> DataFrame:
        return experiment_log(self.exposures)

    @property
    def profile_replies(self) -> DataFrame:
        """Text that should hold a JSON profile: (event_id, text)."""
        return self.raw("events").select("event_id", F.col("props").alias("text"))

    @property
    def replies(self) -> DataFrame:
        """Free-text replies: (conv_id, turn, text)."""
        return self.raw("conversations").select("conv_id", "turn", "text")


@dataclass
class RetailTables(Tables):
    """The same inputs from a retailer's own tables; ``sources`` has the DataFrames tx, articles and customers.

    What needs an event stream or replies (``raw``) has no source here and raises KeyError."""

    sources: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        raise KeyError(f"these tables have no {name}")

    @property
    def tx(self) -> DataFrame:
        return self.sources["tx"]

    @property
    def articles(self) -> DataFrame:
        return self.sources["articles"]

    @property
    def customers(self) -> DataFrame:
        return self.sources["customers"]


def load_files(spark: SparkSession, root: str, transactions: str, articles: str, customers: str, fmt: str = "csv") -> RetailTables:
    """Tables from the three files (or folders) under ``root``, CSV with a header or Parquet."""
    root = root.rstrip("/")
    return RetailTables(spark, root, sources={"tx": read_transactions_csv(spark, f"{root}/{transactions}", fmt),
                                              "articles": read_articles_csv(spark, f"{root}/{articles}", fmt),
                                              "customers": read_customers_csv(spark, f"{root}/{customers}", fmt)})


def load_catalog(spark: SparkSession, database: str, transactions: str = "transactions", articles: str = "articles",
                 customers: str = "customers") -> RetailTables:
    """Tables of the session's catalog. Nothing derived is written: the catalog's tables may change under the same name."""
    def read(name: str, schema: T.StructType) -> DataFrame:
        return spark.table(f"{database}.{name}").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])

    return RetailTables(spark, database, materialize=False, sources={
        "tx": read(transactions, TX_SCHEMA).select("customer_id", "article_id", "t_dat", "price"),
        "articles": read(articles, ARTICLES_SCHEMA), "customers": read(customers, CUSTOMERS_SCHEMA)})


def save_catalog(t: Tables, database: str, buckets: int = 64) -> None:
    """Write the three tables to the catalog; transactions and customers in ``buckets`` by customer, so that joins and groups
    on the customer need no shuffle. Choose ``buckets`` so that one holds a task's share of the rows."""
    by_customer = lambda df: df.write.bucketBy(int(buckets), "customer_id").sortBy("customer_id")
    by_customer(t.tx).mode("overwrite").saveAsTable(f"{database}.transactions")
    by_customer(t.customers).mode("overwrite").saveAsTable(f"{database}.customers")
    t.articles.write.mode("overwrite").saveAsTable(f"{database}.articles")


def load_tables(spark: SparkSession, root: str, materialize: bool = True) -> Tables:
    return Tables(spark, root.rstrip("/"), materialize=materialize)
