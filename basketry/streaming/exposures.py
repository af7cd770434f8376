"""The experiment log, built incrementally from an event stream.

``exposures_from_events`` (batch) groups events per user and calendar day. Here the same rows are
produced by Structured Streaming: a watermark on the event time bounds the state, a one-day tumbling
window per user replaces the calendar-day key, and a day is appended once the watermark has passed
its end, so late events up to ``lateness`` are still counted. The stream writes Parquet that the
batch readouts (``ab_basic_stats``, ``ab_chi_square``, ...) read like any other table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import experiment_group

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def exposures_stream(events: DataFrame, lateness: str = "1 day", experiment: str = "exp1") -> DataFrame:
    """Streaming (or batch) exposures: user_id, day, grp, clicked, purchase_count, num_items, first_ts.

    Event time must be a session-zone ``timestamp`` for the watermark, so ``timestamp_ntz`` is cast;
    the session time zone is UTC, so days are the same calendar days as in the batch adapter.
    """
    ev = events.select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ets"),
                       "event_type", F.col("ts").alias("ts"))
    agg = (ev.withWatermark("ets", lateness)
             .groupBy("user_id", F.window("ets", "1 day").alias("w"))
             .agg(F.max(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("_clk"),
                  F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).cast("long").alias("purchase_count"),
                  F.count(F.lit(1)).alias("num_items"), F.min("ts").alias("first_ts")))
    return agg.select("user_id", F.col("w.start").cast("date").alias("day"),
                      experiment_group(F.col("user_id"), experiment).alias("grp"),
                      (F.col("_clk") == 1).alias("clicked"), "purchase_count", "num_items", "first_ts")


def run_exposures_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                         lateness: str = "1 day", available_now: bool = True):
    """Read event Parquet files arriving under ``source`` and append closed user-days to ``sink``.

    ``checkpoint`` must be a shared, durable folder (the query restarts from it after a failure).
    With ``available_now`` the query processes what is there and stops; otherwise it keeps running.
    """
    stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(source)
    writer = (exposures_stream(stream, lateness).writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
