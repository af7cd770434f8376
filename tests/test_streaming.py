"""The streamed experiment log equals the batch adapter on every user-day the watermark has closed."""

import tempfile

from pyspark.sql import functions as F

from basketry.sources.tables import exposures_from_events
from basketry.streaming import run_exposures_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch_on_closed_days(spark):
    base = tempfile.mkdtemp(prefix="stream-test-")
    events = spark.read.parquet(f"{SF}/events.parquet")
    # land the events as several files, as a feed would
    events.repartition(4, "event_id").write.parquet(f"{base}/in")
    q = run_exposures_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", lateness="1 day")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{base}/out")
    batch = exposures_from_events(events)
    last_day = batch.agg(F.max("day")).collect()[0][0]
    closed = batch.filter(F.col("day") < F.date_sub(F.lit(last_day), 1))
    cols = ["user_id", "day", "grp", "clicked", "purchase_count", "num_items", "first_ts"]
    got = sorted(tuple(r) for r in streamed.filter(F.col("day") < F.date_sub(F.lit(last_day), 1)).select(cols).collect())
    want = sorted(tuple(r) for r in closed.select(cols).collect())
    assert len(want) > 0 and got == want
