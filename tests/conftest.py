import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("basketry-tests")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="basketry-test-ckpt-"))
    yield s


@pytest.fixture
def mk(spark):
    """Build a small DataFrame: mk("customer_id string, article_id string, t_dat date", rows)."""
    import datetime as dt

    def _mk(schema, rows):
        conv = []
        for r in rows:
            conv.append(tuple(dt.date.fromisoformat(v) if isinstance(v, str) and len(v) == 10 and v[4] == "-"
                              else v for v in r))
        return spark.createDataFrame(conv, schema)
    return _mk
