import gzip
import os

from oracle import same
from pyspark.sql import functions as F

from basketry.llm import warc

ROWS = [(3, "http://a/é x", "<p>é</p>"), (9, None, "<p>é</p>"), (None, "http://a", "<p>é</p>"), (4, "u", None), (5, "u", ""),
        (6, "l", "long " * 200_000), (7, "one\r\nX: y", "own"), (9, None, "<p>é</p>"), (2**60 + 1, "b", "big id")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(2)


def test_round_trip(spark, tmp_path):
    index = warc.write(pages(spark, ROWS), "page_id", "url", "html", folder=str(tmp_path / "w"))
    got = warc.read(index).collect()
    assert len(got) == len(ROWS)
    assert sorted((str(r.page_id), r.record_type, r.refers_to or 0, r.payload_bytes) for r in got) == sorted([
        ("3", "revisit", 9, 9), ("9", "response", 0, 9), ("9", "response", 0, 9), ("None", "revisit", 9, 9),
        ("4", "revisit", 5, 0), ("5", "response", 0, 0), ("6", "response", 0, 1_000_000), ("7", "response", 0, 3),
        (str(2**60 + 1), "response", 0, 6)])
    assert {r.page_id: r.payload for r in got}[6] == b"long " * 200_000
    assert {r.page_id: r.url for r in got}[3] == "http://a/é x"
    for f in os.listdir(tmp_path / "w"):  # whole files are plain gzip streams of records
        raw = gzip.open(tmp_path / "w" / f).read()
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"\r\nX: y" not in raw


def test_selected_records_and_least_bytes(spark):
    index = warc.write(pages(spark, ROWS), "page_id", "url", "html", least_bytes=10)
    assert index.filter("record_type = 'revisit'").count() == 0
    some = index.filter(F.col("page_id").isin(3, 7))
    assert sorted(r.page_id for r in warc.read(some.unionAll(some)).collect()) == [3, 3, 7, 7]
    bad = index.filter("page_id = 7").withColumn("payload_digest", F.lit("X"))
    try:
        warc.read(bad).collect()
    except Exception as e:
        assert "another digest" in str(e)
    else:
        raise AssertionError


def test_empty(spark):
    assert warc.read(warc.write(pages(spark, []), "page_id", "url", "html")).count() == 0


def test_oracle(spark):
    same(spark, "op3_warc_archive", "/root/testdata/sf0.01")
