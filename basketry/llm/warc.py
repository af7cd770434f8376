"""WARC archives: write with an index, then read selected records back by coalesced byte ranges.

``write`` streams rows into WARC/1.1 files of gzip members (one per record) and stores an index with
file, offset, length, URL and digest per record. ``read`` sorts the selected index rows by file and
offset, merges neighbouring ranges into one read each, and cuts the records out. Of equal payloads one
is a response and the others revisit it. Files are opened through ``pyarrow.fs``, so the folder may be
any store it knows; a retried task writes new files and the index names only those of the task that won.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import join_spread, shared_path, stored, utf8

#: Bytes after which a writer starts its next file; widest gap and longest range of one read.
ROLL, GAP, RANGE = 64 << 20, 64 << 10, 8 << 20
#: Format constants of WARC/1.1, as text.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAFE = "!#$%&'()*+,/:;=?@[]~"
FIELDS = [("page_id", "long"), ("url", "string"), ("record_type", "string"), ("refers_to", "long"),
          ("payload_digest", "string"), ("payload_bytes", "long")]
INDEX = [*FIELDS, ("file", "string"), ("offset", "long"), ("length", "long")]
READ = [*FIELDS, ("payload", "binary")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1 without prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(url: str | None) -> str | None:
    """The URL as a header can carry it: what is not printable ASCII is percent-encoded."""
    return None if url is None else quote(url, safe=SAFE)


def _record_id(key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"


def record(page_id, url, payload: bytes, dig: str, refers_to, date: str) -> bytes:
    """One uncompressed WARC record; with ``refers_to``, a revisit without payload."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)),
            ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{dig}")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    if refers_to is not None:
        head += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", PROFILE)]
        block = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _ddl(fields) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _batch(rows: list[tuple], fields) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write(df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str | None = None,
          least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row and return the stored index (see ``INDEX``).

    Of payloads with equal bytes and at least ``least_bytes`` of them, the row with the largest id is the
    response and the others revisit it; all others are responses. A null payload is empty; a null id is
    smaller than any other; rows that repeat the largest id are all responses; a null URL leaves its header
    out; an empty table gives an empty index; other columns are ignored.
    """
    spark = df.sparkSession
    folder = folder or shared_path(spark, "warc")
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                     utf8(payload_col).alias("payload"))
    rows = rows.withColumn("bytes", F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    # only payloads that repeat, with the id to refer to; pre-aggregated before the shuffle
    same = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("bytes").agg(
        F.count(F.lit(1)).alias("c"), F.max("page_id").alias("first_id"))
    same = stored(same.filter("c > 1"), "repeats")
    j = join_spread(rows, same, "bytes", "c", df.count(), "page_id").select(
        "page_id", "url", "payload",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        store.create_dir(base, recursive=True)
        out = None
        try:
            for batch in it:
                index = []
                for page, url, payload, to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    dig = digest(payload)
                    data = _gzip(record(page, url, payload, dig, to, date))
                    out.write(data)
                    index.append((page, url, "response" if to is None else "revisit", to, dig, len(payload), name, at, len(data)))
                    at += len(data)
                yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    index = stored(j.mapInArrow(put, _ddl(INDEX)), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def read(index: DataFrame) -> DataFrame:
    """Read the records that ``index`` selects (rows of ``write``'s index, in any order, repeats included).

    Returns page_id, url, record_type, refers_to, payload_digest, payload_bytes (both of the full
    payload; computed from the bytes read for responses, from the headers for revisits) and payload (null
    for revisits). A response whose bytes do not have the digest in the index raises ValueError.
    """
    ids = index.select("folder", "file", "offset", "length", "page_id", "url", "refers_to", "payload_digest")
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = ids.repartitionByRange(n, "folder", "file", "offset").sortWithinPartitions("folder", "file", "offset")

    def ranges(rows):
        """Runs of index rows whose byte ranges lie close together."""
        run, start, end = [], 0, 0
        for r in rows:
            if run and (r[:2] != run[-1][:2] or r[2] - end > GAP or r[2] + r[3] - start > RANGE):
                yield start, end, run
                run = []
            if not run:
                start, end = r[2], r[2]
            run.append(r)
            end = max(end, r[2] + r[3])
        if run:
            yield start, end, run

    def get(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f = None, None
        for batch in it:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for start, end, run in ranges(rows):
                if run[0][:2] != key:
                    if f is not None:
                        f.close()
                    key = run[0][:2]
                    store, base = _place(key[0])
                    f = store.open_input_file(f"{base}/{key[1]}")
                f.seek(start)
                buf, out = memoryview(f.read(end - start)), []
                for _, _, offset, length, page, url, to, dig in run:
                    fields, http, payload = parse(zlib.decompress(buf[offset - start:offset - start + length], 31))
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = fields["WARC-Type"]
                    if (stated if kind == "revisit" else digest(payload)) != dig or stated != dig:
                        raise ValueError(f"{key[1]} at {offset}: the payload has another digest than the index")
                    out.append((page, url, kind, to if kind == "revisit" else None, dig,
                                int(http["Content-Length"]) if kind == "revisit" else len(payload),
                                None if kind == "revisit" else payload))
                yield _batch(out, READ)
        if f is not None:
            f.close()

    return ids.mapInArrow(get, _ddl(READ))
