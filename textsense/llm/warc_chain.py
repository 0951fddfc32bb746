"""WARC archives, read back by boundary-chain verification.

Writing: a record per page. Of pages with equal payloads the one with the largest id is a
``response``; the others are ``revisit`` records that name it and hold no payload. Equal payloads
are found by digest: one sum per digest, joined back, so a hot payload is a hot key of narrow
sums only.

Reading: the record magic may also occur inside a payload, so a task that finds it only proposes
a candidate: its offset and, by its length header, the offset of its successor. From the start of
each file, pointer jumping (each round doubles the pointers' reach) marks the candidates that
the chain of successors runs through; all others lie inside payloads and are dropped.

Defined results: a null payload is the empty one; a null url has no target header; rows with the
largest id of their payload are all responses if it is repeated; a null id counts as smaller than
any, and is a response if its payload has no other id; files of a broken chain yield the records
in front of the break; an empty table gives no file and no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folder, stored, write_file

FILE_BYTES = 16 << 20
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_ID = "<urn:x-page:%s>"


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("Content-Length", str(len(block)))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def page_record(page_id, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to) -> bytes:
    """The record of one page; without a payload it is a revisit of ``refers_to``."""
    head = [("WARC-Record-ID", _ID % ("" if page_id is None else page_id))]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    if payload is not None:
        return _record("response", head, block + payload)
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _ID % refers_to)]
    return _record("revisit", head, block)


def with_decisions(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, url, payload, n_bytes, digest, refers_to): payload is null where refers_to is not."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")) \
                .withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    last = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest") \
               .agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    joined = rows.join(stored(last, "payload-last"), "digest", "left")
    revisit = F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last")))
    return joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "n_bytes", "digest",
                         F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_REVISIT_BYTES,
          file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the archives; their folder and the files (file, records, bytes)."""
    out = folder(pages.sparkSession, "warc")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, made, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush():
            nonlocal held, size
            name = f"part-{part:05d}-{len(made):05d}.warc"
            data = _record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{name}>"), ("Content-Type", "application/warc-fields")],
                           b"format: WARC file version 1.1\r\n") + b"".join(held)
            write_file(f"{out}/{name}", data)
            made.append((name, len(held), len(data)))
            held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, n, digest, refers = (batch.column(k)[i].as_py() for k in range(6))
                r = page_record(page_id, url, payload, n, base64.b32encode(bytes.fromhex(digest)).decode(), refers)
                if held and size + len(r) > file_bytes:
                    flush()
                held.append(r)
                size += len(r)
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["file", "records", "bytes"])

    # sorted, so that a task that is run again cuts its files alike
    rows = with_decisions(pages, id_col, url_col, html_col, min_bytes).sortWithinPartitions("id", "digest", "url")
    return out, stored(rows.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-manifest")


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+) *\r\n", re.IGNORECASE)
_FIELD = re.compile(rb"\r\n([A-Za-z0-9-]+): *([^\r\n]*)")
_PAGE = re.compile(rb"<urn:x-page:(-?\d*)>")


def _page(value: bytes | None):
    m = _PAGE.fullmatch(value or b"")
    return int(m[1]) if m and m[1] else None


def propose(data: bytes):
    """Candidates of one archive: (offset, successor, kind, id, refers_to, payload bytes, digest)
    wherever the magic is followed by a header block and a length that end on a record's end."""
    at = data.find(MAGIC)
    while at >= 0:
        head_end = data.find(END, at)
        head = data[at + len(MAGIC) - 2:head_end + 2] if head_end >= 0 else b""
        if m := _LENGTH.search(head):
            start = head_end + 4
            stop = start + int(m[1])
            if data[stop:stop + 4] == END:
                f = {k.lower(): v for k, v in _FIELD.findall(head)}
                kind = f.get(b"warc-type", b"").decode("latin-1")
                http_end = data.find(END, start, stop)
                n, digest = 0, None
                if http_end >= 0 and (h := _LENGTH.search(data[start:http_end + 2])):
                    n = int(h[1])
                if kind == "response":
                    body = memoryview(data)[http_end + 4:stop] if http_end >= 0 else memoryview(data)[start:stop]
                    n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                elif kind == "revisit":
                    digest = f.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                yield at, stop + 4, kind, _page(f.get(b"warc-record-id")), _page(f.get(b"warc-refers-to")), n, digest
        at = data.find(MAGIC, at + 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """All candidates of the archives in folder ``path``; a task reads one file at a time."""
    def run(batches):
        import pyarrow as pa
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["at", "next", "kind", "id", "refers_to", "n_bytes", "digest"]
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                rows = list(propose(data.as_py()))
                for a in range(0, len(rows), 5000):
                    some = rows[a:a + 5000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.as_py()] * len(some), pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*some), types)]],
                        names=["file", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path)
    return files.select(F.xxhash64("path").alias("file"), "content").mapInArrow(
        run, "file bigint, at bigint, next bigint, kind string, id bigint, refers_to bigint, n_bytes bigint, digest string")


def reachable(links: DataFrame) -> DataFrame:
    """The (file, at) of ``links`` (file, at, next) that lie on the chain from offset 0."""
    jump = stored(links.select("file", "at", "next"), "jumps")
    reached = stored(jump.where("at = 0").select("file", "at"), "reached")
    while True:
        # what the reached ones point to, if a candidate is there
        there = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")) \
                       .join(links.select("file", "at"), ["file", "at"], "left_semi").join(reached, ["file", "at"], "left_anti")
        new = stored(there, "reached")
        if new.limit(1).count() == 0:
            return reached
        reached = stored(reached.union(new), "reached")
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jump = stored(jump.join(further, ["file", "next"]).select("file", "at", F.col("further").alias("next")), "jumps")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page record."""
    found = stored(candidates(spark, path), "candidates")
    real = reachable(found.select("file", "at", "next"))
    return found.join(real, ["file", "at"], "left_semi").where(F.col("kind").isin("response", "revisit")).select(
        "id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def round_trip(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the archives of ``pages`` and read them back."""
    spark = pages.sparkSession
    path, files = write(pages, id_col, url_col, html_col, min_bytes)
    if files.limit(1).count() == 0:
        return spark.createDataFrame([], "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read(spark, path)
