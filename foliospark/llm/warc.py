"""WARC archives with revisit records.

Headers (page id, payload digest, size) are shuffled by payload digest without their payloads; of equal payloads the
one with the largest page id is the response and the others become revisit records of it. The payloads that occur
repeatedly are told to the writing tasks: by broadcast while they are few, else by a join that broadcasts the hot ones.
Archives have fresh headers, a gzip member for each record, and a bounded size; a task reports the files that it closed,
so what a lost task leaves behind is not read. Reading streams the archives and joins revisit records to the responses
that they refer to.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import join_counted, materialize, scratch_dir
from .tokenfile import _filesystem

MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive file, about: a file ends with the record that reaches them.
FILE_BYTES = 64 << 20
#: Repeated payloads up to which all of them are broadcast (some 60 MB).
BROADCAST = 1_000_000
LEVEL = 5
BATCH = 2000


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of each row; the payload is the html in UTF-8, null as empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))


def originals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """digest, the page_id of its response, and n, its records, for payloads of at least ``min_bytes`` that occur repeatedly."""
    found = headers(pages).where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest"))
    return found.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")


def record_id(page_id: object, digest: str) -> str:
    """Of the page id and the payload's digest: only exact repeats share it."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives below ``path``: a response record, or a revisit record without payload, for each row.

    Returns name, n_records and n_bytes of the files; they are written when it is read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    again = materialize(originals(pages, min_bytes), "originals")
    total, most = again.agg(F.sum("n"), F.count("*")).first()
    if most <= BROADCAST:
        rows = rows.join(F.broadcast(again.drop("n")), "digest", "left")
    else:  # of the rows without a repeated payload, each is a group of one
        counted = headers(pages).select(F.col("payload_digest").alias("digest")).distinct().join(again, "digest", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        rows = join_counted(rows, counted, "digest", "n", total)
    rows = rows.select("page_id", "url", "digest", "payload", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(path)
        out, name, n, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["name", "n_records", "n_bytes"])

        for b in batches:
            for page_id, url, digest, payload, original in zip(*b.columns, strict=True):
                page_id, digest, original = page_id.as_py(), digest.as_py(), original.as_py()
                revisit = original is not None and page_id != original
                body = b"" if revisit else payload.as_buffer()
                head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
                head += [f"WARC-Target-URI: {(url.as_py() or '').translate({10: None, 13: None})}", f"WARC-Payload-Digest: sha1:{digest}"]  # a line break in a url would end its header
                if revisit:
                    head += [f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Profile: {PROFILE}"]
                head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, n, size = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for part in (packer.compress("\r\n".join(head).encode()), packer.compress(body), packer.compress(b"\r\n\r\n"), packer.flush()):
                    out.write(part)
                    size += len(part)
                n += 1
                if size >= file_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    system, root = _filesystem(path)
    system.create_dir(root, recursive=True)
    return rows.mapInArrow(run, "name string, n_records long, n_bytes long")


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        n = int(head["content-length"])
        payload = stream.read(n)
        if len(payload) != n:
            raise ValueError("the archive ends within a record")
        yield head, payload


def read(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """record_id, page_id, record_type, payload_bytes (null for a revisit), payload_digest and refers_to (the record a
    revisit refers to), one row for each record of ``files`` (their ``name``), or of all archives below ``path``."""
    if files is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    names = files.select("name")
    names = names.repartition(max(1, names.count()), "name")
    fields = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to string"

    def number(uri: str) -> int | None:
        return int(x) if (x := uri.removeprefix("<urn:page:").partition(":")[0]) else None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for head, payload in records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)):
                        revisit = head["warc-type"] == "revisit"
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("a payload does not match its digest")
                        own = head["warc-record-id"]
                        rows.append((own, number(own), head["warc-type"], None if revisit else len(payload), digest, head.get("warc-refers-to")))
                        if len(rows) == BATCH:
                            yield out(rows)
                            rows = []
                if rows:
                    yield out(rows)

    return names.mapInArrow(run, fields)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; payloads under ``min_bytes`` are all responses. Rows that share the largest page
    id of a payload are all responses; a null page id never is a revisit's target (of payloads whose ids are all
    null, all are responses). An empty table gives no archives and no rows. Only page_id, url and html are read.
    """
    spark, path = pages.sparkSession, f"{scratch_dir(pages.sparkSession)}/archives"
    files = materialize(write(pages, path, min_bytes, file_bytes=file_bytes), "files")
    found = materialize(read(spark, path, files), "records")
    revisits = found.where("record_type = 'revisit'")
    asked = revisits.groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("n"))
    original = found.where("record_type = 'response'").join(asked, "record_id").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("original"), F.max("payload_bytes").alias("whole"), F.max("n").alias("n"))
    original = materialize(original, "referred")
    resolved = join_counted(revisits, original, "refers_to", "n", revisits.count())
    whole = resolved.select("page_id", F.col("whole").alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to"))
    return found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(whole)
