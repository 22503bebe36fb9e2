"""Token files: flat unsigned ids with 64-bit document offsets, memory-mapped.

A shard is three files: ``.bin`` holds the ids of its documents one after the other (16 bits each where the
vocabulary allows, else 32), ``.idx`` the document offsets (one more than documents, unsigned 64-bit, in ids), and
``.doc`` the document ids (a byte for present and a signed 64-bit number). Shards are in ascending order of doc_id;
a shard's base is the prefix sum of the token counts before it.
"""

from __future__ import annotations

import mmap
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, scratch_dir
from .encoding import encoder, grouped, vocabulary

END_ID = 1
DOC = np.dtype([("present", "u1"), ("id", "<i8")])
#: Ids written to a file at once.
FLUSH = 1 << 22
#: Bytes of text that a shard holds, about, and most shards: beyond that, shards grow with the input.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 20_000
#: Ids that are read at once.
READ = 1 << 22


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary_name: str = "word_bpe_49k.json", shards: int | None = None) -> DataFrame:
    """Write the shards below ``path`` and return shard, n_docs, n_tokens, name; the files are written when it is read.

    A task writes under a name of its own and reports that name with its row, so a task that runs twice (lost
    executor, speculation) leaves a file that nothing refers to.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(vocabulary(vocabulary_name))  # 2 MB, whatever the input
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if shards is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = min(MOST_SHARDS, max(1, -(-total // SHARD_BYTES)))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        kind = "<u2" if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, root = _filesystem(path)
        n_docs = n_tokens = 0
        with system.open_output_stream(f"{root}/{name}.bin") as ids, system.open_output_stream(f"{root}/{name}.idx") as idx, system.open_output_stream(f"{root}/{name}.doc") as doc:
            idx.write(np.zeros(1, "<u8").tobytes())
            for b in batches:
                for at, texts in grouped(b.column(1).to_pylist()):
                    got = enc.encode(texts)
                    ids.write(np.concatenate([x for t in got for x in (np.frombuffer(t, "<u4"), end)]).astype(kind).tobytes())
                    offsets = n_tokens + np.cumsum([len(t) // 4 + 1 for t in got], dtype="<u8")
                    idx.write(offsets.astype("<u8").tobytes())
                    rows = [b.column(0)[i].as_py() for i in range(at, at + len(texts))]
                    doc.write(np.array([(x is not None, x or 0) for x in rows], DOC).tobytes())
                    n_docs, n_tokens = n_docs + len(texts), int(offsets[-1])
        if n_docs:
            cols = [pa.array([shard], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([kind]), pa.array([name])]
            yield pa.RecordBatch.from_arrays(cols, names=["shard", "n_docs", "n_tokens", "kind", "name"])

    system, root = _filesystem(path)
    system.create_dir(root, recursive=True)
    order = [F.col("doc_id").asc_nulls_first(), F.col("copy")]  # an id that many rows share, or none, is split too
    ordered = source.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(int(shards), *order).sortWithinPartitions(*order).drop("copy")
    return ordered.mapInArrow(run, "shard int, n_docs long, n_tokens long, kind string, name string")


class _Numbers:
    """A file's numbers, in slices: mapped into memory where the path is local, else read as asked for."""

    def __init__(self, path: str, kind: np.dtype | str):
        self.kind = np.dtype(kind)
        system, plain = _filesystem(path)
        self.file = system.open_input_file(plain)
        self.n = self.file.size() // self.kind.itemsize
        self.map = None
        if self.n and urlsplit(path).scheme in ("", "file"):
            with open(plain, "rb") as f:
                self.map = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), self.kind)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[part]
        start, stop, _ = part.indices(self.n)
        return np.frombuffer(self.file.read_at(max(0, stop - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)


def _documents(name: str, start: int, kind: str) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids_crc32 of a shard's documents; what is in memory is READ ids, or 10,000 documents' rows."""
    idx, doc, ids = _Numbers(f"{name}.idx", "<u8"), _Numbers(f"{name}.doc", DOC), _Numbers(f"{name}.bin", kind)
    for at in range(0, doc.n, 10_000):
        own, cut = doc[at : at + 10_000], idx[at : at + 10_001].astype(np.int64)
        crcs = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            crc = 0
            for k in range(a, b, READ):
                crc = zlib.crc32(ids[k : min(k + READ, b)].astype("<u4").tobytes(), crc)
            crcs.append(crc)
        cols = [pa.array(own["id"], mask=own["present"] == 0), pa.array(start + cut[:-1]), pa.array(np.diff(cut)), pa.array(crcs, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])
    for x in (idx, doc, ids):
        x.file.close()


def read(path: str, written: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit) of each document, from the files.

    ``written`` is a table with one row for each shard, MOST_SHARDS at most; a running sum gives their bases.
    """
    base = F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")
    parts = min(MOST_SHARDS, max(1, written.count()))
    shards = written.select("shard", base.alias("base"), "kind", F.concat(F.lit(f"{path}/"), "name").alias("file")).repartition(parts, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, start, kind, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from _documents(name, start, kind)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end_id: int = END_ID, vocabulary_name: str = "word_bpe_49k.json") -> DataFrame:
    """Write and read back. Null and empty texts are documents of the end id alone; null ids come first; rows with
    equal ids follow each other in any order; an empty table gives no files and no rows. Only doc_id and text are
    read."""
    path = f"{scratch_dir(docs.sparkSession)}/tokens"
    return read(path, materialize(write(docs, path, end_id, vocabulary_name), "shards"))
