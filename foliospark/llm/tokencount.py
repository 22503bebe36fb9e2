"""Token counts; huge documents are counted in overlapping chunks that are joined where both sides provably agree.

A byte-level vocabulary splits a text into words by a pattern that looks ahead a few characters and never back, and the
ids of a word depend on the word alone. So a word border of the whole text is where any encoding may start afresh: from
a border on which a chunk agrees with the whole text, it agrees with it up to a few characters (``margin``) before
its end, where a longer word, a contraction or a special string may have been cut. Two neighbouring chunks overlap; a
border that both have, and that lies before that margin of the left one, is proven stable by induction from the text's
start, and the counts are spliced there. Where an overlap holds none, as in a word without an end, the document is
encoded again from stable border to stable border, each chunk widened until it holds one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from .common import materialize
from .encoding import RankEncoder, encoder, grouped, load, vocabulary

LIMIT = 1024
#: Characters from one chunk's start to the next one's, and those that both have. Longer texts than two steps are huge.
STEP, OVERLAP = 16_384, 512
#: Chunks of a document that one Arrow batch holds.
TOGETHER = 64


def margin(tok: Tokenizer) -> int:
    """Before the end of a chunk, how many characters a border must lie to be one whatever follows the chunk."""
    return max([2, *(len(t.content) for t in tok.get_added_tokens_decoder().values())]) + 2


def splits(content: str) -> bool:
    """Whether a vocabulary's words are such that chunks can be proven to agree."""
    added = load(content).get_added_tokens_decoder().values()
    return RankEncoder.fits(content) and not any(t.lstrip or t.rstrip or t.single_word for t in added)


def borders(tok: Tokenizer, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the words of a text start, the tokens before each, and the number of all tokens."""
    e = tok.encode(text, add_special_tokens=False)
    words = np.asarray(e.word_ids, np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    return np.asarray(e.offsets, np.int64).reshape(-1, 2)[first, 0], first, len(words)


def widened(tok: Tokenizer, text: str, size: int) -> int:
    """The tokens of a text, encoded from stable border to stable border in chunks of ``size`` characters, of four
    times as many as long as a chunk holds no such border."""
    at, total, now, edge = 0, 0, size, margin(tok)
    while True:
        end = min(at + now, len(text))
        where, before, n = borders(tok, text[at:end])
        if end == len(text):
            return total + n
        k = int(np.searchsorted(where, end - at - edge, "right")) - 1
        if k > 0:
            total, at, now = total + int(before[k]), at + int(where[k]), size
        else:
            now *= 4


def _small(docs: DataFrame, content: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary of 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc, n = encoder(shared.value), np.zeros(b.num_rows, np.int64)
            for at, texts in grouped(b.column(2).to_pylist()):
                n[at : at + len(texts)] = [len(ids) // 4 for ids in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def _chunks(huge: DataFrame, step: int, overlap: int) -> DataFrame:
    """Overlapping chunks of each text: doc_id, n_bytes, digest, task, chunk, last, piece."""
    names = ["doc_id", "n_bytes", "digest", "task", "chunk", "last", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, n_bytes, digest, task, text in zip(*b.columns, strict=True):
                whole = text.as_py()
                starts = [0, *range(step, max(len(whole) - overlap, 1), step)]
                for at in range(0, len(starts), TOGETHER):
                    some = starts[at : at + TOGETHER]
                    k = len(some)
                    cols = [pa.array([x.as_py()] * k, x.type) for x in (doc_id, n_bytes, digest, task)]
                    cols += [pa.array(range(at, at + k), pa.int32()), pa.array([s == starts[-1] for s in some]), pa.array([whole[s : s + step + overlap] for s in some])]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    cut = huge.select("doc_id", "n_bytes", "digest", F.spark_partition_id().alias("task"), "text")
    return cut.mapInArrow(run, "doc_id long, n_bytes long, digest string, task int, chunk int, last boolean, piece string")


def _encoded(chunks: DataFrame, content: str, step: int, overlap: int) -> DataFrame:
    """For each chunk its tokens, and the borders in the overlaps with both neighbours: places in the document and the
    tokens before them. The right ones are those that no text after the chunk can change."""
    shared = chunks.sparkSession.sparkContext.broadcast(content)
    names = ["doc_id", "n_bytes", "digest", "chunk", "last", "n", "left_at", "left_n", "right_at", "right_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for b in batches:
            tok = tok or load(shared.value)
            edge, rows = margin(tok), []
            for chunk, piece in zip(b.column(4).to_pylist(), b.column(6).to_pylist(), strict=True):
                where, before, n = borders(tok, piece)
                left, right = where <= overlap, (where >= step) & (where <= len(piece) - edge)
                at = where + chunk * step
                rows.append((n, at[left], before[left], at[right], before[right]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] + [pa.list_(pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(k) for k in (0, 1, 2, 4, 5)] + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return chunks.mapInArrow(run, "doc_id long, n_bytes long, digest string, chunk int, last boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")


def _spliced(encoded: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes, copies, n_tokens of each document; n_tokens is null if an overlap holds no stable border."""
    own = Window.partitionBy("doc_id", "digest").orderBy("chunk")
    one = encoded.groupBy("doc_id", "digest", "chunk").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in encoded.columns if c not in ("doc_id", "digest", "chunk")))
    met = one.withColumn("next_at", F.lead("left_at").over(own)).withColumn("next_n", F.lead("left_n").over(own))
    met = met.withColumn("splice", F.array_max(F.array_intersect("right_at", "next_at")))
    before = F.expr("element_at(right_n, int(array_position(right_at, splice))) - element_at(next_n, int(array_position(next_at, splice)))")
    counted = met.withColumn("tokens", F.when(F.col("last"), F.col("n")).when(F.col("splice").isNotNull(), before))
    n = F.when(F.count("tokens") == F.count("*"), F.sum("tokens"))
    return counted.groupBy("doc_id", "digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("copies").alias("copies"), n.alias("n_tokens"))


def _widened(docs: DataFrame, content: str, size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for b in batches:
            tok = tok or load(shared.value)
            n = [widened(tok, t.as_py(), size) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def count_tokens(docs: DataFrame, limit: int = LIMIT, vocabulary_name: str = "byte_bpe_50k.json", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null or empty text has no bytes and no tokens. Special strings inside a text count as the library does by default.
    Repeated rows are counted each; a null doc_id is kept. An empty table gives no rows. Only doc_id and text are read,
    so other columns may have any name. Chunks of one document go to many tasks, which hold a chunk each. A text with a
    longer word than ``overlap`` characters at a chunk's end is encoded again by one task, that word as a whole. Vocabularies
    without such borders (another kind than byte-level) are counted in whole texts.
    """
    content = vocabulary(vocabulary_name)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("n_bytes", F.octet_length("text").cast("long"))
    over = (F.col("n_tokens") > limit).alias("over_limit")
    if not splits(content):
        return _small(source, content).select("*", over)
    huge = source.where(F.length("text") > 2 * step).withColumn("digest", F.sha2(F.col("text"), 256))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = _chunks(huge, step, overlap).repartition(parts, "doc_id", "digest", "chunk", "task")  # copies differ in their task
    spliced = materialize(_spliced(_encoded(dealt, content, step, overlap)), "spliced")
    found = spliced.where("n_tokens IS NOT NULL").select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    out = _small(source.where(F.length("text") <= 2 * step), content).union(found.drop("copy"))
    left = spliced.where("n_tokens IS NULL").select(F.col("doc_id").alias("of"), F.col("digest").alias("same"))
    if left.limit(1).count():
        again = huge.join(left, huge["doc_id"].eqNullSafe(F.col("of")) & (huge["digest"] == F.col("same")), "left_semi")
        out = out.union(_widened(again, content, 4 * (step + overlap)))
    return out.select("*", over)
