"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled by a seeded digest of their id and ranked within their source; the rank, from a seeded start below
one, over the source's size is their fractional rank. In the order of fractional ranks every stretch holds each source in proportion, so that order
is cut into shards of equal row counts. Places in both orders come from sorted ranges of equal size, so a source with a
third of all rows, or an id that many rows share, is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_counted, materialize, placed

SHARDS, SEED = 8, "interleave-1"


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null for this law), source.

    Row counts of shards differ by at most one, and each holds every source in proportion. A null source is a stratum
    of its own; a null text counts as empty; repeated rows each take a slot; null ids are shuffled as an id of their
    own. Equal texts are not kept together, as the law is on rows. An empty table gives no rows. The text itself is
    read once and not shuffled; only doc_id, source and text are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("stratum"),
        F.monotonically_increasing_id().alias("copy"),  # tells equal rows apart, which may change places
    )
    rows = rows.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    rows = materialize(rows, "rows")
    ties = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("copy")]
    ordered, n = placed(rows, [F.col("stratum"), F.col("digest"), *ties], "source_position")
    ordered = materialize(ordered, "ordered")
    strata = ordered.groupBy("stratum").agg(F.min("source_position").alias("first"), F.count("*").alias("source_rows"))
    known = join_counted(ordered, strata.withColumn("n", F.col("source_rows")), "stratum", "n", n)
    # each source starts at a seeded point of its first step: small sources would else all meet at the same fractions
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rank = F.col("source_position") - F.col("first")
    fractions = materialize(known.withColumn("source_rank", rank).withColumn("fraction", (rank + start) / F.col("source_rows")), "fractions")
    whole, n = placed(fractions, [F.col("fraction"), F.col("stratum"), F.col("source_rank")])
    number = F.expr(f"(position * {shards}) div {max(n, 1)}L")
    first = F.expr(f"((shard * {n}L) + {shards} - 1) div {shards}")
    out = whole.withColumn("shard", number).withColumn("slot", F.col("position") - first)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
