"""Prefix trie of conversations: count-min screening, then exact grouping of what may be shared.

Each turn becomes a digest of its role and text, each prefix of a conversation a digest of its turns' digests. Every task
counts its prefixes in a count-min sketch; the merged sketch goes to all tasks. An estimate of one proves that a prefix
has one conversation, and so has all that follows it: such tails are nodes that a task emits by itself. Only prefixes
that may be shared are shuffled and grouped exactly.

Subtrees need no walk of the tree. A node belongs to its smallest member, which then has all later nodes of its own path
too. So the leaves below a node are those that its members have, and the sums below it are its members' own sums, less what
its owner has above it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import MOST_PARTS, ORDERED, materialize
from .runs import Runs, before, elements, packed

GROUP, HEADS = 5, 9
#: Rows of the sketch, counters for each prefix, and the least and most counters of a row. A counter is a byte that stops
#: at two. Beyond some 30 million prefixes the sketch fills up and more of them go the exact way.
ROWS, EACH, LEAST, MOST = 3, 8, 1 << 12, 1 << 25
SEGMENT = 1 << 16
#: Characters of ids that are hashed together.
PACK = 1 << 16
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_NONE = hashlib.sha256(b"").hexdigest()


def cells(k1: np.ndarray, k2: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each prefix in each row of a sketch (``width`` is a power of two)."""
    a, b, shift = k1.view(np.uint64), k2.view(np.uint64), np.uint64(65 - width.bit_length())
    mixed = lambda i: a * np.uint64(_MULTIPLIERS[2 * i]) ^ (b * np.uint64(_MULTIPLIERS[2 * i + 1]))
    return [((m ^ (m >> np.uint64(29))) * np.uint64(_MULTIPLIERS[0]) >> shift).astype(np.int64) + i * width for i, m in enumerate(map(mixed, range(ROWS)))]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text; 16 bytes), n_bytes (of the text in UTF-8)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(whole)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )


def heads_of(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, pos, digest, n_bytes) of the rebuilt conversations, in the order of pos, and all ids.

    A conversation is its own turns after its first h, behind the first h of conversation conv_id - conv_id % 5.
    """
    runs = Runs(materialize(turns(conversations), "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")])
    resolve = runs.resolver()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = resolve(b)["at"]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at), b.column(2), b.column(3)], names=["conv_id", "pos", "digest", "n_bytes"])

    own = materialize(runs.table.mapInArrow(run, "conv_id long, pos long, digest binary, n_bytes long"), "own")
    ids = own.where("pos = 1").select("conv_id")
    to = ids.select(F.col("conv_id").alias("to"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("conv_id"), heads_of(F.col("conv_id")).alias("h"))
    heads = own.where((F.col("pos") < HEADS) & (F.col("conv_id") % GROUP == 0)).join(to, "conv_id").where("pos <= h")
    tails = own.where(F.col("pos") > heads_of(F.col("conv_id")))
    return heads.select(F.col("to").alias("conv_id"), "pos", "digest", "n_bytes").union(tails), ids


def _sketch(runs: Runs) -> np.ndarray:
    """The count-min sketch of all prefixes."""
    resolve, width = runs.resolver(), min(MOST, max(LEAST, 1 << (EACH * max(runs.n, 1) - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * width, np.uint8)
        for b in batches:
            for at in cells(*packed(resolve(b)["lanes"]), width):
                cell, n = np.unique(at, return_counts=True)
                counts[cell] = np.minimum(2, counts[cell] + n)
        yield from out({s: counts[s * SEGMENT : (s + 1) * SEGMENT] for s in range(-(-len(counts) // SEGMENT))})

    def out(segments: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s, c in segments.items():
            if c.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1)])], names=["segment", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(zlib.decompress(raw), np.uint8)
                held[s] = np.minimum(2, held[s] + c) if s in held else c
        yield from out(held)

    schema, whole = "segment int, counts binary", np.zeros(ROWS * width, np.uint8)
    for r in runs.table.mapInArrow(count, schema).repartition("segment").mapInArrow(merge, schema).collect():  # ROWS * MOST bytes at most
        whole[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    return whole


_PREFIX = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, n_bytes long, last boolean, shared boolean, top boolean"


def prefixes(runs: Runs, sketch: np.ndarray) -> DataFrame:
    """Every prefix of every sequence: its key (k1, k2) and its parent's (p1, p2); ``shared`` if it may have other
    members, else ``top`` unless the row before is proven to be its only parent's."""
    resolve, width, schema = runs.resolver(), len(sketch) // ROWS, _PREFIX
    whole = runs.table.sparkSession.sparkContext.broadcast(sketch)  # ROWS * MOST bytes at most
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, alone = None, 0, False  # of the row before
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            found, c = resolve(b), b.column(0).to_numpy()
            k1, k2 = packed(found["lanes"])
            p1, p2 = packed(before(found["lanes"], elements(b.column(2))))
            least = np.minimum.reduce([whole.value[at] for at in cells(k1, k2, width)])
            at = found["at"]
            one, rows = least < 2, np.arange(n)
            follows = np.r_[c[0] == conv and at[0] == depth + 1, (c[1:] == c[:-1]) & (at[1:] == at[:-1] + 1)]
            start = np.maximum.accumulate(np.where(follows, 0, rows))
            ones = np.cumsum(one)
            single = ones - (ones - one)[start] + ((start == 0) & follows[0] & alone) > 0  # proven here or before in its conversation
            top = single & ~(follows & np.r_[alone, single[:-1]])
            conv, depth, alone = c[-1], at[-1], bool(single[-1])
            cols = (c, at, k1, k2, p1, p2, b.column(3), found["last"], ~single, top)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    return runs.table.mapInArrow(run, schema)


def id_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256: SHA-256 of the ids of each key, ascending, joined by commas.

    Ids are packed in sorted ranges first, so a hot key is split until its packs are hashed, one after the other.
    """
    spark = ends.sparkSession
    ends = materialize(ends, "ends")
    parts = min(MOST_PARTS, max(1, -(-ends.count() // ORDERED), spark.sparkContext.defaultParallelism))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            cols = ([key[0]], [key[1]], [first], [",".join(ids)])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["k1", "k2", "first", "ids"])

        for b in batches:
            for k1, k2, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if key is not None and ((k1, k2) != key or size > PACK):
                    yield out()
                    key = None
                if key is None:
                    key, first, ids, size = (k1, k2), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if key is not None:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done: list[tuple[int, int, str]] = []
            for k1, k2, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (k1, k2) == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, sha.hexdigest())])

    order = ["k1", "k2", "conv_id"]
    packs = ends.select(order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, "k1 long, k2 long, first long, ids string")
    return packs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])


def nodes(sequences: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie of sequences (conv_id, pos, digest, n_bytes), and of those of ``ids`` that have no rows: columns as in ``trie``."""
    runs = Runs(materialize(sequences, "sequences"), "conv_id", [F.col("pos")], digest="digest")
    every = materialize(prefixes(runs, _sketch(runs)), "prefixes")
    key, root = ["k1", "k2"], ids.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not root["n"]:
        return sequences.sparkSession.createDataFrame([], _SCHEMA)
    alone, maybe = every.where("NOT shared"), every.where("shared")

    group = maybe.groupBy(key).agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count("*").alias("n_convs"),
        F.sum(F.col("last").cast("long")).alias("n_ends"), ((F.count("*") - 1) * F.first("n_bytes")).alias("value"),
    )
    exact = materialize(group, "exact")
    # what each conversation has of its own: a leaf, and the sum of its nodes' values
    has = exact.groupBy("conv_id").agg(F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"), F.sum("value").alias("total"))
    has = has.union(alone.where("last").select("conv_id", F.lit(1).cast("long"), F.lit(0).cast("long")))
    has = materialize(has.groupBy("conv_id").agg(F.max("leaf").alias("leaf"), F.sum("total").alias("total")), "owned")
    below = maybe.join(has.where("leaf > 0 OR total > 0"), "conv_id").groupBy(key).agg(F.sum("leaf").alias("n_leaves"), F.sum("total").alias("total"))
    chains = Runs(exact.select("conv_id", "depth", *key, "value"), "conv_id", [F.col("depth")], sums=("value",))
    resolve = chains.resolver()

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(resolve(b)["sum0"] - b.column(4).to_numpy())], names=["k1", "k2", "above"])

    above_ = chains.table.mapInArrow(above, "k1 long, k2 long, above long")
    # parents and children, a row for each node that is shared or whose parent may be
    firsts = exact.select("conv_id", "depth", *key, "p1", "p2").union(alone.where("top").select("conv_id", "depth", *key, "p1", "p2"))
    children = firsts.where("depth > 1").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).toDF("k1", "k2", "n_children")
    owner = exact.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    parents = firsts.where("depth > 1").join(owner, ["p1", "p2"], "left").select(*key, "depth", F.coalesce("parent", "conv_id").alias("parent_conv_id"))
    parents = materialize(parents.union(firsts.where("depth = 1").select(*key, "depth", F.lit(root["least"]).alias("parent_conv_id"))), "parents")
    ends = id_digests(maybe.where("last").select(*key, "conv_id"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shared = exact.join(below, key, "left").join(above_, key).join(children, key, "left").join(parents.drop("depth"), key).join(ends, key, "left")
    saved = F.coalesce("total", F.lit(0)) - F.col("above")
    shared = shared.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), zero("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sha = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NONE)
    rest = lambda df: df.select("conv_id", "depth", "parent_conv_id", one, F.when(F.col("last"), 0).otherwise(1).cast("long"), one, none, sha)
    tails = rest(alone.where("NOT top").withColumn("parent_conv_id", F.col("conv_id"))).union(rest(alone.where("top").join(parents, [*key, "depth"])))

    turnless = id_digests(ids.join(every.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(none.alias("k1"), none.alias("k2"), "conv_id"))
    sums, n_children = has.agg(F.sum("leaf").alias("leaf"), F.sum("total").alias("total")).first(), firsts.where("depth = 1").count()
    sha_of = turnless.first()
    row = (root["least"], 0, None, root["n"], n_children, max(sums["leaf"] or 0, 1), sums["total"] or 0, sha_of["ends_sha256"] if sha_of else _NONE)
    top = sequences.sparkSession.createDataFrame([row], _SCHEMA)
    return top.union(shared).union(tails).toDF(*COLUMNS)


COLUMNS = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}
_SCHEMA = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def trie(conversations: DataFrame) -> DataFrame:
    """Per node of the prefix trie of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty. Turns are in the order of ``turn``, null first; equal ones in that of the MD5 of the
    role's bytes, a colon, role and text; repeated rows are turns each. Rows without conv_id take no part. Conversations
    that are rebuilt without a turn are members of the root. An empty table gives no rows, not even a root. Only
    conv_id, turn, role and text are read, so other columns may have any name. Prefixes are told apart by 124 bits.
    """
    return nodes(*rebuilt(conversations))
