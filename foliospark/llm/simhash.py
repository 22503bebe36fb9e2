"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, then from some
segment on, every chain of l consecutive segments holds at most 3*l/4 of the differences: none in the first, at most
one in two, two in three. The chain of length two is the join key (the second segment is probed with each of its
one-bit variants), the longer chains prune what meets under a key, and the full distance decides.

What meets under a key gives a spanning forest of its links, never all pairs. A key that many fingerprints reach, their
own or as a neighbour, is divided by the pigeonhole principle: of the other two segments' four bytes one is equal. What is
still crowded is split into cells, one for each pair of blocks of its members, so no task holds more than two blocks of
a key. A key that no fingerprint has as its own links nothing and is left out where it would be crowded. Components are
found by alternating star contractions over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_counted, materialize, remove, written

SEGMENTS, BITS, NEAR = 4, 16, 3
#: Fingerprints under one key that one task compares with each other; beyond it the key is split.
BLOCK = 4096


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as an unsigned number; zero for a text without words."""
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = h[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, row_key: Column | None = None) -> DataFrame:
    """doc_id, the fingerprint ``fp`` as a signed long, and ``row_key`` (a string; null if not given), one row for
    each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "row_key"])

    key = F.lit(None).cast("string") if row_key is None else row_key
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("row_key")).mapInArrow(run, "doc_id long, fp long, row_key string")


def _entries(fps: DataFrame) -> DataFrame:
    """For each segment: one row under the key of two segments, and one under each key whose second segment has a
    further bit set. Of two fingerprints that differ in one bit there, the one without it finds the other."""
    seg = [F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit(0xFFFF)) for i in range(SEGMENTS)]
    own, more = [], []
    for i in range(SEGMENTS):
        key = F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(F.shiftleft(seg[i], 16)).bitwiseOR(seg[(i + 1) % SEGMENTS])
        own.append(F.struct(key.alias("key"), F.lit(True).alias("own")))
        more += [F.when(key.bitwiseAND(F.lit(1 << j)) == 0, F.struct(key.bitwiseOR(F.lit(1 << j)).alias("key"), F.lit(False).alias("own"))) for j in range(BITS)]
    every = F.concat(F.array(*own), F.filter(F.array(*more), lambda x: x.isNotNull()))
    return fps.select("fp", F.explode(every).alias("e")).select("e.key", "fp", "e.own")


def _forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints (as unsigned) that meet at a segment."""
    rolled = (fps >> np.uint64(BITS * start)) | (fps << np.uint64(64 - BITS * start) if start else np.uint64(0))
    chain = np.uint64((1 << 3 * BITS) - 1)
    left, out = np.arange(len(fps)), []
    while len(left) > 1:  # breadth first: each fingerprint is compared with those that no tree has yet
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            d = rolled[left] ^ rolled[x]
            near = np.bitwise_count(d & chain) <= NEAR * 3 // SEGMENTS
            near[near] = np.bitwise_count(d[near]) <= NEAR
            found, left = left[near], left[~near]
            out += [(x, y) for y in found]
            queue.extend(found)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, key, fp, own), those of a cell and key together, to links (a, b)."""
    rest: list[np.ndarray] | None = None

    def found(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, key, fp, own = cols
        n = len(key)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]) if n else np.zeros(0, int)
        ends = np.r_[first[1:], n]
        a, b = [], []
        for s, e in zip(first[ends - first > 1], ends[ends - first > 1], strict=True):
            if own[s:e].any():
                each = np.unique(fp[s:e])
                for x, y in _forest(each.view(np.uint64), int(key[s] >> 32)):
                    a.append(each[x])
                    b.append(each[y])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [x[cut:] for x in cols]
        yield found([x[:cut] for x in cols])
    if rest is not None:
        yield found(rest)


def _neighbours(key: str) -> Column:
    """The key itself and each key with one more bit in its second segment."""
    return F.array(F.col(key), *(F.when(F.col(key).bitwiseAND(F.lit(1 << j)) == 0, F.col(key).bitwiseOR(F.lit(1 << j))) for j in range(BITS)))


def _crowded(fps: DataFrame, block: int) -> DataFrame:
    """(key, owned): the keys that more than ``block`` entries may reach, and whether any fingerprint has it as its own.

    A key that is its own for few fingerprints, and each of whose neighbours is, cannot be crowded; so the counts of
    own keys tell, and probes are not counted.
    """
    own = _entries(fps).where("own").groupBy("key").agg(F.count("*").alias("n"))
    own = materialize(own, "own")
    big = own.where(F.col("n") > block // (BITS + 1))
    reached = big.select(F.explode(_neighbours("key")).alias("key")).where("key is not null").distinct()
    return materialize(reached.join(own, "key", "left").select("key", F.col("n").isNotNull().alias("owned")), "crowded")


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints: a set that connects all those within 3 bits of each other."""
    entries, crowded = _entries(fps), _crowded(fps, block)
    if crowded.isEmpty():
        return _met(entries.withColumn("cell", F.lit(0).cast("long")))
    plain = _met(entries.join(crowded, "key", "left_anti").withColumn("cell", F.lit(0).cast("long")))
    # the segments after the key's two: their four bytes hold at most three differences
    start = F.shiftright("key", 32)
    turned = F.expr("shiftrightunsigned(fp, cast(16 * ((start + 2) % 4) as int)) | shiftleft(fp, cast(64 - 16 * ((start + 2) % 4) as int) % 64)")
    rest = entries.join(crowded.where("owned").select("key"), "key").withColumn("start", start).withColumn("turned", turned)
    byte = F.explode(F.array(*(F.lit(256 * i) + F.shiftright("turned", 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(4))))
    dug = materialize(rest.select("key", "fp", "own", byte.alias("byte")), "dug")
    counts = dug.groupBy("key", "byte").agg(F.count("*").alias("n"), F.max("own").alias("owned")).where(F.col("n") > block)
    still = materialize(counts, "still")
    sparse = dug.join(still, ["key", "byte"], "left_anti").withColumn("cell", F.col("byte").cast("long"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    one, every = F.pmod(F.xxhash64("fp"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    cells = dug.join(still.where("owned").drop("owned"), ["key", "byte"]).withColumn("one", one).withColumn("other", F.explode(every))
    cell = (F.least("one", "other").cast("long") * F.col("n") + F.greatest("one", "other")) * 1024 + F.col("byte")
    return plain.union(_met(sparse)).union(_met(cells.withColumn("cell", cell)))


def _met(entries: DataFrame) -> DataFrame:
    return entries.select("cell", "key", "fp", "own").repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_links, "a long, b long")


def _least(edges: DataFrame, node: str, to: str, name: str) -> DataFrame:
    """``edges`` with ``name``, the smallest ``to`` of their ``node``; a node with very many edges does not meet them in one task."""
    least = materialize(edges.groupBy(node).agg(F.min(to).alias(name), F.count("*").alias("n")), "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    return join_counted(edges, least, node, "n", total)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge (a, b) that is not its component's smallest node."""
    e = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct()
    (e, path), before = written(e, "edges"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.count_distinct("node")).first()
        # a tree of one level: every node has one root, and no root is a node
        if state == before or not state[0] or state[0] == state[2] and e.join(e.select(F.col("root").alias("node")).distinct(), "node", "left_semi").isEmpty():
            return e
        before = state
        both = e.select("node", F.col("root").alias("to")).union(e.select(F.col("root").alias("node"), F.col("node").alias("to")))
        large = _least(both, "node", "to", "m").where("`to` > node").select(F.col("to").alias("node"), F.least("node", "m").alias("root")).distinct()
        large, held = written(large, "large")
        small = _least(large, "node", "root", "m")
        small = small.where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root")).union(small.select("node", F.col("m").alias("root")))
        e, new = written(small.distinct(), "edges")
        for old in (path, held):
            remove(e.sparkSession, old)
        path = new


def near_duplicates(docs: DataFrame, width: int = 3, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null doc_id get a
    row too; they link texts but never name a component, unless it has no other id (then it is null). Repeated rows
    each get a row. An empty table gives no rows. Only doc_id and text are read.
    """
    prints = materialize(fingerprints(docs, width).drop("row_key"), "fingerprints")
    rooted = materialize(_rooted(prints, block), "rooted")
    total = prints.count()
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_prints"))
    labels = join_counted(rooted.select("fp", "root", "n"), least, "root", "n_prints", rooted.count()).select("fp", "component_id", "n")
    return join_counted(prints, labels, "fp", "n", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(prints: DataFrame, block: int) -> DataFrame:
    """Per distinct fingerprint: its first document (``first``), its first row by id and key (``row``; rows without an
    id come last), its number of rows (``n``) and its component (``root``)."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key") if "row_key" in prints.columns else F.lit(None)
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(row).alias("row"), F.count("*").alias("n"))
    roots = components(links(distinct.select("fp"), block))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(docs: DataFrame, width: int = 3, block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, all columns as they are.

    It is the row with the smallest doc_id, of rows that share it the one whose digest of id and text is smallest; a
    row without an id stays only if its group has no other. Of rows with equal id and text, one stays. Columns may have
    any name but ``_row_key_of_simhash``.
    """
    shown = F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("n"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.lit(":"), shown))
    prints = materialize(fingerprints(docs, width, key), "fingerprints")
    firsts = _rooted(prints, block).groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.row_key").alias("_row_key_of_simhash"))
    return docs.withColumn("_row_key_of_simhash", key).join(materialize(firsts, "firsts"), "_row_key_of_simhash", "left_semi").dropDuplicates(["_row_key_of_simhash"]).drop("_row_key_of_simhash")
