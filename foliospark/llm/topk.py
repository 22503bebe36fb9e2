"""Exact top-k by inner product with the threshold algorithm.

Vectors are packed into blocks, once, with their lists: for each dimension the block's vectors sorted by that component.
A query reads its lists from the top where its own component is positive and from the bottom where it is negative. What
is unseen can score at most the inner product of the query with the components at the current depth; reading stops at
the depth where that bound is below the k-th score known. Equal bounds read on, as an unseen vector with a smaller id
would win the tie. The bound falls with the depth, so the depth where a query stops is found by bisection.

A query's first block gives it a k-th score, and it carries that to all other blocks, so most of them it leaves early.
Where the entries up to that depth outnumber the block's vectors, the block is scored as a whole, many queries at once.
Blocks of queries go to the blocks of candidates, and each pair gives at most k rows a query.

Vectors so large that an inner product may not be a 64-bit number have blocks of their own, which are scored as a whole
with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import floored, materialize

K, EVERY, SCALE = 20, 20, 64
#: Vectors in a block of candidates, and in a block of queries.
CANDIDATES, QUERIES = 16_384, 2048
#: Blocks of queries that a task meets with one block of candidates, at most.
TOGETHER = 64
#: Depth of the first read, and queries that score a whole block at once.
DEPTH, ROWS = 32, 256


def _below(score: float) -> float:
    """A double that is at most the score: beyond 53 bits a whole number may round up."""
    near = float(score)
    return near if abs(near) < 1 << 53 else float(np.nextafter(near, -np.inf))


_ENDS = (-(1 << 63), (1 << 63) - 1)


def _exact(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As ``Block.top_k`` for any doubles that are whole numbers; a score beyond 64 bits is the nearest such number."""
    whole = [[int(x) for x in v] for v in vectors.tolist()]
    for i, q in enumerate(queries.tolist()):
        q = [int(x) for x in q]
        score = np.array([min(max(sum(map(int.__mul__, v, q)), _ENDS[0]), _ENDS[1]) for v in whole], np.int64)
        keep = np.flatnonzero(ids != own[i])
        order = keep[np.lexsort((ids[keep], ~score[keep]))[:k]]  # not minus: the least number has no opposite
        yield i, ids[order], score[order]


class Block:
    """Candidates of one length: ids, components (whole numbers held as floats where these are exact) and sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, kind: np.dtype):
        self.ids, self.lists = ids, lists
        self.vectors = vectors.astype(kind)
        self.sorted = np.take_along_axis(self.vectors, lists.T.astype(np.int64), axis=0)  # by depth from the bottom

    def stops(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """For each query, the least depth whose bound is below the k-th score; the block's size if there is none."""
        n, rows, dims = len(self.ids), np.arange(len(queries)), np.arange(queries.shape[1])
        low, high = np.zeros(len(rows), int), np.full(len(rows), n)
        while (low < high).any():
            at = (low + high) // 2
            depth = np.minimum(at, n - 1)[:, None]
            edge = self.sorted[np.where(queries > 0, n - 1 - depth, depth), dims]
            below = (np.einsum("ij,ij->i", edge, queries) < kth) | (at >= n)
            high, low = np.where(below, np.minimum(at, high), high), np.where(below, low, at + 1)
            low = np.minimum(low, high)
        return high

    def read(self, query: np.ndarray, depth: int) -> np.ndarray:
        """The vectors within a depth of the query's lists."""
        n, up = len(self.ids), query > 0
        return np.unique(np.r_[self.lists[up, n - depth :].ravel(), self.lists[query < 0, :depth].ravel()])

    def best(self, own: int, at: np.ndarray, score: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        keep = (score >= least) & (self.ids[at] != own)
        at, score = at[keep], score[keep]
        if len(at) > 4 * k:
            top = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[top], score[top]
        order = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[order]], score[order]

    def top_k(self, own: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, and ids and scores of its k best vectors here; those below ``kth`` may lack."""
        n = len(self.ids)
        queries, kth = queries.astype(self.vectors.dtype), kth.copy()
        every = np.arange(n)
        for i in np.flatnonzero(np.isneginf(kth)):  # the first read gives a k-th score
            at = self.read(queries[i], min(DEPTH, n))
            _, score = self.best(own[i], at, self.vectors[at] @ queries[i], -np.inf, k)
            kth[i] = _below(score[-1]) if len(score) == k else -np.inf
        stops = np.zeros(len(own), int)
        for at in range(0, len(own), ROWS):
            stops[at : at + ROWS] = self.stops(queries[at : at + ROWS], kth[at : at + ROWS])
        whole = np.flatnonzero((stops >= n) | (stops * np.count_nonzero(queries, axis=1) >= n))
        for at in range(0, len(whole), ROWS):
            part = whole[at : at + ROWS]
            for i, score in zip(part, queries[part] @ self.vectors.T, strict=True):
                yield i, *self.best(own[i], every, score, kth[i], k)
        for i in np.setdiff1d(np.flatnonzero(stops), whole):
            at = self.read(queries[i], stops[i])
            yield i, *self.best(own[i], at, self.vectors[at] @ queries[i], kth[i], k)


def _blocks(rows: DataFrame, size: int, lists: bool) -> DataFrame:
    """Rows (vec_id, v, large) packed into blocks of one length and kind: ``width``, ``ids``, ``vectors`` and, with ``lists``,
    ``lists``, as bytes."""
    names = ["width", "ids", "vectors", *(["lists"] if lists else [])]

    def out(width: int, ids: list[np.ndarray], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        i, v = np.concatenate(ids), np.concatenate(parts)
        for at in range(0, len(i), size):
            cols = [pa.array([width], pa.int32()), pa.array([i[at : at + size].astype("<i8").tobytes()]), pa.array([v[at : at + size].astype("<f8").tobytes()])]
            if lists:
                cols.append(pa.array([np.argsort(v[at : at + size], axis=0, kind="stable").T.astype("<i4").tobytes()]))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for b in batches:
            width = np.diff(b.column(1).offsets.to_numpy())
            large = b.column(2).to_numpy(zero_copy_only=False)
            for w, kind in {*zip(width.tolist(), large.tolist(), strict=True)}:
                part = b.filter(pa.array((width == w) & (large == kind)))
                ids, parts = held.setdefault((w, kind), ([], []))
                ids.append(part.column(0).to_numpy())
                parts.append(np.asarray(part.column(1).flatten(), "<f8").reshape(-1, w))
                if sum(map(len, ids)) >= size:
                    yield from out(w, *held.pop((w, kind)))
        for (w, _), (ids, parts) in held.items():
            yield from out(w, ids, parts)

    return rows.mapInArrow(run, "width int, ids binary, vectors binary" + (", lists binary" if lists else ""))


def _numbered(blocks: DataFrame, name: str, number: str) -> DataFrame:
    """Blocks as a table, numbered from 0 within their width; a row for each block passes the window, without its bytes."""
    blocks = materialize(blocks.withColumn("id", F.monotonically_increasing_id()), name)
    order = F.row_number().over(Window.partitionBy("width").orderBy("id")) - 1
    return blocks.join(blocks.select("width", "id").withColumn(number, order), ["width", "id"]).drop("id")


def _meet(candidates: DataFrame, queries: DataFrame, keys: list[str], k: int, blocks: bool) -> DataFrame:
    """The k best of each query in the block it meets: rows (query_id, vec_id, score); with ``blocks``, rows of bytes with
    the queries' new k-th scores beside them."""
    schema = "width int, c int, q int, ids binary, vectors binary, kth binary, found_query binary, found_vec binary, found_score binary" if blocks else "query_id long, vec_id long, score long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], pa.schema([]))
        cand = left.slice(0, 1).to_pylist()[0]
        dims = cand["width"]
        ids, v = np.frombuffer(cand["ids"], "<i8"), np.frombuffer(cand["vectors"], "<f8").reshape(-1, dims)
        lists = np.frombuffer(cand["lists"], "<i4").reshape(dims, -1)
        held: dict[type, Block] = {}
        rows: list[tuple] = []
        found: list[list[np.ndarray]] = [[], [], []]
        for r in right.select(["c", "q", "ids", "vectors", "kth"]).to_pylist():
            own, q, kth = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(-1, dims), np.frombuffer(r["kth"], "<f8")
            most = float(np.abs(v).max(initial=1)) * float(np.abs(q).max(initial=1)) * dims
            kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
            if most < 1 << 62 and kind not in held:
                held[kind] = Block(ids, v, lists, kind)
            new, mine = kth.copy(), [[np.zeros(0, np.int64)] for _ in range(3)]
            for i, vec, score in held[kind].top_k(own, q, kth, k) if most < 1 << 62 else _exact(ids, v, own, q, k):
                for c, x in zip(mine, (np.full(len(vec), own[i]), vec, score.astype(np.int64)), strict=True):
                    c.append(x)
                if len(score) == k:
                    new[i] = max(new[i], _below(score[-1]))
            whole = [np.concatenate(c) for c in mine]
            if blocks:
                rows.append((dims, r["c"], r["q"], r["ids"], r["vectors"], new.astype("<f8").tobytes(), *(c.astype("<i8").tobytes() for c in whole)))
            else:
                for c, x in zip(found, whole, strict=True):
                    c.append(x)
        if blocks:
            kinds = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6)
            return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        return pa.table([pa.array(np.concatenate(c)) for c in found], names=names)

    def fit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        got = run(key, left, right)
        if got.num_columns:
            return got
        kinds = [pa.int32()] * 3 + [pa.binary()] * 6 if blocks else [pa.int64()] * 3
        return pa.table([pa.array([], t) for t in kinds], names=names)

    return candidates.groupby(*keys).cogroup(queries.groupby(*keys)).applyInArrow(fit, schema)


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """Per query (vec_id divisible by ``every``) and rank: query_id, rank, vec_id, score.

    Components become floor(scale * x). Vectors that are null or empty, or hold null or non-finite components, and rows
    with a null id take no part. Scores are exact, whatever the size of the components; one that does not fit 64 bits counts as
    the nearest number that does. Vectors of different lengths do not meet. Rows with the query's own id are no candidates of
    it; repeated ids otherwise are candidates each. Ties go to the smaller vec_id. Fewer candidates than k give fewer
    rows; an empty table none.
    """
    x = F.col("embedding")
    most = F.sqrt(F.lit(float(1 << 61)) / F.size(x)) / scale
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    large = F.exists(x, lambda e: F.abs(e.cast("double")) >= most)
    whole = F.transform(x, lambda e: floored(e.cast("double") * scale))
    vectors = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), large.alias("large"))
    vectors = materialize(vectors, "vectors")
    n, m = vectors.count(), vectors.where(F.col("vec_id") % every == 0).count()
    dealt = lambda df, rows, size: df.repartition(max(1, -(-rows // size)), F.xxhash64("vec_id", F.lit(size)))
    candidates = materialize(_numbered(_blocks(dealt(vectors, n, CANDIDATES), CANDIDATES, True), "candidates", "c"), "numbered")
    queries = _numbered(_blocks(dealt(vectors.where(F.col("vec_id") % every == 0), m, QUERIES), QUERIES, False), "queries", "q")
    sizes = candidates.groupBy("width").agg(F.count("*").cast("int").alias("blocks"))
    queries = queries.join(sizes, "width").withColumn("c", (F.col("q") % F.col("blocks")).cast("int"))
    unknown = F.lit(np.array([-np.inf], "<f8").tobytes().hex())
    queries = queries.withColumn("kth", F.unhex(F.repeat(unknown, F.expr("int(octet_length(ids) div 8)"))))
    first = materialize(_meet(candidates, queries.select("width", "c", "q", "ids", "vectors", "kth"), ["width", "c"], k, True), "first")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*b.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), "<i8")) for x in row], names=["query_id", "vec_id", "score"])

    early = first.select("found_query", "found_vec", "found_score").mapInArrow(unpack, "query_id long, vec_id long, score long")
    group = (F.col("q") / TOGETHER).cast("int").alias("g")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i != F.col("c"))
    later = first.join(sizes, "width").select("width", F.explode(others).alias("c"), "q", group, "ids", "vectors", "kth")
    groups = first.groupBy("width").agg(F.max("q").alias("last")).select("width", F.explode(F.sequence(F.lit(0), (F.col("last") / TOGETHER).cast("int"))).alias("g"))
    rest = _meet(candidates.join(groups, "width"), later, ["width", "c", "g"], k, False)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")).cast("int")
    return early.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
