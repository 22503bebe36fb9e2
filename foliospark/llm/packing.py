"""Best-fit packing by a linear grouping scheme.

Pieces have whole lengths of 1 to the capacity, so their histogram has a bounded size and the packing is planned on
it: large lengths are rounded up within groups of equal cardinality, a linear program over configurations of the few
rounded sizes is solved by column generation, actual lengths take the places of the rounded ones, and small pieces
go by best fit into what is left. Bins that look alike are one row of the plan with a multiplicity, so neither the
plan nor the driver's work grows with the number of pieces. Pieces then find their bin by their rank in their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize, placed
from .encoding import encoder, grouped, vocabulary

CAPACITY, END_ID = 1024, 2
#: The scheme's parameters; of all combinations the one with the fewest sequences is taken. Groups of large lengths,
#: and the share of the capacity up to which pieces are small, so that they fill gaps.
GROUPS, SMALL = (24, 48), (1 / 8, 1 / 4, 1 / 3, 1 / 2)


def _knapsack(values: np.ndarray, sizes: list[int], most: list[int], capacity: int) -> tuple[float, list[int]]:
    """The most valuable configuration of at most ``most`` of each size."""
    best, took = np.zeros(capacity + 1), []
    for v, s, n in zip(values, sizes, most, strict=True):
        count = np.zeros(capacity + 1, int)
        if v > 1e-12:
            base = best.copy()
            for k in range(1, min(n, capacity // s) + 1):
                other = np.full(capacity + 1, -1.0)
                other[k * s :] = base[: capacity + 1 - k * s] + k * v
                better = other > best + 1e-12
                best[better], count[better] = other[better], k
        took.append(count)
    at, config = int(best.argmax()), [0] * len(sizes)
    value = float(best[at])
    for i in range(len(sizes) - 1, -1, -1):
        config[i] = int(took[i][at])
        at -= config[i] * sizes[i]
    return value, config


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Configurations and how often each is used, by column generation with a dense basis (few sizes)."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.array(demand, float) / basis.diagonal()
    most = [min(capacity // s, d) for s, d in zip(sizes, demand, strict=True)]
    for _ in range(60 * n):
        inverse = np.linalg.inv(basis)
        value, config = _knapsack(inverse.sum(axis=0), sizes, most, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ np.array(config, float)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = config
    return [([int(round(c)) for c in basis[:, k]], float(x[k])) for k in range(n)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in the bin, number of such bins) for pieces of the given lengths; every piece has a place."""
    tried = [grouping(histogram, capacity, g, s) for s in SMALL for g in GROUPS]
    return min(tried, key=lambda bins: sum(n for _, n in bins))


def grouping(histogram: dict[int, int], capacity: int, groups: int, share: float) -> list[tuple[tuple[int, ...], int]]:
    """The plan of the linear grouping scheme with one choice of its parameters."""
    left = Counter({s: n for s, n in histogram.items() if n})
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("lengths are from 1 to the capacity")
    bins: list[tuple[tuple[int, ...], int]] = []
    small = max(1, int(capacity * share))
    large = sorted((s for s in left if small < s < capacity), reverse=True)
    if capacity in left:
        bins.append(((capacity,), left.pop(capacity)))
    # groups of equal cardinality, by falling length; each is rounded up to its largest length
    total, seen, members = sum(left[s] for s in large), 0, defaultdict(list)
    for s in large:
        at, n = s, left[s]
        while n:  # a length may span groups
            g = seen * groups // total
            take = min(n, -(-(g + 1) * total // groups) - seen)
            members[g].append([at, take])
            seen, n = seen + take, n - take
    runs: list[list[list[int]]] = []  # by rounded size: [length, number] still to place, by falling length
    sizes: list[int] = []
    for g in sorted(members):
        if sizes and sizes[-1] == members[g][0][0]:
            runs[-1] += members[g]
        else:
            sizes.append(members[g][0][0])
            runs.append(members[g])
    if sizes:
        demand = [sum(n for _, n in r) for r in runs]
        for config, times in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[1]):
            slots = [i for i, c in enumerate(config) for _ in range(c)]
            if sum(sizes[i] for i in slots) + sizes[-1] > capacity and len(slots) > 1:
                slots.pop()  # rounding left a gap here: what really fits is found by best fit below
            use = min([int(times + 1e-6), *(sum(n for _, n in runs[i]) // slots.count(i) for i in set(slots))]) if slots else 0
            if not use:
                continue
            held = []  # for each place of the configuration: the next ``use`` pieces of its group, as runs
            for i in slots:
                mine, need = [], use
                while need:
                    s, n = runs[i][0]
                    take = min(n, need)
                    mine.append([s, take])
                    need -= take
                    runs[i][0][1] -= take
                    if not runs[i][0][1]:
                        runs[i].pop(0)
                held.append(mine)
            while held[0]:
                same = min(h[0][1] for h in held)
                bins.append((tuple(h[0][0] for h in held), same))
                for h in held:
                    h[0][1] -= same
                    if not h[0][1]:
                        h.pop(0)
    rest = Counter({s: n for s, n in left.items() if s <= small})
    for r in runs:
        for s, n in r:
            rest[s] += n
    return _best_fit(bins, rest, capacity)


def _best_fit(bins: list[tuple[tuple[int, ...], int]], rest: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by falling length; bins with the same content are filled together."""
    open_bins: dict[int, Counter] = defaultdict(Counter)  # by free space
    for content, n in bins:
        open_bins[capacity - sum(content)][content] += n
    free = sorted(open_bins)

    def put(content: tuple[int, ...], n: int) -> None:
        if n:
            space = capacity - sum(content)
            if not open_bins[space]:
                if space not in free:
                    insort(free, space)
            open_bins[space][content] += n

    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            k = bisect_left(free, s)
            while k < len(free) and not open_bins[free[k]]:
                free.pop(k)
            if k == len(free):
                each = capacity // s
                put((s,) * each, n // each)
                put((s,) * (n % each), 1 if n % each else 0)
                break
            space = free[k]
            content, there = next(iter(open_bins[space].items()))
            each = space // s
            full = min(there, n // each)
            used = full or 1
            open_bins[space][content] -= used
            if not open_bins[space][content]:
                del open_bins[space][content]
            take = each if full else n
            put(content + (s,) * take, used)
            n -= used * take
    return [(c, n) for cs in open_bins.values() for c, n in cs.items() if n]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a longer document is cut from its end into whole
    sequences, so only its first piece is shorter."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_name))  # 2 MB, whatever the input
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or encoder(content.value)
            rows: list[tuple] = []
            for at, texts in grouped(b.column(1).to_pylist()):
                for i, ids in enumerate(enc.encode(texts), at):
                    ids += end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    stop = n % capacity or capacity
                    while start < n:
                        rows.append((b.column(0)[i].as_py(), piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (its place in the sequence).

    A null or empty text is a document of the end id alone. Repeated rows are packed each; a null doc_id is kept. An
    empty table gives no rows. Only doc_id and text are read. To the driver come the numbers of pieces by length, at
    most ``capacity`` rows; the plan that goes back has a few thousand places, whatever the input.
    """
    spark = docs.sparkSession
    spread = [F.xxhash64("doc_id", "piece", "ids_crc32").alias("spread"), F.monotonically_increasing_id().alias("copy")]  # any order within a length will do
    cut = materialize(pieces(docs, capacity, end_id, vocabulary_name).select("*", *spread), "pieces")
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, sequence, rank = [], 0, Counter()
    before, seen = {}, 0
    for s in sorted(by_length):
        before[s], seen = seen, seen + by_length[s]
    for content, n in plan(by_length, capacity):
        offset = 0
        for s in content:
            places.append((s, before[s] + rank[s], before[s] + rank[s] + n, sequence, offset))
            rank[s] += n
            offset += s
        sequence += n
    where = spark.createDataFrame(places, "length long, low long, high long, sequence long, offset long")
    ranked, _ = placed(cut, [F.col("length"), F.col("spread"), F.col("copy")])  # the places of a length follow each other
    fits = (ranked["length"] == where["length"]) & (ranked["position"] >= where["low"]) & (ranked["position"] < where["high"])
    return ranked.join(F.broadcast(where), fits).select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (where["sequence"] + ranked["position"] - where["low"]).alias("sequence_id"), "offset")
