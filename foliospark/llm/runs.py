"""Running counts, sums and digests within a key, over sorted ranges, so that a key with any share of the rows is split.

Rows are sorted by key and order in ranges. Each range's task runs through its rows and notes, for each, the place in
its key and the sums so far; only the first key of a range can have begun before. What it brings along is folded from one
row for each range's first and last key (at most MOST_PARTS ranges) and is added when the table is read again, row by row.

The digest of a sequence is a polynomial of its elements' digests modulo a prime, at four points: that of two parts
joined follows from theirs, which a chained hash does not allow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import MOST_PARTS, ORDERED, materialize

PRIME = np.uint64((1 << 31) - 1)
#: Where the polynomials are evaluated.
POINTS = (1_103_515_245, 747_796_405, 1_664_525_177, 1_181_783_497)
LANES = len(POINTS)
#: Internal columns of a ranged table; input columns may not have these names.
_MARKS = "_part int, _head boolean, _first boolean, _final boolean, _last boolean, _at long"


class Powers:
    """Powers of the points and of their inverses; they grow with the longest run of one range."""

    def __init__(self) -> None:
        self.size = 1
        self.up = [np.ones(1, np.uint64) for _ in POINTS]
        self.down = [np.ones(1, np.uint64) for _ in POINTS]

    def reach(self, n: int) -> None:
        while self.size <= n:
            for j, b in enumerate(POINTS):
                for table, base in ((self.up, b), (self.down, pow(b, -1, int(PRIME)))):
                    table[j] = np.r_[table[j], table[j] * np.uint64(pow(base, self.size, int(PRIME))) % PRIME]
            self.size *= 2


def elements(digests: pa.Array) -> list[np.ndarray]:
    """Digests of 16 bytes as numbers below the prime, four for each."""
    raw = b"".join(digests.to_pylist())
    return [x.astype(np.uint64) % PRIME for x in np.frombuffer(raw, "<u4").reshape(-1, LANES).T]


def _within(batches: Iterator[pa.RecordBatch], key: int, sums: list[int], digest: int | None) -> Iterator[pa.RecordBatch]:
    part, powers = TaskContext.get().partitionId(), Powers()
    held: list | None = None
    begin, now, at_now = None, None, 0
    sum_now, lane_now = [0] * len(sums), [np.uint64(0)] * LANES

    def out(h: list, final: bool, last: bool) -> pa.RecordBatch:
        b, marks, rest = h
        n = b.num_rows
        ends = np.zeros(n, bool)
        ends[-1] = final
        marks["_last"][-1] = last
        cols = [pa.array(np.full(n, part, np.int32)), *(pa.array(marks[m]) for m in ("_head", "_first")), pa.array(ends), pa.array(marks["_last"]), *map(pa.array, rest)]
        names = ["_part", "_head", "_first", "_final", "_last", "_at", *(f"_sum{i}" for i in range(len(sums))), *(f"_lane{j}" for j in range(LANES) if digest is not None)]
        return pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k, rows = b.column(key).to_numpy(zero_copy_only=False), np.arange(n)
        new = np.r_[now is None or k[0] != now, k[1:] != k[:-1]]
        start = np.maximum.accumulate(np.where(new, rows, 0))
        on = (start == 0) & ~new[0]  # rows that go on with the last batch's key
        at = rows - start + 1 + np.where(on, at_now, 0)
        begin = k[0] if held is None and begin is None else begin
        first = np.zeros(n, bool)
        first[0] = now is None
        rest = [at]
        for i, c in enumerate(sums):
            v = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(v)
            rest.append(total - (total - v)[start] + np.where(on, sum_now[i], 0))
            sum_now[i] = int(rest[-1][-1])
        if digest is not None:
            powers.reach(int(at.max()))
            for j, t in enumerate(elements(b.column(digest))):
                v = t * powers.down[j][at] % PRIME
                total = np.cumsum(v)
                run = (total - (total - v)[start] + np.where(on, lane_now[j], np.uint64(0))) % PRIME
                rest.append((run * powers.up[j][at] % PRIME).astype(np.int64))
                lane_now[j] = run[-1]
        if held is not None:
            yield out(held, False, bool(new[0]))
        held = [b, {"_head": k == begin, "_first": first, "_last": np.r_[new[1:], True]}, rest]
        now, at_now = k[-1], int(at[-1])
    if held is not None:
        yield out(held, True, True)


class Runs:
    """A written table in ranges; ``resolve`` gives a batch of it its true places, sums, digests and ends."""

    def __init__(self, df: DataFrame, key: str, order: list[Column], sums: tuple[str, ...] = (), digest: str | None = None):
        names, schema = df.columns, ", ".join(f"{n} {t}" for n, t in df.dtypes)
        self.n = df.count()
        parts = min(MOST_PARTS, max(1, -(-self.n // ORDERED), df.sparkSession.sparkContext.defaultParallelism))
        sorted_ = df.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
        extra = [f"_sum{i} long" for i in range(len(sums))] + [f"_lane{j} long" for j in range(LANES) if digest is not None]
        at = names.index(key), [names.index(s) for s in sums], None if digest is None else names.index(digest)
        self.names, self.key, self.sums, self.digest = names, key, len(sums), digest
        self.table = materialize(sorted_.mapInArrow(lambda batches: _within(batches, *at), ", ".join([schema, _MARKS, *extra])), "ranged")
        self._fold()

    def _fold(self) -> None:
        """Two rows of each range, at most, come to the driver."""
        values = ["_at", *(f"_sum{i}" for i in range(self.sums)), *(f"_lane{j}" for j in range(LANES) if self.digest is not None)]
        edges = self.table.where("_first OR _final").select("_part", F.col(self.key).alias("k"), "_first", "_final", *values).collect()
        first, final = {r["_part"]: r for r in edges if r["_first"]}, {r["_part"]: r for r in edges if r["_final"]}
        size = max(first, default=0) + 1
        self.carry = np.zeros((len(values), size), np.int64)
        self.goes_on = np.zeros(size, bool)  # the last key of a range goes on in the next one
        key, total, before = None, [0] * len(values), None
        for p in sorted(first):
            if first[p]["k"] == key:
                self.carry[:, p] = total
                self.goes_on[before] = True
            last, mine = final[p], [final[p][v] for v in values]
            if last["k"] == first[p]["k"] == key:
                added = [a + b for a, b in zip(total[: 1 + self.sums], mine, strict=False)]
                if self.digest is not None:
                    at = 1 + self.sums
                    added += [(c * pow(b, mine[0], int(PRIME)) + m) % int(PRIME) for b, c, m in zip(POINTS, total[at:], mine[at:], strict=True)]
                mine = added
            key, total, before = last["k"], mine, p

    def resolver(self) -> Callable[[pa.RecordBatch], dict[str, np.ndarray]]:
        """A function for tasks: place, ``last``, sums, and as ``lanes`` the digests, of the rows of a batch."""
        carry, goes_on, n, sums, hashed, powers = self.carry, self.goes_on, len(self.names), self.sums, self.digest is not None, Powers()

        def resolve(b: pa.RecordBatch) -> dict[str, np.ndarray]:
            col = lambda k: b.column(n + k).to_numpy(zero_copy_only=False)
            part, head, local = col(0), col(1), col(5)
            found = {"last": col(4) & ~(col(3) & goes_on[part]), "at": local + np.where(head, carry[0][part], 0)}
            for i in range(sums):
                found[f"sum{i}"] = col(6 + i) + np.where(head, carry[1 + i][part], 0)
            if hashed:
                lanes = [col(6 + sums + j).astype(np.uint64) for j in range(LANES)]
                k = np.flatnonzero(head & (carry[0][part] > 0))
                if len(k):
                    powers.reach(int(local[k].max()))
                    for j in range(LANES):
                        brought = carry[1 + sums + j][part[k]].astype(np.uint64)
                        lanes[j][k] = (brought * powers.up[j][local[k]] + lanes[j][k]) % PRIME
                found["lanes"] = lanes
            return found

        return resolve


def before(lanes: list[np.ndarray], elements_: list[np.ndarray]) -> list[np.ndarray]:
    """The digests of the sequences without their last element."""
    return [(x + PRIME - t) % PRIME * np.uint64(pow(b, -1, int(PRIME))) % PRIME for b, x, t in zip(POINTS, lanes, elements_, strict=True)]


def packed(lanes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The four lanes as two whole numbers."""
    s = np.uint64(31)
    return ((lanes[0] << s) | lanes[1]).astype(np.int64), ((lanes[2] << s) | lanes[3]).astype(np.int64)
