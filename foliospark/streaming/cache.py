"""A cache with a time to live and learned factors of estimates; each as a batch and as a stream with state and timers.

The batch sorts each key's rows within a task and runs through them; the stream keeps the same state between batches.
The stream needs Spark's RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Seconds that an answer and a failure are kept.
KEPT, FAILED = 300, 600
_READS = "key string, time timestamp, seq long, hit boolean, value string, ok boolean"
#: A factor's bounds, what one task changes it by at most, and seconds below which a task tells nothing.
BOUNDS, STEP, NOISE = (0.15, 8.0), 2.0, 2.0
_LEARNED = "scope string, seq long, predicted double, factors map<string,double>"


def _served(rows: pd.DataFrame, state: tuple | None, kept: int, failed: int) -> tuple[list[tuple], tuple | None]:
    """Reads of one key in the order of time, and the state (expiry, value, ok) after them."""
    out = []
    for time, seq, value, ok in zip(rows["time"], rows["seq"], rows["value"], rows["ok"], strict=True):
        hit = state is not None and time < state[0]
        if not hit:
            state = (time + pd.Timedelta(seconds=kept if ok else failed), value, bool(ok))
        out.append((time, seq, hit, state[1], state[2]))
    return out, state


def _frame(key: str, out: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(out, columns=["time", "seq", "hit", "value", "ok"])
    found.insert(0, "key", key)
    return found


def _runs(batches: Iterator[pd.DataFrame], by: str) -> Iterator[tuple[str, bool, pd.DataFrame]]:
    """Sorted rows by key, a batch's at a time: key, whether it goes on from the last batch, rows."""
    last = None
    for b in batches:
        for key, rows in b.groupby(by, sort=False):
            yield key, key == last, rows
            last = key


def cached(reads: DataFrame, kept: int = KEPT, failed: int = FAILED) -> DataFrame:
    """(key, time, seq, hit, value, ok): each read (key, time, seq, value, ok: what a query would answer then) with the answer
    that it is given: the cached one until that expires, else the query's, which is then kept, a failure for longer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for key, on, rows in _runs(batches, "key"):
            out, state = _served(rows, state if on else None, kept, failed)
            yield _frame(key, out)

    some = reads.select(F.col("key").cast("string").alias("key"), F.col("time").cast("timestamp").alias("time"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("string").alias("value"), "ok")
    return some.repartition("key").sortWithinPartitions("key", "time", "seq").mapInPandas(run, _READS)


class _Cache(StatefulProcessor):
    """State: expiry in milliseconds, value, ok; a timer at the expiry clears it."""

    def __init__(self, kept: int, failed: int):
        self.kept, self.failed = kept, failed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", StructType([StructField("expires", LongType()), StructField("value", StringType()), StructField("ok", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        got = self.state.get() if self.state.exists() else None
        before = (pd.Timestamp(got[0], unit="ms"), got[1], bool(got[2])) if got else None
        out, after = _served(pd.concat(list(rows)).sort_values(["time", "seq"]), before, self.kept, self.failed)
        if after != before:
            if before:
                self.handle.deleteTimer(int(before[0].timestamp() * 1000))
            at = int(after[0].timestamp() * 1000)
            self.state.update((at, after[1], int(after[2])))
            self.handle.registerTimer(at)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield _frame(key[0], []).iloc[:0]

    def close(self) -> None:
        pass


def cached_stream(reads: DataFrame, late: str = "1 hour", kept: int = KEPT, failed: int = FAILED) -> DataFrame:
    """As ``cached`` over a stream: reads later than ``late`` are dropped, expired answers leave the state by event time."""
    some = reads.select(F.col("key").cast("string").alias("key"), F.col("time").cast("timestamp").alias("time"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("string").alias("value"), "ok")
    return some.withWatermark("time", late).groupBy("key").transformWithStateInPandas(_Cache(kept, failed), _READS, "append", "EventTime")


def learn(factors: dict[str, float], parts: dict[str, float], observed: float) -> float | None:
    """Move each profile that a task used toward what happened, by its share of the task; the prediction before, or null
    if the task tells nothing. A task halves or doubles a factor at most."""
    predicted = sum(seconds * factors.get(p, 1.0) for p, seconds in parts.items())
    if not predicted > 0 or not observed or not observed > 0 or predicted < NOISE and observed < NOISE:
        return None
    now = {p: factors.get(p, 1.0) for p in parts}
    for p, seconds in parts.items():
        step = (observed / predicted) ** (0.5 * seconds * now[p] / predicted)
        factors[p] = min(BOUNDS[1], max(BOUNDS[0], now[p] * min(STEP, max(1 / STEP, step))))
    return predicted


def _learned(scope: str, rows: pd.DataFrame, factors: dict[str, float]) -> pd.DataFrame:
    out = []
    for seq, parts, observed in zip(rows["seq"], rows["parts"], rows["observed"], strict=True):
        predicted = learn(factors, dict(parts), observed)
        out.append((scope, seq, predicted, {p: factors.get(p, 1.0) for p in dict(parts)}))
    return pd.DataFrame(out, columns=["scope", "seq", "predicted", "factors"])


def learned(tasks: DataFrame) -> DataFrame:
    """(scope, seq, predicted, factors): for each task (scope, seq, parts: seconds by profile, observed seconds) what was
    predicted with the factors before it, and the factors of its profiles after it. Tasks go by seq within a scope."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors: dict[str, float] = {}
        for scope, on, rows in _runs(batches, "scope"):
            factors = factors if on else {}
            yield _learned(scope, rows, factors)

    some = tasks.select(F.col("scope").cast("string").alias("scope"), F.col("seq").cast("long").alias("seq"), "parts", F.col("observed").cast("double").alias("observed"))
    return some.repartition("scope").sortWithinPartitions("scope", "seq").mapInPandas(run, _LEARNED)


class _Factors(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.factors = handle.getMapState("factors", StructType([StructField("profile", StringType())]), StructType([StructField("factor", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        factors = {k[0]: v[0] for k, v in self.factors.iterator()}
        yield _learned(key[0], pd.concat(list(rows)).sort_values("seq"), factors)
        for profile, factor in factors.items():
            self.factors.updateValue((profile,), (factor,))

    def close(self) -> None:
        pass


def learned_stream(tasks: DataFrame) -> DataFrame:
    """As ``learned`` over a stream; the state of a scope is its factors by profile."""
    some = tasks.select(F.col("scope").cast("string").alias("scope"), F.col("seq").cast("long").alias("seq"), "parts", F.col("observed").cast("double").alias("observed"))
    return some.groupBy("scope").transformWithStateInPandas(_Factors(), _LEARNED, "append", "None")
