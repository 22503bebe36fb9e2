"""Change monitoring: per url, new / unchanged / changed / error, as a batch and as a stream."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType


def changes(checks: DataFrame) -> DataFrame:
    """(url, seq, markdown or null for a failed fetch) with status; a failure keeps the baseline."""
    w = Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.sha2("markdown", 256), ignorenulls=True).over(w)
    status = F.when(F.col("markdown").isNull(), "error").when(before.isNull(), "new").when(before == F.sha2("markdown", 256), "unchanged").otherwise("changed")
    return checks.withColumn("status", status).select("url", "seq", "status")


@F.pandas_udf(StringType())
def _line_diff(old: pd.Series, new: pd.Series, name: pd.Series) -> pd.Series:
    def one(a: str, b: str, url: str) -> str:
        return "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), f"{url} (previous)", f"{url} (current)", lineterm=""))

    return pd.Series([None if a is None or b is None else one(a, b, url) for a, b, url in zip(old, new, name, strict=True)], dtype=object)


def diffs(checks: DataFrame) -> DataFrame:
    """(url, seq, diff) of the checks that found a change: a unified diff by lines against the last good text, without
    dates, so equal texts give equal diffs. Only texts that differ leave the JVM."""
    good = checks.where(F.col("markdown").isNotNull()).withColumn("_old", F.lag("markdown").over(Window.partitionBy("url").orderBy("seq")))
    changed = good.where(F.col("_old") != F.col("markdown"))
    return changed.select("url", "seq", _line_diff("_old", "markdown", F.coalesce("url", F.lit(""))).alias("diff"))


def watch(checks: DataFrame) -> DataFrame:
    """The same over a stream; the state of a url is its last good hash."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, h in zip(rows["seq"], rows["hash"], strict=True):
            out.append((key[0], seq, "error" if h is None else "new" if last is None else "unchanged" if h == last else "changed"))
            last = h or last
        if last:
            state.update((last,))
        yield pd.DataFrame(out, columns=["url", "seq", "status"])

    hashed = checks.select("url", "seq", F.sha2("markdown", 256).alias("hash"))
    return hashed.groupBy("url").applyInPandasWithState(step, "url string, seq long, status string", "hash string", "append", GroupStateTimeout.NoTimeout)
