"""Copies of a page's blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def without_repeat(blocks: list[str], low: int = 40, high: int = 250, most: int = 60) -> list[str]:
    """The blocks without the second copy of the longest run that is repeated at once and has ``low`` to ``high``
    characters; of equally long runs the first. Over ``most`` blocks nothing is a short page's repeat."""
    n = len(blocks)
    best = (0, 0, 0)
    for at in range(n if n <= most else 0):
        for size in range(1, (n - at) // 2 + 1):
            length = len("\n\n".join(blocks[at : at + size]))
            if low <= length <= high and length > best[0] and blocks[at : at + size] == blocks[at + size : at + 2 * size]:
                best = (length, at, size)
    return blocks[: best[1] + best[2]] + blocks[best[1] + 2 * best[2] :]


@F.pandas_udf(StringType())
def repaired(text: pd.Series) -> pd.Series:
    """Markdown without a short page's repeated run of blocks."""
    from .structure import blocks

    return text.map(lambda t: t if not isinstance(t, str) else "\n\n".join(without_repeat(blocks(t))))
