"""Alignment of word sequences: slots, votes, error lists, block partners, order and tree distances."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

Pair = tuple[str | None, str | None]


def align(a: Sequence[str], b: Sequence[str]) -> list[Pair]:
    """The pairs of a cheapest edit path; None is a gap. Of equal paths, from the end, pairs come before gaps in ``b``,
    and these before gaps in ``a``."""
    n, m = len(a), len(b)
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    other, steps = np.array([codes[w] for w in b], np.int64), np.arange(m + 1)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[0] = steps
    for i, w in enumerate(a, 1):
        best = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (other != codes[w]))
        cost[i] = np.minimum.accumulate(np.r_[i, best] - steps) + steps
    out: list[Pair] = []
    i, j = n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def slots(pivot: Sequence[str], other: Sequence[str]) -> tuple[list[str | None], list[list[str]]]:
    """What ``other`` has at each word of ``pivot``, and what it inserts before each of them and at the end."""
    at: list[str | None] = []
    more: list[list[str]] = [[]]
    for x, y in align(pivot, other):
        if x is None:
            more[-1].append(y or "")
        else:
            at.append(y)
            more.append([])
    return at, more


def common(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """A longest common subsequence."""
    best: list[list[list[str]]] = [[[] for _ in range(len(b) + 1)] for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + [x] if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
    return best[-1][-1]


def vote(pivot: Sequence[str], second: Sequence[str], third: Sequence[str]) -> list[str]:
    """Two of three readings win at each word of the pivot, deletions included; what both others insert is kept."""
    (s, s_more), (t, t_more) = slots(pivot, second), slots(pivot, third)
    out: list[str] = []
    for i in range(len(pivot) + 1):
        out += common(s_more[i], t_more[i])
        if i < len(pivot):
            word = s[i] if s[i] == t[i] else pivot[i]
            out += [] if word is None else [word]
    return out


def word_errors(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """(key, ord, kind, reference, output): substitutions, deletions and insertions of each pair of word arrays. A null
    array has no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, a, b in zip(pdf["k"], pdf["a"], pdf["b"], strict=True):
                path = align([] if a is None else list(a), [] if b is None else list(b))
                rows += [(k, i, "ins" if x is None else "del" if y is None else "sub", x, y) for i, (x, y) in enumerate(path) if x != y]
            yield pd.DataFrame(rows, columns=["k", "ord", "kind", "reference", "output"])

    kind = pairs.schema[key].dataType.simpleString()
    found = pairs.select(F.col(key).alias("k"), F.col(reference).alias("a"), F.col(output).alias("b")).mapInPandas(run, f"k {kind}, ord long, kind string, reference string, output string")
    return found.withColumnRenamed("k", key)


def vote_texts(readings: DataFrame, key: str, columns: tuple[str, str, str]) -> DataFrame:
    """(key, text): the vote of three word arrays of each row; the first is the pivot."""

    @F.pandas_udf("string")
    def voted(p: pd.Series, s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([" ".join(vote(*([] if x is None else list(x) for x in row))) for row in zip(p, s, t, strict=True)], dtype=object)

    return readings.select(key, voted(*columns).alias("text"))


def mutual_partners(gold: DataFrame, output: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """(key, gold, output, shared): blocks (key, block, words) that are each other's best partner and share at least
    ``share`` of both blocks' words, counted as multisets."""
    def counts(blocks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        words = blocks.select(key, F.col("block").alias(name), F.explode("words").alias("w"))
        return words.groupBy(key, name, "w").agg(F.count("*").alias(f"n_{name}")), blocks.select(key, F.col("block").alias(name), F.size("words").alias(f"all_{name}"))

    (g, g_all), (o, o_all) = counts(gold, "gold"), counts(output, "output")
    met = g.join(o, [key, "w"]).groupBy(key, "gold", "output").agg(F.sum(F.least("n_gold", "n_output")).alias("shared"))
    met = met.join(g_all, [key, "gold"]).join(o_all, [key, "output"]).where(F.col("shared") >= share * F.greatest("all_gold", "all_output"))
    best = lambda side, other: F.row_number().over(Window.partitionBy(key, side).orderBy(F.desc("shared"), other))
    return met.withColumn("a", best("gold", "output")).withColumn("b", best("output", "gold")).where("a = 1 AND b = 1").select(key, "gold", "output", "shared")


def order_error(places: Sequence[int]) -> float:
    """The share of items outside a longest increasing run of places."""
    ends: list[int] = []
    for p in places:
        at = bisect_left(ends, p)
        ends[at : at + 1] = [p]
    return 1 - len(ends) / len(places) if len(places) else 0.0


order_error_of = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else order_error(list(x))), DoubleType())


Tree = tuple[str, list]


def _postorder(tree: Tree) -> tuple[list[str], list[int]]:
    """Labels in post-order, and for each node the place of its leftmost leaf."""
    labels: list[str] = []
    left: list[int] = []

    def visit(node: Tree) -> int:
        firsts = [visit(child) for child in node[1]]
        labels.append(node[0])
        left.append(firsts[0] if firsts else len(labels) - 1)
        return left[-1]

    visit(tree)
    return labels, left


def tree_distance(a: Tree, b: Tree, rename: Callable[[str, str], float] = lambda x, y: float(x != y)) -> float:
    """Edit distance of ordered labelled trees with unit insertions and deletions (Zhang and Shasha)."""
    (la, lefta), (lb, leftb) = _postorder(a), _postorder(b)
    roots = lambda left: sorted({x: i for i, x in enumerate(left)}.values())
    done = np.zeros((len(la), len(lb)))
    for i in roots(lefta):
        for j in roots(leftb):
            i0, j0 = lefta[i], leftb[j]
            forest = np.zeros((i - i0 + 2, j - j0 + 2))
            forest[:, 0], forest[0] = np.arange(i - i0 + 2), np.arange(j - j0 + 2)
            for x in range(i0, i + 1):
                for y in range(j0, j + 1):
                    u, v = x - i0 + 1, y - j0 + 1
                    gap = min(forest[u - 1, v], forest[u, v - 1]) + 1
                    if lefta[x] == i0 and leftb[y] == j0:
                        forest[u, v] = done[x, y] = min(gap, forest[u - 1, v - 1] + rename(la[x], lb[y]))
                    else:
                        forest[u, v] = min(gap, forest[lefta[x] - i0, leftb[y] - j0] + done[x, y])
    return float(done[-1, -1])


def tree_similarity(a: Tree, b: Tree, rename: Callable[[str, str], float] = lambda x, y: float(x != y)) -> float:
    """One minus the distance's share of the larger tree, not below zero."""
    return max(0.0, 1 - tree_distance(a, b, rename) / max(len(_postorder(a)[0]), len(_postorder(b)[0])))
