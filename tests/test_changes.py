"""Diffs of changed texts and likeness of titles, against the standard library."""

from difflib import SequenceMatcher, unified_diff

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.streaming import monitor


def test_diffs(spark):
    a, b = "# T\n\none\ntwo\nthree\n", "# T\n\none\n2\nthree\nfour"
    rows = [("u", 1, a), ("u", 2, a), ("u", 3, None), ("u", 4, b), ("u", 5, ""), ("v", 1, None), ("v", 2, b), (None, 1, "x"), (None, 2, "y")]
    got = {(r.url, r.seq): r.diff for r in monitor.diffs(spark.createDataFrame(rows, "url string, seq long, markdown string")).collect()}

    def want(x, y, url):
        return "\n".join(unified_diff(x.splitlines(), y.splitlines(), f"{url} (previous)", f"{url} (current)", lineterm=""))

    assert got == {("u", 4): want(a, b, "u"), ("u", 5): want(b, "", "u"), (None, 2): want("x", "y", "")}
    assert monitor.diffs(spark.createDataFrame([], "url string, seq long, markdown string")).count() == 0


def test_similar_titles(spark):
    titles = ["introduction", "introduccion", "introduction to it", "the method", "the methods", "method", "short", "", "conclusion and outlook", "conclusions and outlook", "🙂" * 7, "🙂" * 8, None]
    pairs = [(x, y) for x in titles for y in titles]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.similar_titles(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.s is None
        else:
            assert r.s == (min(len(r.a), len(r.b)) >= 6 and SequenceMatcher(None, r.a, r.b).ratio() >= 0.86), r
