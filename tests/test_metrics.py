"""Spans by cells of time, against a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import metrics as M


def plain(spans):
    most, busy = {}, {}
    for key in {k for k, *_ in spans}:
        own = sorted((a, b) for k, a, b in spans if k == key and a is not None and b is not None)
        if own:
            most[key] = max(sum(x <= a < y for x, y in own) for a, _ in own)
            reach, total = own[0][0], 0
            for a, b in own:
                total, reach = total + max(0, b - max(a, reach)), max(reach, b)
            busy[key] = total
    return most, busy


@pytest.mark.parametrize("grain", [1, 7, 1000])
def test_spans(spark, grain):
    rng = random.Random(grain)
    spans = [("ab"[rng.random() < 0.2], a, a + rng.choice([0, 1, 3, 20])) for a in (rng.randrange(-40, 120) for _ in range(150))]
    spans += [("c", 5, None), ("c", None, 7), ("c", 3, 9), ("c", 3, 9), ("d", 1, 1), (None, 2, 8), (None, 4, 30), ("e", None, None)]
    df = spark.createDataFrame(spans, "k string, start long, stop long")
    most, busy = plain(spans)
    assert {r.k: r.most for r in M.in_flight(df, "k", grain).collect()} == most
    assert {r.k: r.busy for r in M.busy(df, "k", F.col("stop") - F.col("start"), grain).collect()} == busy


def test_no_spans(spark):
    df = spark.createDataFrame([], "k string, start long, stop long")
    assert M.in_flight(df, "k").count() == M.busy(df, "k", F.col("stop") - F.col("start")).count() == 0
