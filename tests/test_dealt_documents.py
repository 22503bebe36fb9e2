"""Shuffles of queries over pages and documents: rows are dealt as they are read, and to their document or page once more (F6, F7, F8)."""

import re

import pytest

import __spark_entry__ as entry
from foliospark.operators import stitch, units as U
from foliospark.plans import elements

DIR = "/root/testdata/sf0.001"
#: Both sides of the items' join and the items by customer, for elements and for relations, and both by document; blocks and what
#: is found of them by page.
MOST = {"document_markdown": 7, "reader_edition": 7, "stitched_cells": 1}


@pytest.mark.parametrize("name", sorted(MOST))
def test_shuffles(spark, name, monkeypatch):
    monkeypatch.setattr(elements, "DEALT", 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    found = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)
    assert 1 <= len(found) <= MOST[name], found
    assert all(int(n) > 8 for n in found), found


def test_units_keep_every_element(spark):
    """Elements of one place, without an id, and relations to nowhere."""
    cells = "array<array<struct<text:string,header:boolean,row_span:int,col_span:int>>>"
    schema = f"doc_id long, page int, ord int, type string, text string, text_format string, level int, level_signal string, role_signal string, signal string, rows {cells}, asset string"
    el = lambda d, o, text: (d, 1, o, "text", text, "plain", None, None, None, None, None, None)
    e = spark.createDataFrame([el(1, 1, "a"), el(1, 2, "b"), el(1, 2, "c"), el(None, 1, "d"), el(None, 2, "e"), el(2, 5, "f")], schema)
    r = spark.createDataFrame([(1, "continues_from", 9, 1, U.JOINED), (1, "continues_from", 1, 9, U.JOINED), (None, "continues_from", 2, 1, U.JOINED), (3, "caption_of", 1, 2, "rule"), (2, "continues_from", 5, 5, U.JOINED)], "doc_id long, type string, source int, target int, signal string")
    for how in ({}, {"tasks": 3}):
        assert sorted((x.doc_id or 0, x.unit) for x in U.units(e, r, **how).collect()) == [(0, "d"), (0, "e"), (1, "a"), (1, "b"), (1, "c"), (2, "f")]


def test_neighbours_are_found_where_the_page_was_dealt_to(spark):
    rows = [(d, 1, b, 1, 50.0 + 60 * (b % 3), 100.0 + 20 * (b // 3), 90.0 + 60 * (b % 3), 112.0 + 20 * (b // 3), f"w{b}") for d in range(9) for b in range(12)]
    lines = spark.createDataFrame(rows, "doc_id long, page int, block long, ord int, x0 double, y0 double, x1 double, y1 double, text string")
    found = stitch.blocks(lines.repartition(5, "doc_id"))
    for df, most in ((found, 1), (stitch.neighbours(found, 7), 2)):
        dealt = re.findall("Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString())
        assert len(dealt) <= most
    assert stitch.neighbours(found, 7).count() == stitch.neighbours(found).count() > 50
