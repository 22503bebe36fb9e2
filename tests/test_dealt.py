"""Queries whose rows are dealt by document once, to as many tasks as the table's size asks for: their plans shuffle nothing else."""

import re

import pytest

import __spark_entry__ as entry
from foliospark.plans import elements

DIR = "/root/testdata/sf0.001"
#: Shuffles of each: one for each way in which a table's rows are read.
MOST = {"tabular_orders": 2, "reference_texts": 2, "spliced_tables": 2, "fallback_ladder": 13, "furniture_types": 3, "footnotes": 3}


@pytest.mark.parametrize("name", sorted(MOST))
def test_rows_are_dealt_once(spark, name, monkeypatch):
    monkeypatch.setattr(elements, "DEALT", 100)
    monkeypatch.setattr("foliospark.operators.service.ASKED", 100, raising=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    found = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)
    assert 1 <= len(found) <= MOST[name], found
    assert all(int(n) > 8 for n in found), found
