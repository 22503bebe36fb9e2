import duckdb
import pytest

import __spark_entry__ as entry

plans = entry.plans
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in plans.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    r = duck.execute(plans.ORACLE[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted(at) == names
    assert got == sorted(repr([plain(row[at[c]]) for c in names]) for row in r.fetchall())


def test_stream_is_batch(spark, tmp_path):
    from foliospark.streaming import monitor

    rows = [("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, None), ("u", 5, "b"), ("v", 1, None), ("v", 2, "x")]
    checks = spark.createDataFrame(rows, "url string, seq long, markdown string")
    checks.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted(tuple(r) for r in monitor.changes(checks).collect())
    q = monitor.watch(spark.readStream.schema(checks.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("seen").collect()) == want
    assert [s for u, _, s in want if u == "u"] == ["new", "unchanged", "changed", "error", "unchanged"]


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_subsumption_before_the_cut(spark, tmp_path):
    from foliospark.plans import queries as plans

    phrases = [" ".join(f"{w}{chr(97 + i)}{w}" for w in ("kor", "lum", "nev", "pid")) for i in range(8)] + [f"aba{chr(97 + i)}ba" for i in range(10)]
    text = ". ".join(phrases * 2) + "."
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert plans.QUERIES["keyword_subsumption"](spark, str(tmp_path)).count() == 20
