"""Rules of keyword tables and ledgers on small cases."""

from pyspark.sql import functions as F

from foliospark.operators import service as S


def test_keyword_table_in_a_document(spark):
    rows = [("a", 1, "x|y\nz ", 1.0, ["yake", "frequency"], None), ("b", 1, None, None, None, "Too short."), ("c", 1, None, None, None, None)]
    tables = {r.doc: r.markdown for r in S.keyword_table(spark.createDataFrame(rows, "doc string, rank int, keyword string, weight double, methods array<string>, note string"), "doc").collect()}
    assert tables["a"] == "## Keywords\n\n| Keyword | Weight | Found by |\n| --- | ---: | --- |\n| x\\|y z | 1.00 | frequency, yake |\n\n*1 keyword extracted by frequency, yake. Weight is relative to the top-ranked term (1.00), fused across methods by rank.*\n"
    assert (tables["b"], tables["c"]) == ("## Keywords\n\n*Too short.*\n", "## Keywords\n\n*No keywords were extracted.*\n")
    block = f"{S.OPEN}\n\n{tables['b']}\n{S.CLOSE}"
    docs = {"# T\ntext\n": f"# T\n\n{block}\n\ntext\n", "\n\n## T": f"\n\n## T\n\n{block}\n", "text\n# T": f"{block}\n\ntext\n# T\n", "": f"{block}\n", f"{S.OPEN} old {S.CLOSE}\n\n# T": f"# T\n\n{block}\n"}
    df = spark.createDataFrame(list(docs.items()), "d string, want string").withColumn("got", S.with_table(F.col("d"), F.lit(tables["b"])))
    for r in df.withColumn("bare", S.without_table(F.col("got"))).withColumn("again", S.with_table(F.col("got"), F.lit(tables["b"]))).collect():
        assert r.got == r.want and r.again == r.want.lstrip("\n") and S.OPEN not in r.bare


def test_a_failed_request_ends_the_ledger(spark):
    rows = [("a", 1, 3.0, 1.0), ("a", 2, 3.0, None), ("a", 3, 3.0, 1.0), ("b", 1, 3.0, 2.0), ("b", 2, 9.0, 1.0), ("b", 3, 1.0, 1.0), ("c", 1, 3.0, 3.0), ("c", 2, 3.0, 3.0)]
    got = S.within_spend(spark.createDataFrame(rows, "ledger string, ord int, worst double, cost double"), 10.0).orderBy("ledger", "ord").collect()
    assert [(r.ledger, r.ord, r.spent_before) for r in got] == [("a", 1, 0.0), ("a", 2, 1.0), ("b", 1, 0.0), ("c", 1, 0.0), ("c", 2, 3.0)]
