from pyspark.sql import functions as F

from foliospark.operators import recover as R


def test_repeats(spark):
    a, b = "x" * 30, "y" * 30
    assert R.without_repeat([a, b, a, b, "end"]) == [a, b, "end"]
    assert R.without_repeat([a, a, "end"]) == [a, a, "end"] and R.without_repeat([]) == []
    long = "z" * 251
    assert R.without_repeat([long, long]) == [long, long]
    df = spark.createDataFrame([(f"{a}{b}\n\n{a}{b}",), (None,)], "t string")
    assert [r[0] for r in df.select(R.repaired(F.col("t"))).collect()] == [a + b, None]
