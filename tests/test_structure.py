from foliospark.operators import structure as D


def box(x0, y0, x1, y1):
    return (float(x0), float(y0), float(x1), float(y1))


def test_blocks():
    assert D.blocks("# a\n\nb\nc\n \n```\nx\n\ny\n```\n\nd") == ["# a", "b\nc", "```\nx\n\ny\n```", "d"]
    assert D.blocks(None) == D.blocks(" \n\n ") == []
    assert D.blocks("````\na\n```\n\nb") == ["````\na\n```\n\nb"]


def test_continuations(spark):
    rows = [(1, 1, "the survey began in the"), (1, 2, "northern valleys and went on."), (1, 3, "A new one")]
    df = spark.createDataFrame(rows, "doc long, ord int, text string")
    assert [tuple(r) for r in D.continuations(df, "doc", "ord", "text").collect()] == [(1, 2, 1)]


def test_regroup(spark):
    b = "struct<x0:double,y0:double,x1:double,y1:double>"
    lines = spark.createDataFrame([(1, 1, 1, box(0, 0, 10, 10)), (1, 1, 2, box(0, 20, 10, 30)), (1, 1, 3, box(0, 500, 10, 510))], f"doc_id long, page int, ord int, box {b}")
    regions = spark.createDataFrame([(1, 1, 1, box(0, 0, 100, 15)), (1, 1, 2, box(0, 14, 100, 100))], f"doc_id long, page int, ord int, box {b}")
    assert {r.ord: r.region for r in D.regroup(lines, regions).collect()} == {1: 1, 2: 2, 3: 2}
