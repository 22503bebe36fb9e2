from pyspark.sql import functions as F

from foliospark.operators import layout as L


def two_columns(gap=40, n=8):
    left = [(50, 100 + 14 * i, 280, 110 + 14 * i) for i in range(n)]
    return left + [(280 + gap, a, 280 + gap + 230, b) for _, a, _, b in left]


def test_reading_order():
    assert L.reading_order(two_columns()) == [list(range(8)), list(range(8, 16))]
    assert L.reading_order(two_columns(4)) is None and L.reading_order(two_columns()[:5]) is None
    shuffled = two_columns(n=12)[::-1] + [(50, 60, 550, 72)]  # one of 25 lines may cross the gutter
    assert L.reading_order(shuffled) == [[24], list(range(23, 11, -1)), list(range(11, -1, -1))]


def test_rows_by_centre():
    assert L.rows_by_centre([(60, 1, 90, 11), (10, 0, 50, 10), (10, 20, 50, 30)]) == [[1, 0], [2]]
    assert L.rows_by_centre([]) == []


def test_order_lines(spark):
    rows = [(1, 1, i, *map(float, b)) for i, b in enumerate(two_columns())] + [(1, 2, 0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.page, r.ord): (r.place, r.paragraph) for r in L.order_lines(df.select("doc_id", "page", "ord", F.struct("x0", "y0", "x1", "y1").alias("box"))).collect()}
    assert got[(2, 0)] == (None, None) and got[(1, 15)] == (15, 1) and len(got) == 17


def boxed(spark, rows, names):
    df = spark.createDataFrame(rows, names + ", x0 double, y0 double, x1 double, y1 double")
    return df.withColumn("box", F.struct("x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1")


def test_detections_and_cells(spark):
    found = boxed(spark, [(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 1.0, 1.0, 9.0, 9.0), (1, 1, 2, 8.0, 8.0, 30.0, 30.0)], "doc_id long, page int, ord long")
    assert sorted(r.ord for r in L.distinct_detections(found).collect()) == [0, 2]
    bands = [(1, 1, 0, "table", 0, 0.0, 0.0, 100.0, 40.0), *((1, 1, 0, "row", i, 0.0, 20.0 * i, 100.0, 20.0 * i + 20) for i in range(2)), *((1, 1, 0, "column", i, 50.0 * i, 0.0, 50.0 * i + 50, 40.0) for i in range(2))]
    words = [(1, 1, 0, "Site", 5.0, 5.0, 20.0, 15.0), (1, 1, 1, "Count", 55.0, 5.0, 80.0, 15.0), (1, 1, 2, "A", 5.0, 25.0, 10.0, 35.0), (1, 1, 3, "3", 60.0, 25.0, 65.0, 35.0), (1, 1, 4, "B", 12.0, 25.0, 20.0, 35.0), (1, 1, 5, "out", 0.0, 90.0, 9.0, 99.0)]
    cells = L.table_cells(boxed(spark, words, "doc_id long, page int, ord long, text string"), boxed(spark, bands, "doc_id long, page int, table int, kind string, n int"))
    assert {(r.row, r.col): r.text for r in cells.collect()} == {(0, 0): "Site", (0, 1): "Count", (1, 0): "A B", (1, 1): "3"}
    t = L.tabular(cells).first()
    assert (t.n_rows, t.n_cols, t.filled, t.mean_words, t.numeric_share) == (2, 2, 4, 1.25, 0.25)


def test_write_table(spark):
    cell = lambda text, header=False, down=None, right=None: (text, header, down, right)
    rows = [
        ([[cell("a", True), cell("b\n c", True)], [], [cell("x|y")]], "| a | b c |\n|---|---|\n| x\\|y |  |"),
        ([[cell("a", True), cell("b", True)]], "<table>\n<tr><th>a</th><th>b</th></tr>\n</table>"),
        ([[cell("a", True), cell("b")], [cell("c"), cell("d")]], "<table>\n<tr><th>a</th><td>b</td></tr>\n<tr><td>c</td><td>d</td></tr>\n</table>"),
        ([[cell("a<  &", False, 2, 2), cell(""), cell("e")], [cell("x"), cell("x"), cell("f")], [cell(None)]], '<table>\n<tr><td rowspan="2" colspan="2">a&lt; &amp;</td><td>e</td></tr>\n<tr><td>f</td></tr>\n<tr><td></td></tr>\n</table>'),
        ([], ""),
        ([[]], ""),
    ]
    df = spark.createDataFrame(rows, "rows array<array<struct<text:string,header:boolean,row_span:int,col_span:int>>>, want string")
    assert [r.got for r in df.select(L.write_table(F.col("rows")).alias("got")).collect()] == [w for _, w in rows]
