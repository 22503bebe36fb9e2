from pyspark.sql import functions as F

from foliospark.operators import units as U

CELLS = "array<array<struct<text:string,header:boolean,row_span:int,col_span:int>>>"
ELEMENTS = f"doc_id long, page int, ord int, type string, text string, text_format string, level int, level_signal string, role_signal string, signal string, rows {CELLS}, asset string"
RELATIONS = "doc_id long, type string, source int, target int, signal string"


def el(page, ord, type="text", text="", fmt="plain", level=None, level_signal=None, role=None, signal=None, rows=None, asset=None):  # noqa: A002
    return (1, page, ord, type, text, fmt, level, level_signal, role, signal, rows, asset)


def table(*rows):
    return [[(c, i == 0, 1, 1) for c in r] for i, r in enumerate(rows)]


def got(spark, elements, relations, **how):
    r = U.document_markdown(spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(relations, RELATIONS), **how).collect()
    return r[0].markdown if r else None


def test_pages_and_chains(spark):
    assert got(spark, [el(1, 1, text="one\n"), el(1, 2, text="two"), el(3, 3, text="  \n"), el(4, 4, text="\nthree"), el(None, 5, text="four"), el(None, 6, text=None)], []) == "one\n\n\ntwo\n\nthree\n\nfour"
    elements = [el(1, 1, text="pig-\n"), el(1, 2, "figure"), el(1, 3, text="mented"), el(1, 4, text="\nleaves"), el(2, 5, text="over")]
    relations = [(1, "continues_from", 3, 1, "continuation-column"), (1, "continues_from", 4, 3, "continuation-column"), (1, "continues_from", 5, 4, "continuation-column"), (1, "continues_from", 9, 4, "continuation-column")]
    assert got(spark, elements, relations) == "pig-\nmented\nleaves\n\nover"
    assert U.units(spark.createDataFrame(elements, ELEMENTS), spark.createDataFrame(relations, RELATIONS)).orderBy("ord").first().members == [1, 3, 4]
    assert got(spark, [], []) is None


def test_figures_and_tables(spark):
    elements = [el(1, 1, "figure", asset="a.png"), el(1, 2, "caption", "## Fig. [1]\n moss", "markdown"), el(1, 3, "caption", "second"), el(1, 4, "table", rows=table(("Site", "No."), ("a", "1")), signal="tatr"), el(2, 5, "table", rows=table(("site", "no"), ("b", "2")), asset="t.png"), el(2, 6, "page_number", "2")]
    relations = [(1, "caption_of", 3, 1, "x"), (1, "caption_of", 2, 1, "x"), (1, "continues_table", 5, 4, "table-page")]
    assert got(spark, elements, relations, assets=True) == "![Fig. (1) moss](a.png)\n\n## Fig. [1]\n moss\n\nsecond\n\n| Site | No. |\n|---|---|\n| a | 1 |\n\nsite no\nb 2\n\n![Table image](t.png)\n\n2"
    assert got(spark, elements, relations, reader=True) == "## Fig. [1]\n moss\n\nsecond\n\n| Site | No. |\n|---|---|\n| a | 1 |\n\nb 2"


def test_headings_and_notes(spark):
    elements = [
        el(1, 1, "title", "# Moss\nand **fern**", "markdown", 3, "pass"), el(1, 2, "heading", "By\nlayout", level=1, signal="pp-doclayoutv3"), el(1, 3, "heading", "## kept", "markdown", 1), el(1, 4, text="a<sup>2, 4</sup> b<sup>2,3</sup> c<sup>4</sup>"),
        el(1, 5, "footnote", "2. two", role="footnote-marker"), el(1, 6, "footnote", " 4 four", role="footnote-marker"), el(1, 7, "footnote", "5 plain"),
    ]
    relations = [(1, "footnote_for", 5, 4, "footnote-marker"), (1, "footnote_for", 6, 4, "footnote-marker"), (1, "footnote_for", 7, 4, "other")]
    assert got(spark, elements, relations) == "### Moss and **fern**\n\n# By layout\n\n## kept\n\na[^2][^4] b<sup>2,3</sup> c[^4]\n\n[^2]: two\n\n [^4]: four\n\n5 plain"


def test_note_marks(spark):
    df = spark.createDataFrame([("x<sup>1</sup>", [1]), ("x<sup>1</sup>", []), ("x<sup>1</sup>", None), (None, [1])], "t string, n array<int>")
    assert [r[0] for r in df.select(U.with_note_marks(F.col("t"), F.col("n"))).collect()] == ["x[^1]", "x<sup>1</sup>", "x<sup>1</sup>", None]
