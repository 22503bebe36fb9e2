from foliospark.operators import passes as P

BOX = "bbox struct<x0:double,y0:double,x1:double,y1:double>"
ELEMENTS = f"doc_id long, page int, ord int, type string, text string, text_format string, {BOX}"


def box(*at):
    return tuple(map(float, at))


def pages(spark, *numbers, height=842.0):
    return spark.createDataFrame([(1, p, height) for p in numbers], "doc_id long, page int, height double")


def test_furniture(spark):
    top, middle = box(50, 20, 300, 40), box(50, 300, 300, 340)
    rows = [(1, p, 10 * p, "text", f"Gazette No {p}", "plain", top) for p in (1, 2, 3)] + [
        (1, 1, 11, "heading", "Gazette No 9", "plain", top), (1, 1, 12, "text", "7", "plain", box(290, 810, 300, 825)), (1, 1, 13, "text", "body text", "plain", middle),
        (1, 1, 14, "page_header", "Header amid", "plain", middle), (1, 2, 21, "text", "*Journal* 41", "markdown", top), (1, 2, 22, "text", "**Moss 41**", "markdown", top), (1, 2, 23, "text", "Appendix 6", "markdown", top),
        (1, 3, 31, "text", None, None, None), (1, 9, 91, "text", "12", "plain", top), (None, None, None, None, None, None, None),
    ]
    got = {r.ord: (r.type, r.role_signal) for r in P.typed_furniture(spark.createDataFrame(rows, ELEMENTS), pages(spark, 1, 2, 3)).collect()}
    repeat, same = ("page_header", "furniture-repeat"), ("text", None)
    assert got == {10: repeat, 20: repeat, 30: repeat, 11: ("heading", None), 12: ("page_number", "furniture-number"), 13: same, 14: ("text", "furniture-outside"), 21: ("page_header", "furniture-head"), 22: same, 23: same, 31: same, 91: same, None: (None, None)}


def test_continued_paragraphs(spark):
    rows = [
        (1, 1, 1, "text", "the survey began in the", "plain", box(50, 700, 280, 780)), (1, 1, 2, "figure", "", "plain", None), (1, 1, 3, "text", "northern valleys went on and", "plain", box(300, 100, 550, 200)),
        (1, 1, 4, "page_number", "1", "plain", box(290, 810, 300, 825)), (1, 1, 5, "text", "speckle of scanner noise", "plain", box(0, 830, 9, 840)), (1, 2, 6, "text", "over the hills.", "plain", None),
        (1, 2, 7, "text", "some words without end", "plain", None), (1, 2, 8, "heading", "Part 2", "plain", None), (1, 2, 9, "text", "after a heading nothing goes on", "plain", None), (1, 4, 10, "text", "nor over a page", "plain", None),
    ]
    got = P.continued_paragraphs(spark.createDataFrame(rows, ELEMENTS), pages(spark, 1, 2, 4)).collect()
    assert sorted((r.source, r.target, r.signal) for r in got) == [(3, 1, "continuation-column"), (6, 3, "continuation-page")]


def test_captions(spark):
    rows = [
        (1, 1, 1, "heading", "PART 2 Lichens", "plain", box(50, 90, 300, 115)), (1, 1, 2, "table", "", "plain", box(50, 200, 400, 300)), (1, 1, 3, "text", "Table 4 Counts by site", "plain", box(50, 310, 300, 325)),
        (1, 1, 4, "text", "Table 5 far away", "plain", box(50, 700, 300, 715)), (1, 1, 5, "caption", "of the table too", "plain", box(50, 330, 300, 340)), (1, 1, 6, "text", "running text", "plain", box(50, 345, 300, 350)),
        (1, 1, 7, "text", "Fig. 3 behind text", "plain", box(50, 352, 300, 360)), (1, 1, 8, "figure", "", "plain", box(50, 370, 300, 400)), (1, 2, 9, "caption", "no height", "plain", box(0, 0, 1, 1)),
    ]
    e = spark.createDataFrame(rows, ELEMENTS)
    links = P.caption_links(e, pages(spark, 1))
    assert sorted((r.source, r.target) for r in links.collect()) == [(3, 2), (5, 2), (7, 8)]
    got = {r.ord: (r.type, r.role_signal) for r in P.typed_captions(e, links).collect()}
    assert [got[k] for k in (3, 4, 5, 7)] == [("caption", "caption-pattern"), ("text", None), ("caption", None), ("caption", "caption-pattern")]


def test_outlined(spark):
    rows = [(1, 1, 1, "heading", "Part 2: **Lichens**", "markdown", None), (1, 1, 2, "text", "PART 2 — lichens", "plain", None), (1, 1, 3, "table", "part 2 lichens", "plain", None), (1, 2, 4, "title", "Part 2 lichens", "plain", None)]
    outline = spark.createDataFrame([(1, 1, 1, 2, "Part 2: lichens"), (1, 2, 1, 3, "Part 2, Lichens"), (1, 3, 1, 4, "Part 2 lichens"), (1, 4, 1, 1, "—")], "doc_id long, entry int, page int, level int, title string")
    got = {r.ord: (r.type, r.level, r.level_signal, r.role_signal) for r in P.outlined(spark.createDataFrame(rows, ELEMENTS), outline).collect()}
    assert got == {1: ("heading", 2, "pdf-outline", None), 2: ("heading", 3, "pdf-outline", "pdf-outline"), 3: ("table", None, None, None), 4: ("title", None, None, None)}


def test_notes(spark):
    rows = [
        (1, 1, 0, "text", "Moss<sup>1</sup> and fern<sup>2</sup>"), (1, 1, 1, "text", "More moss<sup>1, 2</sup>"), (1, 1, 2, "text", "1 On moss\ngoes on\n9 no note\n2. On fern"), (1, 1, 3, "table", "1 a\n2 b"),
        (1, 2, 0, "text", "Bark<sup>1</sup>"), (1, 2, 1, "text", "1 One note only"), (2, 1, 0, "text", None), (2, 1, 1, "text", ""), (3, 1, 0, "text", "a<sup>1,2</sup>"), (3, 1, 1, "text", "before\n1 x\n2 y"),
    ]
    got = P.split_notes(spark.createDataFrame(rows, "doc_id long, page int, ord int, type string, text string")).collect()
    assert sorted((r.doc_id, r.page, r.ord, r.note, r.number, r.text, r.cited) for r in got) == [(1, 1, 2, 1, 1, "1 On moss\ngoes on\n9 no note", [0, 1]), (1, 1, 2, 2, 2, "2. On fern", [0, 1])]


def test_table_links(spark):
    def rows_of(*rows, header=True):
        return [[(c, header and i == 0) for c in r] for i, r in enumerate(rows)]

    left, right, low = box(50, 100, 280, 300), box(300, 120, 550, 290), box(300, 500, 550, 600)
    rows = [
        (1, 1, 1, "table", "", "plain", left, rows_of(("Site", "Count"), ("a", "1"))), (1, 1, 2, "table", "", "plain", right, rows_of(("site", "Counts"), ("b", "2"))), (1, 1, 3, "table", "", "plain", low, rows_of(("Site", "Count"))),
        (1, 1, 4, "page_number", "1", "plain", None, None), (1, 2, 5, "table", "", "plain", None, rows_of(("c", "3"), header=False)), (1, 3, 6, "caption", "Table 1 (continued)", "plain", None, None),
        (1, 3, 7, "table", "", "plain", None, rows_of(("x", "y", "z"))), (1, 4, 8, "table", "", "plain", None, rows_of(("p", "q", "r"))), (1, 5, 9, "table", "no rows", "plain", None, None),
    ]
    e = spark.createDataFrame(rows, ELEMENTS + ", rows array<array<struct<text:string,header:boolean>>>")
    assert sorted((r.source, r.target, r.signal) for r in P.table_links(e).collect()) == [(2, 1, "table-panel"), (5, 3, "table-page"), (7, 5, "table-page")]
    assert P.table_links(e.limit(0)).isEmpty()
