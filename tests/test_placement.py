import numpy as np
import pytest

from foliospark.operators import placement as P

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_crossed_blocks_align():
    a, b = "one two three four five six".split(), "four five six one two three".split()
    assert P.align_tokens(a, b).tolist() == [3, 4, 5, 0, 1, 2]
    assert P.align_tokens([], b).tolist() == [] and P.align_tokens(["x"], []).tolist() == [-1]


def test_place(spark):
    elements = spark.createDataFrame([(1, 1, 1, "Big [Title](http://x.y)"), (1, 1, 2, "lost words here now title"), (1, 1, 3, None), (2, 1, 1, "none")], "doc_id long, page int, ord int, text string")
    words = spark.createDataFrame([(1, 1, 1, "Big", 0.0, 0.0, 10.0, 5.0), (1, 1, 2, "title", 12.0, 1.0, 20.0, 6.0)], "doc_id long, page int, word int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.doc_id, r.ord): (r.coverage, r.x0, r.y1) for r in P.place(elements, words).collect()}
    assert got[1, 1] == (1.0, 0.0, 6.0) and got[1, 2][1] is None
    assert got[1, 3] == (None, None, None) and got[2, 1] == (0.0, None, None)


def test_photos(spark):
    grey = np.full((90, 120), 255, np.uint8)
    grey[0:45, 0:45] = 120  # 225 cells
    grey[60:66, 60:66] = 120  # 4 cells: too few
    cells = P.photo_cells(grey)
    assert cells.sum() == 225 and cells[:15, :15].all()
    images = spark.createDataFrame([(1, 120, bytearray(grey.tobytes()))], "page long, width int, pixels binary")
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 44.0, 8.0), (1, 2, 60.0, 60.0, 90.0, 68.0), (2, 1, 0.0, 0.0, 9.0, 9.0)], "page long, ord int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page, r.ord, r.share) for r in P.photo_share(images, lines).collect()) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0)]


def test_figures(spark):
    elements = spark.createDataFrame([(1, 1, 1, "text", "a", (0.0, 0.0, 90.0, 10.0)), (1, 1, 2, "text", "b", (0.0, 100.0, 90.0, 110.0))], f"doc_id long, page int, ord int, type string, text string, bbox {BOX}")
    images = spark.createDataFrame([(1, 1, (0.0, 20.0, 60.0, 90.0)), (1, 1, (0.0, 20.0, 60.0, 90.0)), (1, 1, (0.0, 20.0, 9.0, 90.0)), (1, 1, (0.0, 0.0, 595.0, 842.0))], f"doc_id long, page int, bbox {BOX}")
    pages = spark.createDataFrame([(1, 1, 595.0, 842.0)], "doc_id long, page int, width double, height double")
    assert sorted((r.ord, r.type, r.text) for r in P.figures(images, elements, pages).collect()) == [(1, "text", "a"), (2, "figure", ""), (3, "text", "b")]


def test_tiers(spark):
    assert P.tiers([20, 18, 14, 20], 10) == [0, 0, 1, 0]
    assert P.line_size("gap", 10) == 10 and P.line_size("ABC", 7.8) == pytest.approx(10)
    assert P.line_size("(gap)", 10) != P.line_size("(gap)", 10)
    lines = spark.createDataFrame([(1, 1, True, "gy", 20.0), (1, 2, True, "gy", 14.0), (1, 3, False, "gy", 10.0), (2, 1, True, "gy", 20.0), (3, 1, None, None, None)], "doc_id long, ord int, heading boolean, text string, height double")
    assert sorted((r.doc_id, r.ord, r.tier) for r in P.size_tiers(lines).collect()) == [(1, 1, 0), (1, 2, 1)]


def test_typography_levels(spark):
    lines = spark.createDataFrame([(1, 1, True, "PART 1 gy", 12.0), (1, 2, True, "1. Sky", 12.0), (1, 3, True, "1.1 Sky", 12.0), (1, 4, False, "gy", 10.0), (2, 1, True, "gy", 12.0), (2, 2, True, "(gy)", 12.0), (2, 3, False, "gy", 10.0)], "doc_id long, ord int, heading boolean, text string, height double")
    heads = lines.where("heading").select("doc_id", "ord", "text")
    assert sorted((r.doc_id, r.ord, r.level) for r in P.typography_levels(heads, lines).collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, None)]
