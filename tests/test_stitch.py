"""Components, stitched cells, spliced tables and line order on small cases, against plain Python where that is short."""

import random

import pytest

from foliospark.operators import graph, order, stitch


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(3000, 3100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


LINE = "doc_id string, page int, block int, ord int, x0 double, y0 double, x1 double, y1 double, text string"


def cell(doc, block, x, n, text, step=20.0, y=0.0, height=12.0, width=40.0):
    return [(doc, 1, block, k, x, y + step * k, x + width, y + step * k + height, f"{text}{k}") for k in range(n)]


def test_stitched(spark):
    prose = lambda d, b, y: [(d, 1, b, 0, 0.0, y, 430.0, y + 12, "these are more words than a cell has")]
    rows = prose("t", 1, -40.0) + cell("t", 2, 0.0, 4, "a") + prose("t", 3, 300.0) + cell("t", 4, 60.0, 4, "b") + cell("t", 5, 130.0, 2, "c")  # a lone table over three blocks
    rows += prose("far", 1, -40.0) + cell("far", 2, 0.0, 3, "a") + cell("far", 3, 200.0, 3, "b")  # over a fifth of the width apart
    rows += prose("off", 1, -40.0) + cell("off", 2, 0.0, 3, "a") + cell("off", 3, 60.0, 3, "b", y=9.0)  # between the rows
    rows += prose("tall", 1, -40.0) + cell("tall", 2, 0.0, 3, "a") + cell("tall", 3, 60.0, 3, "b", y=-5.0, height=22.0)  # another size of type
    got = {}
    for r in sorted(stitch.stitched(spark.createDataFrame(rows, LINE)).collect(), key=lambda r: (r.doc_id, r.ord)):
        got.setdefault(r.doc_id, []).append((r.n_blocks, r.text.split("\n")[0]))
    words = "these are more words than a cell has0"[:-1]
    assert got == {"t": [(1, words), (3, "a0 b0 c0"), (1, words)], "far": [(1, words), (1, "a0"), (1, "b0")], "off": [(1, words), (1, "a0"), (1, "b0")], "tall": [(1, words), (1, "a0"), (1, "b0")]}


def test_spliced(spark):
    words = []
    for elem, line, word, text, table in [(0, 0, 0, "kept", None), (1, 1, 0, "above", None), (1, 2, 0, "left", None), (1, 2, 1, "a", "x"), (1, 3, 0, "b", "x"), (1, 4, 0, "below", None), (2, 5, 0, "c", "x"), (2, 5, 1, "d", "y"), (3, 6, 0, "end", None)]:
        words.append(("d", 1, elem, line, word, 20.0 * line, 20.0 * line + 10, text, table))
    w = spark.createDataFrame(words, "doc_id string, page int, elem int, line int, word int, y0 double, y1 double, text string, table string")
    t = spark.createDataFrame([("d", 1, "x", 39.0, "X"), ("d", 1, "y", 99.0, "Y"), ("d", 1, "unused", 0.0, "Z")], "doc_id string, page int, table string, y0 double, text string")
    got = [(r.kind, r.text) for r in stitch.spliced(w, t).orderBy("ord").collect()]
    assert got == [("text", "kept"), ("text", "above"), ("table", "X"), ("text", "left\nbelow"), ("table", "Y"), ("text", "end")]


def test_line_order(spark):
    ref = "one two three four\nfive six seven\nshort\neight nine ten\neleven twelve thirteen"
    rows = [("same", ref, ref), ("swapped", ref, "five six seven\none two three four\neight nine ten eleven twelve thirteen"), ("one", ref, "five six seven"), ("none", ref, ""), ("null", ref, None)]
    got = {r.id: (r.located, r.order_error) for r in order.line_order_errors(spark.createDataFrame(rows, "id string, reference string, output string")).collect()}
    assert got == {"same": (4, 0.0), "swapped": (4, 0.5), "one": (1, None), "none": (0, None), "null": (0, None)}


def test_references(spark):
    w = [("d", 1, k, x, y, x + 10, y + 10, t) for k, (x, y, t) in enumerate([(50.0, 0.0, "b"), (0.0, 2.0, "a"), (0.0, 20.0, "c"), (90.0, 20.0, "edge"), (95.0, 50.0, "out"), (0.0, 60.0, "second")])]
    words = spark.createDataFrame(w, "doc_id string, page int, word int, x0 double, y0 double, x1 double, y1 double, text string")
    r = [("d", 1, 2, 100.0, 200.0, 0.0, 0.0, 0.95, 1.0), ("d", 1, 1, 100.0, 200.0, 0.0, 0.325, 0.5, 0.5)]  # the second holds a centre on its upper edge, the first none on its right one
    regions = spark.createDataFrame(r, "doc_id string, page int, region int, width double, height double, x0 double, y0 double, x1 double, y1 double")
    got = stitch.references(words, regions).first()
    assert (got.text, got.missed) == ("second\na b\nc\n", 2)


@pytest.mark.parametrize("folded", [200, 2])
def test_tables_of_a_page_by_its_pairs(spark, monkeypatch, folded):
    """pairs of a page make its tables within a row, those of a page with many over tables, without a difference."""
    asked = []
    monkeypatch.setattr(stitch, "FOLDED", folded)
    monkeypatch.setattr(stitch, "components", lambda edges, real=stitch.components: asked.append(edges.count()) or real(edges))
    rows = [(1, 1, 1, 2), (1, 1, 3, 4), (1, 1, 2, 4), (1, 1, 7, 8), (1, 2, 1, 2), (2, 1, 5, 9), (2, 1, 3, 9)]
    got = {tuple(r) for r in stitch.firsts(spark.createDataFrame(rows, "doc_id long, page int, a long, b long")).collect()}
    assert {g for g in got if g[2] != g[3]} == {(1, 1, 2, 1), (1, 1, 3, 1), (1, 1, 4, 1), (1, 1, 8, 7), (1, 2, 2, 1), (2, 1, 5, 3), (2, 1, 9, 3)}
    assert len(got) == len({g[:3] for g in got}) == 11 and asked == ([] if folded > 2 else [4])


def test_neighbours_meet_once(spark):
    """cells that share several bands and buckets are looked at once."""
    line = lambda block, at, x0: (1, 1, block, at, float(x0), 20.0 * at, float(x0 + 40), 20.0 * at + 12, "x")
    rows = [line(b, at, x) for b, x in ((1, 50), (2, 110), (3, 170)) for at in range(1, 9)] + [(1, 1, 4, 1, 0.0, 0.0, 500.0, 12.0, "one two three four five six")]
    found = stitch.blocks(spark.createDataFrame(rows, "doc_id long, page int, block long, ord int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert sorted((r.a, r.b) for r in stitch.neighbours(found).collect()) == [(1, 2), (2, 3)]
