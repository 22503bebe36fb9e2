import random

from pyspark.sql import functions as F

from foliospark.operators import align as A, chapters as C


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_align_is_a_cheapest_path():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.choices("abc", k=rng.randrange(9)) for _ in "ab")
        path = A.align(a, b)
        assert [x for x, _ in path if x is not None] == a and [y for _, y in path if y is not None] == b
        assert sum(x != y for x, y in path) == distance(a, b)


def test_vote():
    assert A.vote("a b c".split(), "a x c".split(), "a x c".split()) == "a x c".split()
    assert A.vote("a b c".split(), "a c".split(), "a c".split()) == ["a", "c"]
    assert A.vote("a c".split(), "a b c".split(), "a b d".split()) == ["a", "b", "c"]
    assert A.vote("a b".split(), "a x".split(), "a y".split()) == ["a", "b"]
    assert A.vote([], [], []) == []


def test_tree_distance():
    leaf = lambda x: (x, [])
    a = ("f", [("d", [leaf("a"), ("c", [leaf("b")])]), leaf("e")])
    b = ("f", [("c", [("d", [leaf("a"), leaf("b")])]), leaf("e")])
    assert A.tree_distance(a, b) == 2 and A.tree_distance(a, a) == 0
    assert A.tree_similarity(leaf("a"), leaf("b")) == 0 and abs(A.tree_similarity(a, b) - 2 / 3) < 1e-9


def test_order_error():
    assert A.order_error([0, 1, 2]) == 0 and A.order_error([]) == 0
    assert A.order_error([2, 0, 1]) == 1 - 2 / 3


def test_word_errors_and_votes(spark):
    pairs = spark.createDataFrame([(1, ["a", "b"], ["a", "c", "d"]), (2, None, ["x"]), (3, [], [])], "id long, r array<string>, o array<string>")
    got = {(r.id, r.kind) for r in A.word_errors(pairs, "id", "r", "o").collect()}
    assert got == {(1, "sub"), (1, "ins"), (2, "ins")}
    assert {r.id: r.text for r in A.vote_texts(pairs, "id", ("r", "o", "o")).collect()} == {1: "a c d", 2: "x", 3: ""}


def test_chapters(spark):
    body = "Moss grows on the north side of the old stone walls. " * 5
    by_heading = f"# Book\n\nshort\n\n## Chapter 1: Moss\n{body}\n```\n## no heading\n```\n## Chapter 2: Fern\n{body}"
    by_marker = f"{body}\nChapter I\n{body}\nChapter II\n{body}\n"
    docs = spark.createDataFrame([(1, by_heading), (2, by_marker), (3, "no chapters"), (4, None), (5, "## a\nx\n## b\ny")], "doc_id long, text string")
    rows = C.chapters(docs).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.ord, r.level, r.name) for r in rows] == [(1, 1, 1, "01-moss.md"), (1, 2, 1, "02-fern.md"), (2, 0, 0, "00-front-matter.md"), (2, 1, 1, "01-chapter-i.md"), (2, 2, 1, "02-chapter-ii.md")]
    for k, text in ((1, by_heading), (2, by_marker)):
        assert "\n".join(r.text for r in rows if r.doc_id == k) == text


def test_contents_entries(spark):
    given = ["| Moss | 12 |", "## Fern", "  - 1.2 Lichens .... 30", "[Bark](#bark)", "Roots . . . . . 7", "Leaves 9", "plain text here"]
    rows = spark.createDataFrame([(x,) for x in given], "x string").select(C.contents_entry(F.col("x")).alias("e")).collect()
    got = [r.e and (r.e.form, r.e.title, r.e.page, r.e.depth) for r in rows]
    assert got == [("row", "Moss", "12", 0), ("heading", "Fern", None, 0), ("list", "1.2 Lichens", "30", 1), ("link", "Bark", None, 0), ("leader", "Roots", "7", 0), ("loose", "Leaves", "9", 0), None]
