"""Gold files: round trips, annotations, error rows; tokens with their emphasis."""

import pytest

from foliospark.sources import gold as G

FILE = """<!-- page 3 -->

<!-- heading id=h1 -->
## Of mosses

Plain words
over lines.

<!-- page 4 -->

| a | b |
|---|---|

<!-- caption id=c1 caption_of=h1 continues_from=c1 -->
Table 1

<!-- figure id=f -->

<!-- odd -->
x

<!-- text of=h1 -->
y

<!-- footnote footnote_for=none -->
z

```
a fence

<!-- page 9 -->
```
"""


def test_gold_blocks(spark, tmp_path):
    (tmp_path / "one.md").write_text(FILE)
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "other.txt").write_text("no gold")
    files = G.read_gold(spark, str(tmp_path))
    assert [r.name for r in files.collect()] == ["one.md"]
    rows = sorted(G.gold_blocks(files).collect(), key=lambda r: r.ord)
    got = [(r.page, r.type, r.level, r.id, r.relations, r.text, r.error) for r in rows]
    assert got == [
        (3, "heading", 2, "h1", {}, "## Of mosses", None), (3, "paragraph", None, "", {}, "Plain words\nover lines.", None), (4, "table", None, "", {}, "| a | b |\n|---|---|", None),
        (4, "caption", None, "c1", {"caption_of": "h1", "continues_from": "c1"}, "Table 1", None), (4, "figure", None, "f", {}, "", None), (4, "paragraph", None, "", {}, "x", "unknown annotation odd"),
        (4, "text", None, "", {"of": "h1"}, "y", "unknown relation of"), (4, "footnote", None, "", {"footnote_for": "none"}, "z", "none names no block"), (4, "code", None, "", {}, "```\na fence\n\n<!-- page 9 -->\n```", None),
    ]
    sound = G.gold_blocks(files).where("error IS NULL")
    again = G.gold_blocks(G.gold_text(sound))
    key = lambda df: [(r.page, r.type, r.level, r.id, r.relations, r.text, r.error) for r in sorted(df.collect(), key=lambda r: r.ord)]
    assert key(again) == [g for g in got if g[-1] is None]


@pytest.mark.parametrize(("text", "want"), [
    ("a **b c** d", "a B C d"), ("*x* _y_ snake_case_word 2*3*4", "X Y snake case word 2 3 4"), ("<b>One <i>two</i></b> <sup>3</sup>", "ONE TWO 3"), ("[link *it*](http://a.b/c) ![pic](x.png)", "link IT"),
    ("\\alpha **x", "x"), ("<!-- **no** --> __yes__", "YES"), ("ﬁne **Ⅳ**", "fine IV"), ("", ""),
])
def test_tokens(text, want):
    assert " ".join(t.upper() if e else t for t, e in G.tokens_of(text)) == want


def test_emphasis_scores(spark):
    rows = [("a", "# **H** one\n\n**two three** four *five*", "H one two **three** **four** *five*"), ("none", "x y", "x y"), ("null", None, "x"), ("apart", "**a b c**\n\nd e f", "d e f\n\na **b** c")]
    got = {r.id: tuple(r)[1:] for r in G.emphasis_scores(spark.createDataFrame(rows, "id string, gold string, output string")).collect()}
    assert got == {"a": (4, 3, 3, 2, 0.666667, 0.666667), "none": (2, 0, 0, 0, None, None), "null": (0, 0, 0, 0, None, None), "apart": (6, 3, 1, 1, 0.333333, 1.0)}
    tokens = spark.createDataFrame([("a **b**",), (None,)], "t string").select(G.emphasis_tokens(G.F.col("t")).alias("x")).collect()
    assert [[tuple(y) for y in r.x] if r.x else None for r in tokens] == [[("a", False), ("b", True)], None]


def test_emphasis_of_a_word_that_is_in_the_heading_too(spark):
    from foliospark.sources import gold as G

    rows = [(1, "# A heading\n\n**A**", "<em>A</em>."), (2, "# A heading\n\n**B**", "# A heading\n\nC"), (3, "# A heading\n\n**A**", "# A heading")]
    got = {r.id: (r.aligned, r.gold, r.output, r.both) for r in G.emphasis_scores(spark.createDataFrame(rows, "id int, gold string, output string")).collect()}
    assert got == {1: (1, 1, 1, 1), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}
