"""Phrases found by kernels within documents, against rows of words and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import keywords as K, phrases as X, statistical as Y

ODD = [
    (1, "Harbour walls, harbour wall; the walls' harbour-walls\n \t\n\nharbour walls_of 12 34 12 34 ab ab\nHarbour  walls"), (1, "harbour walls 2nd row: Ab cities' cities CITIES classes class"),
    (2, None), (3, ""), (4, "x" * 30 + " " + "x" * 30 + " y'y y’y -y- y- _z _z é É éé ÉÉ éé ½½½ ½½½ ۱۲۳ ۱۲۳"), (None, "no id no id such such id id"), (5, "including walls walls including walls walls"), (6, "a\n\na\nb\n \nb c\r\nc c"),
]


def exploded(docs, top_k):
    """The ranking from rows of phrases."""
    out = {}
    for r in K.ngrams(docs, phrases=True).where((F.col("occurrences") >= 2) & K.usable(F.col("key"))).collect():
        out.setdefault(r.doc_id, []).append((-round(r.occurrences * K.BONUS[r["size"] - 1], 6), r.key, r.occurrences))
    return {d: [(k, -s, n) for s, k, n in sorted(v)[:top_k]] for d, v in out.items()}, {d: len(v) for d, v in out.items()}


def test_frequent_as_from_rows(spark):
    chance = random.Random(3)
    rows = ODD + [(100 + k % 30, " ".join(chance.choice("harbour walls. wall, the of boxes box cities\n\n city-wall 1 22 it's ’tis".split(" ")) for _ in range(chance.randrange(60)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranked, counts = exploded(docs, 7)
    got = {}
    for r in X.frequent(docs, 7, K.MAX_WORDS, K.BONUS, K.BOUNDARY).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.key, r.score, r.occurrences))
    assert got == ranked and len(got) > 20
    assert {r.doc_id: r.n for r in X.candidates(docs, K.MAX_WORDS, K.BOUNDARY).collect()} == counts


def test_slices_of_texts_change_nothing(spark, monkeypatch):
    docs = [["Harbour walls. Harbour walls and Harbour lights"], [], ["one two. one two", "two one"], [""]]
    whole = X._frequencies(X.Laid(docs), 4, 9, 4, K.BONUS, frozenset(K.BOUNDARY))[1], X._statistics(X.Laid(docs), 4, 9, frozenset(K.STOP), 3, 3)
    each = [[x for d in docs for x in f(d)] for f in (lambda d: X._frequencies(X.Laid([d]), 1, 9, 4, K.BONUS, frozenset(K.BOUNDARY))[1], lambda d: X._statistics(X.Laid([d]), 1, 9, frozenset(K.STOP), 3, 3))]
    assert list(whole) == each and whole[0][1] == [] and whole[0][2] and whole[1][2]


@pytest.mark.parametrize("name", ["candidate_filter", "statistical_keywords"])
def test_no_row_for_a_phrase(spark, name):
    """Texts are the only rows that are dealt, and no phrase or word is a row before it is ranked (F3, F5)."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "ArrowEvalPython" in plan
    assert plan.count("Generate ") == (name != "candidate_filter") and "Window" not in plan and "Join" not in plan


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_near_is_edit_distance():
    chance = random.Random(5)
    for _ in range(3000):
        a = "".join(chance.choice("ab c") for _ in range(chance.randrange(12)))
        b = "".join(chance.choice([c, c, c, "a", "", c + "b"]) for c in a)
        for most in range(6):
            assert X._near(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_phrases_alike_make_room_for_all_others(spark):
    """Of two hundred phrases that are alike one is kept, and those that come after them are all looked at (F10)."""
    alike = [f"abcdefghijklmnopqrstuvw{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    others = [chr(97 + k) * 5 for k in range(12)]
    text = ". ".join(w.upper() for w in alike) + ". " + ". ".join(others)
    keys = [r.key for r in Y.statistical(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10).orderBy("rank").collect()]
    assert len(keys) == 10 and sum(k in alike for k in keys) == 1
    assert all(1 - distance(a, b) / max(len(a), len(b)) < 0.9 for i, a in enumerate(keys) for b in keys[:i])


def test_fused_as_from_two_rankings(spark):
    """Fusion within a document's row gives what the fusion of two tables of ranks gives (F2)."""
    chance = random.Random(9)
    rows = [(k % 25, " ".join(chance.choice("Harbour walls. Wall, the of Boxes box. cities\n City-Wall O’Neill's including Überseehafen 22 NASA lights reports".split(" ")) for _ in range(chance.randrange(80)))) for k in range(30)] + [(90, None), (91, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = K.fuse({"frequency": K.frequency(docs, 12).select("doc_id", "key", "rank"), "statistical": Y.canonical(Y.statistical(docs, 12))}, 9)
    got = X.fused(docs, 9, 12, K.MIN_TEXT, K.MAX_WORDS, K.BONUS, K.BOUNDARY, K.STOP, Y.LEAST, Y.SIZES, K.RRF_K, whole=False)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() > 150


@pytest.mark.parametrize("name", ["fused_keywords", "keyword_fusion"])
def test_fusion_deals_texts_once(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") and "Window" not in plan, plan


def test_fusion_has_both_methods_and_drops_what_is_within(spark, tmp_path):
    """A phrase that is said once has the vote of the statistics alone; a word that is only said within a longer key goes before
    the list is cut; each ranking is deeper than forty (F9)."""
    from foliospark.plans import queries as plans

    once = "Zanzibar Quarry"
    text = " ".join(f"the {w} mill of {w}." for w in (f"{chr(97 + k)}{chr(98 + k // 2)}orrel" for k in range(24))) + " the copper kettle rang and a copper kettle fell. " + once + "."
    spark.createDataFrame([(1, text), (2, "copper kettle copper kettle")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = plans.QUERIES["keyword_fusion"](spark, str(tmp_path)).collect()
    keys = {r.key: r for r in rows}
    assert {r.doc_id for r in rows} == {1} and len(rows) == 20
    assert [r.agreement for r in rows].count(2) > 10 and keys["mill"].score == 1
    deep = X.fused(spark.read.parquet(str(tmp_path / "documents.parquet")), 200, 200, 1, K.MAX_WORDS, K.BONUS, K.BOUNDARY, K.STOP, Y.LEAST, Y.SIZES, K.RRF_K, whole=True).where("doc_id = 1").collect()
    found = {r.key: r.agreement for r in deep}
    assert found["zanzibar quarry"] == 1 and found["copper kettle"] == 2
    n = {"copper kettle": 2, "copper": 2, "kettle": 3, "mill": 0}
    assert [k for _, k, _ in X._alone([(4.0, "copper kettle", 2), (3.0, "copper", 2), (2.0, "kettle", 1), (1.0, "mill", 1)], n.get, 3)] == ["copper kettle", "kettle", "mill"]
