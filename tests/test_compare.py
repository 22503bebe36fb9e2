from foliospark.operators import compare as C


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_survey_of_nulls_and_numbers(spark):
    pages = spark.createDataFrame([(1, None, 1), (2, "a1 b2 " * 100, 2), (3, "word " * 200, None), (4, "word " * 200, 2)], "page long, text string, columns int")
    assert rows(C.survey(pages), "page", "words", "kind", "reader") == [(1, 0, "near-empty", "default"), (2, 200, "tables", "default"), (3, 200, "single column", "default"), (4, 200, "two-column prose", "heavy")]


def test_paired_counts_sets_and_all(spark):
    scores = spark.createDataFrame([("a", 1, "x", 0.1), ("a", 1, "y", 0.2), ("b", 2, "x", 0.3), ("b", 2, "y", 0.1), ("b", 3, "y", 0.5), ("b", 4, "x", None)], "set string, page long, engine string, cost double")
    assert rows(C.paired(scores, "x"), "engine", "set", "n", "better", "worse", "same") == [("y", "a", 1, 0, 1, 0), ("y", "all", 2, 1, 1, 0), ("y", "b", 1, 1, 0, 0)]


def test_draw_takes_both_parts(spark):
    pages = spark.createDataFrame([(i, "k", i == 0) for i in range(50)] + [(99, "l", None)], "page long, kind string, low boolean")
    got = rows(C.quota_draw(pages, 4, "s"), "kind", "low")
    assert got == [("k", False)] * 3 + [("k", True), ("l", False)]


def test_budget_states(spark):
    files = spark.createDataFrame([(1, 1, 5), (1, 2, 50), (1, 3, 6), (1, 4, None), (2, 1, 10)], "batch long, ord long, size long")
    assert rows(C.admit(files, 10, 10), "batch", "ord", "state") == [(1, 1, "ok"), (1, 2, "too large"), (1, 3, "over budget"), (1, 4, "over budget"), (2, 1, "ok")]


def test_headings_and_fences(spark):
    heads = spark.createDataFrame([(1, i, x) for i, x in enumerate([2, 1, 3, 3, 2, 4, None], 1)], "doc_id long, ord long, level int")
    assert rows(C.heading_parents(heads), "ord", "parent") == [(1, None), (2, None), (3, 2), (4, 2), (5, 2), (6, 5), (7, None)]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "```", "b", "```", None], 1)], "doc_id long, ord long, text string")
    assert rows(C.fence_mask(lines), "ord", "fenced") == [(1, False), (2, True), (3, True), (4, True), (5, False)]


def test_empty_tables(spark):
    scores = spark.createDataFrame([], "set string, page long, engine string, cost double")
    assert C.paired(scores, "x").count() == C.best_reading(scores).count() == C.complete_pages(scores).count() == 0
    assert C.threshold_rules(spark.createDataFrame([], "page long, feature string, value double, delta double, held boolean")).count() == 0


def test_flips_and_languages(spark):
    from pyspark.sql import functions as F

    from foliospark.functions import tokens as K

    pages = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, None)], "page long, share double")
    assert rows(C.flips(pages, F.col("share") > 0.4, F.col("share") > 0.6), "page", "old", "new") == [(2, True, False)]
    listed = spark.createDataFrame([("eng+deu, pol",), (None,)], "x string").select(K.language_codes(F.col("x")).alias("c"), K.decimal_depth(F.col("x")).alias("d"))
    assert [r.c for r in listed.collect()] == [["en", "de", "pol"], ["en"]]
