import random

from pyspark.sql import functions as F

from foliospark.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_clean_markdown(spark):
    dirty = "a b​﻿ \r\nc\t\n\n\n\n![x](data:image/png;base64,AAAA==)\ré  "
    want = "a b\nc\n\n![x](data:image/png;base64,...)\né\n"
    assert one(spark, T.clean_markdown, dirty, "", None) == [want, "", ""]
    assert one(spark, T.clean_markdown, want) == [want]


def test_names(spark):
    assert one(spark, T.slug, " Été à la Mer! ", "!!!", "a" * 70) == ["été-à-la-mer", "section", "a" * 60]
    assert one(spark, T.markdown_filename, "Reports\\Annual Report 2025.pdf", "🙂.docx") == ["annual-report-2025.md", "document.md"]


def test_stems(spark):
    assert one(spark, T.s_stem, "policies", "boxes", "glass", "changes", "gas", "x2s", "dies") == ["policy", "box", "glass", "change", "gas", "x2s", "die"]


def test_line_tests(spark):
    assert one(spark, T.is_page_number, "17", "- 7 -", "Page 3", "3 of 20", "xiv", "Chapter 1") == [True] * 5 + [False]
    assert one(spark, T.open_end, "and then", "The end.", "(closed)", "hyphen-") == [True, False, False, True]


def test_word_levenshtein(spark):
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    rows = [([rng.choice("abcde") for _ in range(rng.randint(0, 12))], [rng.choice("abcde") for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", T.word_levenshtein(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == brute(r.a, r.b) for r in got)
