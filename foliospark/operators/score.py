"""Accuracy scores: multiset overlap, word error rate, paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import plain_words, word_levenshtein


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(plain_words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def overlap(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """(key, hit, wanted, given): sizes of the multiset intersection of words and of both sides."""
    a = word_counts(pairs, key, reference).withColumnRenamed("n", "a")
    b = word_counts(pairs, key, output).withColumnRenamed("n", "b")
    both = a.join(b, [key, "word"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.groupBy(key).agg(F.sum(F.least(zero("a"), zero("b"))).alias("hit"), F.sum(zero("a")).alias("wanted"), F.sum(zero("b")).alias("given"))


def word_error_rate(reference: Column, output: Column) -> Column:
    a, b = plain_words(reference), plain_words(output)
    return word_levenshtein(a, b) / F.nullif(F.size(a).cast("double"), F.lit(0.0))


def lost_words(pairs: DataFrame, key: str, reference: str, output: str) -> DataFrame:
    """(key, word, n): words of the reference that the output lacks, with how many copies."""
    a, b = word_counts(pairs, key, reference), word_counts(pairs, key, output).withColumnRenamed("n", "m")
    left = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(b, [key, "word"], "left").select(key, "word", left.alias("n")).where("n > 0")
