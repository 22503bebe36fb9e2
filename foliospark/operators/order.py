"""Line order of a reading against its reference: lines are placed by votes of their trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

LEAST, WORDS = 2, 3


def _trigrams(words: Column) -> Column:
    def of(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= WORDS, F.sequence(F.lit(0), F.size(ws) - WORDS)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, WORDS), " "))

    return T.let(words, of)  # a text's words are taken once, not for every trigram


def line_places(pairs: DataFrame) -> DataFrame:
    """(id, line, start): where each reference line of three words is in the output, by the start that most of its
    trigrams vote for (of equal ones the first), if that is half of them.

    ``pairs``: id, reference, output (texts). Votes are counted where a trigram of one side meets its like of the other, by
    equality of (id, trigram).
    """
    lines = pairs.select("id", F.posexplode(F.split("reference", "\n")).alias("line", "text")).select("id", "line", _trigrams(T.plain_words(F.col("text"))).alias("grams"))
    lines = lines.where(F.size("grams") > 0).select("id", "line", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "gram"))
    index = pairs.select("id", F.posexplode(_trigrams(T.plain_words(F.col("output")))).alias("pos", "gram"))
    votes = lines.join(index, ["id", "gram"]).groupBy("id", "line", "n", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("id", "line", "n").agg(F.min(F.struct((-F.col("votes")).alias("votes"), "start")).alias("best"))
    return best.where(-F.col("best.votes") * 2 >= F.col("n")).select("id", "line", F.col("best.start").alias("start"))


def line_order_errors(pairs: DataFrame) -> DataFrame:
    """(id, located, order_error): the edit distance between the located lines in the reference's and in the output's
    order, over their number; null where fewer than two are located."""
    placed = line_places(pairs)
    order = lambda *by: F.transform(F.sort_array(F.collect_list(F.struct(*by))), lambda x: x["line"].cast("string"))
    found = placed.groupBy("id").agg(F.count("*").alias("located"), order("line").alias("wanted"), order("start", "line").alias("got"))
    error = F.when(F.col("located") >= LEAST, T.word_levenshtein(F.col("wanted"), F.col("got")) / F.col("located"))
    return pairs.select("id").join(found, "id", "left").select("id", F.coalesce("located", F.lit(0)).cast("long").alias("located"), error.alias("order_error"))
