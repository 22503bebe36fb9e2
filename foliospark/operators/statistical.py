"""Keywords by the statistics of their terms within one document: case, position, frequency, contexts, spread.

After the published YAKE method (Campos et al., 2020). Phrases are runs of up to three words without a stop word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import s_stem
from . import phrases as X
from .keywords import STOP, by_document

#: Where a sentence ends, and what no phrase crosses.
SENTENCE, CROSSED, WORD = r"[.!?]+\s+|\n+", r"[^\p{L}\p{N}'’\- ]+", r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
SIZES, LEAST = 3, 3


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sentence, chunk, at, word, low, left, right, stop): the words of each text with their neighbours in a chunk,
    which is what stands between two signs. ``row`` tells rows of ``docs`` apart."""
    each = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    each = each.select("doc_id", "row", F.posexplode_outer(F.split("text", SENTENCE)).alias("sentence", "s"))
    each = each.select("doc_id", "row", "sentence", F.posexplode_outer(F.split("s", CROSSED)).alias("chunk", "c"))
    each = each.select("doc_id", "row", "sentence", "chunk", F.regexp_extract_all("c", F.lit(WORD), F.lit(0)).alias("ws")).where(F.size("ws") > 0)
    low = each.withColumn("lows", F.transform("ws", F.lower))
    near = low.select("doc_id", "row", "sentence", "chunk", "lows", F.posexplode("ws").alias("at", "word"))
    own = F.get("lows", F.col("at"))
    stop = own.isin(STOP) | (F.length(own) < LEAST)
    return near.select("doc_id", "row", "sentence", "chunk", "at", "word", own.alias("low"), F.get("lows", F.col("at") - 1).alias("left"), F.get("lows", F.col("at") + 1).alias("right"), stop.alias("stop"))


def term_features(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, case, position, frequency, context, spread, h) of each term that is no stop word; a low h is a
    significant term.

    case: how often it is written in capitals, or with one inside a sentence; position: the median sentence; frequency:
    over the mean and deviation of terms; context: how many different neighbours it has; spread: the share of sentences.
    """
    docs = by_document(docs.select("doc_id", "text"))
    t = tokens(docs)
    word = F.col("word")
    acronym = (F.length(word) > 1) & (F.upper(word) == word) & word.rlike(r"\p{L}")
    capital = ~acronym & word.rlike(r"^\p{Lu}") & ~((F.col("chunk") == 0) & (F.col("at") == 0))
    different = lambda c: F.coalesce(F.size(F.collect_set(c)) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0))
    of = t.groupBy("doc_id", F.col("low").alias("term"), "stop").agg(
        F.count("*").alias("tf"), F.greatest(F.count_if(acronym), F.count_if(capital)).alias("caps"), F.percentile("sentence", 0.5).alias("middle"),
        F.size(F.collect_set("sentence")).alias("sentences"), (different("left") + different("right")).alias("contexts"),
    )
    said = F.filter(F.transform(F.split("text", SENTENCE), lambda s, i: F.when(s.rlike(r"[\p{L}\p{N}]"), i)), lambda i: i.isNotNull())
    ends = docs.select("doc_id", F.explode(said).alias("sentence")).groupBy("doc_id").agg(F.count_distinct("sentence").alias("all"))
    w, own = Window.partitionBy("doc_id"), F.when(~F.col("stop"), F.col("tf"))
    of = of.withColumns({"usual": F.avg(own).over(w) + F.stddev_pop(own).over(w), "most": F.max("tf").over(w)})
    x = of.where("NOT stop").join(ends, "doc_id")
    x = x.withColumns({"case": F.col("caps") / (1 + F.log("tf")), "position": F.log(F.log(3 + F.col("middle"))), "frequency": F.col("tf") / F.col("usual"), "context": 1 + F.col("contexts") * F.col("tf") / F.col("most"), "spread": F.col("sentences") / F.col("all")})
    h = F.col("position") * F.col("context") / (F.col("case") + F.col("frequency") / F.col("context") + F.col("spread") / F.col("context"))
    return x.select("doc_id", "term", "tf", "case", "position", "frequency", "context", "spread", h.alias("h"))


def statistical(docs: DataFrame, top_k: int = 20) -> DataFrame:
    """(doc_id, rank, key, score): the phrases with the lowest scores, less those that are nine tenths alike to a better one.

    A phrase's score is the product of its terms' h over its frequency and one more than their sum. Numbers alone make no
    phrase. Rows share a doc_id only if their texts are one document; no phrase crosses rows, and a null text has none.
    """
    return X.significant(docs, top_k, STOP, LEAST, SIZES)


def canonical(ranked: DataFrame) -> DataFrame:
    """Rankings with keys of stems, as frequency has them; of keys that become one, the best."""
    stems = F.array_join(F.transform(F.split("key", " "), s_stem), " ")
    return ranked.select("doc_id", stems.alias("key"), "rank").groupBy("doc_id", "key").agg(F.min("rank").alias("rank"))
