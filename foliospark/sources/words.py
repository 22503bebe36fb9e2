"""Recognised words: the tab-separated scan of a recogniser, its lines, and what decides whether a page needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def scan_words(spark: SparkSession, path: str) -> DataFrame:
    """Words (page, block, par, line, word, text, box) of tab-separated files; rows of other levels and blanks go."""
    raw = spark.read.schema(SCHEMA).csv(path, sep="\t", quote="", header=True).where("level = 5 AND trim(text) <> ''")
    box = F.struct(F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    return raw.select(F.col("page_num").alias("page"), F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line"), F.col("word_num").alias("word"), "text", box.alias("box"))


def word_lines(words: DataFrame) -> DataFrame:
    """Lines (page, block, par, line, text, box): words joined in order, the union of their boxes."""
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    box = F.struct(F.min("box.x0").alias("x0"), F.min("box.y0").alias("y0"), F.max("box.x1").alias("x1"), F.max("box.y1").alias("y1"))
    return words.groupBy("page", "block", "par", "line").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), box.alias("box"))


def needs_recognition(text: Column, invisible_share: Column, image_share: Column, mode: str = "auto") -> Column:
    """Whether a page is to be recognised: fewer than 16 characters of text, or only invisible glyphs over an image of
    nine tenths of the page. ``mode`` is auto, force or off."""
    if mode not in ("auto", "force", "off"):
        raise ValueError(f"unknown mode {mode!r}: auto, force or off")
    if mode != "auto":
        return F.lit(mode == "force")
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) < 16) | (F.coalesce(invisible_share >= 1, F.lit(False)) & F.coalesce(image_share >= 0.9, F.lit(False)))
