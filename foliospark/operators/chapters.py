"""Chapters: a document's lines cut at headings or marker lines, losslessly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

#: A line that names a division and its number.
MARKER = r"(?i)^\s*[*_]{0,3}(chapter|part|book|section|chapitre|kapitel|cap[ií]tulo)\s+([0-9]{1,3}|[ivxlc]{1,7})\b"
MIN_FRONT, MIN_LENGTH, MIN_CHAPTERS, MAX_CHAPTERS, MARKED = 100, 200, 2, 500, 0.6


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, fenced): the lines of each text; fences and what they hold are fenced."""
    each = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "text"))
    fence = F.col("text").rlike("^ {0,3}(`{3,}|~{3,})")
    upto = F.sum(fence.cast("int")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("fenced", fence | (upto % 2 == 1))


def title_line(text: Column) -> Column:
    """A short line that is bold throughout, names a division, or has three letters and no lower case."""
    t = F.trim(text)
    return (F.length(t) <= 120) & (t.rlike(r"^(\*\*[^*]+\*\*|__[^_]+__)$") | t.rlike(MARKER) | (t.rlike(r"(\p{L}[^\p{L}]*){3}") & (F.upper(t) == t)))


def without_number(title: Column) -> Column:
    """The title without the first of: a division's name and number, a decimal number, a roman number or letter."""
    out = F.lit(None)
    for pattern in (MARKER + r"\s*[.:)–—-]*\s*", r"^\s*[0-9]+(\.[0-9]+)*[.)]?\s+", r"^\s*([IVXLC]+|[A-Z])[.)]\s+"):
        cut = F.regexp_replace(title, pattern, "")
        out = F.coalesce(out, F.when((cut != title) & (cut != ""), cut))
    return F.coalesce(out, title)


def contents_entry(line: Column) -> Column:
    """struct(form, title, page, depth) of a line of a contents page; form is null for what is no entry.

    Forms in order: table row, heading, list item, link, dot leaders with a page, loose (a title and a page). Depth is
    the larger of the indent in steps of two blanks and the dots of the leading number.
    """
    strict = [
        ("row", r"^\s*\|\s*([^|]*\S)\s*\|\s*([0-9]{1,4}|[ivxlc]{1,7})\s*\|\s*$"), ("heading", r"^ {0,3}#{1,6}\s+(.*\S)()\s*$"),
        ("list", r"^\s*(?:[-*+]|[0-9]{1,3}[.)])\s+(.*?)(?:[ .…]+([0-9]{1,4}))?\s*$"), ("link", r"^\s*\[([^\]]+)\]\([^)]*\)()\s*$"),
        ("leader", r"^\s*(.*?\S)\s*(?:\.\s?){3,}\s*([0-9]{1,4}|[ivxlc]{1,7})\s*$"), ("loose", r"^\s*(\S.*?)\s+([0-9]{1,4})\s*$"),
    ]
    indent = F.length(F.regexp_extract(line, r"^( *)", 1)) / 2
    made = F.lit(None).cast("struct<form:string,title:string,page:string,depth:int>")
    for form, pattern in reversed(strict):
        title = F.regexp_replace(F.regexp_extract(line, pattern, 1), r"^\[([^\]]*)\]\([^)]*\)", "$1")
        number = F.regexp_extract(title, r"^([0-9]+(?:\.[0-9]+)*)", 1)
        depth = F.greatest(F.floor(indent), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))).cast("int")
        made = F.when(line.rlike(pattern), F.struct(F.lit(form).alias("form"), title.alias("title"), F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")).alias("page"), depth.alias("depth"))).otherwise(made)
    return made


def chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, level, title, name, text): the chapters of each text by the first way that gives plausible ones.

    By headings: the shallowest level with two of them, levels of which most are marked before others. By marker
    lines: at least two that are no headings. What precedes the first is front matter (level 0) if it has 100
    characters, else part of the first chapter. Plausible are 2 to 500 chapters whose upper median has 200 characters;
    a text without plausible chapters gives no rows. The texts of a document's chapters, joined by line feeds, are it.
    """
    l = lines(docs)
    head = F.regexp_extract("text", r"^ {0,3}(#{1,6})[ \t]+\S", 1)
    l = l.withColumn("level", F.when(~F.col("fenced") & (head != ""), F.length(head)))
    l = l.withColumn("title", F.trim(F.when(F.col("level").isNull(), F.col("text")).otherwise(F.regexp_replace("text", r"^ {0,3}#{1,6}[ \t]+|[ \t]+#*[ \t]*$", ""))))
    l = l.withColumn("marked", F.col("title").rlike(MARKER) & ~F.col("fenced"))
    levels = l.where("level IS NOT NULL").groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.count_if("marked").alias("m")).where("n >= 2")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy((F.col("m") < MARKED * F.col("n")).cast("int"), "level"))
    by_heading = levels.withColumn("k", first).where("k = 1").select("doc_id", F.lit(1).alias("way"), F.col("level").alias("at"))
    by_marker = l.where("marked AND level IS NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id", F.lit(2).alias("way"), F.lit(None).cast("int").alias("at"))
    own = l.join(by_heading.union(by_marker), "doc_id")
    starts = F.when(F.col("way") == 1, F.coalesce(F.col("level") == F.col("at"), F.lit(False))).otherwise(F.col("marked") & F.col("level").isNull())
    by_line = Window.partitionBy("doc_id", "way").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("start", starts).withColumn("island", F.sum(F.col("start").cast("int")).over(by_line))
    front = F.sum(F.when(F.col("island") == 0, F.length("text") + 1).otherwise(0)).over(Window.partitionBy("doc_id", "way"))
    own = own.withColumn("ord", F.when(front <= MIN_FRONT, F.greatest("island", F.lit(1))).otherwise(F.col("island")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    made = own.groupBy("doc_id", "way", "ord").agg(text.alias("text"), F.max(F.when(F.col("start"), F.col("title"))).alias("title"))
    every = Window.partitionBy("doc_id", "way")
    lengths = F.sort_array(F.collect_list(F.when(F.col("ord") > 0, F.length("text"))).over(every))
    made = made.withColumn("n", F.size(lengths)).withColumn("mid", F.element_at(lengths, (F.floor(F.size(lengths) / 2) + 1).cast("int")))
    made = made.where((F.col("n") >= MIN_CHAPTERS) & (F.col("n") <= MAX_CHAPTERS) & (F.col("mid") >= MIN_LENGTH))
    made = made.withColumn("best", F.min("way").over(Window.partitionBy("doc_id"))).where("way = best")
    title = F.coalesce("title", F.lit("Front matter"))
    name = F.concat(F.lpad(F.col("ord").cast("string"), F.greatest(F.lit(2), F.length(F.col("ord").cast("string"))), F.lit("0")), F.lit("-"), T.slug(without_number(title)), F.lit(".md"))
    return made.select("doc_id", F.col("ord").cast("long").alias("ord"), F.when(F.col("ord") == 0, 0).otherwise(1).alias("level"), title.alias("title"), name.alias("name"), "text")
