"""Gold files: Markdown whose blocks carry annotations, read into blocks with error rows; emphasised tokens and their scores."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..operators.placement import align_tokens
from ..operators.structure import block_type, blocks, split_blocks

# The types and relations that an annotation may name, and what is markup.
TYPES = "heading table list paragraph code figure rule title caption footnote page_number page_header page_footer equation list_item text".split()
RELATIONS = ("caption_of", "continues_from", "continues_table", "footnote_for")
PAGE, NOTE = r"^<!--\s*page\s+(\d+)\s*-->$", r"(?s)^<!--(.*?)-->[ \t]*(?:\n|$)"
_BLANKED = (r"(?s)<!--.*?-->", r"!\[[^\]]*\]\([^)]*\)", r"\]\([^)]*\)", r"\\[a-zA-Z]+")
_TAGGED, _TAG = r"(?si)<(b|strong|i|em)\b[^>]*>(.*?)</\1>", r"</?[A-Za-z][^<>\n]*>"
_SIGNED = (r"(?s)(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"(?<![*\w])([*_])(?=[^\s*_|])([^*_|\n]+?)(?<=[^\s*_|])\1(?![*\w])")
_TOKEN = re.compile(r"[^\W_]+")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, text) of the Markdown files below a path; ids are digests of the names. An empty file has no row."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return found.select(F.xxhash64("name").alias("doc_id"), "name", "text")


def gold_blocks(files: DataFrame) -> DataFrame:
    """(doc_id, ord, page, type, level, id, relations, text, error) of the blocks of files (doc_id, text).

    A page mark on its own holds for the blocks after it. A leading annotation names a block's type, id and relations; else its
    Markdown shows the type. A word that is no type, an unknown relation, or one whose target names no block of the file is an
    error of its row, the first of these in that order.
    """
    each = split_blocks(files).withColumn("block", F.regexp_replace("block", r"^\n+|\n+$", ""))
    mark = F.regexp_extract(F.trim(F.col("block")), PAGE, 1)
    each = each.withColumn("page", F.last(F.nullif(mark, F.lit("")).cast("int"), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord"))).where(mark == "")
    words = F.filter(F.split(F.regexp_extract("block", NOTE, 1), r"\s+"), lambda w: w != "")
    each = each.withColumn("words", words).withColumn("text", F.regexp_replace("block", NOTE, ""))
    pairs = F.map_from_entries(F.transform(F.filter("words", lambda w: F.contains(w, F.lit("="))), lambda w: F.struct(F.substring_index(w, "=", 1), F.regexp_replace(w, r"^[^=]*=", ""))))
    bare = F.filter("words", lambda w: ~F.contains(w, F.lit("=")))
    each = each.withColumns({"pairs": pairs, "bare": bare})
    kind = F.get(F.reverse(F.filter("bare", lambda w: w.isin(TYPES))), F.lit(0))
    shown = F.when(F.trim("text") == "", "figure").when(F.lower(F.ltrim("text")).startswith("<table"), "table").otherwise(block_type(F.col("text")))
    each = each.withColumn("type", F.coalesce(kind, shown)).withColumn("id", F.coalesce(F.try_element_at("pairs", F.lit("id")), F.lit("")))
    each = each.withColumn("relations", F.map_filter("pairs", lambda k, _: k != "id"))
    level = F.when(F.col("type") == "heading", F.nullif(F.length(F.regexp_extract("text", r"^ {0,3}(#{1,6})[ \t]", 1)), F.lit(0)))
    targets = each.select("doc_id", "ord", F.explode(F.map_values("relations")).alias("target")).join(each.where("id <> ''").select("doc_id", F.col("id").alias("target")).distinct(), ["doc_id", "target"], "left_anti").groupBy("doc_id", "ord").agg(F.min("target").alias("lost"))
    each = each.join(targets, ["doc_id", "ord"], "left")
    wrong = F.get(F.filter("bare", lambda w: ~w.isin(TYPES)), F.lit(0))
    odd = F.get(F.array_sort(F.filter(F.map_keys("relations"), lambda k: ~k.isin(*RELATIONS))), F.lit(0))
    error = F.when(wrong.isNotNull(), F.concat(F.lit("unknown annotation "), wrong)).when(odd.isNotNull(), F.concat(F.lit("unknown relation "), odd)).when(F.col("lost").isNotNull(), F.concat("lost", F.lit(" names no block")))
    return each.select("doc_id", "ord", "page", "type", level.alias("level"), "id", "relations", "text", error.alias("error"))


def gold_text(found: DataFrame) -> DataFrame:
    """(doc_id, text): blocks (doc_id, ord, page, type, id, relations, text) as gold files, which ``gold_blocks`` reads back."""
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("ord"))
    mark = F.when(F.col("page").isNotNull() & ~F.col("page").eqNullSafe(before), F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->\n\n"))).otherwise("")
    own = F.when(F.col("id") != "", F.array(F.concat(F.lit("id="), "id"))).otherwise(F.array().cast("array<string>"))
    links = F.transform(F.array_sort(F.map_entries("relations")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    note = F.concat(F.lit("<!-- "), F.array_join(F.concat(F.array("type"), own, links), " "), F.lit(" -->"))
    block = F.concat(mark, note, F.when(F.trim("text") == "", "").otherwise(F.concat(F.lit("\n"), "text")))
    made = found.withColumn("block", block).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "block"))).alias("all"))
    return made.select("doc_id", F.concat(F.array_join("all.block", "\n\n"), F.lit("\n")).alias("text"))


def tokens_of(markdown: str) -> list[tuple[str, bool]]:
    """The printed tokens of Markdown in lower case, each with whether it is bold or italic. Markup is blanked in place, so
    places in the text stay what they are."""
    blank = lambda m: " " * len(m[0])
    for pattern in _BLANKED:
        markdown = re.sub(pattern, blank, markdown)
    spans = [m.span(2) for m in re.finditer(_TAGGED, markdown)]
    markdown = re.sub(_TAG, blank, markdown)
    spans += [m.span(2) for pattern in _SIGNED for m in re.finditer(pattern, markdown)]
    marked = bytearray(len(markdown))
    for a, b in spans:
        marked[a:b] = b"\x01" * (b - a)
    return [(t, bool(marked[m.start()])) for m in _TOKEN.finditer(markdown) for t in _TOKEN.findall(unicodedata.normalize("NFKC", m[0]).lower())]


@F.pandas_udf(ArrayType(StructType([StructField("token", StringType()), StructField("emphasised", BooleanType())])))
def _tokens(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"token": w, "emphasised": e} for w, e in tokens_of(t)] for t in text], dtype=object)


def emphasis_tokens(markdown: Column) -> Column:
    return _tokens(markdown)


@F.pandas_udf(StructType([StructField(n, LongType()) for n in ("aligned", "gold", "output", "both")]))
def _emphasis(gold: pd.Series, output: pd.Series) -> pd.DataFrame:
    def one(a: str, b: str) -> tuple[int, int, int, int]:
        wanted = [(w, e, bool(re.match(r" {0,3}#{1,6}\s", x))) for x in blocks(a) for w, e in tokens_of(x)]
        got = tokens_of(b or "")
        partner = align_tokens([w for w, _, _ in wanted], [w for w, _ in got])
        # an output's token outside its headings that met a heading is given back to a text that has no partner
        rest = [i for i, j in enumerate(partner) if j < 0 and not wanted[i][2]]
        titled = [bool(re.match(r" {0,3}#{1,6}\s", x)) for x in blocks(b) for _ in tokens_of(x)] if rest else []
        spare = sorted(j for i, j in enumerate(partner) if j >= 0 and wanted[i][2] and not (len(titled) == len(got) and titled[j]))
        if rest and spare:
            for k, j in enumerate(align_tokens([wanted[i][0] for i in rest], [got[j][0] for j in spare])):
                if j >= 0:
                    partner[rest[k]] = spare[j]
        met = [(wanted[i][1], got[j][1]) for i, j in enumerate(partner) if j >= 0 and not wanted[i][2]]
        return len(met), sum(x for x, _ in met), sum(y for _, y in met), sum(x and y for x, y in met)

    return pd.DataFrame([one(a or "", b or "") for a, b in zip(gold, output, strict=True)], columns=["aligned", "gold", "output", "both"], dtype="int64")


def emphasis_scores(pairs: DataFrame) -> DataFrame:
    """(id, aligned, gold, output, both, recall, precision) of pairs (id, gold, output: Markdown): of the tokens that both
    have, outside the gold's headings, those that are bold or italic in one and in both. No share of none is null."""
    met = pairs.select("id", _emphasis("gold", "output").alias("e")).select("id", "e.*")
    return met.withColumns({"recall": F.round(F.try_divide("both", "gold"), 6), "precision": F.round(F.try_divide("both", "output"), 6)})
