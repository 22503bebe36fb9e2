"""Elements of a document as Markdown and JSON, and the relations among them.

An element is a row (doc_id, page, ord, type, text, text_format, level, level_signal, role_signal, signal, rows, asset); a relation is a row
(doc_id, type, source, target) between the ids of elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .layout import write_table

FURNITURE = ("page_header", "page_footer", "page_number")


def plain_text(text: Column, text_format: Column) -> Column:
    """An element's words: of Markdown without tags, heading marks and emphasis."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"(?m)^#{1,6}\s+", ""), r"\*+|_{2,}", "")
    return F.trim(F.when(text_format == "markdown", bare).otherwise(text))


def rows_text(rows: Column) -> Column:
    """Cells joined by a space, rows by a line break."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " ")), "\n")


def _one_line(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""), " ")


def heading_words(text: Column, text_format: Column) -> Column:
    """A heading's or caption's words on one line, without the marks that its Markdown starts with."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\n+", ""), r"^ {0,3}#{1,6}(?:[ \t]+|$)", "")
    return _one_line(F.when(text_format == "markdown", bare).otherwise(text))


# Whose headings are written with marks, whose cells are columns, whose notes become labels.
HEADING_SIGNALS, CELL_SIGNALS, NOTE_SIGNAL = ("pp-doclayoutv3",), ("tatr",), "footnote-marker"
NOTE_NUMBER = r"^(\s*)([0-9]{1,2})[.)]?[ \t]+"


def render(e: DataFrame, assets: bool = False, alt: Column | None = None, rows: Column | None = None) -> Column:
    """One element as Markdown. A level that a pass assigned, or a heading of the layout model, writes the heading's marks; a
    table's cells (``rows``, arrays of struct(text, header, row_span, col_span)) are a table where the signal says that they are columns, else text; the number of a
    note that the pass split out becomes its label; a figure or table with an asset links its image, a figure's with ``alt``."""
    c = {n: F.col(n) for n in e.columns}
    rows = c["rows"] if rows is None else rows
    heading = c["type"].isin("heading", "title")
    marks = F.concat(F.repeat(F.lit("#"), F.coalesce(F.nullif(c["level"], F.lit(0)), F.lit(2))), F.lit(" "))
    text = F.coalesce(c["text"], F.lit(""))
    cells = F.when(c["signal"].isin(*CELL_SIGNALS), write_table(rows)).otherwise(rows_text(F.transform(rows, lambda r: F.transform(r, lambda x: x["text"]))))
    body = F.when(F.size(F.coalesce(rows, F.array().cast("array<array<struct<text:string,header:boolean,row_span:int,col_span:int>>>"))) > 0, cells).otherwise(text)
    linked = c["asset"].isNotNull() & F.lit(assets)
    words = F.translate(F.trim(F.regexp_replace(F.coalesce(F.lit("") if alt is None else alt, F.lit("")), r"(?U)\s+", " ")), "[]", "()")
    return (
        F.when(heading & c["level_signal"].isNotNull(), F.concat(marks, heading_words(text, c["text_format"])))
        .when(heading & c["signal"].isin(*HEADING_SIGNALS), F.concat(marks, F.replace(text, F.lit("\n"), F.lit(" "))))
        .when((c["type"] == "table") & linked, F.concat(body, F.when(body == "", "").otherwise("\n\n"), F.lit("![Table image]("), c["asset"], F.lit(")")))
        .when(c["type"] == "table", body)
        .when((c["type"] == "footnote") & (c["role_signal"] == NOTE_SIGNAL), F.regexp_replace(text, NOTE_NUMBER, "$1[^$2]: "))
        .when((c["type"] == "figure") & linked, F.concat(F.lit("!["), words, F.lit("]("), c["asset"], F.lit(")")))
        .otherwise(text)
    )


def to_markdown(elements: DataFrame, reader: bool = False) -> DataFrame:
    """(doc_id, markdown) of elements (doc_id, page, ord, type, unit): consecutive elements of a page are joined by blank
    lines and stripped, empty pages left out. ``reader`` leaves page furniture out."""
    e = elements.where(F.col("unit") != "")
    if reader:
        e = e.where(~F.col("type").isin(*FURNITURE))
    w = Window.partitionBy("doc_id").orderBy("ord")
    fresh = F.when(F.lag("page").over(w).eqNullSafe(F.col("page")), 0).otherwise(1)
    e = e.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w))
    joined = lambda key, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text]), "\n\n")
    pages = e.groupBy("doc_id", "_run").agg(F.regexp_replace(joined("ord", "unit"), r"^\s+|\s+$", "").alias("part")).where("part <> ''")
    return pages.groupBy("doc_id").agg(joined("_run", "part").alias("markdown"))


def to_json(elements: DataFrame, *fields: str) -> Column:
    """An element as JSON with its fields in the order of their names; null fields are left out."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "true"})


def from_json(docs: DataFrame, column: str, schema: str) -> DataFrame:
    """Elements of documents (doc_id, JSON array of elements), each with its place as ``ord``."""
    return docs.select("doc_id", F.posexplode(F.from_json(column, f"array<struct<{schema}>>")).alias("pos", "e")).select("doc_id", (F.col("pos") + 1).alias("ord"), "e.*")


def remapped(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations (doc_id, type, source, target) with ids renumbered by (doc_id, old, new); others stay."""
    side = lambda name: ids.select("doc_id", F.col("old").alias(name), F.col("new").alias(f"_{name}"))
    met = relations.join(side("source"), ["doc_id", "source"], "left").join(side("target"), ["doc_id", "target"], "left")
    return met.select("doc_id", "type", F.coalesce("_source", "source").alias("source"), F.coalesce("_target", "target").alias("target"))


def panels(tables: DataFrame) -> DataFrame:
    """(doc_id, page, source, target): each table of a page and the first later one with the same header words."""
    key = F.array_join(F.transform("header", lambda c: F.array_join(T.plain_words(c), " ")), "|")
    w = Window.partitionBy("doc_id", "page", "_h").orderBy("ord")
    return tables.withColumn("_h", key).withColumn("target", F.lead("ord").over(w)).where("target IS NOT NULL").select("doc_id", "page", F.col("ord").alias("source"), "target")


def chains(relations: DataFrame, rounds: int = 32) -> DataFrame:
    """(doc_id, id, head): every id of relations that continue an earlier element, with the first of its chain.

    Each id continues one other at most. By pointer jumping, a chain of n takes log2(n) rounds of one join each.
    """
    step = relations.select("doc_id", F.col("source").alias("id"), F.col("target").alias("head"))
    for _ in range(rounds):
        up = step.select("doc_id", F.col("id").alias("head"), F.col("head").alias("next"))
        jumped = step.join(up, ["doc_id", "head"], "left")
        if jumped.where("next IS NOT NULL").isEmpty():
            break
        step = jumped.select("doc_id", "id", F.coalesce("next", "head").alias("head"))
        if step.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            step = step.checkpoint()  # else each round would be planned on top of all before
    return step.union(step.select("doc_id", F.col("head").alias("id"), "head").distinct())


def relabel(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, element, type) of lines (doc_id, element, region type, area): the type that holds at least ``share`` of
    the element's area; of equal ones the first by name."""
    by_type = lines.groupBy("doc_id", "element", "type").agg(F.sum("area").alias("own"))
    w = Window.partitionBy("doc_id", "element")
    best = F.row_number().over(w.orderBy(F.desc("own"), "type"))
    return by_type.withColumns({"all": F.sum("own").over(w), "k": best}).where((F.col("k") == 1) & (F.col("own") >= share * F.col("all"))).select("doc_id", "element", "type")


def found_relations(gold: DataFrame, drawn: DataFrame, matches: DataFrame) -> DataFrame:
    """The gold relations (doc_id, type, source, target) that the drawn ones hold, by matches (doc_id, gold, output)."""
    to = lambda name: matches.select("doc_id", F.col("gold").alias(name), F.col("output").alias(f"_{name}"))
    mapped = gold.join(to("source"), ["doc_id", "source"]).join(to("target"), ["doc_id", "target"])
    return mapped.join(drawn.select("doc_id", "type", F.col("source").alias("_source"), F.col("target").alias("_target")), ["doc_id", "type", "_source", "_target"], "left_semi").select("doc_id", "type", "source", "target")


def splits_and_merges(shared: DataFrame) -> DataFrame:
    """Of (doc_id, gold, output, shared, n_gold, n_output): gold blocks whose tokens go to two or more outputs, and outputs
    that take from two or more gold blocks, where a part counts from two tokens and a tenth of the block on."""
    part = lambda n: F.col("shared") >= F.greatest(F.lit(2.0), 0.1 * F.col(n))
    split = shared.where(part("n_gold")).groupBy("doc_id", "gold").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id", F.lit("split").alias("kind"), F.col("gold").alias("block"), "n")
    merge = shared.where(part("n_output")).groupBy("doc_id", "output").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id", F.lit("merge").alias("kind"), F.col("output").alias("block"), "n")
    return split.union(merge)


def level_scores(headings: DataFrame) -> DataFrame:
    """Per document of matched headings (doc_id, gold, output levels; null where one side lacks it): hits, gold, output, and
    the share of hits whose levels are equal once each side's levels are numbered by rank."""
    w = Window.partitionBy("doc_id")
    dense = lambda side: F.when(F.col(side).isNotNull(), F.dense_rank().over(Window.partitionBy("doc_id", F.col(side).isNull()).orderBy(side)))
    ranked = headings.withColumns({"_g": dense("gold"), "_o": dense("output")})
    both = F.col("gold").isNotNull() & F.col("output").isNotNull()
    return ranked.groupBy("doc_id").agg(
        F.count_if(both).alias("hits"), F.count("gold").alias("n_gold"), F.count("output").alias("n_output"), F.round(F.avg(F.when(both, (F.col("_g") == F.col("_o")).cast("double"))), 6).alias("level_accuracy"),
    )


def runs(items: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """(key, kind, first, last): runs of consecutive items of one kind, by their place from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    placed = items.select(key, kind, *order, F.row_number().over(w).cast("long").alias("_n"), F.lag(kind).over(w).alias("_last"))
    opened = placed.withColumn("_run", F.sum(F.when(F.col("_last").eqNullSafe(F.col(kind)), 0).otherwise(1)).over(Window.partitionBy(key).orderBy("_n")))
    return opened.groupBy(key, "_run").agg(F.first(kind).alias(kind), F.min("_n").alias("first"), F.max("_n").alias("last")).drop("_run")


def next_match(events: DataFrame, key: str, order: str, source: Column, target: Column) -> DataFrame:
    """Each source row with the order of the next target row after it in its key, by one window; those without are left out."""
    after = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn("next_id", F.min(F.when(target, F.col(order))).over(after)).where(source & F.col("next_id").isNotNull())
