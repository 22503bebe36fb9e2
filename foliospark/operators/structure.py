"""Document structure: blocks, continuation, regrouping. Elements carry ``ord``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as T

_BLANK = re.compile(r"\n(?:[ \t]*\n)+")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")


def blocks(text: str | None) -> list[str]:
    """Blocks at blank lines outside code fences; an open fence runs to the end."""
    done: list[str] = []
    held: list[str] = []
    mark = ""
    for chunk in _BLANK.split(text or ""):
        held.append(chunk)
        for m in filter(None, map(_FENCE.match, chunk.split("\n"))):
            if not mark:
                mark = m[1]
            elif m[1].startswith(mark) and not m[2].strip():
                mark = ""
        if not mark:
            done.append("\n\n".join(held))
            held = []
    return [b for b in (*done, "\n\n".join(held)) if b.strip()]


def split_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, block): the blocks of each text in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, b) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, b in enumerate(blocks(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "ord", "block"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ord long, block string")


def block_type(block: Column) -> Column:
    """The type that a block's leading Markdown shows."""
    first = F.regexp_extract(block, r"^\n*([^\n]*)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.trim(x) != "")
    one = F.size(lines) == 1
    return (
        F.when(first.rlike(r"^ {0,3}(`{3,}|~{3,})"), "code")
        .when(first.rlike(r"^ {0,3}#{1,6}([ \t]|$)") & one, "heading")
        .when((F.size(lines) > 0) & F.forall(lines, lambda x: F.ltrim(x).startswith("|")), "table")
        .when(first.rlike(r"^ {0,3}((-[ \t]*){3,}|(\*[ \t]*){3,}|(_[ \t]*){3,})$") & one, "rule")
        .when(first.rlike(r"^ {0,3}([-*+]|[0-9]{1,9}[.)])[ \t]"), "list")
        .when(first.rlike(r"^ {0,3}!\[") & one, "figure")
        .otherwise("paragraph")
    )


def to_markdown(elements: DataFrame, key: str, order: str, text: str, unit: str = "\n\n") -> DataFrame:
    """One text for each key: its non-blank elements in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return elements.where(F.trim(text) != "").groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), unit).alias("markdown"))


def element_ids(elements: DataFrame, key: str, order: str) -> DataFrame:
    """Ids e1, e2, ... in reading order."""
    return elements.withColumn("id", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string")))


def continuations(elements: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, source, target): prose with an open end, and the next prose that starts in lower case."""
    w = Window.partitionBy(key).orderBy(order)
    prose = elements.where(T.is_prose(F.col(text)))
    pairs = prose.select(key, F.col(order).alias("target"), F.col(text).alias("a"), F.lead(order).over(w).alias("source"), F.lead(text).over(w).alias("b"))
    return pairs.where(T.open_end(F.col("a")) & T.lower_start(F.col("b"))).select(key, "source", "target")


def regroup(lines: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Each line (doc_id, page, ord, box) with the region that holds most of its area, at least ``share``; else the
    last region used before it in reading order (null before the first). Lines are partitioned exactly."""
    ratio = G.intersection(F.col("l.box"), F.col("r.box")) / F.nullif(G.area(F.col("l.box")), F.lit(0.0))
    met = lines.alias("l").join(regions.alias("r"), (F.col("l.doc_id") == F.col("r.doc_id")) & (F.col("l.page") == F.col("r.page")) & (ratio >= share), "left")
    first = F.row_number().over(Window.partitionBy("l.doc_id", "l.page", "l.ord").orderBy(ratio.desc_nulls_last(), G.area(F.col("r.box")), "r.ord"))
    best = met.withColumn("k", first).where("k = 1").select("l.*", F.col("r.ord").alias("own"))
    w = Window.partitionBy("doc_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("region", F.last("own", ignorenulls=True).over(w)).drop("own")
