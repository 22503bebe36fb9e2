"""Page layout: reading order of columns, rows, table cells, overlapping detections, written tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let

Line = tuple[float, float, float, float]
MIN_GUTTER, CROSSING, MIN_SHARE, MIN_LINES, MIN_DENSITY, LEAST = 8.0, 0.05, 0.25, 3, 0.7, 6


def rows_by_centre(lines: Sequence[Line]) -> list[list[int]]:
    """Indexes in rows: a line joins a row if its centre is within half a median height of the row's first line's."""
    if not lines:
        return []
    centre = [(y0 + y1) / 2 for _, y0, _, y1 in lines]
    reach = median(y1 - y0 for _, y0, _, y1 in lines) / 2
    rows: list[list[int]] = []
    for i in sorted(range(len(lines)), key=lambda i: (centre[i], lines[i][0])):
        if rows and centre[i] - centre[rows[-1][0]] <= reach:
            rows[-1].append(i)
        else:
            rows.append([i])
    return [sorted(r, key=lambda i: lines[i][0]) for r in rows]


def gutters(lines: Sequence[Line]) -> list[tuple[float, float]]:
    """Strips inside the text, 8 points or wider, that at most a twentieth of the lines cross."""
    edges = sorted({x for l in lines for x in (l[0], l[2])})
    starts, ends = np.sort([l[0] for l in lines]), np.sort([l[2] for l in lines])
    found: list[tuple[float, float]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        over = np.searchsorted(starts, a, "right") - np.searchsorted(ends, a, "right")
        if over <= CROSSING * len(lines):
            if found and found[-1][1] == a:
                found[-1] = (found[-1][0], b)
            else:
                found.append((a, b))
    return [g for g in found if g[1] - g[0] >= MIN_GUTTER]


def _columns(lines: Sequence[Line], cuts: Sequence[tuple[float, float]]) -> list[list[int]] | None:
    """The lines of each column between the cuts, if each is wide, full and dense enough to be one."""
    low, high = min(l[0] for l in lines), max(l[2] for l in lines)
    bounds = [low, *(x for c in cuts for x in c), high]
    out = []
    for a, b in zip(bounds[::2], bounds[1::2], strict=True):
        own = [i for i, l in enumerate(lines) if l[0] >= a and l[2] <= b]
        if b - a < MIN_SHARE * (high - low) or len(own) < MIN_LINES:
            return None
        dense = []
        for r in rows_by_centre([lines[i] for i in own]):
            boxes = [lines[own[k]] for k in r]
            wide = max(x[2] for x in boxes) - min(x[0] for x in boxes)
            dense.append(min(1.0, sum(x[2] - x[0] for x in boxes) / wide) if wide else 1.0)
        if median(dense) < MIN_DENSITY:
            return None
        out.append(own)
    return out


def reading_order(lines: Sequence[Line]) -> list[list[int]] | None:
    """Paragraphs of line indexes, column by column; None for fewer than six lines or a page without columns.

    Three columns are preferred to two, then wide gutters, then those to the left. A line that crosses a gutter ends
    a band; bands are read from the top, each column by column. A gap over 0.8 of a line's height ends a paragraph.
    """
    if len(lines) < LEAST:
        return None
    strips = gutters(lines)
    options = [c for n in (2, 1) for c in sorted(combinations(strips, n), key=lambda c: (-sum(b - a for a, b in c), c))]
    columns = next((found for c in options if (found := _columns(lines, c))), None)
    if columns is None:
        return None
    place = {i: k for k, own in enumerate(columns) for i in own}
    wide = sorted((i for i in range(len(lines)) if i not in place), key=lambda i: (lines[i][1], lines[i][0]))
    tops = [lines[i][1] for i in wide]
    band = {i: int(np.searchsorted(tops, lines[i][1], "right")) for i in place}
    runs: list[list[int]] = []
    for b in range(len(wide) + 1):
        runs += [[wide[b - 1]]] if b else []
        runs += [own for k in range(len(columns)) if (own := [i for i in columns[k] if band[i] == b])]
    out: list[list[int]] = []
    for run in runs:
        bottom = None
        for row in rows_by_centre([lines[i] for i in run]):
            top, low = min(lines[run[k]][1] for k in row), max(lines[run[k]][3] for k in row)
            if bottom is None or top - bottom > 0.8 * (low - top):
                out.append([])
            out[-1] += [run[k] for k in row]
            bottom = low
    return out


def order_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, ord, box) with ``place`` and ``paragraph`` from 0 on their page; both are null where the
    page has no columns. A page's lines are one task's group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        found = reading_order(list(zip(pdf.x0, pdf.y0, pdf.x1, pdf.y1, strict=True)))
        at = {i: (k, p) for k, (i, p) in enumerate((i, p) for p, own in enumerate(found or []) for i in own)}
        pdf["place"] = pd.array([at.get(i, (None, None))[0] for i in range(len(pdf))], "Int64")
        pdf["paragraph"] = pd.array([at.get(i, (None, None))[1] for i in range(len(pdf))], "Int64")
        return pdf[["doc_id", "page", "ord", "place", "paragraph"]]

    flat = lines.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), F.col("ord").cast("long"), "box.x0", "box.y0", "box.x1", "box.y1")
    return flat.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, ord long, place long, paragraph long")


def distinct_detections(found: DataFrame, share: float = 0.5) -> DataFrame:
    """Detections (doc_id, page, ord, box) without those that a kept earlier one covers by over ``share`` of their area."""

    def kept(boxes: list) -> list[int]:
        done: list = []
        for b in sorted(boxes, key=lambda b: b["ord"]):
            x0, y0, x1, y1 = (b[k] for k in ("x0", "y0", "x1", "y1"))
            area = max(0.0, x1 - x0) * max(0.0, y1 - y0)
            over = (max(0.0, min(x1, d["x1"]) - max(x0, d["x0"])) * max(0.0, min(y1, d["y1"]) - max(y0, d["y0"])) for d in done)
            if not any(o > share * area for o in over):
                done.append(b)
        return [d["ord"] for d in done]

    flat = F.struct(F.col("ord").cast("long").alias("ord"), "box.x0", "box.y0", "box.x1", "box.y1")
    chosen = found.groupBy("doc_id", "page").agg(F.collect_list(flat).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, p, o) for d, p, b in zip(pdf.doc_id, pdf.page, pdf.b, strict=True) for o in kept(list(b))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord"])

    keys = chosen.select(F.col("doc_id").cast("long"), F.col("page").cast("int"), "b").mapInPandas(run, "doc_id long, page int, ord long")
    return found.join(keys, ["doc_id", "page", "ord"], "left_semi")


def table_cells(words: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, page, table, row, col, text, n_words): the words of each table cell from the top.

    ``words`` are (doc_id, page, ord, text, box); ``bands`` are (doc_id, page, table, kind, n, box) with the kinds
    table, row and column. A word belongs to the first table that holds its centre; its row and column are the bands
    that overlap it most, or else the nearest by centre. A page's bands meet each of its words in one row, so words are
    shuffled once, and not at all where both are dealt by document.
    """
    key = ["doc_id", "page"]
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("table", "n", F.col("box.x0").alias("x0"), F.col("box.y0").alias("y0"), F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"))))
    drawn = bands.groupBy(*key).agg(of("table").alias("tables"), of("row").alias("rows"), of("column").alias("columns"))
    cx, cy = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    holds = lambda t: cx.between(t["x0"], t["x1"]) & cy.between(t["y0"], t["y1"])
    own = words.join(drawn, key).withColumn("table", F.array_min(F.transform(F.filter("tables", holds), lambda t: t["table"])))

    def best(bands: str, a: str, b: str) -> Column:
        lo, hi = F.col(f"box.{a}"), F.col(f"box.{b}")
        overlap = lambda x: F.greatest(F.least(hi, x[b]) - F.greatest(lo, x[a]), F.lit(0.0))
        rank = lambda x: F.struct((-overlap(x)).alias("o"), F.abs(lo + hi - x[a] - x[b]).alias("d"), x["n"].alias("n"))
        return F.array_min(F.transform(F.filter(bands, lambda x: x["table"] == F.col("table")), rank))["n"]

    placed = own.select(*key, "table", best("rows", "y0", "y1").alias("row"), best("columns", "x0", "x1").alias("col"), "ord", "text", "box").where("row IS NOT NULL AND col IS NOT NULL")
    inside = F.array_sort(F.collect_list(F.struct(F.round("box.y0").alias("y"), F.col("box.x0").alias("x"), "ord", "text")))
    return placed.groupBy(*key, "table", "row", "col").agg(F.array_join(F.transform(inside, lambda w: w["text"]), " ").alias("text"), F.count("*").alias("n_words"))


def tabular(cells: DataFrame, most: float = 2.5) -> DataFrame:
    """(doc_id, page, table, n_rows, n_cols, filled, mean_words, numeric_share): tables of at least two rows and columns
    with at most ``most`` words a filled cell."""
    found = cells.groupBy("doc_id", "page", "table").agg(
        F.size(F.collect_set("row")).cast("long").alias("n_rows"), F.size(F.collect_set("col")).cast("long").alias("n_cols"), F.count("*").alias("filled"), F.round(F.avg("n_words"), 4).alias("mean_words"),
        F.round(F.avg(F.col("text").rlike(r"^[\s(+\-–$€£]*[0-9][0-9.,\s%)]*$").cast("int")), 4).alias("numeric_share"),
    )
    return found.where((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2) & (F.col("mean_words") <= most))


def write_table(rows: Column) -> Column:
    """Rows (array of arrays of struct(text, header, row_span, col_span)) as Markdown: a pipe table where no cell spans, the
    first row is all header and there are two rows, else HTML. Empty rows are left out; an HTML row leaves out the cells that one above
    or to the left covers, whose places its array holds. Runs of white space in a cell are one blank; an absent span is one."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"(?U)\s+", " "))
    span = lambda c, side: F.coalesce(c[f"{side}_span"], F.lit(1))
    head = lambda c: F.coalesce(c["header"], F.lit(False))

    def pipes(rs: Column) -> Column:
        width = F.array_max(F.transform(rs, F.size))

        def line(r: Column) -> Column:
            cells = F.concat(F.transform(r, lambda c: F.replace(flat(c), F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), width - F.size(r)))
            return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

        lines = F.transform(rs, line)
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))), F.slice(lines, F.lit(2), F.size(lines))), "\n")

    def cell(c: Column) -> Column:
        tag = F.when(head(c), "th").otherwise("td")
        sides = [F.when(span(c, s) > 1, F.concat(F.lit(f' {s}span="'), span(c, s).cast("string"), F.lit('"'))).otherwise("") for s in ("row", "col")]
        text = F.replace(F.replace(F.replace(flat(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit("<"), tag, *sides, F.lit(">"), text, F.lit("</"), tag, F.lit(">"))

    def html(rs: Column) -> Column:
        cells = F.flatten(F.transform(rs, lambda r, i: F.transform(r, lambda c, k: F.struct(i.alias("r"), k.alias("k"), c.alias("c")))))
        start = F.struct(F.array().cast("array<struct<r:int,k:int,down:int,right:int>>").alias("spans"), F.array().cast("array<struct<r:int,html:string>>").alias("out"))

        def put(at: Column, x: Column) -> Column:
            covered = F.exists(at["spans"], lambda s: (s["r"] <= x["r"]) & (x["r"] < s["r"] + s["down"]) & (s["k"] <= x["k"]) & (x["k"] < s["k"] + s["right"]))
            down, right = span(x["c"], "row"), span(x["c"], "col")
            wide = ~covered & ((down > 1) | (right > 1))
            spans = F.when(wide, F.concat(at["spans"], F.array(F.struct(x["r"].alias("r"), x["k"].alias("k"), down.alias("down"), right.alias("right"))))).otherwise(at["spans"])
            out = F.when(covered, at["out"]).otherwise(F.concat(at["out"], F.array(F.struct(x["r"].alias("r"), cell(x["c"]).alias("html")))))
            return F.struct(spans.alias("spans"), out.alias("out"))

        def lines(out: Column) -> Column:
            row = lambda i: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(out, lambda o: o["r"] == i), lambda o: o["html"]), ""), F.lit("</tr>"))
            return F.concat(F.lit("<table>\n"), F.array_join(F.transform(rs, lambda r, i: row(i)), "\n"), F.lit("\n</table>"))

        return let(F.aggregate(cells, start, put)["out"], lines)

    def written(rs: Column) -> Column:
        spans = F.exists(F.flatten(rs), lambda c: (span(c, "row") > 1) | (span(c, "col") > 1))
        plain = ~spans & (F.size(rs) > 1) & F.forall(F.get(rs, F.lit(0)), head)
        return F.when(F.size(rs) == 0, "").when(plain, pipes(rs)).otherwise(html(rs))

    return let(F.filter(rows, lambda r: F.size(r) > 0), written)
