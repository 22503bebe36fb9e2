"""Blocks of recognised lines that are cells of one table, stitched; tables spliced into the elements that they claim words of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from .graph import components, written

PAGE = ["doc_id", "page"]
#: Pairs of neighbours up to which a page's tables are found within its row; pages with more are contracted over tables.
FOLDED = 200
#: A cell has at most so many words a line (median) and so much of the text's width; neighbours are at most GAP of it apart,
#: and ALIGNED of the shorter one's lines lie in a row with one of the other.
CELL_WORDS, CELL_WIDTH, GAP, ALIGNED, HEIGHTS, EDGE = 4, 0.40, 0.20, 0.6, 1.6, 0.9


def _same_row(a: Column, b: Column) -> Column:
    ha, hb = a["y1"] - a["y0"], b["y1"] - b["y0"]
    alike = F.greatest(ha, hb) <= HEIGHTS * F.greatest(F.least(ha, hb), F.lit(1e-6))
    return alike & (F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) <= 0.5 * F.least(ha, hb))


def _row_aligned(a: Column, b: Column) -> Column:
    """Whether enough lines of the block with fewer lines (the first of two alike) lie in a row with one of the other."""
    share = lambda x, y: F.size(F.filter(x, lambda l: F.exists(y, lambda m: _same_row(l, m)))) / F.size(x)
    return F.when(F.size(a) <= F.size(b), share(a, b)).otherwise(share(b, a)) >= ALIGNED


def blocks(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, block, ord, x0, y0, x1, y1, text) as blocks: box, lines in order, ``cell`` if they look like a
    table's, and the width of the page's text, which lines along a scanner's edge do not count for."""
    page = Window.partitionBy(*PAGE)
    body = lines.withColumn("inner", F.col("x1") - F.col("x0") < EDGE * F.max("x1").over(page))
    span = lambda c: F.max(F.when(c, F.col("x1"))).over(page) - F.min(F.when(c, F.col("x0"))).over(page)
    body = body.withColumn("width", F.greatest(F.coalesce(span(F.col("inner")), span(F.lit(True))), F.lit(1.0)))
    n_words = F.size(F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\S+"), F.lit(0)))
    each = F.struct("ord", "x0", "y0", "x1", "y1", "text")
    made = body.groupBy(*PAGE, "block").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.percentile(n_words, 0.5).alias("words"), F.sort_array(F.collect_list(each)).alias("lines"), F.max("width").alias("width")
    )
    return made.withColumn("cell", (F.col("words") <= CELL_WORDS) & ((F.col("x1") - F.col("x0")) / F.col("width") <= CELL_WIDTH))


def neighbours(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """Pairs (doc_id, page, a, b) of cells beside each other whose lines are in rows.

    Cells meet by buckets: a step across is the widest gap, so a left cell's right edge and a right cell's left edge are
    in one or in following buckets, and a step down is the page's mean height of a cell, so a cell is in about two. A pair
    counts in the first step that both are in, so each is looked at once. Boxes are dealt by page, to ``tasks`` tasks.
    """
    ys = F.transform("lines", lambda l: F.struct(l["y0"].alias("y0"), l["y1"].alias("y1")))
    cells = found.where("cell").select(*PAGE, "block", "x0", "y0", "x1", "y1", "width", ys.alias("lines")).repartition(*([tasks] if tasks else []), *PAGE)
    band = F.greatest(F.avg(F.col("y1") - F.col("y0")).over(Window.partitionBy(*PAGE)), F.lit(1e-6))
    cells = cells.withColumns({"band": band, "across": GAP * F.col("width")})
    step = lambda x, by: F.floor(F.col(x) / F.col(by))
    cells = cells.withColumn("step", step("y0", "band")).withColumn("down", F.explode(F.sequence("step", step("y1", "band"))))
    at = lambda bucket, left: F.struct(bucket.alias("bucket"), F.lit(left).alias("left"))
    places = F.array(at(step("x1", "across"), True), at(step("x0", "across") - 1, False), at(step("x0", "across"), False))
    cell = F.struct("block", "x0", "y0", "x1", "y1", "lines", "step")
    # all cells of a bucket meet in its row, which is made where the page was dealt to
    met = cells.select(*PAGE, "down", "width", cell.alias("cell"), F.inline(places)).groupBy(*PAGE, "down", "bucket")
    met = met.agg(F.max("width").alias("width"), *(F.collect_list(F.when(F.col("left") == left, F.col("cell"))).alias(name) for name, left in (("l", True), ("r", False)))).where("size(l) > 0 AND size(r) > 0")
    met = met.withColumn("l", F.explode("l")).withColumn("r", F.explode("r")).where(F.col("down") == F.greatest("l.step", "r.step"))
    gap = F.col("r.x0") - F.col("l.x1")
    met = met.where((F.col("l.block") != F.col("r.block")) & (F.least("l.y1", "r.y1") > F.greatest("l.y0", "r.y0")) & (gap >= 0) & (gap / F.col("width") <= GAP))
    first = F.col("l.block") < F.col("r.block")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    met = met.where(_row_aligned(pick("l.lines", "r.lines"), pick("r.lines", "l.lines")))
    return met.select(*PAGE, F.least("l.block", "r.block").alias("a"), F.greatest("l.block", "r.block").alias("b"))


def rows_within(lines: Column, reach: Column) -> Column:
    """Texts of lines (sorted structs of centre, x0, text) as rows from top to bottom, each from left to right: a line belongs to
    a row if its centre is within ``reach`` of that of the row's first line."""
    start = F.struct(F.lit(-1).alias("row"), F.lit(float("-inf")).alias("first"), F.array().cast("array<int>").alias("rows"))

    def put(at: Column, l: Column) -> Column:
        new = l["centre"] - at["first"] > reach
        row = at["row"] + new.cast("int")
        return F.struct(row.alias("row"), F.when(new, l["centre"]).otherwise(at["first"]).alias("first"), F.concat(at["rows"], F.array(row)).alias("rows"))

    numbered = F.zip_with(F.aggregate(lines, start, put)["rows"], lines, lambda r, l: F.struct(r.alias("row"), l["x0"].alias("x0"), l["text"].alias("text")))
    split = lambda all_: F.transform(F.sequence(F.lit(0), F.element_at(all_, -1)["row"]), lambda r: F.transform(F.filter(all_, lambda l: l["row"] == r), lambda l: l["text"]))
    return F.when(F.size(lines) > 0, T.let(F.array_sort(numbered), split)).otherwise(F.array().cast("array<array<string>>"))


def table_rows(lines: Column) -> Column:
    """The lines of a stitched table as rows: within half the median height of a line."""
    centred = F.array_sort(F.transform(lines, lambda l: F.struct(((l["y0"] + l["y1"]) / 2).alias("centre"), l["x0"].alias("x0"), l["text"].alias("text"), (l["y1"] - l["y0"]).alias("height"))))
    middle = lambda h: (F.get(h, F.floor((F.size(h) - 1) / 2).cast("int")) + F.get(h, F.floor(F.size(h) / 2).cast("int"))) / 2
    reach = lambda ls: T.let(F.array_sort(F.transform(ls, lambda l: l["height"])), lambda h: 0.5 * middle(h))
    return T.let(centred, lambda ls: T.let(reach(ls), lambda r: rows_within(ls, r)))


#: Points between the centres of words of one printed line.
LINE_REACH = 2.5


def references(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, text, missed): a page's reference text from its printed words and the regions drawn on it, in their order.

    ``words``: doc_id, page, word, x0, y0, x1, y1, text; ``regions``: doc_id, page, region, width, height (of the page) and x0,
    y0, x1, y1 as shares of it. A word belongs to the first region that holds its centre, upper and left edge included; words
    that none holds are missed. A page's regions meet each of its words in one row.
    """
    box = regions.select(*PAGE, "region", *((F.col(c) * F.col(side)).alias(f"r_{c}") for c, side in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))))
    centred = words.select(*PAGE, "word", "x0", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("centre"))
    drawn = box.groupBy(*PAGE).agg(F.collect_list(F.struct("region", "r_x0", "r_y0", "r_x1", "r_y1")).alias("drawn"))
    holds = lambda r: (F.col("cx") >= r["r_x0"]) & (F.col("cx") < r["r_x1"]) & (F.col("centre") >= r["r_y0"]) & (F.col("centre") < r["r_y1"])
    own = centred.join(drawn, PAGE, "left").withColumn("region", F.array_min(F.transform(F.filter("drawn", holds), lambda r: r["region"]))).drop("drawn")
    part = own.groupBy(*PAGE, "region").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("region").isNotNull(), F.struct("centre", "x0", "text")))).alias("lines"))
    part = part.withColumn("text", F.array_join(F.transform(rows_within(F.col("lines"), F.lit(LINE_REACH)), lambda r: F.array_join(r, " ")), "\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("region").isNotNull(), F.struct("region", "text")))), lambda x: x["text"]), "\n")
    made = part.groupBy(*PAGE).agg(F.coalesce(F.sum(F.when(F.col("region").isNull(), F.col("n"))), F.lit(0)).alias("missed"), text.alias("text"))
    return made.select(*PAGE, F.concat("text", F.lit("\n")).alias("text"), "missed")


def _tables(pairs: Column) -> Column:
    """Pairs of blocks as arrays of the blocks that they connect."""

    def put(sets: Column, pair: Column) -> Column:
        both = F.array(pair["a"], pair["b"])
        met = F.filter(sets, lambda s: F.arrays_overlap(s, both))
        return F.concat(F.filter(sets, lambda s: ~F.arrays_overlap(s, both)), F.array(F.array_distinct(F.concat(F.flatten(met), both))))

    return F.aggregate(pairs, F.array(F.slice(F.array(pairs[0]["a"]), 1, 0)), put)


def firsts(pairs: DataFrame) -> DataFrame:
    """(doc_id, page, block, first): for each block of the pairs (doc_id, page, a, b) the first one that they connect it with."""
    paged = written(pairs.groupBy(*PAGE).agg(F.collect_list(F.struct("a", "b")).alias("pairs")), "pairs")
    few = paged.where(F.size("pairs") <= FOLDED).select(*PAGE, F.explode(_tables(F.col("pairs"))).alias("set"))
    few = few.select(*PAGE, F.explode("set").alias("block"), F.array_min("set").alias("first"))
    many = paged.where(F.size("pairs") > FOLDED)
    if many.isEmpty():
        return few
    node = lambda c: F.struct(*(F.col(p).alias(p) for p in PAGE), F.col(f"x.{c}").alias("block")).alias(c)
    of = components(many.select(*PAGE, F.explode("pairs").alias("x")).select(node("a"), node("b")))
    return few.union(of.select("node.*", F.col("root.block").alias("first")))


def stitched(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, page, ord, n_blocks, text): a page's blocks in their order, those of a table as one at its first block's place,
    read row by row; other blocks line by line. Blocks and what is found of them are dealt by page once, to ``tasks`` tasks."""
    found = written(blocks(lines), "blocks")
    of = firsts(neighbours(found, tasks))
    own = F.array("lines")
    rows = found.select(*PAGE, "block", own.alias("own"), F.lit(None).cast(found.schema["block"].dataType).alias("first"))
    rows = rows.unionByName(of.select(*PAGE, "block", F.lit(None).cast(rows.schema["own"].dataType).alias("own"), "first")).repartition(*([tasks] if tasks else []), *PAGE)
    each = rows.groupBy(*PAGE, "block").agg(F.flatten(F.collect_list("own")).alias("own"), F.max("first").alias("first"))
    each = each.select(*PAGE, "block", F.explode("own").alias("lines"), F.coalesce("first", "block").alias("first"))
    made = each.groupBy(*PAGE, "first").agg(F.count("*").alias("n_blocks"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "lines"))), lambda b: b["lines"])).alias("lines"))
    as_table = F.array_join(F.transform(table_rows(F.col("lines")), lambda r: F.array_join(r, " ")), "\n")
    text = F.when(F.col("n_blocks") > 1, as_table).otherwise(F.array_join(F.transform("lines", lambda l: l["text"]), "\n"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("first"))
    return made.select(*PAGE, order.alias("ord"), "n_blocks", text.alias("text"))


def spliced(words: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, ord, kind, elem, table, text): the elements of a page with the words that tables claim replaced by these.

    ``words``: doc_id, page, elem, line, word, y0, y1, text, table (what claims it, or null); ``tables``: doc_id, page, table,
    y0, text. A line keeps the words that no table took, and goes if there are none. A table stands where the first element
    is that it took from; what is left of an element whose centre is above its tables' top comes before them, the rest after.
    Each word is in one place, and those left keep their order. Words are summed up within their page alone.
    """
    free = F.col("table").isNull()
    line = words.groupBy(*PAGE, "elem", "line").agg(
        F.min(F.when(free, F.col("y0"))).alias("low"), F.max(F.when(free, F.col("y1"))).alias("high"), F.sort_array(F.collect_list(F.when(free, F.struct("word", "text")))).alias("left"),
        F.collect_list(F.when(~free, F.struct("table", "line", "word"))).alias("hits"),
    )
    left = F.when(F.size("left") > 0, F.struct("line", ((F.col("low") + F.col("high")) / 2).alias("centre"), F.array_join(F.transform("left", lambda w: w["text"]), " ").alias("text")))
    elems = line.groupBy(*PAGE, "elem").agg(F.sort_array(F.collect_list(left)).alias("lines"), F.flatten(F.collect_list("hits")).alias("hits"))
    here = tables.groupBy(*PAGE).agg(F.collect_list(F.struct("table", "y0", "text")).alias("tables"))
    met = F.filter(F.col("tables"), lambda t: F.exists("hits", lambda h: h["table"] == t["table"]))
    elems = elems.join(here, PAGE, "left").withColumn("tables", F.coalesce(met, F.slice("tables", 1, 0))).withColumn("top", F.array_min(F.transform("tables", lambda t: t["y0"])))
    above = lambda l: F.col("top").isNull() | F.coalesce(l["centre"] < F.col("top"), F.lit(False))
    none, at = F.lit(None).cast(dict(tables.dtypes)["table"]), F.struct(F.col("hits")[0]["line"].alias("line"), F.col("hits")[0]["word"].alias("word"))
    piece = lambda part, at, kind, table, text: F.struct(F.lit(part).alias("part"), at.alias("at"), F.lit(kind).alias("kind"), table.alias("table"), text.alias("text"))
    no_at = F.when(F.lit(False), at)
    kept = lambda part, own: F.transform(F.filter(F.array(F.filter("lines", own)), lambda ls: F.size(ls) > 0), lambda ls: piece(part, no_at, "text", none, F.array_join(F.transform(ls, lambda l: l["text"]), "\n")))
    first = lambda t: F.array_min(F.transform(F.filter("hits", lambda h: h["table"] == t["table"]), lambda h: F.struct(h["line"].alias("line"), h["word"].alias("word"))))
    put = F.transform(F.coalesce("tables", F.array().cast(elems.schema["tables"].dataType)), lambda t: piece(1, first(t), "table", t["table"], t["text"]))
    parts = elems.select(*PAGE, "elem", F.explode(F.concat(kept(0, above), put, kept(2, lambda l: ~above(l)))).alias("p")).select(*PAGE, "elem", "p.*")
    # a table stands in the first of its elements
    parts = parts.withColumn("first", F.min("elem").over(Window.partitionBy(*PAGE, "table"))).where("part <> 1 OR elem = first")
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("elem", "part", "at"))
    return parts.select(*PAGE, order.alias("ord"), "kind", "elem", "table", "text")
