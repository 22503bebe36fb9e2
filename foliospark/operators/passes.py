"""Passes over the elements of documents: furniture, broken paragraphs, captions, continued tables, outline levels, notes.

An element is a row (doc_id, page, ord, type, text, text_format, bbox, ...) whose ``ord`` is its place in the document; a
page is a row (doc_id, page, height). No pass edits a text: it changes types and levels, with the signal that tells why, or
returns relations (doc_id, type, source, target, signal) between places. Where the evidence is thin nothing is drawn: an
element without a box, or on a page without a height, is in no band and next to nothing. Columns that a pass does not
name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G, text as T
from .elements import FURNITURE
from .placement import DIVISION

BODY = ("text", "paragraph")

# The words and marks by which captions, continuations, notes and prose are known.
CAPTION = r"(?i)^\s*(?:\(\s*\*\s*=|\(\s*photo|(?:table|fig\.?|figure|plate|photo(?:graph)?)\b)"
OF_TABLE = r"(?i)^\s*(?:\(\s*\*\s*=|table\b)"
CONTINUED = r"(?i)\bcontinued\b|\bcont(?:'|’)?d\b"
NOT_PROSE = r"^\s*(?:#|\||>|[-*+]\s|[0-9]{1,3}[.)]\s|```|<table)"
SENTENCE = r"[a-z]{3,}[,;]?\s+[a-z]{3,}\s+[a-z]{3,}\s+[a-z]{3,}"
MARKER = r"<sup>\s*([0-9]{1,2}(?:\s*,\s*[0-9]{1,2})*)\s*</sup>"
NOTE = r"^\s*([0-9]{1,2})[.)]?\s+\S"


def words_of(text: Column, text_format: Column) -> Column:
    """An element's words without Markdown's tags, heading marks and emphasis, for tests by pattern."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"(?m)^ {0,3}#{1,6}[ \t]+", ""), r"\*\*|__|~~|\*|_", "")
    return F.regexp_replace(F.coalesce(F.when(text_format == "markdown", bare).otherwise(text), F.lit("")), r"(?U)^\s+|\s+$", "")


def _words() -> Column:
    return words_of(F.col("text"), F.col("text_format"))


def _said(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") != "", F.lit(False))


def _heights(pages: DataFrame) -> DataFrame:
    return pages.where("height > 0").select("doc_id", "page", F.col("height").alias("_height"))


def typed_furniture(elements: DataFrame, pages: DataFrame | None = None, band: float = 0.10, outer: float = 0.12, least: int = 3, longest: int = 120) -> DataFrame:
    """Elements with the types of page furniture, and ``role_signal`` where a type has changed.

    In the top or bottom ``band`` of a page a page number alone is one, and a text that repeats there (digits masked) on
    ``least`` pages and a quarter of them is a header or footer. On pages of Markdown so is one short line in the top band
    with a number and no sentence, unless it is bold or names a division. Furniture away from both margins is plain text.
    Without ``pages`` the elements have the ``height`` of their page; then all is found by windows within a document.
    """
    never = ["heading", "title", "table", "figure", "caption", "footnote", "code", "equation"]
    top, bottom = F.col("bbox.y1") <= band * F.col("_height"), F.col("bbox.y0") >= (1 - band) * F.col("_height")
    outside = F.col("type").isin(*FURNITURE) & (F.col("bbox.y0") > outer * F.col("_height")) & (F.col("bbox.y1") < (1 - outer) * F.col("_height"))
    e = elements.withColumn("_height", F.when(F.col("height") > 0, F.col("height"))) if pages is None else elements.join(_heights(pages), ["doc_id", "page"], "left")
    e = e.withColumns({"_words": _words(), "_out": F.coalesce(outside, F.lit(False)), "_band": F.when(top, "header").when(bottom, "footer")})
    e = e.withColumn("_key", F.when(~F.col("_out") & ~F.col("type").isin(never) & (F.col("_words") != ""), T.furniture_key(F.col("_words"))))
    # distinct pages: the highest rank of a page, less that of what is none
    same, doc = Window.partitionBy("doc_id", "_band", "_key"), Window.partitionBy("doc_id")
    e = e.withColumn("_nth", F.dense_rank().over(same.orderBy("page")))
    on = F.max("_nth").over(same) - F.max(F.col("page").isNull().cast("int")).over(same)
    e = e.withColumn("_on", F.when(F.col("doc_id").isNotNull() & F.col("_key").isNotNull() & F.col("_band").isNotNull(), on))
    e = e.withColumn("_nth", F.dense_rank().over(doc.orderBy("page")))
    none = F.max(F.when(F.coalesce(F.col("page") > 0, F.lit(False)), 0).otherwise(F.col("_nth"))).over(doc)
    e = e.withColumn("_pages", F.when(F.col("doc_id").isNotNull(), F.max("_nth").over(doc) - none))
    bold = F.trim("text").rlike(r"^(?:\*\*[^*]+\*\*\s*)+$")
    head = (F.col("_band") == "header") & (F.col("text_format") == "markdown") & ~F.col("_words").contains("\n") & (F.length("_words") <= longest)
    head = head & ~bold & ~F.col("_words").rlike(DIVISION) & F.col("_words").rlike("[0-9]") & ~F.col("_words").rlike(SENTENCE)
    found = (
        F.when(F.col("_out"), F.struct(F.lit("text").alias("type"), F.lit("furniture-outside").alias("signal")))
        .when(F.col("_band").isNull() | F.col("_key").isNull(), None)
        .when(T.is_page_number(F.col("_words")), F.struct(F.lit("page_number").alias("type"), F.lit("furniture-number").alias("signal")))
        .when((F.col("_pages") >= 2) & (F.col("_on") >= F.greatest(F.lit(least), F.ceil(F.col("_pages") / 4))), F.struct(F.concat(F.lit("page_"), "_band").alias("type"), F.lit("furniture-repeat").alias("signal")))
        .when(head, F.struct(F.lit("page_header").alias("type"), F.lit("furniture-head").alias("signal")))
    )
    e = e.withColumn("_found", found).withColumn("_signal", F.when(F.col("_found.type") != F.col("type"), F.col("_found.signal")))
    kept = [c for c in elements.columns if c not in ("type", "role_signal")]
    before = F.col("role_signal") if "role_signal" in elements.columns else F.lit(None).cast("string")
    return e.select(*kept, F.coalesce("_found.type", "type").alias("type"), F.coalesce("_signal", before).alias("role_signal"))


def continued_paragraphs(elements: DataFrame, pages: DataFrame, margin: float = 0.06) -> DataFrame:
    """Relations ``continues_from`` (later to earlier) of paragraphs that a column or a page breaks.

    The earlier one is prose with an open end, the later one prose that starts in lower case; between them are only
    figures, captions, furniture, blank elements and what lies wholly in the outer ``margin``. The later one stands to the right
    and higher up on the page, or on the next page.
    """
    edge = (F.col("bbox.y1") <= margin * F.col("_height")) | (F.col("bbox.y0") >= (1 - margin) * F.col("_height"))
    e = elements.join(_heights(pages), ["doc_id", "page"], "left")
    body = e.where(~F.col("type").isin("figure", "caption", *FURNITURE) & _said(F.col("text")) & ~F.coalesce(edge, F.lit(False)))
    stripped = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    prose = F.col("type").isin(*BODY) & T.is_prose(F.col("text")) & ~((F.col("text_format") == "markdown") & stripped.rlike(NOT_PROSE))
    it = F.struct("ord", "page", "bbox", prose.alias("prose"), T.open_end(_words()).alias("open"), T.lower_start(_words()).alias("lower"))
    pairs = body.select("doc_id", it.alias("a"), F.lead(it).over(Window.partitionBy("doc_id").orderBy("ord")).alias("b"))
    beside = (F.col("b.bbox.x0") >= F.col("a.bbox.x1") - 0.1 * (F.col("a.bbox.x1") - F.col("a.bbox.x0"))) & (F.col("b.bbox.y0") < F.col("a.bbox.y0"))
    signal = F.when((F.col("a.page") == F.col("b.page")) & beside, "continuation-column").when(F.col("b.page") == F.col("a.page") + 1, "continuation-page")
    met = pairs.where("a.prose AND a.open AND b.prose AND b.lower").withColumn("signal", signal).where("signal IS NOT NULL")
    return met.select("doc_id", F.lit("continues_from").alias("type"), F.col("b.ord").alias("source"), F.col("a.ord").alias("target"), "signal")


def caption_links(elements: DataFrame, pages: DataFrame, gap: float = 0.08, share: float = 0.3) -> DataFrame:
    """Relations ``caption_of`` from captions, and from blocks that start like one, to the nearest table or figure.

    It overlaps the caption in ``share`` of the narrower of the two, lies above or below it within ``gap`` of the page's
    height, and nothing but captions, figures, furniture and blank elements is between. Of equally near ones the kind that the
    caption names is taken, then the first. Pairs meet within a page only.
    """
    e = elements.join(_heights(pages), ["doc_id", "page"]).where("bbox IS NOT NULL").withColumn("_words", _words())
    e = e.withColumn("_caption", (F.col("type") == "caption") | (F.col("type").isin(*BODY, "heading") & F.col("_words").rlike(CAPTION)))
    c = e.where("_caption").select("doc_id", "page", "_height", F.col("ord").alias("source"), F.col("bbox").alias("c"), F.col("_words").rlike(OF_TABLE).alias("_named"))
    t = e.where(F.col("type").isin("table", "figure")).select("doc_id", "page", F.col("ord").alias("target"), F.col("bbox").alias("t"), (F.col("type") == "table").alias("_table"))
    far = F.when(F.col("c.y1") <= F.col("t.y0") + 1, F.col("t.y0") - F.col("c.y1")).when(F.col("c.y0") >= F.col("t.y1") - 1, F.col("c.y0") - F.col("t.y1"))
    near = lambda a, b: F.coalesce(G.narrow_share(F.col(a), F.col(b)) >= share, F.lit(False))
    met = c.join(t, ["doc_id", "page"]).withColumn("_far", far).where((F.col("_far") <= gap * F.col("_height")) & near("c", "t"))
    stops = e.where(~F.col("_caption") & _said(F.col("text")) & ~F.col("type").isin("figure", *FURNITURE)).select("doc_id", "page", F.col("ord").alias("k"), F.col("bbox").alias("b"))
    first = F.col("c.y1") <= F.col("t.y0")
    low, high = F.when(first, F.col("c.y1")).otherwise(F.col("t.y1")) - 1, F.when(first, F.col("t.y0")).otherwise(F.col("c.y0")) + 1
    m, s = met.withColumns({"_low": low, "_high": high}).alias("m"), stops.alias("s")
    between = (F.col("s.k") != F.col("m.target")) & (F.col("b.y0") >= F.col("_low")) & (F.col("b.y1") <= F.col("_high")) & (near("b", "c") | near("b", "t"))
    free = m.join(s, (F.col("m.doc_id") == F.col("s.doc_id")) & (F.col("m.page") == F.col("s.page")) & between, "left_anti")
    best = free.groupBy("doc_id", "page", "source").agg(F.min(F.struct(F.greatest("_far", F.lit(0.0)).alias("far"), (F.col("_table") != F.col("_named")).alias("other"), "target")).alias("best"))
    return best.select("doc_id", F.lit("caption_of").alias("type"), "source", F.col("best.target").alias("target"), F.lit("caption-geometry").alias("signal"))


def typed_captions(elements: DataFrame, links: DataFrame) -> DataFrame:
    """Elements in which every source of a caption's link is a caption."""
    linked = links.select("doc_id", F.col("source").alias("ord"), F.lit(True).alias("_linked"))
    fresh = F.col("_linked").isNotNull() & (F.col("type") != "caption")
    e = elements.join(linked, ["doc_id", "ord"], "left").withColumn("_fresh", fresh)
    changed = {"type": F.when(F.col("_fresh"), "caption").otherwise(F.col("type"))}
    before = F.col("role_signal") if "role_signal" in elements.columns else F.lit(None).cast("string")
    changed["role_signal"] = F.when(F.col("_fresh"), "caption-pattern").otherwise(before)
    changed |= {c: F.when(~F.col("_fresh"), F.col(c)) for c in ("level", "level_signal") if c in elements.columns}
    return e.withColumns(changed).drop("_linked", "_fresh")


def _same(a: Column, b: Column, least: float) -> Column:
    """Two header keys that are alike; those whose lengths forbid it never leave the JVM."""
    short, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    near = (2.0 * short / both >= least) & (a != b)
    return F.coalesce(F.when(a == b, True).when(near, T._alike(F.when(near, a), F.when(near, b), F.lit(least))), F.lit(False))


def table_links(elements: DataFrame, share: float = 0.8) -> DataFrame:
    """Relations ``continues_table`` (later to earlier) of tables in pieces: the first later one to the right of a table on
    its page, and the first block of a page after a table that ends the page before.

    Elements have ``rows`` (arrays of struct(text, header)); a table without rows takes no part. Two pieces match when the
    later one's first row reads like the first or second row of the earlier (two cells or more), or it starts with data
    and both have as many columns, two or more. A caption that says "continued" above the later one stands for a match across pages.
    """
    norm = lambda c: F.array_join(T.plain_words(F.coalesce(c["text"], F.lit(""))), " ")
    cells = lambda i: F.filter(F.transform(F.get("rows", F.lit(i)), norm), lambda x: x != "")
    key = lambda i: F.when(F.size(cells(i)) >= 2, F.array_join(cells(i), " | "))
    filled = F.coalesce(F.size("rows"), F.lit(0)) > 0
    data = ~F.exists(F.get("rows", F.lit(0)), lambda c: F.coalesce(c["header"], F.lit(False)))
    it = F.struct("ord", "page", "bbox", ((F.col("type") == "table") & filled).alias("table"), key(0).alias("k0"), key(1).alias("k1"), F.array_max(F.transform("rows", F.size)).alias("width"), data.alias("data"))
    e = elements.select("doc_id", "page", "type", (_said(F.col("text")) | filled).alias("full"), _words().alias("words"), it.alias("a"))

    def alike() -> Column:
        same = _same(F.col("a.k0"), F.col("b.k0"), share) | _same(F.col("a.k1"), F.col("b.k0"), share)
        return same | F.coalesce(F.col("b.data") & (F.col("a.width") >= 2) & (F.col("a.width") == F.col("b.width")), F.lit(False))

    t = e.where("a.table").select("doc_id", "page", "a")
    high = F.least("a.bbox.y1", "b.bbox.y1") - F.greatest("a.bbox.y0", "b.bbox.y0")
    short = F.least(F.col("a.bbox.y1") - F.col("a.bbox.y0"), F.col("b.bbox.y1") - F.col("b.bbox.y0"))
    beside = t.join(t.withColumnRenamed("a", "b"), ["doc_id", "page"]).where((F.col("b.ord") > F.col("a.ord")) & (F.col("b.bbox.x0") >= F.col("a.bbox.x1") - 2) & (short > 0) & (high >= 0.5 * short))
    panels = beside.where(alike()).groupBy("doc_id", F.col("a.ord").alias("target")).agg(F.min("b.ord").alias("source")).withColumn("signal", F.lit("table-panel"))
    body = e.where(~F.col("type").isin("figure", "caption", *FURNITURE) & F.col("full"))
    follow = body.withColumn("b", F.lead("a").over(Window.partitionBy("doc_id").orderBy("a.ord"))).where("a.page > 0 AND b.page = a.page + 1 AND a.table AND b.table")
    told = e.where((F.col("type") == "caption") & F.col("words").rlike(CONTINUED)).groupBy("doc_id", F.col("page").alias("_next")).agg(F.min("a.ord").alias("_told"))
    follow = follow.withColumn("_next", F.col("b.page")).join(told, ["doc_id", "_next"], "left").withColumn("_said", F.coalesce(F.col("_told") < F.col("b.ord"), F.lit(False)))
    over = follow.where(F.col("_said") | alike()).select("doc_id", F.col("a.ord").alias("target"), F.col("b.ord").alias("source"), F.lit("table-page").alias("signal"))
    return panels.select("doc_id", "target", "source", "signal").union(over).select("doc_id", F.lit("continues_table").alias("type"), "source", "target", "signal")


def outlined(elements: DataFrame, outline: DataFrame) -> DataFrame:
    """Elements with the levels of an outline (doc_id, entry, page, level, title): the k-th entry of a page with some words
    levels the k-th heading, title or body block of up to three lines there that is just these words, and makes it a heading.
    Words are compared in lower case; an entry without words, or without a match, levels nothing."""
    norm = lambda c: F.array_join(T.plain_words(F.coalesce(c, F.lit(""))), " ")
    nth = lambda order: F.row_number().over(Window.partitionBy("doc_id", "page", "_n").orderBy(order))
    fit = F.col("type").isin("heading", "title", *BODY) & (F.size(F.split(_words(), "\n")) <= 3)
    e = elements.where(fit).select("doc_id", "page", "ord", norm(_words()).alias("_n")).where("_n <> ''")
    o = outline.where("page >= 1").select("doc_id", "page", F.col("entry").alias("_entry"), F.col("level").alias("_level"), norm(F.col("title")).alias("_n"))
    found = e.withColumn("_k", nth("ord")).join(o.withColumn("_k", nth("_entry")), ["doc_id", "page", "_n", "_k"]).select("doc_id", "ord", "_level")
    before = lambda c, kind: F.col(c) if c in elements.columns else F.lit(None).cast(kind)
    by = F.col("_level").isNotNull()
    fresh = by & ~F.col("type").isin("heading", "title")
    e = elements.join(found, ["doc_id", "ord"], "left").withColumn("_fresh", fresh)
    return e.withColumns({
        "type": F.when(F.col("_fresh"), "heading").otherwise(F.col("type")), "level": F.coalesce("_level", before("level", "int")),
        "level_signal": F.when(by, "pdf-outline").otherwise(before("level_signal", "string")), "role_signal": F.when(F.col("_fresh"), "pdf-outline").otherwise(before("role_signal", "string")),
    }).drop("_level", "_fresh")


def markers(text: Column) -> Column:
    """The numbers of a text's note markers in order."""
    inner = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(1)), ",")
    return F.transform(F.filter(F.split(inner, r"\s*,\s*"), lambda x: x != ""), lambda x: x.cast("int"))


def split_notes(elements: DataFrame) -> DataFrame:
    """(doc_id, page, ord, note, number, text, cited): the notes of each page's notes block, with the places that cite each.

    The block is the page's last body block or footnote without markers whose first line starts a note, with two or
    more notes: a line starts one if its number is cited on the page and larger than that of the note before. The notes
    together are exactly the block. Elements are those of pages with a text layer; pages without markers have no notes.
    """
    key = ["doc_id", "page"]
    starts = lambda t: F.nullif(F.regexp_extract(t, NOTE, 1), F.lit("")).try_cast("int")
    mine = F.when(F.col("doc_id").isNotNull() & F.col("page").isNotNull(), F.array_distinct(markers(F.col("text"))))
    cite = F.transform(mine, lambda n: F.struct(n.alias("number"), F.col("ord").alias("target"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("t")))
    plain = F.col("type").isin(*BODY, "footnote") & (F.size(markers(F.col("text"))) == 0)
    own = F.transform(F.when(plain, F.split("text", "\n")), lambda t, i: F.struct(starts(t).alias("number"), F.col("ord").alias("target"), i.alias("line"), t.alias("t")))
    # citations of a number and the lines that start with it meet in one row of their page
    each = elements.select(*key, F.explode(F.flatten(F.array_compact(F.array(cite, own)))).alias("x")).select(*key, "x.*")
    met = each.groupBy(*key, "number").agg(F.array_sort(F.collect_list(F.when(F.col("line").isNull(), F.col("target")))).alias("cited"), F.collect_list(F.when(F.col("line").isNotNull(), F.struct(F.col("target").alias("ord"), "line", "t"))).alias("lines"))
    lines = met.select(*key, "number", F.when(F.size("cited") > 0, F.col("cited")).alias("cited"), F.explode("lines").alias("l")).select(*key, "number", "cited", "l.*")
    block = Window.partitionBy(*key, "ord")
    known = F.when(F.col("cited").isNotNull(), F.col("number"))
    larger = F.col("number") > F.coalesce(F.max(known).over(block.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("begins", F.coalesce(F.col("cited").isNotNull() & larger, F.lit(False)))
    fit = lines.withColumns({"n": F.count_if("begins").over(block), "opens": F.max(F.col("begins") & (F.col("line") == 0)).over(block)}).where("n >= 2 AND opens")
    fit = fit.withColumn("last", F.max("ord").over(Window.partitionBy(*key))).where("ord = last")
    fit = fit.withColumn("note", F.sum(F.col("begins").cast("int")).over(block.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return fit.groupBy(*key, "ord", "note").agg(F.min(F.when(F.col("begins"), F.col("number"))).alias("number"), text.alias("text"), F.max(F.when(F.col("begins"), F.col("cited"))).alias("cited"))
