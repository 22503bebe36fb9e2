"""Elements of a document as Markdown blocks by their relations: broken paragraphs joined, captions as figures' texts, repeated
header rows and notes' marks. Elements and relations are those of ``elements.py``, with places (``ord``) as ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from . import elements as E, passes as P

#: The relation by which a paragraph that a column breaks is written as one; across pages both parts stand alone.
JOINED = "continuation-column"
SPAN = r"<sup>\s*[0-9]{1,2}(?:\s*,\s*[0-9]{1,2})*\s*</sup>"


def with_note_marks(text: Column, numbers: Column) -> Column:
    """A text whose raised numbers are marks of notes where every number of a marker is one of ``numbers``."""
    def marked(t: Column, m: Column) -> Column:
        mine = P.markers(m)
        new = F.array_join(F.transform(mine, lambda n: F.concat(F.lit("[^"), n.cast("string"), F.lit("]"))), "")
        return F.when(F.forall(mine, lambda n: F.array_contains(numbers, n)), F.replace(t, m, new)).otherwise(t)

    spans = F.array_distinct(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)))
    return F.when(F.size(F.coalesce(numbers, F.array().cast("array<int>"))) == 0, text).otherwise(F.aggregate(spans, text, marked))


def _by_page(elements: DataFrame) -> DataFrame:
    """Elements with the run of consecutive elements of one page that each is in."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    fresh = F.when(F.lag("page").over(w).eqNullSafe(F.col("page")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return elements.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w)).drop("_new")


def units(elements: DataFrame, relations: DataFrame, reader: bool = False, assets: bool = False, tasks: int | None = None) -> DataFrame:
    """(doc_id, run, ord, page, unit, members): each page's Markdown blocks with the places of the elements in them.

    An element is a block; one that goes on from an earlier one of its page by ``JOINED`` follows it in the same block on a new
    line. A figure's image takes the words of its first caption; a block whose first element is cited by notes of its page
    gets their marks. ``reader`` leaves out page furniture and the first row of a table that repeats that of the table it
    continues. Empty blocks are left out. Relations point from later to earlier elements; an element goes on from one
    other at most. Relations of elements that do not exist, or of two pages where one is needed, say nothing. Documents are
    dealt to ``tasks`` tasks.
    """
    e = _by_page(elements)
    head = lambda rows: F.transform(F.get(rows, F.lit(0)), lambda c: F.array_join(T.plain_words(F.coalesce(c["text"], F.lit(""))), " "))
    number = lambda text: F.nullif(F.regexp_extract(text, E.NOTE_NUMBER, 2), F.lit("")).try_cast("int")
    held = F.struct(*(c for c in e.columns if c != "doc_id"))
    kind, one = "array<" + e.select(held.alias("e")).schema["e"].dataType.simpleString() + ">", F.get("els", F.lit(0))
    told = F.struct(F.col("type").alias("kind"), F.col("signal").alias("why"), F.col("target").cast("long").alias("target"))
    # elements and relations meet at the place of a relation's source, then of its target, then what a target tells goes to the
    # sources: all of it within documents, so their rows are dealt once
    none = {"els": F.lit(None).cast(kind), "rel": F.lit(None).cast("struct<kind:string,why:string,target:bigint>")}
    rows = e.select("doc_id", F.col("ord").cast("long").alias("at"), F.array(held).alias("els"), none["rel"].alias("rel"))
    rows = rows.unionByName(relations.where("doc_id IS NOT NULL").select("doc_id", F.col("source").cast("long").alias("at"), none["els"].alias("els"), told.alias("rel"))).repartition(*([tasks] if tasks else []), "doc_id")
    met = rows.groupBy("doc_id", "at").agg(F.flatten(F.collect_list("els")).alias("els"), F.collect_list("rel").alias("rels")).where(F.size("els") > 0)

    def side(of: Column) -> Column:
        facts = F.struct(of["_run"].alias("run"), (of["type"] == "table").alias("table"), F.size(of["rows"]).alias("n"), head(of["rows"]).alias("head"), number(of["text"]).alias("number"), E.heading_words(of["text"], of["text_format"]).alias("words"))
        return F.when(F.size("rels") > 0, facts)

    met = met.withColumn("s", side(one))
    sent = F.transform("rels", lambda r: F.struct(r["target"].alias("at"), none["els"].alias("els"), F.struct(r["kind"].alias("kind"), r["why"].alias("why"), F.col("at").alias("source"), F.col("s").alias("s")).alias("rel")))
    stay = F.array(F.struct("at", "els", F.lit(None).cast(met.select(sent.alias("x")).schema["x"].dataType.elementType["rel"].dataType).alias("rel")))
    met = met.select("doc_id", F.inline(F.concat(stay, sent))).groupBy("doc_id", "at").agg(F.flatten(F.collect_list("els")).alias("els"), F.collect_list("rel").alias("rels")).where(F.size("els") > 0).withColumn("t", side(one))
    here = lambda r: r["s"]["run"] == F.col("t.run")
    goes_on = lambda r: here(r) & (r["kind"] == "continues_from") & (r["why"] == JOINED) & (F.col("at") < r["source"])
    cites = lambda r: here(r) & (r["kind"] == "footnote_for") & (r["why"] == E.NOTE_SIGNAL)
    same = lambda r: (r["s"]["n"] > 1) & (F.col("t.n") > 0) & (r["s"]["head"] == F.col("t.head")) & F.exists(r["s"]["head"], lambda x: x != "")
    again = lambda r: (r["kind"] == "continues_table") & r["s"]["table"] & F.col("t.table") & same(r)
    sources = lambda rule: F.transform(F.filter("rels", rule), lambda r: r["source"])
    alt = F.array_min(F.transform(F.filter("rels", lambda r: here(r) & (r["kind"] == "caption_of")), lambda r: F.struct(r["source"].alias("source"), r["s"]["words"].alias("words"))))["words"]
    numbers = F.array_distinct(F.array_compact(F.transform(F.filter("rels", cites), lambda r: r["s"]["number"])))
    met = met.select("doc_id", "at", "els", *((F.when(F.size("rels") > 0, x).alias(n)) for n, x in (("numbers", numbers), ("alt", alt), ("next", F.array_max(sources(goes_on))), ("repeats", sources(again) if reader else F.array().cast("array<bigint>")))))
    fact = lambda at, els=none["els"], numbers=F.lit(None).cast("array<int>"), alt=F.lit(None).cast("string"), before=F.lit(None).cast("long"), again=F.lit(None).cast("boolean"): F.struct(at.alias("at"), els.alias("els"), numbers.alias("numbers"), alt.alias("alt"), before.alias("before"), again.alias("again"))
    facts = F.array(fact(F.col("at"), F.col("els"), F.col("numbers"), F.col("alt")), F.when(F.col("next").isNotNull(), fact(F.col("next"), before=F.col("at"))))
    facts = F.concat(F.array_compact(facts), F.coalesce(F.transform("repeats", lambda x: fact(x, again=F.lit(True))), F.slice(facts, 1, 0)))
    met = met.select("doc_id", F.inline(facts)).groupBy("doc_id", "at").agg(F.flatten(F.collect_list("els")).alias("els"), *(F.first(c, ignorenulls=True).alias(c) for c in ("numbers", "alt")), *(F.max(c).alias(c) for c in ("before", "again")))
    e = met.select("doc_id", F.explode("els").alias("e"), "numbers", "alt", "before", "again").select("doc_id", "e.*", "numbers", "alt", "before", "again")
    if reader:
        e = e.where(~F.col("type").isin(*E.FURNITURE))
    rows = F.when(F.col("again"), F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1)))).otherwise(F.col("rows"))
    shown = E.render(e, assets=assets, alt=F.col("alt"), rows=rows)
    item = F.struct(F.col("ord").cast("long").alias("ord"), F.col("before").cast("long").alias("before"), shown.alias("unit"), F.col("numbers"))
    pages = e.groupBy("doc_id", "_run").agg(F.first("page").alias("page"), F.array_sort(F.collect_list(item)).alias("items"))
    block = lambda x: F.struct(F.array(x["ord"]).alias("members"), x["unit"].alias("unit"), x["numbers"].alias("numbers"))

    def put(done: Column, x: Column) -> Column:
        held = lambda g: F.array_contains(g["members"], x["before"])
        longer = lambda g: F.struct(F.concat(g["members"], F.array(x["ord"])).alias("members"), F.concat(F.regexp_replace(g["unit"], r"\n+\z", ""), F.lit("\n"), F.regexp_replace(x["unit"], r"\A\n+", "")).alias("unit"), g["numbers"].alias("numbers"))
        goes = x["before"].isNotNull() & F.exists(done, lambda g: F.coalesce(held(g), F.lit(False)))
        return F.when(goes, F.transform(done, lambda g: F.when(held(g), longer(g)).otherwise(g))).otherwise(F.concat(done, F.array(block(x))))

    none = F.array().cast("array<struct<members:array<bigint>,unit:string,numbers:array<int>>>")
    broken = F.exists("items", lambda x: x["before"].isNotNull())
    blocks = F.when(broken, F.aggregate("items", none, put)).otherwise(F.transform("items", block))
    out = pages.select("doc_id", F.col("_run").alias("run"), "page", F.explode(blocks).alias("b"))
    unit = with_note_marks(F.col("b.unit"), F.col("b.numbers"))
    return out.select("doc_id", "run", F.get("b.members", F.lit(0)).alias("ord"), "page", unit.alias("unit"), F.col("b.members").alias("members")).where("unit <> ''")


def document_markdown(elements: DataFrame, relations: DataFrame, reader: bool = False, assets: bool = False, tasks: int | None = None) -> DataFrame:
    """(doc_id, markdown): the blocks of a page joined by blank lines and stripped, then the pages; blank pages are left out."""
    return E.to_markdown(units(elements, relations, reader, assets, tasks).select("doc_id", "page", "ord", F.lit("unit").alias("type"), "unit"))
