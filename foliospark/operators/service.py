"""Service rules as data: routes, limits, budgets, fallbacks, batch results, progress and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: File endings that are converted, and by what.
ROUTES = {"pdf": "pdf", "docx": "docx", "html": "html", "htm": "html", "md": "markdown", "txt": "text", "png": "image", "jpg": "image", "jpeg": "image"}
#: Entity labels that may be keywords.
ENTITY_LABELS = ("PERSON", "NORP", "FAC", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW", "LANGUAGE")
#: Digits that each kind of number is rounded to.
DIGITS = {"coordinate": 2, "coverage": 3, "score": 6, "fused": 4, "weight": 2, "region": 4}


def dispatch(name: Column) -> Column:
    """struct(route, error): the converter for a file name's ending; 415 for an unknown one."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in ROUTES.items() for x in pair))
    route = F.try_element_at(known, ending)
    return F.struct(route.alias("route"), F.when(route.isNull(), 415).alias("error"))


def decoded(payload: Column) -> Column:
    """The bytes of a base64 payload; null for anything that is none."""
    return F.try_to_binary(payload, F.lit("base64"))


def rounded(value: Column, kind: str) -> Column:
    return F.round(value, DIGITS[kind])


def within_spend(requests: DataFrame, budget: float) -> DataFrame:
    """Requests (ledger, ord, worst, cost or null if it failed) that are sent: before each, what is spent so far and its
    worst case must fit ``budget``. The first that does not fit ends the ledger unsent; a failed one is booked at its worst
    case and is the last."""
    upto = Window.partitionBy("ledger").orderBy("ord")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("cost", "worst")).over(earlier), F.lit(0.0))
    over = F.max(F.col("_before") + F.col("worst") > budget).over(upto)
    failed = F.coalesce(F.max(F.col("cost").isNull()).over(earlier), F.lit(False))
    sent = requests.withColumn("_before", before).withColumn("_over", over | failed).where("NOT _over")
    return sent.drop("_over").withColumnRenamed("_before", "spent_before")


def strict_regions(text: Column, finish: Column) -> Column:
    """struct(n, malformed, error) of a model's JSON answer: only a code fence around it is removed; one cut off by the
    token limit, or that is no JSON array, is an error; items without a box of four numbers are counted, never mended."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-z]*\s*", ""), r"\s*```$", "")
    items = F.from_json(bare, "array<struct<box:array<double>,label:string>>")
    good = F.filter(items, lambda x: F.coalesce((F.size(x["box"]) == 4) & F.forall(x["box"], lambda b: b.isNotNull()), F.lit(False)))
    error = F.when(finish == "length", "cut off").when(~bare.rlike(r"^\[") | items.isNull() | F.get_json_object(bare, "$").isNull(), "no array")
    return F.struct(F.when(error.isNull(), F.size(good)).alias("n"), F.when(error.isNull(), F.size(items) - F.size(good)).alias("malformed"), error.alias("error"))


def label_scores(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """Pooled recall and precision of each label over pairs (gold, output) of types."""
    one = pairs.withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    hit = F.count_if((F.col("gold") == F.col("label")) & (F.col("output") == F.col("label")))
    out = one.groupBy("label").agg(hit.alias("hits"), F.count_if(F.col("gold") == F.col("label")).alias("n_gold"), F.count_if(F.col("output") == F.col("label")).alias("n_output"))
    return out.withColumns({"recall": F.round(F.try_divide("hits", "n_gold"), 6), "precision": F.round(F.try_divide("hits", "n_output"), 6)})


def grid(settings: list[tuple], entries: DataFrame, value: Column, names: tuple[str, ...], base: tuple) -> DataFrame:
    """Per setting and split: mean value, and entries better and worse than with the ``base`` setting, for ``value`` of an
    entry's columns and the setting's. Each entry meets the fixed settings only, in its own row."""
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, s, strict=True))) for s in settings))
    rows = entries.withColumn("s", F.explode(each)).select("*", "s.*").withColumn("value", value)
    is_base = reduce(lambda a, b: a & b, (F.col(n) == v for n, v in zip(names, base, strict=True)))
    at_base = F.max(F.when(is_base, F.col("value"))).over(Window.partitionBy("entry"))
    better, worse = F.count_if(F.col("value") > F.col("_base") + 0.0005), F.count_if(F.col("value") < F.col("_base") - 0.0005)
    return rows.withColumn("_base", at_base).groupBy(*names, "split").agg(F.round(F.avg("value"), 6).alias("mean"), better.alias("better"), worse.alias("worse"))


def leg_report(requests: DataFrame) -> DataFrame:
    """Per leg of (leg, page, outcome, seconds): counts by outcome, mean, median and maximum seconds."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "fallback", "failed")]
    return requests.groupBy("leg").agg(*counts, F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.median("seconds"), 6).alias("median"), F.max("seconds").alias("longest"))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """(page, same): whether two runs' texts (page, text) are equal byte by byte; false where one lacks the page."""
    digest = lambda df, name: df.select("page", F.sha2("text", 256).alias(name))
    return digest(a, "_a").join(digest(b, "_b"), "page", "full").select("page", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("same"))


def refusal(n_pages: Column, size: Column, kind: Column, most_pages: int = 20, most_bytes: int = 25 << 20, kinds: tuple[str, ...] = ("pdf", "png", "jpg")) -> Column:
    """Why a file is refused, or null: its type, its size, its pages, in this order."""
    return F.when(~F.coalesce(kind, F.lit("")).isin(*kinds), "type").when(size > most_bytes, "size").when(n_pages > most_pages, "pages")


def _document_stages(kind: Column, probe: Column, engine: Column, reader: Column) -> Column:
    """Stages for a document of one kind; ``probe`` is what its bytes look like (scan, text, or null and mixed)."""
    of = lambda *names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    remote = F.when(engine == "docling", "docling").when(engine == "glm-ocr", "glm")
    fast = engine == "fast"
    scan = F.concat(F.when(fast, of("ocrFast")).otherwise(of("ocr")), F.when(fast, none).otherwise(of("layout")))
    local = F.when(kind == "image", scan).when(probe == "scan", F.concat(of("inspect"), scan)).when(probe == "text", of("inspect", "textLayer")).otherwise(of("inspect", "read"))
    word = F.when(engine == "docling", of("docling")).otherwise(of("mammoth"))
    made = F.when(kind == "docx", word).otherwise(F.concat(F.when(remote.isNotNull(), F.array(remote)).otherwise(local), of("structure")))
    return F.concat(made, F.when(reader, of("reader")).otherwise(none))


def stages(url: Column, kinds: Column, probes: Column, engine: Column, chapters: Column, reader: Column) -> Column:
    """The stages that a request will run, in order: of a link (``url``), or of files of the given kinds and probes.

    A link to a PDF is opened and downloaded, any other page is rendered and its main text extracted. Files of several
    kinds are one mixed stage. Chapters are split for one document only.
    """
    of = lambda *names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    asked = F.coalesce(engine, F.lit("pymupdf"))
    link = F.when(url.rlike(r"(?i)\.pdf($|[?#])"), F.concat(of("render", "fetchPdf"), _document_stages(F.lit("pdf"), F.lit(None), asked, F.lit(False)))).otherwise(of("render", "extract"))
    found = F.filter(probes, lambda p: p.isNotNull())
    some = lambda name: F.exists(found, lambda p: p == name)
    merged = F.when(F.size(found) == 0, None).when(some("scan") & some("text"), "mixed").when(some("scan"), "scan").otherwise("text")
    probe = F.when(F.size(kinds) == 1, F.get(probes, F.lit(0))).otherwise(merged)
    several = F.concat(of("mixed"), F.when(asked == "pymupdf", of("structure")).otherwise(none), F.when(reader, of("reader")).otherwise(none))
    one = _document_stages(F.coalesce(F.get(kinds, F.lit(0)), F.lit("pdf")), F.when(F.size(kinds) > 0, probe), asked, reader)
    files = F.concat(of("upload"), F.when(F.size(F.array_distinct(kinds)) > 1, several).otherwise(one))
    single = url.isNotNull() | (F.size(kinds) <= 1)
    return F.concat(F.when(url.isNotNull(), link).otherwise(files), F.when(chapters & single, of("chapters")).otherwise(none), of("normalize", "markdown"))


def progress(done: Column, total: Column) -> Column:
    """The share shown: pages done of all, which past nine tenths nears 0.98 and never reaches it."""
    x = F.try_divide(done, total)
    return F.when(x <= 0.9, x).otherwise(0.9 + 0.08 * (1 - F.exp(-2.5 * (x - 0.9))))


def usage_state(used: Column, allowance: Column) -> Column:
    share = F.try_divide(used, allowance)
    return F.when(share >= 1, "over").when(share >= 0.8, "warn").otherwise("ok")


def probe_kind(pages: DataFrame) -> DataFrame:
    """(doc_id, kind) of pages (doc_id, scanned): scan, text, or mixed where it has both."""
    scan, text = F.bool_or("scanned"), F.bool_or(~F.col("scanned"))
    return pages.groupBy("doc_id").agg(F.when(scan & text, "mixed").when(scan, "scan").otherwise("text").alias("kind"))


#: Requests, about, that one task asks for.
ASKED = 150_000


def ladder(requests: DataFrame, *engines: DataFrame) -> DataFrame:
    """Requests (id) with the first engine's (id, text or null for a failure) that has a text: each engine gets what all
    before it failed on. ``engine`` is its number from 1, null where all failed. All are dealt by id to tasks of about ASKED requests."""
    parts = max(requests.sparkSession.sparkContext.defaultParallelism, -(-requests.count() // ASKED))
    left, out = requests.select("id").repartition(parts, "id"), None
    for n, engine in enumerate(engines, 1):
        good = engine.where("text IS NOT NULL").select("id", "text").repartition(parts, "id")
        got = left.join(good, "id").withColumn("engine", F.lit(n))
        out = got if out is None else out.union(got)
        left = left.join(good, "id", "left_anti")
    return out.union(left.withColumns({"text": F.lit(None).cast("string"), "engine": F.lit(None).cast("int")}))


def batch_results(files: DataFrame, most: int) -> DataFrame:
    """One row for each file (batch, ord, name, text or null for an error) in send order: status, error, and a file name for
    good rows only, numbered among those of its name; a batch of over ``most`` files is refused as a whole."""
    n = F.count("*").over(Window.partitionBy("batch"))
    ok = F.col("text").isNotNull() & (F.col("_n") <= most)
    same = F.row_number().over(Window.partitionBy("batch", ok, "name").orderBy("ord"))
    shown = F.when(ok, F.concat("name", F.when(F.col("_k") > 1, F.concat(F.lit("-"), F.col("_k").cast("string"))).otherwise(""), F.lit(".md")))
    error = F.when(F.col("_n") > most, "too many files").when(F.col("text").isNull(), "not converted")
    return files.withColumn("_n", n).withColumn("_k", same).select("batch", "ord", F.when(ok, "ok").otherwise("error").alias("status"), error.alias("error"), shown.alias("filename"))


def top_k_error(top_k: Column, most: int = 100) -> Column:
    """Why a limit is refused, or null; a missing one is the default."""
    return F.when(F.coalesce(top_k, F.lit(20)).between(1, most), None).otherwise(f"top_k must be from 1 to {most}")


def exclusive_error(batch: Column, chapters: Column) -> Column:
    return F.when(batch & chapters, "a batch cannot be split into chapters")


def unknown_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Names that were asked for and are not known, each once."""
    return asked.select("name").distinct().join(known.select("name"), "name", "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(lost, added): how many rows only one side has, repeats counted; both zero means equal."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(a.exceptAll(b), "lost").withColumn("one", F.lit(1)).join(count(b.exceptAll(a), "added").withColumn("one", F.lit(1)), "one").drop("one")


def latest(checks: DataFrame) -> DataFrame:
    """The snapshot of each url after its checks (url, seq, markdown or null for a failure): its last good text, and a file
    name of the first 16 hex digits of the url's SHA-256."""
    good = checks.where("markdown IS NOT NULL").groupBy("url").agg(F.max_by("markdown", "seq").alias("markdown"), F.max("seq").alias("seq"))
    return good.select("url", F.left(F.sha2("url", 256), F.lit(16)).alias("file_key"), "seq", "markdown")


#: The methods in the order that a table names them.
METHODS = ("frequency", "yake", "spacy", "keybert")
#: Marks around a keyword table in a document.
OPEN, CLOSE = "<!-- keywords -->", "<!-- /keywords -->"


def keyword_table(ranked: DataFrame, key: str) -> DataFrame:
    """(key, markdown): the keywords (rank, keyword, weight, methods; rows without a keyword count for nothing) of each key
    as a table with a caption that names the methods used; ``note`` follows it, or stands for it where there are none."""
    known = F.array(*map(F.lit, METHODS))
    named = lambda of: F.array_join(F.filter(known, lambda m: F.array_contains(of, m)), ", ")
    cell = F.trim(F.replace(F.replace("keyword", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    row = F.concat(F.lit("| "), cell, F.lit(" | "), F.format_string("%.2f", F.col("weight").cast("double")), F.lit(" | "), named(F.col("methods")), F.lit(" |"))
    has = F.col("keyword").isNotNull()
    made = ranked.groupBy(key).agg(
        F.count_if(has).alias("n"), F.sort_array(F.collect_list(F.when(has, F.struct("rank", row.alias("row"))))).alias("rows"), F.flatten(F.collect_list(F.when(has, F.col("methods")))).alias("used"), F.max("note").alias("note")
    )
    lines = F.array_join(F.transform("rows", lambda x: x["row"]), "\n")
    many = F.when(F.col("n") == 1, "").otherwise("s")
    used = F.coalesce(F.nullif(named(F.col("used")), F.lit("")), F.lit("no method"))
    caption = F.concat(F.lit("*"), F.col("n").cast("string"), F.lit(" keyword"), many, F.lit(" extracted by "), used, F.lit(". Weight is relative to the top-ranked term (1.00), fused across methods by rank.*"))
    table = F.concat(F.lit("| Keyword | Weight | Found by |\n| --- | ---: | --- |\n"), lines, F.lit("\n\n"), caption, F.coalesce(F.concat(F.lit("\n\n*"), "note", F.lit("*")), F.lit("")))
    reason = F.concat(F.lit("*"), F.coalesce("note", F.lit("No keywords were extracted.")), F.lit("*"))
    return made.select(key, F.concat(F.lit("## Keywords\n\n"), F.when(F.col("n") > 0, table).otherwise(reason), F.lit("\n")).alias("markdown"))


def without_table(markdown: Column) -> Column:
    """A document without the keyword table put into it."""
    bare = F.regexp_replace(markdown, f"(?s)^(.*?){OPEN}.*?{CLOSE}\\n*", "$1")
    return F.when(F.contains(markdown, F.lit(OPEN)), F.regexp_replace(bare, r"^\n+", "")).otherwise(markdown)


def with_table(markdown: Column, table: Column) -> Column:
    """A document with its keyword table between marks, in the place of an earlier one: below the heading that opens it,
    else on top. Twice is as once, but that line feeds that lead the document go with the earlier one."""
    bare = without_table(markdown)
    head = F.regexp_extract(bare, r"^((?:[^\S\n]*\n)*#{1,6}\s+[^\n]+)", 1)
    tail = F.regexp_replace(F.substring(bare, F.length(head) + 1, F.length(bare)), r"^\n+|\n+$", "")
    block = F.concat(F.lit(f"{OPEN}\n\n"), table, F.lit(f"\n{CLOSE}"))
    return F.concat(F.array_join(F.filter(F.array(F.regexp_replace(head, r"\n+$", ""), block, tail), lambda p: p != ""), "\n\n"), F.lit("\n"))


def pooled_votes(rankings: DataFrame) -> DataFrame:
    """(doc_id, key, votes): how many methods propose a candidate (doc_id, method, key)."""
    return rankings.select("doc_id", "method", "key").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("votes"))
