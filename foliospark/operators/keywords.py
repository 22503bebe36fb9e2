"""Keywords: n-grams between breaks, structural frequency, rank fusion, subsumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import BREAK, let, stemmed_words, without_fences
from .phrases import by_document

#: Words that no phrase holds.
STOP = """
    a about above after again against all almost also although always am among an and another any
    anyone anything are around as at be because been before being below between both but by came
    can cannot could did do does doing done down during each either else enough etc even ever every
    few for from further had has have having he her here hers herself him himself his how however i
    if in into is it its itself just made make many may me might more most much must my myself
    neither never nevertheless no nor not now of off often on once one only onto or other others our
    ours ourselves out over own perhaps rather really same seem seen several shall she should since
    so some somewhat still such than that the their theirs them themselves then there therefore
    these they this those though through thus to too toward towards under until up upon us use used
    using very was we well were what when where whether which while who whom whose why will with
    within without would yet you your yours yourself yourselves
""".split()
#: Connective words of reports, which end a phrase too.
BREAKERS = "including include includes included following follows followed said says say per via".split()
BOUNDARY = [*STOP, *BREAKERS]
MAX_WORDS, MIN_WORD, MIN_TEXT, RRF_K = 4, 3, 200, 60
BONUS = (1.0, 1.4, 1.6, 1.6)


def ngrams(docs: DataFrame, sizes: int = MAX_WORDS, phrases: bool = False) -> DataFrame:
    """(doc_id, key, size, occurrences): stemmed n-grams of one to ``sizes`` words that no break divides; with ``phrases``
    only those without a boundary word, which are never made: a segment is cut at them first.

    Texts are dealt by document, and all n-grams of a document are made and counted in its task.
    """
    segments = by_document(docs.select("doc_id", "text")).select("doc_id", F.explode_outer(F.split("text", BREAK)).alias("s")).where("s is not null")
    return _grams(segments, sizes, phrases).groupBy("doc_id", "key", "size").agg(F.count("*").alias("occurrences"))


def _grams(segments: DataFrame, sizes: int, phrases: bool) -> DataFrame:
    """The n-grams (key, size) of segments ``s``, one row each, beside their other columns. Of ``explode`` Spark would ask first
    whether there is anything in the array, which makes it twice more; ``explode_outer`` makes it once."""
    others = [c for c in segments.columns if c != "s"]
    each = segments.select(*others, stemmed_words(F.col("s")).alias("ws"))
    if phrases:
        cut = F.array_join(F.transform("ws", lambda w: F.when(w.isin(BOUNDARY), "\x01").otherwise(w)), " ")
        each = each.select(*others, F.explode_outer(F.split(cut, " ?\x01 ?")).alias("r")).where("r <> ''").select(*others, F.split("r", " ").alias("ws"))
    of = F.flatten(F.array(*(_windows(F.col("ws"), k) for k in range(1, sizes + 1))))
    return each.select(*others, F.explode_outer(of).alias("g")).where("g is not null").select(*others, F.col("g.key").alias("key"), F.col("g.size").alias("size"))


def _windows(seg: Column, k: int) -> Column:
    none = F.array().cast("array<struct<key:string,size:int>>")
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(seg) - (k - 1), F.lit(1))), lambda i: F.struct(F.array_join(F.slice(seg, i, F.lit(k)), " ").alias("key"), F.lit(k).alias("size")))
    return F.when(F.size(seg) >= k, made).otherwise(none)


def substantial(key: Column) -> Column:
    """Whether a key has a word of three characters that is no number."""
    return key.rlike(rf"(?:^| )(?!\p{{N}}+(?: |$))[^ ]{{{MIN_WORD},}}")


def usable(key: Column) -> Column:
    """A key worth ranking: no boundary word, not digits alone, and a word of three characters that is no number."""
    parts = F.split(key, " ")
    stop = F.array(*map(F.lit, BOUNDARY))
    return ~F.arrays_overlap(parts, stop) & F.exists(parts, lambda w: (F.length(w) >= MIN_WORD) & ~w.rlike(r"^\p{N}+$"))


def frequency(docs: DataFrame, top_k: int = 20, min_text: int = MIN_TEXT) -> DataFrame:
    """(doc_id, rank, key, score, occurrences): the structural frequency of prose without headings."""
    grams = ngrams(docs.where(F.length("text") >= min_text), phrases=True).where(F.when(F.col("occurrences") >= 2, substantial(F.col("key"))).otherwise(False))
    bonus = F.element_at(F.array(*map(F.lit, BONUS)), F.col("size"))
    scored = grams.withColumn("score", F.round(F.col("occurrences") * bonus, 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "key"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top_k).select("doc_id", "rank", "key", "score", "occurrences")


#: Names that documents give their own parts; as keys, lower case and singular.
SECTION_NAMES = """abstract|acknowledgement|annex|appendix|background|bibliography|conclusion|content|executive summary|figure|finding|foreword|glossary|index|introduction|method|methodology|overview|preface|recommendation|reference|result|scope|summary|table|table of content""".split("|")


def _inline(text: Column) -> Column:
    """A line's words without inline Markdown and tags."""
    for pattern, kept in ((r"<!--.*?-->", " "), (r"!\[([^\]\n]*)\]\([^)\n]*\)", " $1 "), (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"), (r"`+([^`\n]*)`+", "$1"), (r"</?[A-Za-z][^>\n]*>", " "), (r"(\*{1,3}|_{1,3}|~~)(?=\S)(.+?)(?<=\S)\1", "$2")):
        text = F.regexp_replace(text, pattern, kept)
    return F.trim(text)


def _ended(line: Column) -> Column:
    bare = F.rtrim(line)
    return F.when((bare == "") | bare.rlike(r"""[.!?:;]["')]?$"""), line).otherwise(F.concat(bare, F.lit(".")))


def zones(docs: DataFrame) -> DataFrame:
    """(doc_id, prose, title, headings, emphasis) of Markdown: fenced code, rules and table delimiters go, the words that
    quotes, lists, links, images, code and emphasis wrap stay; headings, items and last lines of blocks end with a stop."""
    lines = F.filter(F.split(without_fences(F.col("text")), "\n"), lambda x: ~x.rlike(r"^ {0,3}((-[ \t]*){3,}|(\*[ \t]*){3,}|(_[ \t]*){3,})$") & ~x.rlike(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"))
    head = r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$"

    def shown(x: Column) -> Column:
        unquoted = F.regexp_replace(x, r"^[ \t]*(>[ \t]?)+", "")
        listed = unquoted.rlike(r"^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]+")
        words = _inline(F.replace(F.regexp_replace(unquoted, r"^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]+", ""), F.lit("|"), F.lit(" . ")))
        return F.when(x.rlike(head), _ended(_inline(F.regexp_extract(x, head, 2)))).when(listed, _ended(words)).otherwise(words)

    closed = lambda ls: F.transform(ls, lambda x, i: F.when((F.trim(x) != "") & (F.trim(F.coalesce(F.get(ls, i + 1), F.lit(""))) == ""), _ended(x)).otherwise(x))
    heads = F.transform(F.filter("_lines", lambda x: x.rlike(head)), lambda x: _inline(F.regexp_extract(x, head, 2)))
    bold = F.transform(F.regexp_extract_all("text", F.lit(r"\*\*(?=\S)(.+?)(?<=\S)\*\*"), F.lit(1)), _inline)
    cut = docs.select("doc_id", "text", lines.alias("_lines")).select("doc_id", "text", "_lines", heads.alias("_heads"))  # each made once
    return cut.select("doc_id", F.array_join(let(F.transform("_lines", shown), closed), "\n").alias("prose"), F.coalesce(F.get("_heads", F.lit(0)), F.lit("")).alias("title"), F.array_join("_heads", " . ").alias("headings"), F.array_join(bold, " . ").alias("emphasis"))


def prominent(docs: DataFrame, top_k: int = 20, min_text: int = MIN_TEXT) -> DataFrame:
    """(doc_id, rank, key, score, occurrences, in_title, in_heading): structural frequency of Markdown. A key of the title
    counts three times, of a heading twice (of both four times), of bold text 0.3 more; names of sections get no such credit,
    and a key that occurs once needs to be in the title or a heading."""
    zone = lambda z, name, at, sign: F.transform(F.split(z[name], sign), lambda x: F.struct(F.lit(at).alias("zone"), x.alias("s")))
    every = lambda z: F.when(F.length(z["prose"]) >= min_text, F.concat(zone(z, "prose", 0, BREAK), *(zone(z, n, k, r" \. ") for k, n in enumerate(("title", "headings", "emphasis"), 1))))
    z = zones(by_document(docs.select("doc_id", "text"))).select("doc_id", F.explode_outer(let(F.struct("prose", "title", "headings", "emphasis"), every)).alias("z")).where("z is not null")
    grams = _grams(z.select("doc_id", "z.zone", "z.s"), MAX_WORDS, True)
    in_zone = lambda k: F.max(F.col("zone") == k)
    grams = grams.groupBy("doc_id", "key", "size").agg(F.count_if(F.col("zone") == 0).alias("occurrences"), in_zone(1).alias("_t"), in_zone(2).alias("_h"), in_zone(3).alias("_bold")).where("occurrences > 0")
    free = ~F.col("key").isin(SECTION_NAMES)
    met = grams.withColumns({"in_title": F.col("_t") & free, "in_heading": F.col("_h") & free})
    met = met.where(F.when((F.col("occurrences") >= 2) | F.col("in_title") | F.col("in_heading"), substantial(F.col("key"))).otherwise(False))
    more = 1.0 + F.when(F.col("in_title"), 2.0).otherwise(0.0) + F.when(F.col("in_heading"), 1.0).otherwise(0.0) + F.when(F.col("_bold"), 0.3).otherwise(0.0)
    scored = met.withColumn("score", F.round(F.col("occurrences") * F.element_at(F.array(*map(F.lit, BONUS)), F.col("size")) * more, 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "key"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top_k).select("doc_id", "rank", "key", "score", "occurrences", "in_title", "in_heading")


def fuse(rankings: dict[str, DataFrame], top_k: int = 20) -> DataFrame:
    """Reciprocal rank fusion of rankings (doc_id, rank, key): one vote per key and method, its best rank."""
    votes = None
    for method, r in rankings.items():
        own = r.groupBy("doc_id", "key").agg(F.min("rank").alias("rank")).withColumn("method", F.lit(method))
        votes = own if votes is None else votes.unionByName(own)
    fused = votes.groupBy("doc_id", "key").agg(F.sum(F.lit(1.0).cast("double") / (F.lit(RRF_K) + F.col("rank"))).alias("s"), F.count("*").alias("agreement"))
    fused = fused.withColumn("s", F.round("s", 12))
    w = Window.partitionBy("doc_id")
    fused = fused.withColumn("score", F.round(F.col("s") / F.max("s").over(w), 4)).withColumn("rank", F.row_number().over(w.orderBy(F.col("s").desc(), "key")).cast("long"))
    return fused.where(F.col("rank") <= top_k).select("doc_id", "rank", "key", "score", "agreement")


def drop_subsumed(ranked: DataFrame) -> DataFrame:
    """Of (doc_id, rank, key, occurrences), in rank order, without keys that only occur within a kept longer one."""

    def put(kept: Column, x: Column) -> Column:
        longer = lambda o: (F.length(o["key"]) > F.length(x["key"])) & (o["occurrences"] >= x["occurrences"])
        inside = F.exists(kept, lambda o: F.when(longer(o), F.contains(F.concat(F.lit(" "), o["key"], F.lit(" ")), F.concat(F.lit(" "), x["key"], F.lit(" ")))).otherwise(False))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    row = F.struct(F.col("rank").alias("_rank"), *ranked.columns)
    lists = ranked.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("all"))
    kind = "array<" + lists.schema["all"].dataType.elementType.simpleString() + ">"
    return lists.select(F.inline(F.aggregate("all", F.array().cast(kind), put))).select(*ranked.columns)
