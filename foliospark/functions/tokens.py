"""Columns over words, chunks and vectors of a text: tests of recognised words, escapes, similarities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

#: Short words that recognition gives rightly.
SHORT = "a i an of to in on by is at or as be it we no mm cm".split()
_TOKEN = r"[\p{L}\p{N}]+"


def even_chunks(text: Column, size: int, limit: int) -> Column:
    """Chunks of ``size`` characters, at most ``limit``, evenly spread over the text."""
    n = F.ceil(F.length(text) / size).cast("int")
    step = F.greatest(F.ceil(n / limit).cast("int"), F.lit(1))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.substring(text, k * size + 1, F.lit(size)))


def plausible(word: Column) -> Column:
    """Whether a run of letters and digits may be printed text: a digit, a common short word, or three letters or more,
    two of them different, a vowel, and no capital after a small letter."""
    low = F.lower(word)
    varied = ~low.rlike(r"^(.)\1*$")
    return word.rlike(r"\p{Nd}") | low.isin(SHORT) | ((F.length(word) >= 3) & varied & word.rlike("[aeiouyAEIOUY]") & ~word.rlike("[a-z][A-Z]"))


def plausible_words(text: Column) -> Column:
    """struct(plausible, raw): counts of the runs of letters and digits of a text."""
    return let(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda ws: F.struct(F.size(F.filter(ws, plausible)).alias("plausible"), F.size(ws).alias("raw")))


def choose_reading(layout: Column, guard: Column, share: float = 0.85) -> Column:
    """The layout's reading if it has ``share`` of the guard's plausible words, else the guard's."""
    return F.when(plausible_words(layout)["plausible"] >= share * plausible_words(guard)["plausible"], layout).otherwise(guard)


def reads_as_words(text: Column, least: int = 3, share: float = 0.8) -> Column:
    """At least ``least`` plausible words of two or more letters that make up ``share`` of the characters but white space."""
    found = F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"\p{L}{2,}") & plausible(w))
    return let(found, lambda ws: (F.size(ws) >= least) & (F.length(F.array_join(ws, "")) >= share * F.length(F.regexp_replace(text, r"\s+", ""))))


def decimal_depth(title: Column) -> Column:
    """The parts of a leading decimal number, of one to five parts of two digits at most; zero without one."""
    number = F.regexp_extract(title, r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2}){0,4})\.?\s+\S", 1)
    return F.when(number == "", 0).otherwise(F.size(F.split(number, r"\.")))


#: Codes of languages for two recognisers.
LANGUAGES = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl"}


def language_codes(listed: Column) -> Column:
    """The short codes of a list of languages with + or commas; others stay as they are, an empty list is English."""
    parts = F.filter(F.transform(F.split(F.coalesce(listed, F.lit("")), "[+,]"), lambda x: F.trim(x)), lambda x: x != "")
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    codes = F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), x))
    return F.when(F.size(codes) == 0, F.array(F.lit("en"))).otherwise(codes)


def caption_start(text: Column) -> Column:
    return text.rlike(r"(?i)^[\s*_]*(table|figure|fig\.|chart|plate|map)\s*[0-9ivx]+")


def says_continued(text: Column) -> Column:
    return text.rlike(r"(?i)\bcont(inued|inuation|'d|\.)")


def superscripts(text: Column) -> Column:
    """The numbers of a text's superscript markers in order."""
    inner = F.array_join(F.regexp_extract_all(text, F.lit(r"<sup>\s*([0-9]+(?:\s*,\s*[0-9]+)*)\s*</sup>"), F.lit(1)), ",")
    return F.when(inner == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inner, r"\s*,\s*"), lambda x: x.cast("int")))


def punctuation(text: Column) -> Column:
    """A text's punctuation as printed, without Markdown's syntax."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)^ {0,3}([-*+>]|#{1,6}|[0-9]{1,3}[.)])[ \t]+", ""), r"[*_`|\\\[\]#]+", "")
    return F.array_join(F.regexp_extract_all(bare, F.lit(r"\p{P}"), F.lit(0)), "")


def pipe_cell(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"[ \t\r\n]+", " "))


def html_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_url(url: Column) -> Column:
    return F.lower(F.trim(url)).rlike("^(https?://|mailto:|#|/(?!/)|\\./)")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; two empty ones are equal."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def normalized_distance(a: Column, b: Column) -> Column:
    return F.when((a == "") & (b == ""), 0.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; null for a zero vector."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    product = lambda x, y: F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
    return total(product(a, b)) / F.nullif(F.sqrt(total(product(a, a))) * F.sqrt(total(product(b, b))), F.lit(0.0))


def json_first(text: Column, *paths: str) -> Column:
    """The first of some paths that a JSON text has."""
    return F.coalesce(*(F.get_json_object(text, p) for p in paths))
