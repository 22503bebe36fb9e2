"""Text columns: normalization, names, tokens and tests on lines. All but NFC are JVM expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType

#: A word: a letter or digits first, inner hyphens and apostrophes kept.
WORD = r"\p{L}[\p{L}\p{N}_'’-]*|\p{N}+[\p{L}\p{N}_'’-]*"
#: What ends a phrase: anything but words, white space, hyphens and apostrophes; or a blank line.
BREAK = r"[^\p{L}\p{N}_\s'’-]+|\n[ \t]*\n\s*"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def strip_data_uri(text: Column) -> Column:
    """Base64 payloads of data URIs become three dots; the media type stays."""
    return F.regexp_replace(text, r"(data:[A-Za-z0-9!#$&^_.+-]*/?[A-Za-z0-9!#$&^_.+-]*;base64,)[A-Za-z0-9+/=]+", "$1...")


def clean_markdown(text: Column, nfc: bool = True) -> Column:
    """Uniform Markdown, idempotent; null and white space give an empty text. Only texts with characters that NFC
    may change leave the JVM; ``nfc=False`` is for texts known to be normalized."""
    x = strip_data_uri(F.coalesce(text, F.lit("")))
    if nfc:
        x = F.when(x.rlike("[^\\x00-\\u02ff]"), _nfc(x)).otherwise(x)
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.translate(x, " ​﻿", " ")
    x = F.regexp_replace(x, "(?m)[ \t]+$", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    x = F.regexp_replace(x, r"^[ \t\n]+|[ \t\n]+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(x, F.lit("\n")))


def slug(title: Column, fallback: str = "section") -> Column:
    x = F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}_]+", "-")
    x = F.regexp_replace(F.left(F.regexp_replace(x, "^-+|-+$", ""), F.lit(60)), "^-+|-+$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def markdown_filename(source: Column) -> Column:
    base = F.substring_index(F.replace(source, F.lit("\\"), F.lit("/")), "/", -1)
    return F.concat(slug(F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", ""), "document"), F.lit(".md"))


def pdf_filename(url: Column) -> Column:
    """The last segment of a URL's path with its percent codes read, unsafe runs as hyphens, the stem at most 100 characters."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.substring_index(path, "/", -1)
    read = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    base = F.regexp_replace(F.regexp_replace(read, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    stem = F.regexp_replace(F.left(F.regexp_replace(base, r"(?i)\.pdf$", ""), F.lit(100)), "^[-.]+|[-.]+$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("document")), F.lit(".pdf"))


def unique_names(files: DataFrame) -> DataFrame:
    """``filename`` of files (batch, ord, name): the first of a name keeps it, later ones get -2, -3 and so on in their
    order, past names that are taken."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, taken, names, last = pdf.sort_values("ord"), set(), [], {}
        for name in pdf["name"]:
            stem, dot, ending = name.rpartition(".")
            n, made = last.get(name, 1), name
            while made in taken:
                n += 1
                made = f"{stem}-{n}{dot}{ending}"
            last[name] = n
            taken.add(made)
            names.append(made)
        return pdf.assign(filename=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", filename string"
    return files.groupBy("batch").applyInPandas(run, schema)


def without_fences(text: Column) -> Column:
    """A text without its fenced code; an open fence runs to the end."""
    return F.regexp_replace(text, r"(?m)^[ \t]*(?:```|~~~)[^\n]*\n?(?:(?![ \t]*(?:```|~~~))[^\n]*(?:\n|\z))*+(?:[ \t]*(?:```|~~~)[^\n]*\n?)?", "")


def shown_title(text: Column, url: Column) -> Column:
    """A title to show and to name a file by: the first heading of level one outside code, else of level two, else the
    end of the url's path; characters that file systems reserve become spaces, at most 80 remain."""
    bare = without_fences(text)
    h1, h2 = (F.regexp_extract(bare, rf"(?m)^ {{0,3}}#{{{n}}}[ \t]+([^\n]*?)[ \t#]*$", 1) for n in (1, 2))
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    tail = F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]{1,5}$", ""), "[-_]+", " ")
    chosen = F.coalesce(F.nullif(F.trim(h1), F.lit("")), F.nullif(F.trim(h2), F.lit("")), tail)
    return F.trim(F.left(F.trim(F.regexp_replace(F.regexp_replace(chosen, r'[<>:"/\\|?*\x00-\x1f]+', " "), " +", " ")), F.lit(80)))


def s_stem(w: Column) -> Column:
    """A plural as its singular, where a trailing s is unambiguous."""
    n = F.length(w)
    return (
        F.when((n < 4) | ~w.rlike(r"^\p{L}+$"), w)
        .when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.rlike("(ss|us|is|os)$"), w)
        .when(w.rlike("(s|x|z|ch|sh)es$"), F.left(w, n - 2))
        .when(w.endswith("s"), F.left(w, n - 1))
        .otherwise(w)
    )


_IN, _BEFORE = r"[\p{L}\p{N}_'-]", r"(?<![\p{L}\p{N}_'-])([_'-]*+"


def stemmed_words(text: Column) -> Column:
    """``words``, each as ``s_stem`` gives it, by two replacements in the text: a run of characters of words is one word after
    signs that start none, so a plural is a run of letters after such signs. Rows are a text each, not a word each."""
    x = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    x = F.regexp_replace(x, rf"{_BEFORE}\p{{L}}{{2,}}?)ies(?!{_IN})", "$1y")
    x = F.regexp_replace(x, rf"{_BEFORE}(?:\p{{L}}{{2,}}?(?<=[sxz]|[cs]h)(?=es(?!{_IN}))|\p{{L}}{{3,}}?(?<![suio])(?=s(?!{_IN}))))e?s", "$1")
    return F.regexp_extract_all(x, F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Matching keys of the words of a text, in order: lower case, one kind of apostrophe."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("’"), F.lit("'")), F.lit(WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case, as scores count them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def furniture_key(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "#"), r"[ \t\r\n]+", " ")
    return F.trim(x)


def is_page_number(text: Column) -> Column:
    return text.rlike(r"(?i)^[\s\-–—|.]*(?:page\s+)?(?:[0-9]{1,4}[a-z]?|[ivxlc]{1,7})(?:\s+of\s+[0-9]{1,4})?[\s\-–—|.]*$")


def is_prose(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))) >= 3


def open_end(text: Column) -> Column:
    last = F.substring_index(text, "\n", -1)
    ends = last.rlike(r"""[.!?:]["'’”)\]*_]*[ \t]*$""") | last.rlike(r"[)\]}][ \t]*$")
    return (F.trim(last) != "") & (last.rlike(r"[A-Za-z][-‐][ \t]*$") | ~ends)


def lower_start(text: Column) -> Column:
    return text.rlike(r"""^[ \t"'‘“(*_]*[a-z]""")


@F.pandas_udf(IntegerType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y) -> int | None:
        if x is None or y is None:
            return None
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            left, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (u != v))
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    def one(x: str, y: str, r: float) -> bool:
        m = SequenceMatcher(None, x, y)
        return m.quick_ratio() >= r and m.ratio() >= r

    return pd.Series([None if x is None or y is None else one(x, y, r) for x, y, r in zip(a, b, least, strict=True)], dtype=object)


def similar_titles(a: Column, b: Column, least: float = 0.86) -> Column:
    """Two normalized titles of six characters or more whose share of matching characters is ``least``. Twice the
    shorter length over both lengths bounds that share, so pairs beyond the bound stay in the JVM."""
    short, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    near = (short >= 6) & (2.0 * short / both >= least)
    return F.when(a.isNull() | b.isNull(), None).when(~near, False).when(a == b, True).otherwise(_alike(F.when(near & (a != b), a), F.when(near & (a != b), b), F.lit(least)))


#: Distinct words that have a code point of their own in the private use areas.
_POINTS = 137_000


def word_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one code point of the private
    use areas; a pair with more distinct words than these hold is compared word by word outside the JVM."""
    def distance(p: Column) -> Column:
        def coded(ws: Column) -> Column:
            at = F.transform(ws, lambda w: F.array_position(p["both"], w) + 0xDFFF)
            point = lambda c: F.when(c < 0xF900, c).otherwise(c + (0xF0000 - 0xF900))
            return F.array_join(F.transform(at, lambda c: F.decode(F.unhex(F.lpad(F.hex(point(c)), 8, "0")), "UTF-32")), "")

        return F.levenshtein(coded(p["a"]), coded(p["b"]))

    many = F.size(F.array_distinct(F.concat(a, b))) > _POINTS
    few = let(F.struct(F.when(~many, a).alias("a"), F.when(~many, b).alias("b"), F.when(~many, F.array_distinct(F.concat(a, b))).alias("both")), distance)
    return F.coalesce(few, _word_distance(F.when(many, a), F.when(many, b)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
