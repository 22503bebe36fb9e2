"""Quality rules: counts of a document, and its divergence from language references.

A document's histograms over character classes and over common words of a language are compared, by the
Jensen-Shannon distance (base 2, from 0 to 1), with the mean histograms of the table's documents of that language.
Short documents have unreliable histograms and are not judged by them.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Frequent function words of the four languages.
COMMON = {
    "en": "the of and to a in that is was for it with as be on by this are or from at which not have an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce avec il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = ("lower", "upper", "accented", "digit", "space", "stop", "quote", "shout", "symbol", "punctuation", "other")
SYMBOLS = "#*$%&|<>"
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.3
MIN_CHARS, MIN_WORDS = 200, 100


def _class(code: int) -> int:
    c = chr(code)
    if c in " \t\n\r\x0b\x0c":
        name = "space"
    elif c in SYMBOLS:
        name = "symbol"
    elif c in ".,;:":
        name = "stop"
    elif c in "!?":
        name = "shout"
    elif c in "'\"()-’“”«»":
        name = "quote"
    elif c.isalpha():
        name = "upper" if c.isupper() else "lower" if c.isascii() else "accented"
    elif c.isdigit():
        name = "digit"
    else:
        name = "punctuation" if unicodedata.category(c)[0] in "PS" else "other"
    return CLASSES.index(name)


#: Beyond the table are letters of rare scripts and private characters, which count as the last of it.
_TABLE = np.array([_class(c) for c in range(0x20000)], np.uint8)
_INDEX = {w.encode(): i for i, w in enumerate(WORDS)}
_SPACE = " \t\n\r\x0b\x0c"


def counts(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, characters by class, common words by WORDS."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(windows)) < len(windows):
        often, covered = Counter(windows), bytearray(len(words))
        for i, w in enumerate(windows):
            if often[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeat = sum(covered)
    codes = np.frombuffer(raw, np.uint8) if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(_TABLE) - 1)
    chars = np.bincount(_TABLE[codes], minlength=len(CLASSES)).tolist()
    common = [0] * len(WORDS)
    for w in filter(_INDEX.__contains__, raw.lower().translate(None, b".,;:!?").split()):
        common[_INDEX[w]] += 1
    return len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, chars, common


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, common array<long>"


def document_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
        for b in batches:
            cols = list(zip(*(counts(t.as_py()) for t in b.column(2)), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "lang", *_FIELDS])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id long, lang string, {_COUNTS}")


def _base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(counted: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, the mean character-class and common-word histograms of its documents that pass the base rules.

    One pass with partial sums; a row for each of the four languages comes to the driver. A language without
    documents has no reference.
    """
    n_chars = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    share = [(F.element_at("chars", i + 1) / n_chars).alias(f"c{i}") for i in range(len(CLASSES))]
    share += [(F.element_at("common", i + 1) / F.col("n_words")).alias(f"w{i}") for i in range(len(WORDS))]
    rows = counted.where(~_base_failed() & F.col("lang").isin(*COMMON)).select("lang", *share).groupBy("lang").agg(*(F.avg(n).alias(n) for n in (*(f"c{i}" for i in range(len(CLASSES))), *(f"w{i}" for i in range(len(WORDS))))))
    return {r["lang"]: (np.array([r[f"c{i}"] for i in range(len(CLASSES))]), np.array([r[f"w{i}"] for i in range(len(WORDS))])) for r in rows.collect()}


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` from ``q``; both sum to one."""
    q = np.broadcast_to(q, p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = [np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1) for x in (p, q)]
    return np.sqrt(np.clip((kl[0] + kl[1]) / 2, 0, 1))


def _nearest(known: dict[str, tuple[np.ndarray, np.ndarray]], chars: np.ndarray, common: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row, the two distances from the reference that is nearest by their sum; infinite without references."""
    best = np.full((2, len(words)), np.inf)
    for lang, (c, w) in known.items():
        own = [WORDS.index(x) for x in COMMON[lang]]
        near = js_distance(chars / np.maximum(chars.sum(axis=1), 1)[:, None], c / c.sum())
        part = common[:, own] / np.maximum(words, 1)[:, None]
        of_words = js_distance(np.c_[part, np.maximum(1 - part.sum(axis=1), 0)], np.r_[w[own], max(0, 1 - w[own].sum())])
        take = near + of_words < best.sum(axis=0)
        best[:, take] = np.array([near, of_words])[:, take]
    return best


def rate(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept, and the distances from the nearest language reference.

    A null or empty text has no words and fails the base rules. A distance is null where the document is too short
    for it, there is no reference, or ``lang`` names a language that has no reference here, and then rejects nothing. The
    nearest of all references counts, so a null or mistaken ``lang`` does no harm. Repeated rows each get a row; only doc_id, lang and text are read.
    """
    counted = materialize(document_counts(docs), "counts")
    known = references(counted)

    def judged(lang: pa.Array) -> np.ndarray:
        return np.array([x is None or x in COMMON for x in lang.to_pylist()], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars = np.asarray(b.column("chars").flatten(), dtype=float).reshape(b.num_rows, len(CLASSES))
            common = np.asarray(b.column("common").flatten(), dtype=float).reshape(b.num_rows, len(WORDS))
            words = b.column("n_words").to_numpy()
            best = _nearest(known, chars, common, words)
            enough = np.array([b.column("word_chars").to_numpy() >= min_chars, words >= min_words]) & np.isfinite(best) & judged(b.column("lang"))
            out = [pa.array(np.where(ok, x, 0), mask=~ok) for x, ok in zip(best, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", *_FIELDS[:5])), *out], names=["doc_id", *_FIELDS[:5], "char_distance", "word_distance"])

    rated = counted.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double")
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char) | (F.coalesce("word_distance", F.lit(0.0)) > max_word)
    return rated.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)


def keep(docs: DataFrame, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, all columns as they are.

    One pass makes the references, a second one judges each row by its own text and passes it on, so texts are not
    shuffled and rows that share an id, or have none, get their own verdicts. An empty table stays empty.
    """
    known = references(document_counts(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n_words, word_chars, _, _, repeat, chars, common = (np.array(x) for x in zip(*(counts(t.as_py()) for t in b.column("text")), strict=True))
            best = _nearest(known, chars.astype(float), common.astype(float), n_words)
            enough = np.array([word_chars >= min_chars, n_words >= min_words]) & np.isfinite(best) & np.array([x is None or x in COMMON for x in b.column("lang").to_pylist()], bool)
            far = (enough & (best > np.array([[max_char], [max_word]]))).any(axis=0)
            yield b.filter(pa.array((n_words >= 50) & (100 * repeat <= 50 * n_words) & ~far))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
