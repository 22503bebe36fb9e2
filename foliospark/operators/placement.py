"""Elements on their page: token alignment, boxes from printed words, photo regions, figures, sizes of type.

What works on one page or document at a time is bounded by it; pages are the groups, so skew is that of a page.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import tokens as K
from .compare import style_levels

ROUNDS, MIN_COVERAGE = 32, 0.5
#: Grey levels between these are mid-tones; a cell is tone from this share on; a photo has so many cells.
TONES, CELL, TONE_SHARE, PHOTO_CELLS, IN_PHOTO = (50, 200), 3, 0.6, 150, 0.5
MIN_SIDE, MAX_PAGE_SHARE = 36.0, 0.85
TIER_STEP, NO_DESCENDER = 0.25, 0.78
#: What goes below the base line, words of divisions, letters as numbers.
DESCENDERS = "gjpqy(),;[]{}|"
DIVISION = r"(?i)^\s*(PART|APPENDIX|SCHEDULE|CHAPTER|ANNEX|ANNEXURE|SECTION)\b"
LETTERED = r"^\s*\(?([a-z]|[ivx]{1,4})\)\s+\S"
_TOKEN = re.compile(r"[^\W_]+")
_UNPRINTED = re.compile(r"\]\([^)]*\)|</?[A-Za-z][^>]*>")


def align_tokens(a: list[str], b: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """For each token of ``a`` its partner in ``b``, or -1. The first round keeps the order; later ones align what is
    left over, by runs of two tokens or more, so that crossed blocks find each other."""
    partner, taken = np.full(len(a), -1), np.zeros(len(b), bool)
    for least in (1, *[2] * (rounds - 1)):
        rest, free = np.flatnonzero(partner < 0), np.flatnonzero(~taken)
        runs = SequenceMatcher(None, [a[i] for i in rest], [b[j] for j in free], autojunk=False).get_matching_blocks()
        runs = [r for r in runs if r.size >= least]
        if not runs:
            break
        for r in runs:
            partner[rest[r.a : r.a + r.size]] = free[r.b : r.b + r.size]
            taken[free[r.b : r.b + r.size]] = True
    return partner


def _placed(elements: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    elements, words = elements.sort_values("ord"), words.sort_values("word")
    printed = [(w, t.lower()) for w, text in enumerate(words["text"]) for t in _TOKEN.findall(text or "")]
    own = [(n, t.lower()) for n, text in enumerate(elements["text"]) for t in _TOKEN.findall(_UNPRINTED.sub(" ", text or ""))]
    partner = align_tokens([t for _, t in own], [t for _, t in printed])
    size = Counter(n for n, _ in own)
    free = {j for j in range(len(printed))} - set(partner.tolist())
    for i in np.flatnonzero(partner < 0):  # an element of one word is placed if just one free word can be it
        if size[own[i][0]] == 1 and len(same := [j for j in free if printed[j][1] == own[i][1]]) == 1:
            partner[i] = same[0]
            free -= {same[0]}
    hits: dict[int, list[int]] = {}
    for (n, _), j in zip(own, partner, strict=True):
        if j >= 0:
            hits.setdefault(n, []).append(printed[j][0])
    out = []
    for n, e in enumerate(elements.itertuples()):
        share = len(hits.get(n, ())) / size[n] if size[n] else None
        box = [None] * 4
        if share is not None and share >= MIN_COVERAGE:
            w = words.iloc[sorted(set(hits[n]))]
            box = [w["x0"].min(), w["y0"].min(), w["x1"].max(), w["y1"].max()]
        out.append((e.doc_id, e.page, e.ord, share, *box))
    return pd.DataFrame(out, columns=["doc_id", "page", "ord", "coverage", "x0", "y0", "x1", "y1"])


def place(elements: DataFrame, words: DataFrame) -> DataFrame:
    """Boxes of elements (doc_id, page, ord, text) from the page's words (doc_id, page, word, text, x0, y0, x1, y1).

    ``coverage`` is the share of an element's tokens that were found, null if it has none; below a half there is no
    box. Elements of a page without words have coverage 0.
    """
    e = elements.select("doc_id", "page", "ord", "text").groupBy("doc_id", "page")
    w = words.select("doc_id", "page", "word", "text", "x0", "y0", "x1", "y1").groupBy("doc_id", "page")
    return e.cogroup(w).applyInPandas(_placed, "doc_id long, page int, ord int, coverage double, x0 double, y0 double, x1 double, y1 double")


def photo_cells(grey: np.ndarray) -> np.ndarray:
    """The cells of a grey page image that lie in a photo: connected mid-tone regions that are large enough."""
    h, w = grey.shape[0] // CELL, grey.shape[1] // CELL
    middle = (grey > TONES[0]) & (grey < TONES[1])
    tone = middle[: h * CELL, : w * CELL].reshape(h, CELL, w, CELL).mean(axis=(1, 3)) >= TONE_SHARE
    label = np.where(tone, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:  # each cell takes the largest label beside it until none changes
        wide = np.pad(label, 1)
        most = np.maximum.reduce([wide[1:-1, 1:-1], wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]]) * tone
        if (most == label).all():
            break
        label = most
    return tone & (np.bincount(label.ravel(), minlength=h * w + 1)[label] >= PHOTO_CELLS)


def photo_share(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, ord, share): how much of a line's cells lie in photos, from images (page, width, pixels: one byte of
    grey each) and lines (page, ord, x0, y0, x1, y1) in pixels. Lines of pages without an image have share 0."""

    def run(image: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((0, 0), bool)
        if len(image):
            mask = photo_cells(np.frombuffer(image["pixels"].iloc[0], np.uint8).reshape(-1, int(image["width"].iloc[0])))
        out = []
        for x in own.itertuples():
            x0, y0, x1, y1 = (int(v // CELL) for v in (x.x0, x.y0, x.x1, x.y1))
            inside = mask[max(y0, 0) : y1 + 1, max(x0, 0) : x1 + 1].sum()
            out.append((x.page, x.ord, float(inside) / ((x1 - x0 + 1) * (y1 - y0 + 1))))
        return pd.DataFrame(out, columns=["page", "ord", "share"])

    return images.select("page", "width", "pixels").groupBy("page").cogroup(lines.groupBy("page")).applyInPandas(run, "page long, ord int, share double")


def figures(images: DataFrame, elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Elements (doc_id, page, ord, type, text, bbox) with a figure for each image (doc_id, page, bbox) of enough size,
    after the last element above it that it overlaps sideways, else before the page's first; ``ord`` is given anew.

    pages: doc_id, page, width, height. Images that are small or cover the page are left out, equal ones come once.
    """
    b = F.col("bbox")
    i = images.join(pages, ["doc_id", "page"])
    wide, high = b["x1"] - b["x0"], b["y1"] - b["y0"]
    i = i.where((wide >= MIN_SIDE) & (high >= MIN_SIDE) & (wide * high <= MAX_PAGE_SHARE * F.col("width") * F.col("height")))
    clip = F.struct(F.greatest(b["x0"], F.lit(0.0)).alias("x0"), F.greatest(b["y0"], F.lit(0.0)).alias("y0"), F.least(b["x1"], "width").alias("x1"), F.least(b["y1"], "height").alias("y1"))
    i = i.select("doc_id", "page", clip.alias("box")).distinct()
    e = elements.select("doc_id", "page", F.col("ord").alias("at"), F.col("bbox").alias("over"))
    beside = F.least("over.x1", "box.x1") > F.greatest("over.x0", "box.x0")
    above = F.when((F.col("over.y1") <= F.col("box.y0") + 1) & beside, F.col("at"))
    put = i.join(e, ["doc_id", "page"], "left").groupBy("doc_id", "page", "box").agg(F.coalesce(F.max(above), F.lit(0)).alias("at"))
    new = put.select("doc_id", "page", "at", F.lit(1).alias("late"), F.col("box.y0").alias("y"), F.col("box.x0").alias("x"), F.lit("figure").alias("type"), F.lit("").alias("text"), F.col("box").alias("bbox"))
    old = elements.select("doc_id", "page", F.col("ord").alias("at"), F.lit(0).alias("late"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), "type", "text", "bbox")
    w = Window.partitionBy("doc_id", "page").orderBy("at", "late", "y", "x")
    return old.unionByName(new).withColumn("ord", F.row_number().over(w)).select("doc_id", "page", "ord", "type", "text", "bbox")


def line_size(text: str | None, height: float) -> float:
    """The size of type of a line: its height, which is less where no letter goes below the base line. Not a number
    for a blank line or one in brackets, which is set in a style of its own."""
    text = (text or "").strip()
    if not text or text.startswith("(") or not height > 0:
        return float("nan")
    return height if any(c in DESCENDERS for c in text) else height / NO_DESCENDER


def tiers(sizes: list[float], body: float) -> list[int]:
    """The tier of each size, 0 for the largest: a new one begins where a size is a quarter of the body's size or more
    below the top of the tier before."""
    tier, top, found = -1, 0.0, {}
    for s in sorted(set(sizes), reverse=True):
        if tier < 0 or (top - s) / body >= TIER_STEP:
            tier, top = tier + 1, s
        found[s] = tier
    return [found[s] for s in sizes]


def size_tiers(lines: DataFrame) -> DataFrame:
    """(doc_id, ord, tier) of the headings, from lines (doc_id, ord, heading, text, height): an element's size is the
    median of its lines', the body's that of all lines of no heading. No tiers without a body."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        size = pd.Series([line_size(t, h) for t, h in zip(own["text"], own["height"], strict=True)], own.index)
        own, size = own[size.notna()], size.dropna()
        body, heads = size[~own["heading"]], own[own["heading"]]
        each = size[heads.index].groupby(heads["ord"]).median() if len(body) and body.median() > 0 else pd.Series(dtype=float)
        found = tiers(each.tolist(), median(body)) if len(each) else []
        return pd.DataFrame({"doc_id": list(own["doc_id"][:1]) * len(found), "ord": each.index[: len(found)].astype("int32"), "tier": np.array(found, np.int32)})

    known = lines.where("height IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "ord", F.coalesce("heading", F.lit(False)).alias("heading"), "text", "height")
    return known.groupBy("doc_id").applyInPandas(run, "doc_id long, ord int, tier int")


def typography_levels(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, ord, level) of the headings (doc_id, ord, text) by their style: divisions first, then by depth of the
    number, tier of size, capitals and letters as numbers. Levels are null where there are fewer than two styles;
    headings without a size are left out. ``lines`` is as for ``size_tiers``."""
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    letters = F.length(F.regexp_replace(first, r"[^\p{L}]", ""))
    capital = F.length(F.regexp_replace(first, r"[^\p{Lu}]", ""))
    style = F.struct(
        (~first.rlike(DIVISION)).alias("division"), K.decimal_depth(first).alias("depth"), "tier",
        (~((letters >= 3) & (capital >= 0.8 * letters))).alias("caps"), first.rlike(LETTERED).alias("lettered"),
    )
    styled = headings.join(size_tiers(lines), ["doc_id", "ord"]).select("doc_id", "ord", style.alias("style"))
    return style_levels(styled, largest_first=False).drop("style")
