"""Grey pages as rows: scanner bands and what covers them, features of a page's image, ink that no word covers.

A page is (page_id, grey, width, height): ``grey`` holds a byte a pixel, row by row, 0 is black. A page without that many bytes,
or without a pixel, has no bands and null features. One page at a time is in a task's memory, as runs of dark cells and not as cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

# Pixels of a cell, a dark pixel, a solid cell's share of them; a band's least span, the margin that holds it, how near
# its end is to the edge, its least depth; cells painted around it and the longest hole in it.
CELL, DARK, SOLID = 3, 80, 0.7
SPAN, MARGIN, END, DEPTH = 0.5, 0.18, 0.03, 0.04
PAD, HOLE = 1, 3
# Dots an inch of the pages of bands and of ink; a speck's most pixels; degrees of skew; ink's level, points around a word.
BAND_DPI, INK_DPI, SPECK = 36, 50, 4
MOST_SKEW, SKEW_STEP = 3.0, 0.05
INK, AROUND = 128, 3.0

RUN = StructType([StructField(c, IntegerType()) for c in ("y", "x0", "x1")])
REGION = StructType([StructField("region", IntegerType()), StructField("runs", ArrayType(RUN))])
FEATURES = StructType([StructField("contrast", IntegerType()), StructField("blur", DoubleType()), StructField("specks_per_mpx", DoubleType()), StructField("skew", DoubleType())])


def pixels(grey: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    if grey is None or pd.isna(width) or pd.isna(height) or min(width, height) < 1 or len(grey) != int(width) * int(height):
        return None
    return np.frombuffer(grey, np.uint8).reshape(int(height), int(width))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true cells, in reading order."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edges == 1)
    return row, first, np.nonzero(edges == -1)[1] - 1


def regions(row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, corners: bool) -> np.ndarray:
    """For each run the index of the first run of its region. Runs of neighbouring rows touch side by side or, with ``corners``, by corners too."""
    reach, wide = int(corners), width + 2
    low = np.searchsorted(row * wide + last, (row + 1) * wide + first - reach, "left")
    high = np.searchsorted(row * wide + first, (row + 1) * wide + last + reach, "right")
    many = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(row)), many)
    below = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    root = np.arange(len(row))
    while (root[above] != root[below]).any():
        least = np.minimum(root[above], root[below])
        np.minimum.at(root, root[above].copy(), least)
        np.minimum.at(root, root[below].copy(), least)
        while (root != root[root]).any():
            root = root[root]
    return root


def solid_cells(g: np.ndarray) -> np.ndarray:
    rows, cols = g.shape[0] // CELL, g.shape[1] // CELL
    dark = (g[: rows * CELL, : cols * CELL] < DARK).reshape(rows, CELL, cols, CELL).sum(axis=(1, 3))
    return dark >= SOLID * CELL * CELL


@F.pandas_udf(ArrayType(REGION))
def _solid_regions(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    out = []
    for page in map(pixels, grey, width, height):
        found: dict[int, list] = {}
        if page is not None:
            solid = solid_cells(page)
            row, first, last = runs(solid)
            for k, r in enumerate(regions(row, first, last, solid.shape[1], False)):
                found.setdefault(int(row[r] * solid.shape[1] + first[r]), []).append({"y": int(row[k]), "x0": int(first[k]), "x1": int(last[k])})
        out.append([{"region": r, "runs": of} for r, of in found.items()])
    return pd.Series(out)


def solid_regions(pages: DataFrame) -> DataFrame:
    """(page_id, width, height, cols, rows, region, runs): connected solid cells of a page; a region's name is the number of its first cell."""
    found = pages.select("page_id", "width", "height", F.explode(_solid_regions("grey", "width", "height")).alias("r"))
    size = lambda side: F.floor(F.col(side) / CELL).cast("int")
    return found.select("page_id", "width", "height", size("width").alias("cols"), size("height").alias("rows"), "r.region", "r.runs")


def bands(pages: DataFrame) -> DataFrame:
    """The regions that are scanner bands, with ``across``: whether the band runs across the page or down a side.

    A band spans half the page, keeps within its outer margin, runs off it at an end and is deeper than a hairline.
    """
    least = lambda f: F.array_min(F.transform("runs", lambda r: r[f]))
    most = lambda f: F.array_max(F.transform("runs", lambda r: r[f]))
    boxed = solid_regions(pages).withColumns({"_x0": least("x0"), "_x1": most("x1"), "_y0": least("y"), "_y1": most("y")})
    cols, rows = F.col("cols"), F.col("rows")
    wide, tall = (F.col("_x1") - F.col("_x0") + 1) / cols, (F.col("_y1") - F.col("_y0") + 1) / rows
    # the columns that no margin holds are an interval, which may be empty
    begin, end = F.ceil(MARGIN * cols), F.floor(cols - MARGIN * cols) - 1

    def within(r: Column) -> Column:
        beside = (r["y"] < MARGIN * rows) | (r["y"] + 1 > rows - MARGIN * rows)
        return beside | (begin > end) | (r["x1"] < begin) | (r["x0"] > end)

    def deep(r: Column) -> Column:
        x = F.greatest(r["x0"], F.least(r["x1"], F.floor((cols - 1) / 2)))  # of the run the cell that is farthest from both sides
        return F.least((x + 1) / cols, (cols - x) / cols, (r["y"] + 1) / rows, (rows - r["y"]) / rows)

    off = lambda low, high, n: (low < END * n) | (high + 1 > n - END * n)
    runs_off = F.when(F.col("across"), off(F.col("_x0"), F.col("_x1"), cols)).otherwise(off(F.col("_y0"), F.col("_y1"), rows))
    kept = boxed.where(F.greatest(wide, tall) >= SPAN).withColumn("across", wide >= tall).where(runs_off & F.forall("runs", within))
    return kept.where(F.array_max(F.transform("runs", deep)) >= DEPTH).drop("_x0", "_x1", "_y0", "_y1")


def band_boxes(pages: DataFrame, points: float = 72 / BAND_DPI) -> DataFrame:
    """(page_id, region, x0, y0, x1, y1) in points: what covers each band, for each of its columns (rows, if it runs down a side).

    Short holes are bridged, a longer gap is page between two parts; each box is a cell larger than its cells and ends at the
    page's edge. ``points``: those of a pixel.
    """
    cells = bands(pages).select("*", F.explode("runs").alias("r")).select("page_id", "width", "height", "cols", "rows", "region", "across", F.col("r.y").alias("y"), F.explode(F.sequence("r.x0", "r.x1")).alias("x"))
    lines = cells.withColumn("line", F.when(F.col("across"), F.col("x")).otherwise(F.col("y"))).withColumn("at", F.when(F.col("across"), F.col("y")).otherwise(F.col("x")))
    w = Window.partitionBy("page_id", "region", "line").orderBy("at")
    part = F.sum(F.when(F.col("at") - F.lag("at").over(w) - 1 > HOLE, 1).otherwise(0)).over(w)
    keys = ["page_id", "width", "height", "cols", "rows", "region", "across", "line"]
    spans = lines.withColumn("part", part).groupBy(*keys, "part").agg((F.min("at") - PAD).alias("a"), (F.max("at") + 1 + PAD).alias("b"))
    own = (F.col("line") - PAD, F.col("line") + 1 + PAD)
    side = lambda across, down: F.when(F.col("across"), across).otherwise(down)
    x = lambda cell: F.least(F.greatest(cell, F.lit(0)) * (F.col("width") * points / F.col("cols")), F.col("width") * points)
    y = lambda cell: F.least(F.greatest(cell, F.lit(0)) * (F.col("height") * points / F.col("rows")), F.col("height") * points)
    return spans.select(
        "page_id", "region", x(side(own[0], F.col("a"))).alias("x0"), y(side(F.col("a"), own[0])).alias("y0"), x(side(own[1], F.col("b"))).alias("x1"), y(side(F.col("b"), own[1])).alias("y1"),
    )


def _painted(page: np.ndarray, boxes, pixel: float) -> bytes:
    out = page.copy()
    for b in boxes:
        out[int(b["y0"] / pixel + 0.5) : int(b["y1"] / pixel + 0.5), int(b["x0"] / pixel + 0.5) : int(b["x1"] / pixel + 0.5)] = 255
    return out.tobytes()


def cleaned(pages: DataFrame, points: float = 72 / BAND_DPI) -> DataFrame:
    """``pages`` with its bands painted white and ``n_boxes``; a page without a band keeps its bytes."""
    box = F.struct("x0", "y0", "x1", "y1")
    boxes = band_boxes(pages, points).groupBy("page_id").agg(F.collect_list(box).alias("_boxes"))

    @F.pandas_udf(BinaryType())
    def painted(grey: pd.Series, width: pd.Series, height: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([g if b is None else _painted(pixels(g, w, h), b, points) for g, w, h, b in zip(grey, width, height, of)])

    joined = pages.join(boxes, "page_id", "left")
    return joined.select(*[painted("grey", "width", "height", "_boxes").alias("grey") if c == "grey" else F.col(c) for c in pages.columns], F.coalesce(F.size("_boxes"), F.lit(0)).alias("n_boxes"))


def ink_level(g: np.ndarray) -> int:
    """The grey level (of ink, the darkest that is none of paper) that divides a page's pixels best in two classes."""
    count = np.bincount(g.ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(count), np.cumsum(count * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * below[-1]) ** 2 / (below * (below[-1] - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, 0.0)))


def skew(g: np.ndarray) -> float:
    """Degrees (against the clock) that make the lines level: the rotation whose rows of ink vary most, the least on ties.

    Ink of a page a fourth as large is thrown onto its rotated rows, so an angle costs a pass over the ink alone.
    """
    h, w = g.shape[0] // 4, g.shape[1] // 4
    if not (h and w):
        return 0.0
    small = np.rint(g[: h * 4, : w * 4].reshape(h, 4, w, 4).mean(axis=(1, 3))).astype(np.uint8)
    y, x = np.nonzero(small <= ink_level(small))
    dy, dx = y - h / 2, x - w / 2
    best, most = 0.0, -1.0
    steps = round(MOST_SKEW / SKEW_STEP)
    for k in sorted(range(-steps, steps + 1), key=lambda s: (abs(s), s)):
        angle = np.radians(k * SKEW_STEP)
        row = np.rint(dy * np.cos(angle) - dx * np.sin(angle) + h / 2).astype(np.int64)
        col = np.rint(dy * np.sin(angle) + dx * np.cos(angle) + w / 2)
        inside = (row >= 0) & (row < h) & (col >= 0) & (col < w)
        score = float(np.bincount(row[inside], minlength=h).var())
        if score > most * (1 + 1e-9):
            best, most = k * SKEW_STEP, score
    return round(best, 2)


def features(g: np.ndarray) -> dict:
    """contrast (between percentiles 1 and 99), blur (variance of the Laplacian, edges mirrored), specks of ink a million pixels, skew."""
    low, high = np.percentile(g, [1, 99])
    p = np.pad(g.astype(np.int32), 1, mode="reflect" if min(g.shape) > 1 else "edge")
    bend = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    row, first, last = runs(g <= ink_level(g))
    area = np.bincount(regions(row, first, last, g.shape[1], True), weights=last - first + 1, minlength=1) if len(row) else np.zeros(1)
    specks = int(((area > 0) & (area <= SPECK)).sum())
    return {"contrast": int(high - low), "blur": round(float(bend.var()), 1), "specks_per_mpx": round(specks / (g.size / 1e6), 1), "skew": skew(g)}


@F.pandas_udf(FEATURES)
def _features(grey: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    none = dict.fromkeys(FEATURES.names)
    found = [none if page is None else features(page) for page in map(pixels, grey, width, height)]
    return pd.DataFrame(found, columns=FEATURES.names).astype({"contrast": "Int32"})


def page_features(pages: DataFrame) -> DataFrame:
    """(page_id, contrast, blur, specks_per_mpx, skew) of pages as scanned: the inputs of rules that choose a treatment."""
    return pages.select("page_id", _features("grey", "width", "height").alias("f")).select("page_id", "f.*")


@F.pandas_udf(DoubleType())
def _ink_outside(grey: pd.Series, width: pd.Series, height: pd.Series, words: pd.Series, photo: pd.Series, scale: pd.Series) -> pd.Series:
    k, out = INK_DPI / 72, []
    for page, boxes, cells, s in zip(map(pixels, grey, width, height), words, photo, scale):
        if page is None:
            out.append(None)
            continue
        ink = page < INK
        if cells is not None and len(cells) and not pd.isna(s):
            masked = {(int(c["x"]), int(c["y"])) for c in cells}
            rows, cols = np.nonzero(ink)
            over = [(x, y) in masked for x, y in zip((cols / k * s).astype(int).tolist(), (rows / k * s).astype(int).tolist())]
            ink[rows[over], cols[over]] = False
        n = int(ink.sum())
        for b in boxes if boxes is not None else ():
            left, top = max(0, int((b["x0"] - AROUND) * k)), max(0, int((b["y0"] - AROUND) * k))
            ink[top : max(0, int((b["y1"] + AROUND) * k) + 1), left : max(0, int((b["x1"] + AROUND) * k) + 1)] = False
        out.append(int(ink.sum()) / n if n else 0.0)
    return pd.Series(out, dtype="float64")


def ink_outside(pages: DataFrame, words: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """(page_id, ink_out): the share of a page's ink that lies in no photo cell and under no word's box and a little around it.

    ``words``: page_id and a box in points (x0, y0, x1, y1). ``photos``: page_id, scale (cells a point), cells (array of x and y).
    A page without words has all its ink outside; one without ink has 0.
    """
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    of = words.groupBy("page_id").agg(F.collect_list(box).alias("_words"))
    none = (F.lit(None).cast("array<struct<x:int,y:int>>").alias("_cells"), F.lit(None).cast("double").alias("_scale"))
    own = pages.select("page_id", "grey", "width", "height").join(of, "page_id", "left")
    if photos is None:
        own = own.select("*", *none)
    else:
        own = own.join(photos.select("page_id", F.col("cells").cast("array<struct<x:int,y:int>>").alias("_cells"), F.col("scale").cast("double").alias("_scale")), "page_id", "left")
    return own.select("page_id", _ink_outside("grey", "width", "height", "_words", "_cells", "_scale").alias("ink_out"))
