"""Queries of page images, drawn from rows of the driver's tables; the SQL knows them from how they are drawn or computes each pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from .elements import made
from .queries import query

# A page of 20 by 30 cells for each part: a bar at the top from column a to b, a line too thin to fill its cells, a bar down the left side.
_BARS = """SELECT p_partkey AS page_id, p_size % 5 AS deep, p_partkey % 4 AS a, least(19, p_partkey % 4 + 6 + p_partkey % 15) AS b, p_size % 6 AS c, least(29, 12 + p_partkey % 22) AS low FROM part"""


@query(f"""WITH r AS (SELECT page_id, a AS region, a AS x0, b AS x1, 0 AS y0, deep - 1 AS y1 FROM ({_BARS}) WHERE deep > 0 UNION ALL SELECT page_id, 160, 0, c, 8, low FROM ({_BARS})),
    c AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM r)),
    t AS (SELECT page_id, region, x0, x1, y0, y1, (x1 - x0 + 1) / 20.0 AS wide, (y1 - y0 + 1) / 30.0 AS tall, bool_and(x < 3.6 OR x + 1 > 16.4 OR y < 5.4 OR y + 1 > 24.6) AS beside,
          max(least((x + 1) / 20, (20 - x) / 20, (y + 1) / 30, (30 - y) / 30)) AS depth FROM c GROUP BY ALL),
    k AS (SELECT *, wide >= tall AS across FROM t WHERE beside AND depth >= 0.04 AND greatest(wide, tall) >= 0.5 AND CASE WHEN wide >= tall THEN x0 < 0.6 OR x1 + 1 > 19.4 ELSE y0 < 0.9 OR y1 + 1 > 29.1 END),
    l AS (SELECT *, unnest(CASE WHEN across THEN range(x0, x1 + 1) ELSE range(y0, y1 + 1) END) AS n FROM k),
    b AS (SELECT page_id, region, CASE WHEN across THEN n ELSE x0 END AS x0, CASE WHEN across THEN n ELSE x1 END AS x1, CASE WHEN across THEN y0 ELSE n END AS y0, CASE WHEN across THEN y1 ELSE n END AS y1 FROM l)
    SELECT page_id, CAST(region AS INTEGER) AS region, CAST(6 * greatest(x0 - 1, 0) AS DOUBLE) AS x0, CAST(6 * greatest(y0 - 1, 0) AS DOUBLE) AS y0, CAST(6 * least(x1 + 2, 20) AS DOUBLE) AS x1, CAST(6 * least(y1 + 2, 30) AS DOUBLE) AS y1 FROM b""")
def scanner_bands(spark, sf_dir):
    """What covers the scanner bands of a drawn page for every part."""
    bars = made(spark, sf_dir, _BARS)
    many = lambda text, n: F.repeat(F.lit(text) if isinstance(text, str) else text, (F.lit(n) if isinstance(n, int) else n).cast("int"))
    row = lambda a, b: F.concat(many("F0", 3 * a), many("10", 3 * (b - a + 1)), many("F0", 3 * (19 - b)))
    blank, line = "F0" * 60, "10" * 60
    deep, low = F.col("deep"), F.col("low")
    drawn = F.concat(many(row(F.col("a"), F.col("b")), 3 * deep), many(blank, 18 - 3 * deep), F.lit(line * 2), F.lit(blank * 4), many(row(F.lit(0), F.col("c")), 3 * (low - 7)), many(blank, 3 * (29 - low)))
    return R.band_boxes(bars.select("page_id", F.unhex(drawn).alias("grey"), F.lit(60).alias("width"), F.lit(90).alias("height")).repartition("page_id"))


#: Pages that one task draws.
DRAWN = 500

# A page of 96 by 80 pixels for each supplier: lines of four rows on a paper with grain, and as many specks as its key tells between them.
_PAGES = "SELECT s_suppkey AS page_id, s_suppkey % 20 AS n_specks, 20 + s_suppkey % 40 AS dark, 190 + s_suppkey % 31 AS light FROM supplier"
_GREY = "CASE WHEN y % 16 BETWEEN 4 AND 7 THEN dark WHEN x % 6 <= page_id % 2 AND y % 16 = 12 AND CAST(floor(x / 6) AS BIGINT) + 16 * CAST(floor(y / 16) AS BIGINT) < n_specks THEN dark + 5 ELSE light + (x * page_id + y) % 11 END"
_PIXELS = f"p AS (SELECT page_id, n_specks, x, y, {_GREY} AS g FROM ({_PAGES}) CROSS JOIN (SELECT unnest(range(96)) AS x) CROSS JOIN (SELECT unnest(range(80)) AS y))"


def _drawn(spark, sf_dir):
    pages = made(spark, sf_dir, _PAGES)
    rows = F.expr(f"array_join(flatten(transform(sequence(0, 79), y -> transform(sequence(0, 95), x -> lpad(hex({_GREY}), 2, '0')))), '')")
    # keys are dealt before they are drawn, in tasks of about DRAWN pages; a function in Python takes no lambda as its input, so the drawing ends in a shuffle
    pages = pages.repartition(max(spark.sparkContext.defaultParallelism, -(-pages.count() // DRAWN)), "page_id")
    return pages.select("page_id", F.unhex(rows).alias("grey"), F.lit(96).alias("width"), F.lit(80).alias("height")).repartition("page_id")


@query(f"""WITH {_PIXELS}, n AS (SELECT *, lag(g) OVER a AS l, lead(g) OVER a AS r, lag(g) OVER d AS u, lead(g) OVER d AS o FROM p WINDOW a AS (PARTITION BY page_id, y ORDER BY x), d AS (PARTITION BY page_id, x ORDER BY y))
    SELECT page_id, CAST(trunc(quantile_cont(g, 0.99) - quantile_cont(g, 0.01)) AS INTEGER) AS contrast, round_even(var_pop(CAST(coalesce(l, r) + coalesce(r, l) + coalesce(u, o) + coalesce(o, u) - 4 * g AS DOUBLE)), 1) AS blur,
        round_even(any_value(n_specks) / (7680 / 1e6), 1) AS specks_per_mpx, CAST(0 AS DOUBLE) AS skew FROM n GROUP BY page_id""")
def page_features(spark, sf_dir):
    """Contrast, blur, specks and skew of a drawn page for every supplier."""
    return R.page_features(_drawn(spark, sf_dir))


_BOXES = "SELECT s_suppkey AS page_id, CAST(10 + i AS DOUBLE) AS x0, i * 23.04 + 7 AS y0, CAST(10 + i + (s_suppkey * 7 + i * 13) % 120 AS DOUBLE) AS x1, i * 23.04 + 10 AS y1 FROM supplier CROSS JOIN (SELECT {five} AS i) AS n WHERE s_suppkey % 11 > 0"


@query(f"""WITH {_PIXELS}, w AS ({_BOXES.format(five="unnest(range(5))")}), k AS (SELECT CAST(50 AS DOUBLE) / 72 AS k),
    b AS (SELECT page_id, trunc((x0 - 3) * k) AS l, trunc((x1 + 3) * k) AS r, trunc((y0 - 3) * k) AS t, trunc((y1 + 3) * k) AS u FROM w, k),
    i AS (SELECT page_id, x, y FROM p, k WHERE g < 128 AND NOT (page_id % 3 = 0 AND trunc(x / k * 0.1) < 3)),
    c AS (SELECT DISTINCT page_id, x, y FROM i JOIN b USING (page_id) WHERE x BETWEEN l AND r AND y BETWEEN t AND u)
    SELECT page_id, (count(*) - count(c.x)) / count(*) AS ink_out FROM i LEFT JOIN c USING (page_id, x, y) GROUP BY page_id""")
def ink_outside_words(spark, sf_dir):
    """The ink that no word covers on a drawn page for every supplier; every third has a photograph at its left."""
    words = made(spark, sf_dir, _BOXES.format(five="explode(sequence(0, 4))"))
    cells = F.expr("flatten(transform(sequence(0, 2), x -> transform(sequence(0, 12), y -> named_struct('x', x, 'y', y))))")
    photos = made(spark, sf_dir, "SELECT s_suppkey AS page_id FROM supplier WHERE s_suppkey % 3 = 0").select("page_id", F.lit(0.1).alias("scale"), cells.alias("cells"))
    return R.ink_outside(_drawn(spark, sf_dir), words, photos)
