"""Queries of stitched cells, spliced tables and line order, over pages made of orders and texts made of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L, order as O, stitch as S
from .elements import made, tasks
from .queries import query, read

# A page for each order: two lines of prose, then three columns of cells with a line for each item. The third column is beside
# the second, beyond the widest gap, off the rows, or overlaps the second and is beside the first (order key modulo 4).
_ITEMS = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem) AS i"
_LINES = f"""SELECT l_orderkey AS doc_id, 1 AS page, CAST(c AS BIGINT) AS block, CASE WHEN c = 1 THEN s ELSE l_linenumber END AS ord,
    CAST(CASE c WHEN 1 THEN 50 * s WHEN 2 THEN 50 WHEN 3 THEN 110 ELSE CASE l_orderkey % 4 WHEN 1 THEN 300 WHEN 3 THEN 140 ELSE 170 END END AS DOUBLE) AS x0,
    CAST(CASE c WHEN 1 THEN 40 + 20 * s ELSE 100 + 20 * l_linenumber + CASE WHEN c = 4 AND l_orderkey % 4 = 2 THEN 8 ELSE 0 END END AS DOUBLE) AS y0,
    CAST(CASE c WHEN 1 THEN 410 + 70 * s WHEN 2 THEN 90 WHEN 3 THEN 150 ELSE CASE l_orderkey % 4 WHEN 1 THEN 340 WHEN 3 THEN 180 ELSE 210 END END AS DOUBLE) AS x1,
    CAST(CASE c WHEN 1 THEN 52 + 20 * s ELSE 112 + 20 * l_linenumber + CASE WHEN c = 4 AND l_orderkey % 4 = 2 THEN 8 ELSE 0 END END AS DOUBLE) AS y1,
    CASE c WHEN 1 THEN concat('these are the items of order ', l_orderkey, CASE WHEN s = 2 THEN ' and so on' ELSE '' END) WHEN 2 THEN concat('p', l_partkey) WHEN 3 THEN concat('s', l_suppkey, ' ', l_returnflag) ELSE concat('n ', l_linenumber) END AS text
    FROM {_ITEMS}"""
_SPREAD = {"duck": " CROSS JOIN (SELECT unnest([1, 1, 2, 3, 4]) AS c, unnest([1, 2, 1, 1, 1]) AS s) WHERE c > 1 OR l_linenumber = 1", "spark": " LATERAL VIEW explode(array(1, 2, 3, 4)) u AS c LATERAL VIEW explode(CASE WHEN c = 1 THEN array(1, 2) ELSE array(1) END) v AS s WHERE c > 1 OR l_linenumber = 1"}


@query(f"""WITH t AS (SELECT l_orderkey, l_orderkey % 4 IN (1, 2) AS apart, string_agg(concat('p', l_partkey, ' s', l_suppkey, ' ', l_returnflag), chr(10) ORDER BY l_linenumber) AS two, string_agg(concat('p', l_partkey, ' s', l_suppkey, ' ', l_returnflag, ' n ', l_linenumber), chr(10) ORDER BY l_linenumber) AS three,
    string_agg(concat('n ', l_linenumber), chr(10) ORDER BY l_linenumber) AS third, bool_or(l_linenumber = 1) AS prose FROM {_ITEMS} GROUP BY l_orderkey),
    g AS (SELECT l_orderkey, 1 AS spot, 1 AS n_blocks, concat('these are the items of order ', l_orderkey, chr(10), 'these are the items of order ', l_orderkey, ' and so on') AS text FROM t WHERE prose
    UNION ALL SELECT l_orderkey, 2, CASE WHEN apart THEN 2 ELSE 3 END, CASE WHEN apart THEN two ELSE three END FROM t UNION ALL SELECT l_orderkey, 4, 1, third FROM t WHERE apart)
    SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY spot) AS INTEGER) AS ord, CAST(n_blocks AS BIGINT) AS n_blocks, text FROM g""")
def stitched_cells(spark, sf_dir):
    """Blocks of every order's page, its cells stitched to tables."""
    n = tasks(spark, 3 * read(spark, sf_dir, "lineitem").count())  # an item has three cells
    return S.stitched(made(spark, sf_dir, _LINES + _SPREAD["spark"], {"lineitem": "l_orderkey"}), n).select("doc_id", "ord", "n_blocks", "text")


# Items as lines of three words, three lines an element. Table 1 claims the last two words of returned lines, table 2 all
# words of accepted ones; a table's top is that of its first line.
_WORDS = f"""SELECT l_orderkey AS doc_id, 1 AS page, CAST(floor((l_linenumber - 1) / 3) AS BIGINT) AS elem, l_linenumber AS line, w AS word, CAST(20 * l_linenumber AS DOUBLE) AS y0, CAST(20 * l_linenumber + 12 AS DOUBLE) AS y1,
    CASE w WHEN 1 THEN concat('p', l_partkey) WHEN 2 THEN concat('s', l_suppkey) ELSE l_linestatus END AS text, CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'R' AND w > 1 THEN 1 END AS claimed FROM {_ITEMS}"""


@query(f"""WITH w AS ({_WORDS} CROSS JOIN (SELECT unnest([1, 2, 3]) AS w)), t AS (SELECT doc_id, claimed, min(y0) AS top, min(elem) AS first FROM w WHERE claimed IS NOT NULL GROUP BY doc_id, claimed),
    e AS (SELECT w.doc_id, elem, min(top) AS top FROM w JOIN t USING (doc_id, claimed) GROUP BY w.doc_id, elem),
    l AS (SELECT doc_id, elem, line, min(y0) + 6 AS centre, string_agg(text, ' ' ORDER BY word) AS text FROM w WHERE claimed IS NULL GROUP BY ALL),
    p AS (SELECT doc_id, elem, CASE WHEN top IS NULL OR centre < top THEN 0 ELSE 2 END AS part, NULL AS claimed, 0 AS spot, string_agg(text, chr(10) ORDER BY line) AS text FROM l LEFT JOIN e USING (doc_id, elem) GROUP BY ALL
    UNION ALL SELECT doc_id, first, 1, claimed, (SELECT min(10 * line + word) FROM w WHERE w.doc_id = t.doc_id AND w.claimed = t.claimed AND w.elem = t.first), concat('table ', claimed) FROM t)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY elem, part, spot) AS INTEGER) AS ord, CASE part WHEN 1 THEN 'table' ELSE 'text' END AS kind, elem, CAST(claimed AS INTEGER) AS claimed, text FROM p""")
def spliced_tables(spark, sf_dir):
    """Tables put in the place of the words that they claim, in every order's page."""
    words = made(spark, sf_dir, _WORDS + " LATERAL VIEW explode(array(1, 2, 3)) u AS w", {"lineitem": "l_orderkey"}).withColumnRenamed("claimed", "table")
    tables = words.where("table IS NOT NULL").groupBy("doc_id", "page", "table").agg(F.min("y0").alias("y0")).withColumn("text", F.concat(F.lit("table "), "table"))
    return S.spliced(words, tables).select("doc_id", "ord", "kind", "elem", F.col("table").alias("claimed"), "text")


_TURNS = "SELECT conv_id, turn, CASE WHEN text IS NULL THEN '' ELSE text END AS text FROM conversations"


@query(f"""WITH t AS ({_TURNS}), c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS reference, string_agg(text, chr(10) ORDER BY (turn * 3 + 1) % 7, turn) AS output FROM t GROUP BY conv_id),
    x AS (SELECT conv_id, generate_subscripts(a, 1) - 1 AS line, regexp_extract_all(lower(unnest(a)), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT conv_id, string_split(reference, chr(10)) AS a FROM c)),
    g AS (SELECT conv_id, line, len(w) - 2 AS n, unnest(range(len(w) - 2)) AS spot, unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS gram FROM x WHERE len(w) >= 3),
    o AS (SELECT conv_id, unnest(range(len(w) - 2)) AS pos, unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS gram FROM (SELECT conv_id, regexp_extract_all(lower(output), '[\\p{{L}}\\p{{N}}]+') AS w FROM c) WHERE len(w) >= 3),
    v AS (SELECT conv_id, line, n, pos - spot AS start, count(*) AS votes FROM g JOIN o USING (conv_id, gram) GROUP BY ALL),
    b AS (SELECT conv_id, line, start FROM v WHERE 2 * votes >= n QUALIFY row_number() OVER (PARTITION BY conv_id, line ORDER BY votes DESC, start) = 1),
    r AS (SELECT conv_id, line, start, chr(CAST(32 + row_number() OVER (PARTITION BY conv_id ORDER BY line) AS INTEGER)) AS s FROM b),
    d AS (SELECT conv_id, count(*) AS located, levenshtein(string_agg(s, '' ORDER BY line), string_agg(s, '' ORDER BY start, line)) AS edits FROM r GROUP BY conv_id)
    SELECT c.conv_id, coalesce(located, 0) AS located, CASE WHEN located >= 2 THEN edits / located END AS order_error FROM c LEFT JOIN d USING (conv_id)""")
def line_order_errors(spark, sf_dir):
    """How far the lines of a conversation are out of order when its turns are read in another one."""
    t = made(spark, sf_dir, _TURNS)
    joined = lambda *by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, "text"))), lambda x: x["text"]), "\n")
    pairs = t.withColumn("at", (F.col("turn") * 3 + 1) % 7).groupBy(F.col("conv_id").alias("id")).agg(joined("turn").alias("reference"), joined("at", "turn").alias("output"))
    return O.line_order_errors(pairs).withColumnRenamed("id", "conv_id")


# A table for each order of up to five items: a header of two or three cells; where the order key allows, the first item's
# status spans two rows or its key two columns, and the covered places hold empty cells.
_TABLED = f"SELECT l_orderkey, l_linenumber AS n, concat(' a <b>  ', l_partkey, chr(10), '|') AS one, CAST(l_suppkey AS STRING) AS two, count(*) OVER (PARTITION BY l_orderkey) AS rows FROM {_ITEMS}"


@query(f"""WITH t AS ({_TABLED.replace('STRING', 'VARCHAR')}), c AS (SELECT *, l_orderkey % 4 AS form FROM t)
    SELECT l_orderkey, CASE WHEN form IN (0, 1) THEN CASE form WHEN 0 THEN '| Part \\| key | Supplier |' || chr(10) || '|---|---|' ELSE '| Part \\| key | Supplier |  |' || chr(10) || '|---|---|---|' END || chr(10) || string_agg('| a <b> ' || replace(one[9:], chr(10) || '|', ' \\|') || ' | ' || two || CASE form WHEN 1 THEN ' | n |' ELSE ' |' END, chr(10) ORDER BY n)
    ELSE '<table>' || chr(10) || string_agg('<tr>' || CASE WHEN one IS NULL THEN '' ELSE '<td' || CASE WHEN form = 2 AND n = 1 AND rows > 1 THEN ' rowspan="2"' WHEN form = 3 AND n = 1 THEN ' colspan="2"' ELSE '' END || '>a &lt;b&gt; ' || replace(one[9:], chr(10), ' ') || '</td>' END || CASE WHEN form = 3 AND n = 1 THEN '' ELSE '<td>' || two || '</td>' END || '</tr>', chr(10) ORDER BY n) || chr(10) || '</table>' END AS markdown
    FROM (SELECT * REPLACE (CASE WHEN form = 2 AND n = 2 AND rows > 1 THEN NULL ELSE one END AS one) FROM c) GROUP BY l_orderkey, form""")
def written_tables(spark, sf_dir):
    """Tables of every order's items as Markdown, in pipes or HTML."""
    t = made(spark, sf_dir, _TABLED).withColumn("form", F.col("l_orderkey") % 4)
    cell = lambda text, header=False, down=1, right=1: F.struct(text.alias("text"), F.lit(header).alias("header"), F.lit(down).cast("int").alias("row_span") if isinstance(down, int) else down.alias("row_span"), F.lit(right).cast("int").alias("col_span") if isinstance(right, int) else right.alias("col_span"))
    first = F.col("n") == 1
    down = F.when((F.col("form") == 2) & first & (F.col("rows") > 1), 2).otherwise(1)
    right = F.when((F.col("form") == 3) & first, 2).otherwise(1)
    row = F.concat(F.array(cell(F.col("one"), False, down, right), cell(F.col("two"))), F.when(F.col("form") == 1, F.array(cell(F.lit("n")))).otherwise(F.array().cast("array<struct<text:string,header:boolean,row_span:int,col_span:int>>")))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n", row.alias("row")))), lambda x: x["row"])
    head = F.when(F.col("form") < 2, F.array(F.array(cell(F.lit("Part | key"), True), cell(F.lit("Supplier"), True)))).otherwise(F.array().cast("array<array<struct<text:string,header:boolean,row_span:int,col_span:int>>>"))
    return t.groupBy("l_orderkey", "form").agg(rows.alias("rows")).select("l_orderkey", L.write_table(F.concat(head, F.col("rows"))).alias("markdown"))


# Three words an item; the first region holds the first words of four items, the second, which overlaps it, the rest of these
# and all second words, which stand two points lower; third words are outside.
_PRINTED = f"""SELECT l_orderkey AS doc_id, 1 AS page, 3 * l_linenumber + w AS word, CAST(CASE w WHEN 1 THEN 10 WHEN 2 THEN 60 ELSE 150 END AS DOUBLE) AS x0, CAST(10 * l_linenumber + CASE w WHEN 2 THEN 2 ELSE 0 END AS DOUBLE) AS y0,
    CASE w WHEN 1 THEN concat('p', l_partkey) WHEN 2 THEN concat('s', l_suppkey) ELSE 'x' END AS text FROM {_ITEMS}"""


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber AS n, concat('p', l_partkey) AS p, concat('s', l_suppkey) AS s FROM {_ITEMS})
    SELECT l_orderkey AS doc_id, concat(coalesce(string_agg(p, chr(10) ORDER BY n) FILTER (n <= 4), ''), chr(10), string_agg(CASE WHEN n <= 4 THEN s ELSE concat(p, ' ', s) END, chr(10) ORDER BY n), chr(10)) AS text, count(*) AS missed FROM i GROUP BY l_orderkey""")
def reference_texts(spark, sf_dir):
    """Reference texts of every order's page, each word claimed by the first region that holds it."""
    words = made(spark, sf_dir, _PRINTED + " LATERAL VIEW explode(array(1, 2, 3)) u AS w", {"lineitem": "l_orderkey"}).withColumn("x1", F.col("x0") + 20).withColumn("y1", F.col("y0") + 8)
    pages = words.select("doc_id", "page").distinct()
    boxes = F.array(*(F.struct(F.lit(k).alias("region"), *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), at, strict=True))) for k, at in ((1, (0.0, 0.0, 0.25, 0.0005)), (2, (0.0, 0.0, 0.5, 1.0)))))
    regions = pages.withColumn("r", F.explode(boxes)).select("doc_id", "page", "r.*", F.lit(200.0).alias("width"), F.lit(100_000.0).alias("height"))
    return S.references(words, regions).select("doc_id", "text", "missed")
