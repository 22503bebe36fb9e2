"""Queries of gold files and emphasis, over files made of conversations and texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import gold as G, pdf as P
from .elements import made
from .queries import query

# A file for each conversation, a block for each turn: headings with ids, captions of them (of nothing in every fifth file), figures
# alone, unknown words, plain paragraphs; a page mark before every second.
_TURNS = """SELECT conv_id, n, concat('b', n) AS id, CASE n % 5 WHEN 0 THEN concat('### Part ', n) WHEN 2 THEN '' ELSE concat('Words of ', role, chr(10), 'and turn ', n) END AS text,
    CASE n % 5 WHEN 0 THEN 'heading id=b' WHEN 1 THEN 'caption id=b' WHEN 2 THEN 'figure id=b' WHEN 3 THEN 'bogus id=b' END AS note, CASE WHEN n % 5 = 1 THEN CASE WHEN conv_id % 5 = 0 THEN 'nothing' ELSE concat('b', n - 1) END END AS target
    FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n FROM conversations) AS t"""


@query(f"""SELECT conv_id AS doc_id, n, CAST(n // 2 + 1 AS INTEGER) AS page, CASE n % 5 WHEN 0 THEN 'heading' WHEN 1 THEN 'caption' WHEN 2 THEN 'figure' ELSE 'paragraph' END AS type, CASE WHEN n % 5 = 0 THEN 3 END AS level, CASE WHEN n % 5 = 4 THEN '' ELSE id END AS id,
    target AS caption_of, text, CASE WHEN n % 5 = 3 THEN 'unknown annotation bogus' WHEN n % 5 = 1 AND conv_id % 5 = 0 THEN 'nothing names no block' END AS error FROM ({_TURNS})""")
def gold_files(spark, sf_dir):
    """Blocks, relations and errors of a gold file for every conversation."""
    t = made(spark, sf_dir, _TURNS)
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit("<!-- "), "note", F.col("n").cast("string"), F.coalesce(F.concat(F.lit(" caption_of="), "target"), F.lit("")), F.lit(" -->\n"))).otherwise("")
    page = F.when(F.col("n") % 2 == 0, F.concat(F.lit("<!-- page "), (F.floor(F.col("n") / 2) + 1).cast("string"), F.lit(" -->\n\n"))).otherwise("")
    block = t.withColumn("block", F.concat(page, note, "text"))
    files = block.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n\n").alias("text"))
    found = G.gold_blocks(files)
    n = F.row_number().over(G.Window.partitionBy("doc_id").orderBy("ord")) - 1
    return found.select("doc_id", n.cast("long").alias("n"), "page", "type", "level", "id", F.try_element_at("relations", F.lit("caption_of")).alias("caption_of"), "text", "error")


_WORDS = "SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+', 0) AS ws FROM documents WHERE text IS NOT NULL"


@query(f"""WITH w AS (SELECT doc_id, unnest(range(len(ws))) AS i FROM ({_WORDS}) WHERE len(ws) > 0),
    c AS (SELECT doc_id, count(*) AS aligned, count(*) FILTER (i % 3 = 0) AS gold, count(*) FILTER (i % 4 = 0) AS output, count(*) FILTER (i % 12 = 0) AS "both" FROM w GROUP BY doc_id)
    SELECT *, round("both" / gold, 6) AS recall, round("both" / output, 6) AS precision FROM c""")
def emphasis_scores(spark, sf_dir):
    """Emphasis of the words of every document, every third in gold, every fourth in output."""
    docs = made(spark, sf_dir, _WORDS).where(F.size("ws") > 0)
    every = lambda n, marks: F.array_join(F.transform("ws", lambda w, i: F.when(i % n == 0, F.concat(F.lit(marks[0]), w, F.lit(marks[1]))).otherwise(w)), " ")
    pairs = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("# **A heading** with 0 emphasis\n\n"), every(3, ("**", "**"))).alias("gold"), every(4, ("<em>", "</em>")).alias("output"))
    return G.emphasis_scores(pairs).withColumnRenamed("id", "doc_id")


# A file for each part: pages by its size, fonts and images by its key, some by a scanner, some no PDF or without pages.
_PDFS = """SELECT p_partkey, p_size % 6 AS n, p_partkey % 4 AS fonts, p_partkey % 7 AS images, CASE WHEN p_partkey % 5 = 0 THEN 'ScanSnap' ELSE 'Writer' END AS maker FROM part"""


@query(f"""WITH p AS ({_PDFS}), k AS (SELECT *, CASE WHEN n = 0 OR p_partkey % 11 = 0 THEN NULL WHEN fonts = 0 THEN 1 WHEN images >= 0.8 * n AND maker = 'ScanSnap' THEN 2 ELSE 3 END AS rule FROM p)
    SELECT p_partkey, CASE WHEN rule > 0 THEN n END AS pages, CASE WHEN rule < 3 THEN 'scan' WHEN rule = 3 THEN 'text' END AS kind, CASE rule WHEN 1 THEN 'high' WHEN 2 THEN 'low' WHEN 3 THEN CASE WHEN images > n THEN 'low' ELSE 'high' END END AS confidence FROM k""")
def probed_pdfs(spark, sf_dir):
    """What the bytes of a made PDF file for every part tell."""
    p = made(spark, sf_dir, _PDFS)
    many = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    tree = F.when(F.col("n") > 0, F.concat(F.lit("<< /Type /Pages /Count "), F.col("n").cast("string"), F.lit(" >>\n"))).otherwise("")
    text = F.concat(F.when(F.col("p_partkey") % 11 == 0, "%PNG\n").otherwise("%PDF-1.4\n"), tree, many("<< /Type /Font >>\n", F.col("fonts")), many("<< /Subtype /Image >>\n", F.col("images")), F.lit("<< /Producer ("), "maker", F.lit(") >>\n"))
    found = p.select("p_partkey", P.probed(F.encode(text, "UTF-8")).alias("p"))
    return found.select("p_partkey", F.col("p.pages").alias("pages"), F.col("p.kind").alias("kind"), F.col("p.confidence").alias("confidence"))
