"""Queries of chapters, block partners, table cells, words, chunks, vectors and windows, registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T, tokens as K
from ..operators import align, chapters, layout
from ..streaming import monitor, windows
from .elements import dealt
from .queries import query, read

_BARE = "regexp_replace(text, '[#`~]+', '', 'g')"


@query(
    f"""WITH b AS (SELECT conv_id, row_number() OVER w AS ord, 'Turn ' || turn AS title, '## Turn ' || turn || chr(10) || {_BARE} AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    s AS (SELECT conv_id, count(*) AS n, list(length(text) ORDER BY length(text))[count(*) // 2 + 1] AS mid FROM b GROUP BY conv_id)
    SELECT conv_id, ord, 1 AS level, title, CASE WHEN ord < 10 THEN '0' ELSE '' END || ord || '-' || lower(replace(title, ' ', '-')) || '.md' AS name, text
    FROM b JOIN s USING (conv_id) WHERE n BETWEEN 2 AND 500 AND mid >= 200"""
)
def conversation_chapters(spark, sf_dir):
    block = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", "[#`~]+", ""))
    c = read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", block.alias("b")).alias("s"))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n").alias("text"))
    return chapters.chapters(docs.withColumnRenamed("conv_id", "doc_id")).withColumnRenamed("doc_id", "conv_id")


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
    g AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS x FROM t) GROUP BY ALL),
    o AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(w[2:]) AS x FROM t) GROUP BY ALL),
    m AS (SELECT g.conv_id, g.turn AS gold, o.turn AS output, CAST(sum(least(g.n, o.n)) AS BIGINT) AS shared FROM g JOIN o USING (conv_id, x) GROUP BY ALL),
    k AS (SELECT m.*, row_number() OVER (PARTITION BY m.conv_id, gold ORDER BY shared DESC, output) AS a, row_number() OVER (PARTITION BY m.conv_id, output ORDER BY shared DESC, gold) AS b
          FROM m JOIN t p ON p.conv_id = m.conv_id AND p.turn = gold JOIN t q ON q.conv_id = m.conv_id AND q.turn = output WHERE 2 * shared >= greatest(len(p.w), greatest(len(q.w) - 1, 0)))
    SELECT conv_id, gold, output, shared FROM k WHERE a = 1 AND b = 1"""
)
def block_partners(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block"), T.plain_words(F.col("text")).alias("words"))
    return align.mutual_partners(t, t.withColumn("words", F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1)))), "conv_id")


@query("SELECT l_orderkey, n AS n_rows, CAST(2 AS BIGINT) AS n_cols, 2 * n AS filled, 1.0::DOUBLE AS mean_words, 0.0::DOUBLE AS numeric_share FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY ALL) WHERE n >= 2")
def tabular_orders(spark, sf_dir):
    def box(*sides):
        return F.struct(*(F.lit(s).cast("double").alias(n) if isinstance(s, int) else s.cast("double").alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)))

    item = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("r"), "l_returnflag", "l_linestatus").dropDuplicates(["doc_id", "r"]).withColumn("page", F.lit(1))
    top = F.col("r") * 20
    texts = F.array(F.struct(F.lit(0).alias("c"), F.col("l_returnflag").alias("text")), F.struct(F.lit(1).alias("c"), F.col("l_linestatus").alias("text")))
    words = item.withColumn("w", F.explode(texts)).select("doc_id", "page", (F.col("r") * 2 + F.col("w.c")).alias("ord"), "w.text", box(F.col("w.c") * 50 + 5, top + 5, F.col("w.c") * 50 + 20, top + 15).alias("box"))
    band = lambda kind, n, b: F.struct(F.lit(0).alias("table"), F.lit(kind).alias("kind"), (F.lit(n) if isinstance(n, int) else n.cast("int")).alias("n"), b.alias("box"))
    fixed = F.array(*(band(kind, n, box(*sides)) for kind, n, sides in (("table", 0, (0, 0, 100, 100_000)), ("column", 0, (0, 0, 50, 100_000)), ("column", 1, (50, 0, 100, 100_000)))))
    rows = F.transform(F.collect_list("r"), lambda r: band("row", r, box(0, r * 20, 100, r * 20 + 20)))
    bands = item.groupBy("doc_id", "page").agg(F.concat(fixed, rows).alias("b")).select("doc_id", "page", F.explode("b").alias("b")).select("doc_id", "page", "b.*")
    return layout.tabular(layout.table_cells(words, bands)).select(F.col("doc_id").alias("l_orderkey"), "n_rows", "n_cols", "filled", "mean_words", "numeric_share")


@query("SELECT doc_id, k * s AS chunk, sha256(substring(text, CAST(k * s * 500 + 1 AS BIGINT), 500)) AS digest FROM (SELECT *, unnest(range(0, (n + s - 1) // s)) AS k FROM (SELECT *, greatest((n + 23) // 24, 1) AS s FROM (SELECT doc_id, text, (length(text) + 499) // 500 AS n FROM documents)))")
def even_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    step = F.greatest(F.ceil(F.ceil(F.length("text") / 500) / 24), F.lit(1)).cast("long")
    return d.select("doc_id", step.alias("s"), F.posexplode(K.even_chunks(F.col("text"), 500, 24)).alias("k", "t")).select("doc_id", (F.col("k") * F.col("s")).alias("chunk"), F.sha2("t", 256).alias("digest"))


_RUNS = "regexp_extract_all(text, '[\\p{L}\\p{N}]+')"
_SHORT = "('a', 'i', 'an', 'of', 'to', 'in', 'on', 'by', 'is', 'at', 'or', 'as', 'be', 'it', 'we', 'no', 'mm', 'cm')"


@query(
    f"""WITH w AS (SELECT doc_id, unnest({_RUNS}) AS w FROM documents), n AS (SELECT doc_id, CAST(len({_RUNS}) AS BIGINT) AS n_raw FROM documents)
    SELECT doc_id, n_raw, count(w) FILTER (regexp_matches(w, '[0-9]') OR lower(w) IN {_SHORT} OR (length(w) >= 3 AND len(list_distinct(string_split(lower(w), ''))) >= 2
      AND regexp_matches(w, '[aeiouyAEIOUY]') AND NOT regexp_matches(w, '[a-z][A-Z]'))) AS n_plausible FROM n LEFT JOIN w USING (doc_id) GROUP BY ALL"""
)
def plausible_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", K.plausible_words(F.col("text")).alias("p")).select("doc_id", F.col("p.raw").cast("long").alias("n_raw"), F.col("p.plausible").cast("long").alias("n_plausible"))


@query("SELECT conv_id, turn, trim(regexp_replace(replace(text, '|', '\\|'), '[ \\t\\r\\n]+', ' ', 'g')) AS cell, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM conversations")
def escaped_texts(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", K.pipe_cell(F.col("text")).alias("cell"), K.html_text(F.col("text")).alias("html"))


@query("SELECT event_id, coalesce(props->>'$.none', props->>'$.k') AS value FROM events")
def json_fallback(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", K.json_first(F.col("props"), "$.none", "$.k").alias("value"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", F.round(K.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


@query(
    """WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
      FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, k"""
)
def user_sessions(spark, sf_dir):
    return windows.sessions(read(spark, sf_dir, "events"), "user_id", "ts")


@query("SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - d * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS d) GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    return windows.sliding(read(spark, sf_dir, "events"), "event_type", "ts")


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents)
    SELECT doc_id, count(*) AS n FROM l WHERE length(t) <= 120 AND (regexp_matches(t, '^(\\*\\*[^*]+\\*\\*|__[^_]+__)$')
      OR regexp_matches(t, '(?i)^\\s*[*_]{0,3}(chapter|part|book|section|chapitre|kapitel|cap[ií]tulo)\\s+([0-9]{1,3}|[ivxlc]{1,7})\\b') OR (regexp_matches(t, '(\\p{L}[^\\p{L}]*){3}') AND upper(t) = t))
    GROUP BY doc_id"""
)
def title_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    return lines.where(chapters.title_line(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w, lag({_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM conversations)
    SELECT conv_id, turn, round(CASE WHEN len(w) + len(v) = 0 THEN 1.0 ELSE len(list_distinct(list_intersect(w, v)))::DOUBLE / len(list_distinct(w || v)) END, 4) AS jaccard FROM t WHERE v IS NOT NULL"""
)
def turn_similarity(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_words(F.col("text")).alias("w"))
    t = t.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("v IS NOT NULL")
    return t.select("conv_id", "turn", F.round(K.jaccard(F.col("w"), F.col("v")), 4).alias("jaccard"))


@query(
    """SELECT doc_id, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(text, '(?m)^ {0,3}([-*+>]|#{1,6}|[0-9]{1,3}[.)])[ \\t]+', '', 'g'), '[*_`|\\\\\\[\\]#]+', '', 'g'), '\\p{P}'), '') AS marks FROM documents"""
)
def punctuation_stream(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", K.punctuation(F.col("text")).alias("marks"))


@query("SELECT a.p_partkey, round(CASE WHEN a.p_name = '' AND b.p_name = '' THEN 0.0 ELSE levenshtein(a.p_name, b.p_name)::DOUBLE / greatest(length(a.p_name), length(b.p_name)) END, 4) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def name_distance(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey").select("p_partkey", F.round(K.normalized_distance(F.col("p_name"), F.col("other")), 4).alias("distance"))


@query(
    """WITH c AS (SELECT 'u' || user_id AS url, event_id AS seq, CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS line FROM events WHERE event_type <> 'error'),
    w AS (SELECT *, lag(line) OVER (PARTITION BY url ORDER BY seq) AS old FROM c)
    SELECT url, seq, concat_ws(chr(10), '--- ' || url || ' (previous)', '+++ ' || url || ' (current)', '@@ -1,3 +1,3 @@', ' # ' || url, '-' || old, '+' || line, ' end') AS diff FROM w WHERE old <> line"""
)
def change_diffs(spark, sf_dir):
    url, line = F.concat(F.lit("u"), F.col("user_id")), F.floor(F.col("value") / 50).cast("long").cast("string")
    text = F.when(F.col("event_type") != "error", F.concat(F.lit("# "), url, F.lit("\n"), line, F.lit("\nend")))
    return monitor.diffs(read(spark, sf_dir, "events").select(url.alias("url"), F.col("event_id").alias("seq"), text.alias("markdown")))
