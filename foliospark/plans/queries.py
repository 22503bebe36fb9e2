"""Queries over the driver's tables, each with the SQL that DuckDB runs beside it.

Queries that are plain relational algebra are one SQL text for both engines; the others apply this package's
operators, and their SQL is written independently.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import keywords as K, metrics as M, phrases as X, score as S, statistical as Y, structure as D
from ..sources import web as W
from ..streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def shared(name: str, sql: str, spark_words: dict[str, str] | None = None) -> None:
    """One SQL text for both engines; ``spark_words`` are replaced for Spark."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql
    for old, new in (spark_words or {}).items():
        text = text.replace(old, new)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        quoted = text.replace("{", "{{").replace("}", "}}")
        for t in used:
            quoted = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", quoted)
        return spark.sql(quoted, **{t: read(spark, sf_dir, t) for t in used})

    QUERIES[name], ORACLE[name] = run, sql


# --- text ------------------------------------------------------------------------------------------------------

_CLEAN = """regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(nfc_normalize(regexp_replace(text,
    '(data:[A-Za-z0-9!#$&^_.+-]*/?[A-Za-z0-9!#$&^_.+-]*;base64,)[A-Za-z0-9+/=]+', '\\1...', 'g')), chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    chr(160) || chr(8203) || chr(65279), ' '), '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') || chr(10)"""


@query(f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '' ELSE {_CLEAN} END AS markdown FROM documents")
def normalize_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(F.col("text")).alias("markdown"))


_SLUG = "coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '^-+|-+$', '', 'g'), ''), '{f}')"


@query("SELECT p_partkey, " + _SLUG.format(x="p_name", f="section") + " AS slug, " + _SLUG.format(x="regexp_replace(p_type || '.PDF', '\\.[A-Za-z0-9]{1,5}$', '')", f="document") + " || '.md' AS filename FROM part")
def slug_filenames(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.markdown_filename(F.concat(F.lit("a\\b/"), "p_type", F.lit(".PDF"))).alias("filename"))


@query("SELECT page_id, sha256(url) AS hash, left(sha256(url), 16) AS file_key FROM pages")
def snapshot_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.sha2("url", 256).alias("hash"), F.left(F.sha2("url", 256), F.lit(16)).alias("file_key"))


_W = "'\\p{L}[\\p{L}\\p{N}_''’-]*|\\p{N}+[\\p{L}\\p{N}_''’-]*'"
_STEM = """CASE WHEN length(w) < 4 OR NOT regexp_full_match(w, '\\p{L}+') THEN w WHEN suffix(w, 'ies') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
    WHEN regexp_matches(w, '(ss|us|is|os)$') THEN w WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') THEN left(w, length(w) - 2) WHEN suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END"""
_GRAMS = f"""
    seg AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_\\s''’-]+|\\n[ \\t]*\\n\\s*'),
                lambda s: list_transform(regexp_extract_all(replace(lower(s), '’', ''''), {_W}), lambda w: {_STEM}))) AS ws FROM documents WHERE length(text) >= @least),
    gram AS (SELECT doc_id, k AS size, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS key
             FROM seg, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
    counted AS (SELECT doc_id, key, size, count(*) AS occurrences FROM gram GROUP BY ALL)"""
_USABLE = f"""NOT list_has_any(string_split(key, ' '), {K.BOUNDARY!r}) AND len(list_filter(string_split(key, ' '), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\\p{{N}}+'))) > 0"""
_FREQ = f"""WITH {_GRAMS.replace('@least', '200')},
    scored AS (SELECT *, round(occurrences * [1.0, 1.4, 1.6, 1.6][size]::DOUBLE, 6) AS score FROM counted WHERE occurrences >= 2 AND {_USABLE}),
    ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, key) AS rank, key, score, occurrences FROM scored)"""


@query(f"WITH {_GRAMS.replace('@least', '0')} SELECT size, count(*) AS n_keys, CAST(sum(occurrences) AS BIGINT) AS n_grams FROM counted GROUP BY size")
def ngram_counts(spark, sf_dir):
    g = K.ngrams(read(spark, sf_dir, "documents"))
    return g.groupBy("size").agg(F.count("*").alias("n_keys"), F.sum("occurrences").alias("n_grams"))


@query(f"WITH {_GRAMS.replace('@least', '200')} SELECT doc_id, count(*) AS n FROM counted WHERE occurrences >= 2 AND {_USABLE} GROUP BY doc_id")
def candidate_filter(spark, sf_dir):
    return X.candidates(read(spark, sf_dir, "documents").where(F.length("text") >= K.MIN_TEXT), K.MAX_WORDS, K.BOUNDARY)


@query(f"{_FREQ} SELECT * FROM ranked WHERE rank <= 20")
def keyword_topk(spark, sf_dir):
    return K.frequency(read(spark, sf_dir, "documents"))


_STOP = ", ".join(f"'{w}'" for w in K.STOP)
#: The statistics of terms as SQL: of documents ``docs`` (row, doc_id, text) the words ``u`` and the terms ``x`` with their ``h``.
_SCORED = f"""s AS (SELECT row, doc_id, generate_subscripts(a, 1) - 1 AS sentence, unnest(a) AS s FROM (SELECT row, doc_id, string_split_regex(text, '[.!?]+\\s+|\\n+') AS a FROM docs)),
    c AS (SELECT row, doc_id, sentence, generate_subscripts(a, 1) - 1 AS chunk, regexp_extract_all(unnest(a), '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*') AS ws FROM (SELECT row, doc_id, sentence, string_split_regex(s, '[^\\p{{L}}\\p{{N}}''’\\- ]+') AS a FROM s)),
    t AS (SELECT row, doc_id, sentence, chunk, i - 1 AS spot, ws[i] AS word, lower(ws[i]) AS low, CASE WHEN i > 1 THEN lower(ws[i - 1]) END AS l, lower(ws[i + 1]) AS r FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c)),
    u AS (SELECT *, low IN ({_STOP}) OR length(low) < 3 AS stop, length(word) > 1 AND upper(word) = word AND regexp_matches(word, '\\p{{L}}') AS acronym, regexp_matches(word, '^\\p{{Lu}}') AND NOT (chunk = 0 AND spot = 0) AS capital FROM t),
    f AS (SELECT doc_id, low, stop, count(*) AS tf, greatest(count(*) FILTER (acronym), count(*) FILTER (capital AND NOT acronym)) AS caps, quantile_cont(sentence, 0.5) AS middle, count(DISTINCT sentence) AS sentences,
        coalesce(count(DISTINCT l) / nullif(count(l), 0), 0) + coalesce(count(DISTINCT r) / nullif(count(r), 0), 0) AS contexts FROM u GROUP BY ALL),
    d AS (SELECT doc_id, avg(tf) FILTER (NOT stop) + stddev_pop(tf) FILTER (NOT stop) AS usual, max(tf) AS most FROM f GROUP BY doc_id), e AS (SELECT doc_id, count(DISTINCT sentence) AS n FROM u GROUP BY doc_id),
    v AS (SELECT doc_id, low, caps / (1 + ln(tf)) AS a, ln(ln(3 + middle)) AS b, tf / usual AS g, 1 + contexts * tf / most AS h, sentences / n AS k FROM f JOIN d USING (doc_id) JOIN e USING (doc_id) WHERE NOT stop),
    x AS (SELECT doc_id, low, b * h / (a + g / h + k / h) AS h FROM v)"""
#: DuckDB counts edits of bytes, so letters beyond ASCII are written as signs that no key has.
_BYTES = "translate(key, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&+')"
_INNER = f"list_transform({{ws}}, lambda y: NOT list_contains({K.BOUNDARY!r}, y))"


# Both rankings are four times as deep as the answer, as the reference's are. The second keeps phrases that are not alike to one
# kept before, so it goes from place to place. A key within a longer one before it is dropped whether that one is itself
# dropped or not: what drops that one holds both.
@query(
    f"""WITH RECURSIVE {_GRAMS.replace('@least', '200')},
    scored AS (SELECT *, round(occurrences * [1.0, 1.4, 1.6, 1.6][size]::DOUBLE, 6) AS score FROM counted WHERE occurrences >= 2 AND {_USABLE}),
    frequent AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, key) AS rank FROM scored),
    docs AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE length(text) >= 200), {_SCORED},
    w AS (SELECT doc_id, low AS t1, h AS h1, CASE WHEN lead(spot, 1) OVER o = spot + 1 THEN lead(low, 1) OVER o END AS t2, lead(h, 1) OVER o AS h2, CASE WHEN lead(spot, 2) OVER o = spot + 2 THEN lead(low, 2) OVER o END AS t3, lead(h, 2) OVER o AS h3
        FROM u JOIN x USING (doc_id, low) WINDOW o AS (PARTITION BY row, doc_id, sentence, chunk ORDER BY spot)),
    p AS (SELECT doc_id, t1 AS key, ln(h1) AS logs, h1 AS sums FROM w UNION ALL SELECT doc_id, t1 || ' ' || t2, ln(h1) + ln(h2), h1 + h2 FROM w WHERE t2 IS NOT NULL UNION ALL SELECT doc_id, t1 || ' ' || t2 || ' ' || t3, ln(h1) + ln(h2) + ln(h3), h1 + h2 + h3 FROM w WHERE t3 IS NOT NULL),
    q AS (SELECT doc_id, key, round(exp(max(logs)) / (count(*) * (1 + max(sums))), 9) AS score FROM p WHERE regexp_matches(key, '\\p{{L}}') GROUP BY ALL),
    o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score, key) AS place, key, {_BYTES} AS bytes FROM q),
    g AS (SELECT doc_id, place, [bytes] AS kept, key, true AS fresh FROM o WHERE place = 1 UNION ALL
        SELECT doc_id, place, CASE WHEN fresh THEN list_append(kept, bytes) ELSE kept END, key, fresh FROM (SELECT g.doc_id, o.place, kept, o.key, bytes,
            len(list_filter(kept, lambda y: 10 * levenshtein(y, bytes) <= greatest(length(y), length(bytes)))) = 0 AS fresh FROM g JOIN o ON o.doc_id = g.doc_id AND o.place = g.place + 1 WHERE len(kept) < 80)),
    m AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank, list_transform(string_split(replace(key, '’', ''''), ' '), lambda w: {_STEM}) AS ws FROM g WHERE fresh),
    b AS (SELECT doc_id, rank, list_position({_INNER.format(ws='ws')}, true) AS first, len(ws) + 1 - list_position({_INNER.format(ws='list_reverse(ws)')}, true) AS last, ws FROM m),
    n AS (SELECT doc_id, rank, ws[first:last] AS ws FROM b WHERE first > 0),
    significant AS (SELECT doc_id, array_to_string(ws, ' ') AS key, min(rank) AS rank FROM n WHERE len(list_filter(ws, lambda y: length(y) >= 3 AND NOT regexp_full_match(y, '\\p{{N}}+'))) > 0 GROUP BY ALL),
    voted AS (SELECT doc_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s, count(*) AS agreement FROM (SELECT doc_id, key, rank FROM frequent WHERE rank <= 80 UNION ALL SELECT doc_id, key, rank FROM significant) GROUP BY ALL),
    placed AS (SELECT z.*, coalesce(occurrences, 0) AS occurrences, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, key) AS place FROM voted AS z LEFT JOIN counted USING (doc_id, key)),
    kept AS (SELECT * FROM placed AS a WHERE occurrences = 0 OR NOT EXISTS (SELECT 1 FROM placed AS z WHERE z.doc_id = a.doc_id AND z.place < a.place AND length(z.key) > length(a.key) AND z.occurrences >= a.occurrences AND contains(' ' || z.key || ' ', ' ' || a.key || ' '))),
    r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS rank, key, round(s / max(s) OVER (PARTITION BY doc_id), 4) AS score, agreement FROM kept)
    SELECT * FROM r WHERE rank <= 20"""
)
def keyword_fusion(spark, sf_dir):
    """The reference's fusion of the two methods that need no model: structural frequency and the statistics of terms."""
    docs = read(spark, sf_dir, "documents").where(F.length("text") >= K.MIN_TEXT)
    return X.fused(docs, 20, 80, K.MIN_TEXT, K.MAX_WORDS, K.BONUS, K.BOUNDARY, K.STOP, Y.LEAST, Y.SIZES, K.RRF_K, whole=True)


@query()
def keyword_subsumption(spark, sf_dir):
    from pyspark.sql import Window

    pool = K.frequency(read(spark, sf_dir, "documents"), min(400, max(40, 4 * 20))).select("doc_id", "rank", "key", "occurrences")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))
    return K.drop_subsumed(pool).withColumn("place", place).where("place <= 20").drop("place")


# --- pages -----------------------------------------------------------------------------------------------------


@query(
    """SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host,
    regexp_matches(url, '^https?://[^/]') AS admitted, CASE WHEN regexp_matches(lower(url), '^[a-z]+://[^?#]*\\.pdf([?#]|$)') THEN 'pdf' ELSE 'html' END AS route FROM pages"""
)
def url_admission(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", W.scheme(u).alias("scheme"), W.host(u).alias("host"), W.admitted(u).alias("admitted"), W.route(u, F.col("html")).alias("route"))


shared(
    "page_headings",
    """SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, CAST(length(html) AS BIGINT) AS n_chars FROM pages""",
)
shared(
    "page_links",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages""",
    {"len(": "size("},
)


@query(
    """SELECT page_id, CASE WHEN b = '' THEN 'document.pdf' WHEN suffix(lower(b), '.pdf') THEN b ELSE b || '.pdf' END AS filename FROM
    (SELECT page_id, left(regexp_replace(regexp_replace(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 100) AS b FROM pages)"""
)
def pdf_filenames(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.pdf_filename(F.col("url")).alias("filename"))


# --- blocks and structure --------------------------------------------------------------------------------------

_TYPE = """CASE WHEN regexp_matches(b, '^ {0,3}(`{3,}|~{3,})') THEN 'code' WHEN regexp_matches(b, '^ {0,3}#{1,6}([ \\t]|$)') THEN 'heading' WHEN regexp_matches(b, '^\\s*\\|') THEN 'table'
    WHEN regexp_matches(b, '^ {0,3}((-[ \\t]*){3,}|(\\*[ \\t]*){3,}|(_[ \\t]*){3,})$') THEN 'rule' WHEN regexp_matches(b, '^ {0,3}([-*+]|[0-9]{1,9}[.)])[ \\t]') THEN 'list'
    WHEN regexp_matches(b, '^ {0,3}!\\[') THEN 'figure' ELSE 'paragraph' END"""


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) SELECT {_TYPE} AS type, count(*) AS n FROM l WHERE trim(b) <> '' GROUP BY 1")
def line_block_types(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("b")).where("trim(b) <> ''")
    return lines.groupBy(D.block_type(F.col("b")).alias("type")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1::BIGINT AS ord, text AS block FROM documents WHERE regexp_matches(text, '\\S')")
def document_blocks(spark, sf_dir):
    return D.split_blocks(read(spark, sf_dir, "documents"))  # no text of the driver's tables has a blank line


@query("SELECT conv_id, string_agg('**' || role || '** ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def conversation_markdown(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("trim(text) <> ''").withColumn("line", F.concat(F.lit("**"), "role", F.lit("** "), "text"))
    return D.to_markdown(turns, "conv_id", "turn", "line")




@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents),
    k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(b), '[0-9]+', '#', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS key FROM l)
    SELECT key, count(DISTINCT doc_id) AS n_docs FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 3"""
)
def repeated_lines(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("b"))
    return lines.select("doc_id", T.furniture_key(F.col("b")).alias("key")).where("key <> ''").groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 3")


@query(
    """WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE len(regexp_extract_all(text, '\\p{L}{2,}')) >= 3),
    n AS (SELECT conv_id, turn AS target, regexp_extract(text, '([^\\n]*)$', 1) AS a, lead(turn) OVER w AS source, lead(text) OVER w AS b FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, source, target FROM n WHERE b IS NOT NULL AND trim(a) <> '' AND regexp_matches(b, '^[ \\t"''‘“(*_]*[a-z]')
      AND (regexp_matches(a, '[A-Za-z][-‐][ \\t]*$') OR NOT (regexp_matches(a, '[.!?:]["''’”)\\]*_]*[ \\t]*$') OR regexp_matches(a, '[)\\]}][ \\t]*$')))"""
)
def continuation_pairs(spark, sf_dir):
    return D.continuations(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# --- scores ----------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    b, d = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("output"))
    return b.join(d, b["item_id"] == d["doc_id"]).select("item_id", "text", "output")


_TOK = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
_SIDES = f"""p AS (SELECT item_id, b.text, d.text AS output FROM benchmark b JOIN documents d ON item_id = doc_id),
    a AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest({_TOK.format(x='text')}) AS word FROM p) GROUP BY ALL),
    b AS (SELECT item_id, word, count(*) AS n FROM (SELECT item_id, unnest({_TOK.format(x='output')}) AS word FROM p) GROUP BY ALL)"""


@query(
    f"""WITH {_SIDES} SELECT item_id, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS hit, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS wanted,
    CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS given FROM a FULL JOIN b USING (item_id, word) GROUP BY item_id"""
)
def word_overlap(spark, sf_dir):
    return S.overlap(_pairs(spark, sf_dir), "item_id", "text", "output")


@query(f"WITH {_SIDES} SELECT item_id, word, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (item_id, word) WHERE a.n > coalesce(b.n, 0)")
def lost_words(spark, sf_dir):
    return S.lost_words(_pairs(spark, sf_dir), "item_id", "text", "output")


@query()
def word_error_rates(spark, sf_dir):
    return _pairs(spark, sf_dir).select("item_id", F.round(S.word_error_rate(F.col("text"), F.col("output")), 6).alias("wer"))


def _trigrams(w):
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(3)), " "))
    return F.when(F.size(w) >= 3, F.array_distinct(made))


_TRI = "list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' '))"


@query(
    f"""WITH b AS (SELECT DISTINCT item_id, unnest({_TRI.format(w='w')}) AS t FROM (SELECT item_id, {_TOK.format(x='text')} AS w FROM benchmark)),
    d AS (SELECT DISTINCT doc_id, unnest({_TRI.format(w='w')}) AS t FROM (SELECT doc_id, {_TOK.format(x='text')} AS w FROM documents))
    SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (t) GROUP BY ALL HAVING count(*) >= 5"""
)
def benchmark_contamination(spark, sf_dir):
    def trigrams(df, key):
        return df.select(key, F.explode(T.let(T.plain_words(F.col("text")), _trigrams)).alias("t"))

    b, d = trigrams(read(spark, sf_dir, "benchmark"), "item_id"), trigrams(read(spark, sf_dir, "documents"), "doc_id")
    return d.join(b, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 5")


shared(
    "label_rates",
    """SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS macro, round(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS toxic_rate
    FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())""",
)
shared(
    "paired_delta",
    """SELECT lang, count(*) AS n, sum(CASE WHEN d > 0.0005 THEN 1 ELSE 0 END) * 1 AS better, sum(CASE WHEN d < -0.0005 THEN 1 ELSE 0 END) * 1 AS worse, round(avg(d), 6) AS mean
    FROM (SELECT lang, quality - CAST(n_chars AS DOUBLE) / 33047 AS d FROM documents JOIN labels USING (doc_id)) x GROUP BY ROLLUP (lang)""".replace("sum(CASE", "count(CASE").replace(" ELSE 0 END) * 1", " END)"),
)

# --- metrics ---------------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
    p AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM r WHERE k <= 512 GROUP BY event_type)
    SELECT event_type, n, mean, longest, p50, p95 FROM (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS longest FROM events GROUP BY event_type) JOIN p USING (event_type)"""
)
def latency_percentiles(spark, sf_dir):
    return M.duration_series(read(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


@query("SELECT event_type, user_id, count(*) AS n, CAST(grouping(event_type, user_id) AS BIGINT) AS level FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def event_counters(spark, sf_dir):
    return M.counters(read(spark, sf_dir, "events"), "event_type", "user_id")


def _spans(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_type", start.alias("start"), (start + 600_000_000 + F.col("user_id") * 1_000_000).alias("stop"))


_SPANS = "s AS (SELECT event_type, epoch_us(ts) AS start, epoch_us(ts) + 600000000 + user_id * 1000000 AS stop FROM events)"


@query(
    f"""WITH {_SPANS}, e AS (SELECT event_type, start AS t, 1 AS d FROM s UNION ALL SELECT event_type, stop, -1 FROM s),
    r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM e) SELECT event_type, CAST(max(o) AS BIGINT) AS most FROM r GROUP BY event_type"""
)
def inflight_max(spark, sf_dir):
    return M.in_flight(_spans(spark, sf_dir), "event_type")


@query(
    f"""WITH {_SPANS}, m AS (SELECT *, max(stop) OVER (PARTITION BY event_type ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT event_type, CAST(sum(b) AS BIGINT) AS busy FROM (SELECT event_type, island, max(stop) - min(start) AS b FROM i GROUP BY ALL) GROUP BY event_type"""
)
def busy_time(spark, sf_dir):
    return M.busy(_spans(spark, sf_dir), "event_type", F.col("stop") - F.col("start"))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3")
def rate_limit_violations(spark, sf_dir):
    found = M.over_limit(read(spark, sf_dir, "events"), "user_id", "ts", 3, "1 day")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


shared("monthly_usage", "SELECT event_type, year(ts) * 100 + month(ts) AS ym, count(*) AS n, round(sum(value), 4) AS used, CASE WHEN sum(value) >= 180000 THEN 'over' WHEN sum(value) >= 144000 THEN 'warn' ELSE 'ok' END AS state FROM events GROUP BY event_type, year(ts) * 100 + month(ts)", {"year(ts) * 100 + month(ts)": "CAST(year(ts) * 100 + month(ts) AS BIGINT)"})


@query(
    """WITH c AS (SELECT 'u' || user_id AS url, event_id AS seq, CASE WHEN event_type <> 'error' THEN CAST(floor(value / 50) AS BIGINT)::VARCHAR END AS markdown FROM events),
    w AS (SELECT *, last_value(markdown IGNORE NULLS) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM c)
    SELECT url, seq, CASE WHEN markdown IS NULL THEN 'error' WHEN base IS NULL THEN 'new' WHEN base = markdown THEN 'unchanged' ELSE 'changed' END AS status FROM w"""
)
def change_log(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_type") != "error", F.floor(F.col("value") / 50).cast("long").cast("string"))
    return monitor.changes(e.select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("event_id").alias("seq"), text.alias("markdown")))


# --- relational shapes -----------------------------------------------------------------------------------------

shared("budget_cut", "SELECT o_orderkey, running FROM (SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders) x WHERE running <= 500000")
shared("best_of_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) x WHERE k = 1")
shared("rollup_revenue", """SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
shared("complete_groups", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
shared("anti_orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
shared("dense_levels", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type) AS level FROM part", {"dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type)": "CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type) AS BIGINT)"})
shared("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events", {"END IGNORE NULLS)": "END) IGNORE NULLS"})
shared("stratified_draw", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('draw', CAST(doc_id AS VARCHAR))), doc_id) AS k FROM documents) x WHERE k <= 7", {"VARCHAR": "STRING"})


@query("SELECT label, round(list_inner_product(m, m), 5) AS norm FROM (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label)")
def mean_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("a"))
    return mean.groupBy("label").agg(F.round(F.sum(F.col("a") * F.col("a")), 5).alias("norm"))
