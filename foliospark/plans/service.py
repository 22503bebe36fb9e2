"""Queries of service rules over tables made from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import service as S
from .elements import made
from .queries import query, read

_FILES = "SELECT p_partkey, concat(replace(p_type, ' ', '_'), CASE p_size % 9 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.html' WHEN 3 THEN '.md' WHEN 4 THEN '.jpeg' WHEN 5 THEN '.exe' WHEN 6 THEN '' WHEN 7 THEN '.txt' ELSE '.tar.gz' END) AS name FROM part"


@query("SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' WHEN 3 THEN 'markdown' WHEN 4 THEN 'image' WHEN 7 THEN 'text' END AS route, CASE WHEN p_size % 9 IN (5, 6, 8) THEN 415 END AS error FROM part")
def file_routes(spark, sf_dir):
    return made(spark, sf_dir, _FILES).select("p_partkey", S.dispatch(F.col("name")).alias("d")).select("p_partkey", "d.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name FROM customer")
def decoded_payloads(spark, sf_dir):
    sent = F.when(F.col("c_custkey") % 4 > 0, F.base64(F.encode("c_name", "UTF-8"))).when(F.col("c_custkey") % 8 == 0, F.lit("a*b"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.decode(S.decoded(sent), "UTF-8").alias("name"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) AS coordinate, round(l_discount / 3, 3) AS coverage, round(l_tax / 7, 6) AS score, round(l_discount / 7, 4) AS fused FROM lineitem")
def rounded_numbers(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.rounded(c("l_extendedprice") / 7, "coordinate").alias("coordinate"), S.rounded(c("l_discount") / 3, "coverage").alias("coverage"), S.rounded(c("l_tax") / 7, "score").alias("score"), S.rounded(c("l_discount") / 7, "fused").alias("fused"))


_SPEND = "SELECT o_custkey AS ledger, o_orderkey AS ord, 50000.0 AS worst, CASE WHEN o_orderkey % 5 > 0 THEN floor(o_totalprice / 10) END AS cost FROM orders"


@query(f"""WITH s AS ({_SPEND}), b AS (SELECT *, coalesce(sum(coalesce(cost, worst)) OVER (PARTITION BY ledger ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
    f AS (SELECT ledger, min(ord) FILTER (before + worst > 150000) AS stop, min(ord) FILTER (cost IS NULL) AS failed FROM b GROUP BY ledger)
    SELECT b.ledger, b.ord, CAST(before AS DOUBLE) AS spent_before FROM b JOIN f USING (ledger) WHERE (stop IS NULL OR ord < stop) AND (failed IS NULL OR ord <= failed)""")
def spend_ledger(spark, sf_dir):
    s = made(spark, sf_dir, _SPEND).withColumns({"worst": F.col("worst").cast("double"), "cost": F.col("cost").cast("double")})
    return S.within_spend(s, 150_000.0).select("ledger", "ord", F.col("spent_before").cast("double").alias("spent_before"))


_ANSWERS = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'no json' WHEN 1 THEN '{"box": [1, 2, 3, 4]}' WHEN 2 THEN concat('```json', chr(10), '[{"box": [1, 2, 3, 4], "label": "text"}, {"box": [1, 2]}, {"label": "x"}]', chr(10), '```')
    ELSE concat('[{"box": [1, 2, 3, ', CAST(o_custkey AS STRING), '], "label": "table"}]') END AS answer, CASE WHEN o_orderkey % 5 = 0 THEN 'length' ELSE 'stop' END AS finish FROM orders"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 1 THEN 1 END AS n, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 1 THEN CASE WHEN o_orderkey % 7 = 2 THEN 2 ELSE 0 END END AS malformed,
    CASE WHEN o_orderkey % 5 = 0 THEN 'cut off' WHEN o_orderkey % 7 <= 1 THEN 'no array' END AS error FROM orders""")
def strict_region_answers(spark, sf_dir):
    return made(spark, sf_dir, _ANSWERS).select("o_orderkey", S.strict_regions(F.col("answer"), F.col("finish")).alias("r")).select("o_orderkey", "r.*")


@query("""SELECT label, count(*) FILTER (g = label AND o = label) AS hits, count(*) FILTER (g = label) AS n_gold, count(*) FILTER (o = label) AS n_output, round(hits / n_gold, 6) AS recall, round(hits / n_output, 6) AS precision
    FROM (SELECT l_returnflag AS g, CASE WHEN l_linenumber % 3 = 0 THEN 'N' ELSE l_returnflag END AS o FROM lineitem), (SELECT unnest(['A', 'N', 'R']) AS label) GROUP BY label""")
def label_scores(spark, sf_dir):
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gold"), F.when(F.col("l_linenumber") % 3 == 0, "N").otherwise(F.col("l_returnflag")).alias("output"))
    return S.label_scores(pairs, ["A", "N", "R"])


@query("""WITH s AS (SELECT a, b FROM (SELECT unnest([1, 2, 4]) AS a), (SELECT unnest([10, 20]) AS b)), e AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN 'held' ELSE 'dev' END AS split FROM part),
    v AS (SELECT e.*, a, b, CAST((p_size * a) % b AS DOUBLE) AS x, CAST((p_size * 2) % 10 AS DOUBLE) AS base FROM e CROSS JOIN s)
    SELECT a, b, split, round(avg(x), 6) AS mean, count(*) FILTER (x > base + 0.0005) AS better, count(*) FILTER (x < base - 0.0005) AS worse FROM v GROUP BY ALL""")
def parameter_grid(spark, sf_dir):
    e = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), "p_size", F.when(F.col("p_partkey") % 3 == 0, "held").otherwise("dev").alias("split"))
    return S.grid([(a, b) for a in (1, 2, 4) for b in (10, 20)], e, ((F.col("p_size") * F.col("a")) % F.col("b")).cast("double"), ("a", "b"), (2, 10))


@query("""SELECT user_id AS leg, count(*) FILTER (event_type IN ('view', 'click')) AS ok, count(*) FILTER (event_type IN ('signup', 'purchase')) AS fallback, count(*) FILTER (event_type = 'error') AS failed,
    round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS longest FROM events GROUP BY user_id""")
def leg_report(spark, sf_dir):
    outcome = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "failed").otherwise("fallback")
    return S.leg_report(read(spark, sf_dir, "events").select(F.col("user_id").alias("leg"), F.col("event_id").alias("page"), outcome.alias("outcome"), F.col("value").alias("seconds")))


@query("SELECT page_id AS page, page_id % 3 > 0 AND page_id % 7 > 0 AND page_id % 11 > 0 AS same FROM pages WHERE NOT (page_id % 7 = 0 AND page_id % 11 = 0)")
def identical_runs(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    a = p.where("page_id % 7 > 0").select(F.col("page_id").alias("page"), F.col("html").alias("text"))
    b = p.where("page_id % 11 > 0").select(F.col("page_id").alias("page"), F.concat("html", F.when(F.col("page_id") % 3 == 0, " ").otherwise("")).alias("text"))
    return S.identical(a, b)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'type' WHEN p_retailprice > 1500 THEN 'size' WHEN p_size > 20 THEN 'pages' END AS refused FROM part")
def refused_files(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "png", "jpg", "zip"))), (F.col("p_size") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", S.refusal(F.col("p_size"), F.col("p_retailprice"), kind, most_bytes=1500).alias("refused"))


# Links to pages and to PDF files, one file or two of a kind, or of two kinds, by every engine.
_ASKED = """SELECT p_partkey, p_size % 7 AS form, CASE p_size % 7 WHEN 0 THEN 'https://x.test/a.html' WHEN 1 THEN 'https://x.test/A.PDF?page=2' END AS url, CASE p_partkey % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'docling' WHEN 2 THEN 'glm-ocr' END AS engine,
    p_partkey % 3 = 0 AS chapters, p_partkey % 5 < 2 AS reader, CASE p_partkey % 11 % 3 WHEN 0 THEN 'scan' WHEN 1 THEN 'text' END AS probe FROM part"""


@query(f"""WITH a AS ({_ASKED}), d AS (SELECT *, CASE engine WHEN 'docling' THEN 'docling,structure' WHEN 'glm-ocr' THEN 'glm,structure' END AS remote, CASE WHEN engine = 'fast' THEN 'ocrFast' ELSE 'ocr,layout' END AS scan, CASE WHEN reader THEN ',reader' ELSE '' END AS read FROM a),
    s AS (SELECT *, CASE form WHEN 0 THEN 'render,extract' WHEN 1 THEN 'render,fetchPdf,' || coalesce(remote, 'inspect,read,structure')
        WHEN 2 THEN 'upload,' || coalesce(remote, CASE probe WHEN 'scan' THEN 'inspect,' || scan WHEN 'text' THEN 'inspect,textLayer' ELSE 'inspect,read' END || ',structure') || read
        WHEN 3 THEN 'upload,' || CASE WHEN engine = 'docling' THEN 'docling' ELSE 'mammoth' END || read WHEN 4 THEN 'upload,' || coalesce(remote, scan || ',structure') || read
        WHEN 5 THEN 'upload,' || coalesce(remote, CASE WHEN probe = 'scan' THEN 'inspect,' || scan WHEN probe = 'text' THEN 'inspect,read' ELSE 'inspect,' || scan END || ',structure') || read
        ELSE 'upload,mixed' || CASE WHEN engine IS NULL THEN ',structure' ELSE '' END || read END AS made FROM d)
    SELECT p_partkey, made || CASE WHEN chapters AND form < 5 THEN ',chapters' ELSE '' END || ',normalize,markdown' AS stages FROM s""")
def request_stages(spark, sf_dir):
    a, lit = made(spark, sf_dir, _ASKED), lambda *x: F.array(*map(F.lit, x))
    kinds = F.when(F.col("form") == 2, lit("pdf")).when(F.col("form") == 3, lit("docx")).when(F.col("form") == 4, lit("image")).when(F.col("form") == 5, lit("pdf", "pdf")).when(F.col("form") == 6, lit("pdf", "docx")).otherwise(F.array().cast("array<string>"))
    # the second of two PDF files is a scan
    probes = F.when(F.col("form") == 5, F.array("probe", F.lit("scan"))).when(F.col("form") == 2, F.array("probe")).otherwise(F.transform(kinds, lambda k: F.lit(None).cast("string")))
    found = S.stages(F.col("url"), kinds, probes, F.col("engine"), F.col("chapters"), F.col("reader"))
    return a.select("p_partkey", F.array_join(found, ",").alias("stages"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN 10 * x <= 9 THEN x ELSE 0.9 + 0.08 * (1 - exp(-2.5 * (x - 0.9))) END, 9) AS shown FROM (SELECT *, l_quantity / 50.0 AS x FROM lineitem)")
def shown_progress(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.progress(F.col("l_quantity"), F.lit(50.0)), 9).alias("shown"))


@query("SELECT event_type, year(ts) * 100 + month(ts) AS ym, count(*) AS n, round(sum(value), 4) AS used, CASE WHEN sum(value) >= 180000 THEN 'over' WHEN sum(value) >= 144000 THEN 'warn' ELSE 'ok' END AS state FROM events GROUP BY ALL")
def monthly_usage(spark, sf_dir):
    month = (F.year("ts") * 100 + F.month("ts")).cast("long")
    used = read(spark, sf_dir, "events").groupBy("event_type", month.alias("ym")).agg(F.count("*").alias("n"), F.sum("value").alias("u"))
    return used.select("event_type", "ym", "n", F.round("u", 4).alias("used"), S.usage_state(F.col("u"), F.lit(180_000.0)).alias("state"))


@query("SELECT l_orderkey AS doc_id, CASE WHEN count(DISTINCT l_suppkey % 3 = 0) = 2 THEN 'mixed' WHEN max(l_suppkey % 3) = 0 THEN 'scan' ELSE 'text' END AS kind FROM lineitem GROUP BY ALL")
def probed_kinds(spark, sf_dir):
    return S.probe_kind(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3 == 0).alias("scanned")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'first ' || o_custkey WHEN o_orderkey % 5 > 0 THEN 'second ' || o_custkey WHEN o_orderkey % 7 > 0 THEN 'third ' || o_custkey END AS text,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 > 0 THEN 2 WHEN o_orderkey % 7 > 0 THEN 3 END AS engine FROM orders""")
def fallback_ladder(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    said = lambda name, ok: o.select("id", F.when(ok, F.concat(F.lit(f"{name} "), F.col("o_custkey").cast("string"))).alias("text"))
    return S.ladder(o, said("first", F.col("id") % 3 == 0), said("second", F.col("id") % 5 > 0), said("third", F.col("id") % 7 > 0))


@query("""WITH f AS (SELECT o_custkey AS batch, o_orderkey AS ord, o_orderstatus AS name, o_orderkey % 6 > 0 AS ok, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY batch, ok, name ORDER BY ord) AS k FROM f) SELECT batch, ord, CASE WHEN ok AND n <= 20 THEN 'ok' ELSE 'error' END AS status,
    CASE WHEN n > 20 THEN 'too many files' WHEN NOT ok THEN 'not converted' END AS error, CASE WHEN ok AND n <= 20 THEN name || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' END AS filename FROM k""")
def batch_results(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return S.batch_results(o.select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 6 > 0, "text").alias("text")), 20)


@query("SELECT p_partkey, CASE WHEN p_size * 3 > 100 AND p_partkey % 4 > 0 THEN 'top_k must be from 1 to 100' END AS limit_error, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'a batch cannot be split into chapters' END AS option_error FROM part")
def request_errors(spark, sf_dir):
    asked = F.when(F.col("p_partkey") % 4 > 0, F.col("p_size") * 3)
    return read(spark, sf_dir, "part").select("p_partkey", S.top_k_error(asked).alias("limit_error"), S.exclusive_error(F.col("p_size") > 25, F.col("p_partkey") % 2 == 0).alias("option_error"))


@query("SELECT DISTINCT p_type AS name FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size > 48)")
def unknown_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return S.unknown_names(p.select(F.col("p_type").alias("name")), p.where("p_size > 48").select(F.col("p_type").alias("name")))


@query("""WITH a AS (SELECT o_custkey AS c, o_orderstatus AS s FROM orders), b AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders)
    SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS lost, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS added""")
def row_differences(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return S.same_rows(o.select("o_custkey", "o_orderstatus"), o.select("o_custkey", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus"))))


@query("""WITH g AS (SELECT 'u' || user_id AS url, event_id AS seq, 'v' || CAST(floor(value) AS BIGINT) AS markdown FROM events WHERE event_type <> 'error')
    SELECT url, left(sha256(url), 16) AS file_key, max(seq) AS seq, arg_max(markdown, seq) AS markdown FROM g GROUP BY url""")
def snapshots(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_type") != "error", F.concat(F.lit("v"), F.floor("value").cast("string")))
    return S.latest(e.select(F.concat(F.lit("u"), F.col("user_id")).alias("url"), F.col("event_id").alias("seq"), text.alias("markdown")))


# Ten keywords a brand, none for some; found by one to three methods. Brands' documents open with a heading, with blank lines
# and a heading, with text, and with an old table.
_RANKED = """SELECT p_brand, rank, CASE WHEN kind = 3 THEN NULL ELSE concat(p_type, '|', p_size) END AS keyword, p_size / 50.0 AS weight, p_size % 3 AS found, CASE WHEN kind > 1 THEN 'Only the text was read.' END AS note FROM
    (SELECT p_brand, p_type, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, ascii(right(p_brand, 1)) % 4 AS kind FROM part) AS p WHERE rank <= CASE WHEN kind = 2 THEN 1 ELSE 10 END"""
_BRANDED = "CASE ascii(right(p_brand, 1)) % 4 WHEN 0 THEN concat('# ', p_brand, chr(10), chr(10), 'text', chr(10)) WHEN 1 THEN concat(chr(10), ' ', chr(10), '## ', p_brand, chr(10), 'text', chr(10), '# more') WHEN 2 THEN concat('text', chr(10), '# ', p_brand) ELSE concat('# ', p_brand, chr(10), '<!-- keywords -->', chr(10), 'old', chr(10), '<!-- /keywords -->', chr(10), chr(10), 'text') END"


@query(f"""WITH r AS ({_RANKED}), t AS (SELECT p_brand, CASE WHEN count(keyword) = 0 THEN '## Keywords' || chr(10) || chr(10) || '*Only the text was read.*' || chr(10) ELSE '## Keywords' || chr(10) || chr(10) || '| Keyword | Weight | Found by |' || chr(10) || '| --- | ---: | --- |' || chr(10) ||
    string_agg('| ' || replace(keyword, '|', '\\|') || ' | ' || format('{{:.2f}}', weight) || ' | ' || CASE found WHEN 0 THEN 'frequency' WHEN 1 THEN 'frequency, yake' ELSE 'yake, keybert' END || ' |', chr(10) ORDER BY rank) || chr(10) || chr(10) || '*' || count(*) || CASE WHEN count(*) = 1 THEN ' keyword' ELSE ' keywords' END || ' extracted by ' ||
    concat_ws(', ', CASE WHEN bool_or(found < 2) THEN 'frequency' END, CASE WHEN bool_or(found > 0) THEN 'yake' END, CASE WHEN bool_or(found = 2) THEN 'keybert' END) || '. Weight is relative to the top-ranked term (1.00), fused across methods by rank.*' || coalesce(chr(10) || chr(10) || '*' || max(note) || '*', '') || chr(10) END AS t FROM r GROUP BY p_brand),
    b AS (SELECT p_brand, ascii(right(p_brand, 1)) % 4 AS kind, '<!-- keywords -->' || chr(10) || chr(10) || t || chr(10) || '<!-- /keywords -->' AS block FROM t)
    SELECT p_brand, CASE kind WHEN 1 THEN ' ' || chr(10) || '## ' || p_brand WHEN 2 THEN '' ELSE '# ' || p_brand END || CASE WHEN kind = 2 THEN '' ELSE chr(10) || chr(10) END || block || chr(10) || chr(10) || CASE kind WHEN 1 THEN 'text' || chr(10) || '# more' WHEN 2 THEN 'text' || chr(10) || '# ' || p_brand ELSE 'text' END || chr(10) AS markdown FROM b""")
def keyword_tables(spark, sf_dir):
    """Documents with their keyword tables, put in twice; taking out the first also takes line feeds that lead the document."""
    methods = F.when(F.col("found") == 0, F.array(F.lit("frequency"))).when(F.col("found") == 1, F.array(F.lit("yake"), F.lit("frequency"))).otherwise(F.array(F.lit("keybert"), F.lit("yake")))
    table = S.keyword_table(made(spark, sf_dir, _RANKED).withColumn("methods", methods), "p_brand").withColumnRenamed("markdown", "t")
    once = table.withColumn("markdown", S.with_table(F.expr(_BRANDED), F.col("t")))
    return once.select("p_brand", S.with_table(F.col("markdown"), F.col("t")).alias("markdown"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS key, count(DISTINCT l_linestatus || (l_linenumber % 2)) AS votes FROM lineitem GROUP BY ALL")
def candidate_votes(spark, sf_dir):
    return S.pooled_votes(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat("l_linestatus", (F.col("l_linenumber") % 2).cast("string")).alias("method"), F.col("l_returnflag").alias("key")))
