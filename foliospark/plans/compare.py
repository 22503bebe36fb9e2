"""Queries of surveys, comparisons, rules, draws, budgets and headings, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from .queries import query, read


@query(
    r"""WITH w AS (SELECT doc_id AS page, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w, 1 + doc_id % 2 AS columns FROM documents),
    s AS (SELECT page, len(w) AS words, len(list_filter(w, lambda x: regexp_matches(x, '\p{Nd}'))) / greatest(len(w), 1) AS share, columns FROM w)
    SELECT page, words, round(share, 3) AS num_share, columns, CASE WHEN words < 150 THEN 'near-empty' WHEN share >= 0.3 THEN 'tables' WHEN columns < 2 THEN 'single column'
    WHEN share < 0.12 THEN 'two-column prose' ELSE 'two-column + data' END AS kind, CASE WHEN share >= 0.3 OR columns = 1 THEN 'default' ELSE 'heavy' END AS reader FROM s"""
)
def page_survey(spark, sf_dir):
    return C.survey(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text", (1 + F.col("doc_id") % 2).alias("columns")))


@query(
    """WITH d AS (SELECT l_returnflag AS "set", l_tax AS cost, l_tax - l_discount AS d FROM lineitem),
    a AS (SELECT * FROM d UNION ALL SELECT 'all', cost, d FROM d)
    SELECT 'tax' AS engine, "set", count(*) AS n, round(avg(cost), 6) AS cost, round(avg(d), 6) AS delta, count(*) FILTER (d < -0.0005) AS better, count(*) FILTER (d > 0.0005) AS worse,
    count(*) FILTER (abs(d) <= 0.0005) AS same FROM a GROUP BY "set\""""
)
def paired_deltas(spark, sf_dir):
    page = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    each = F.array(*(F.struct(F.lit(n).alias("engine"), F.col(c).alias("cost")) for n, c in (("discount", "l_discount"), ("tax", "l_tax"))))
    scores = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("set"), page.alias("page"), F.inline(each))
    return C.paired(scores, "discount").withColumns({n: F.round(n, 6) for n in ("cost", "delta")})


@query(
    """WITH p AS (SELECT f.feature, CAST(f.value AS BIGINT) AS value, p_partkey * 7 % 11 - 5 AS delta, p_partkey % 3 = 0 AS held
        FROM part, LATERAL (SELECT unnest(['price', 'size']) AS feature, unnest([floor(p_retailprice / 100), p_size]) AS value) f),
    t AS (SELECT DISTINCT feature, value AS t, side FROM p, (VALUES ('>='), ('<=')) s(side) WHERE NOT held),
    n AS (SELECT feature, count(*) FILTER (NOT held) AS nd, count(*) FILTER (held) AS nh FROM p GROUP BY feature),
    r AS (SELECT t.feature, side, t, count(*) FILTER (NOT held) AS fires, sum(delta) FILTER (NOT held) AS d, count(*) FILTER (held) AS held_fires, coalesce(sum(delta) FILTER (held), 0) AS hd
          FROM t JOIN p ON p.feature = t.feature AND CASE side WHEN '>=' THEN value >= t ELSE value <= t END GROUP BY t.feature, side, t),
    g AS (SELECT r.feature, side, t, fires, d / nd AS gain, held_fires, hd / nh AS held_gain FROM r JOIN n ON n.feature = r.feature WHERE fires >= 3)
    SELECT feature, side, t, fires, round(gain, 6) AS gain, held_fires, round(held_gain, 6) AS held_gain FROM (SELECT * FROM g ORDER BY gain, feature, side, t LIMIT 8)"""
)
def rule_search(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    each = F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("long").alias("value")) for n, v in (("price", F.floor(F.col("p_retailprice") / 100)), ("size", F.col("p_size")))))
    rows = p.select(F.col("p_partkey").alias("page"), F.inline(each), (F.col("p_partkey") * 7 % 11 - 5).alias("delta"), (F.col("p_partkey") % 3 == 0).alias("held"))
    return C.threshold_rules(rows).withColumns({n: F.round(n, 6) for n in ("gain", "held_gain")})


@query("SELECT l_orderkey AS page, arg_min(l_linenumber, (l_extendedprice, l_linenumber)) AS engine, min(l_extendedprice) AS cost FROM lineitem GROUP BY l_orderkey")
def best_readings(spark, sf_dir):
    return C.best_reading(read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS engine", "l_extendedprice AS cost"))


@query("SELECT o_custkey AS page FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def complete_customers(spark, sf_dir):
    return C.complete_pages(read(spark, sf_dir, "orders").selectExpr("o_custkey AS page", "o_orderpriority AS engine"))


@query(
    """WITH v AS (SELECT user_id AS slot, event_type AS word, count(DISTINCT day(ts)) AS families FROM events WHERE event_type <> 'view' GROUP BY ALL)
    SELECT slot, arg_min(word, (-families, word)) AS word, max(families) AS families FROM v GROUP BY slot HAVING max(families) >= 2"""
)
def family_votes(spark, sf_dir):
    return C.disagreements(read(spark, sf_dir, "events").select(F.col("user_id").alias("slot"), F.day("ts").alias("family"), F.col("event_type").alias("word"), F.lit("view").alias("pivot")))


@query(
    """WITH c AS (SELECT c_custkey AS page, c_mktsegment AS kind, c_acctbal < 0 AS low, md5('s:' || c_custkey) AS key FROM customer),
    n AS (SELECT kind, count(*) FILTER (low) AS a, count(*) FILTER (NOT low) AS b FROM c GROUP BY kind),
    q AS (SELECT kind, b, least(a, CASE WHEN a > 0 AND b > 0 THEN greatest(1, least(9, round_even(10 * a / (a + b), 0))) ELSE round_even(10 * a / (a + b), 0) END) AS x FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind, low ORDER BY key, page) AS rank FROM c)
    SELECT page, kind, low FROM r JOIN q USING (kind) WHERE rank <= CASE WHEN low THEN x ELSE least(10 - x, b) END"""
)
def segment_draw(spark, sf_dir):
    return C.quota_draw(read(spark, sf_dir, "customer").selectExpr("c_custkey AS page", "c_mktsegment AS kind", "c_acctbal < 0 AS low"), 10, "s")


@query(
    """WITH f AS (SELECT o_custkey AS batch, o_orderkey AS ord, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders),
    u AS (SELECT *, sum(CASE WHEN size <= 300000 THEN size ELSE 0 END) OVER (PARTITION BY batch ORDER BY ord ROWS UNBOUNDED PRECEDING) AS used FROM f)
    SELECT batch, ord, size, CASE WHEN size > 300000 THEN 'too large' WHEN used > 1000000 THEN 'over budget' ELSE 'ok' END AS state FROM u"""
)
def order_budget(spark, sf_dir):
    return C.admit(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("ord"), F.floor("o_totalprice").alias("size")), 300000, 1000000)


_H = "h AS (SELECT event_id // 50 AS doc_id, event_id AS ord, CAST(1 + event_id * event_id % 7 % 6 AS INTEGER) AS level FROM events)"


def _headings(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.floor(e / 50).alias("doc_id"), e.alias("ord"), (1 + e * e % 7 % 6).cast("int").alias("level"))


@query(f"WITH {_H} SELECT a.doc_id, a.ord, a.level, max(b.ord) AS parent FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level GROUP BY ALL")
def heading_parents(spark, sf_dir):
    return C.heading_parents(_headings(spark, sf_dir))


@query(f"WITH {_H}, r AS (SELECT doc_id, ord, dense_rank() OVER (PARTITION BY doc_id ORDER BY level DESC) AS k FROM h), m AS (SELECT doc_id, max(k) AS most FROM r GROUP BY doc_id) SELECT doc_id, ord, CASE WHEN most >= 2 THEN least(k, 6) END AS level FROM r JOIN m USING (doc_id)")
def style_levels(spark, sf_dir):
    return C.style_levels(_headings(spark, sf_dir).withColumnRenamed("level", "style")).drop("style").withColumn("level", F.col("level").cast("long"))


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS surface FROM documents), c AS (SELECT lower(surface) AS key, surface, count(*) AS n FROM w GROUP BY ALL)
    SELECT key, arg_min(surface, (-n, surface)) AS surface, max(n) AS n FROM c GROUP BY key"""
)
def word_surfaces(spark, sf_dir):
    word = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return C.surfaces(read(spark, sf_dir, "documents").select(word.alias("surface")).withColumn("key", F.lower("surface")))


@query("SELECT event_id, round(least(greatest(0.5 * least(greatest(pow(abs(value) / 50, 0.25), 0.5), 2.0), 0.15), 8.0), 6) AS factor FROM events")
def estimate_factors(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(C.correction(F.lit(0.5), F.abs("value") / 50, F.lit(0.5)), 6).alias("factor"))


@query(
    """WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS gold, count(*) AS output, count(*) FILTER (role = 'user' AND length(text) > 100) AS matched FROM conversations GROUP BY conv_id)
    SELECT conv_id, gold, output, matched, round(matched / nullif(output, 0), 6) AS precision, round(matched / nullif(gold, 0), 6) AS recall, round(2 * matched / nullif(gold + output, 0), 6) AS f1 FROM c"""
)
def block_scores(spark, sf_dir):
    user = F.col("role") == "user"
    counts = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(user).alias("gold"), F.count("*").alias("output"), F.count_if(user & (F.length("text") > 100)).alias("matched"))
    return C.block_scores(counts).withColumns({n: F.round(n, 6) for n in ("precision", "recall", "f1")})
