"""Queries of statistical keywords, cached reads and learned factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keywords as K, phrases as X, statistical as Y
from ..streaming import cache
from .elements import made
from .queries import query, read

_STOP = ", ".join(f"'{w}'" for w in K.STOP)


@query(f"""WITH s AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS sentence, unnest(a) AS s FROM (SELECT doc_id, string_split_regex(text, '[.!?]+\\s+|\\n+') AS a FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT doc_id, sentence, generate_subscripts(a, 1) - 1 AS chunk, regexp_extract_all(unnest(a), '[\\p{{L}}\\p{{N}}]+(?:[''’\\-][\\p{{L}}\\p{{N}}]+)*') AS ws FROM (SELECT doc_id, sentence, string_split_regex(s, '[^\\p{{L}}\\p{{N}}''’\\- ]+') AS a FROM s)),
    t AS (SELECT doc_id, sentence, chunk, i - 1 AS spot, ws[i] AS word, lower(ws[i]) AS low, CASE WHEN i > 1 THEN lower(ws[i - 1]) END AS l, lower(ws[i + 1]) AS r FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM c)),
    u AS (SELECT *, low IN ({_STOP}) OR length(low) < 3 AS stop, length(word) > 1 AND upper(word) = word AND regexp_matches(word, '\\p{{L}}') AS acronym, regexp_matches(word, '^\\p{{Lu}}') AND NOT (chunk = 0 AND spot = 0) AS capital FROM t),
    f AS (SELECT doc_id, low, stop, count(*) AS tf, greatest(count(*) FILTER (acronym), count(*) FILTER (capital AND NOT acronym)) AS caps, quantile_cont(sentence, 0.5) AS middle, count(DISTINCT sentence) AS sentences,
        coalesce(count(DISTINCT l) / nullif(count(l), 0), 0) + coalesce(count(DISTINCT r) / nullif(count(r), 0), 0) AS contexts FROM u GROUP BY ALL),
    d AS (SELECT doc_id, avg(tf) FILTER (NOT stop) + stddev_pop(tf) FILTER (NOT stop) AS usual, max(tf) AS most FROM f GROUP BY doc_id), e AS (SELECT doc_id, count(DISTINCT sentence) AS n FROM u GROUP BY doc_id),
    x AS (SELECT doc_id, low AS term, tf, caps / (1 + ln(tf)) AS a, ln(ln(3 + middle)) AS b, tf / usual AS g, 1 + contexts * tf / most AS h, sentences / n AS k FROM f JOIN d USING (doc_id) JOIN e USING (doc_id) WHERE NOT stop)
    SELECT doc_id, term, tf, round(a, 6) AS "case", round(b, 6) AS position, round(g, 6) AS frequency, round(h, 6) AS context, round(k, 6) AS spread, round(b * h / (a + g / h + k / h), 6) AS h FROM x""")
def term_features(spark, sf_dir):
    """The statistics of every term of every document."""
    f = Y.term_features(read(spark, sf_dir, "documents"))
    return f.select("doc_id", "term", "tf", *(F.round(c, 6).alias(c) for c in ("case", "position", "frequency", "context", "spread", "h")))


@query()
def statistical_keywords(spark, sf_dir):
    return Y.statistical(read(spark, sf_dir, "documents"))


@query()
def fused_keywords(spark, sf_dir):
    """Keywords by two methods, structural frequency and the statistics of terms, fused by rank."""
    return X.fused(read(spark, sf_dir, "documents"), 20, 80, K.MIN_TEXT, K.MAX_WORDS, K.BONUS, K.BOUNDARY, K.STOP, Y.LEAST, Y.SIZES, K.RRF_K, whole=False)


_READS = "SELECT CAST(user_id AS STRING) AS key, ts AS time, event_id AS seq, concat(event_type, event_id) AS value, event_type <> 'error' AS ok FROM events"


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time, seq) AS n FROM ({_READS.replace('STRING', 'VARCHAR')})),
    m AS (SELECT key, n, time + CASE WHEN ok THEN INTERVAL 6 HOUR ELSE INTERVAL 24 HOUR END AS expires, value, ok FROM r WHERE n = 1
    UNION ALL SELECT r.key, r.n, CASE WHEN r.time < m.expires THEN m.expires ELSE r.time + CASE WHEN r.ok THEN INTERVAL 6 HOUR ELSE INTERVAL 24 HOUR END END, CASE WHEN r.time < m.expires THEN m.value ELSE r.value END, CASE WHEN r.time < m.expires THEN m.ok ELSE r.ok END FROM m JOIN r ON r.key = m.key AND r.n = m.n + 1)
    SELECT r.key, r.seq, m.value <> r.value AS hit, m.value, m.ok FROM r JOIN m USING (key, n)""")
def cached_reads(spark, sf_dir):
    """Reads through a cache that keeps answers for six hours and failures for a day."""
    return cache.cached(made(spark, sf_dir, _READS), 6 * 3600, 24 * 3600).select("key", "seq", "hit", "value", "ok")


_TASKS = "SELECT CAST(user_id % 20 AS STRING) AS scope, event_id AS seq, event_type, abs(value) / 10 + 1 AS own, 2.0 AS base, abs(value) / 4 + event_id % 5 AS observed FROM events"
_KINDS = ("signup", "error", "click", "view", "purchase")
_FACTOR = "CASE t.event_type " + " ".join(f"WHEN '{k}' THEN s.{k}" for k in _KINDS) + " END"


@query(f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY seq) AS n FROM ({_TASKS.replace('STRING', 'VARCHAR')})),
    s AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS predicted, 1.0::DOUBLE AS b, {', '.join(f'1.0::DOUBLE AS {k}' for k in _KINDS)}, CAST(NULL AS DOUBLE) AS own FROM t
    UNION ALL SELECT scope, n, seq, CASE WHEN told THEN p END, CASE WHEN told THEN least(8, greatest(0.15, b * least(2, greatest(0.5, pow(observed / p, 0.5 * base * b / p))))) ELSE b END,
    {', '.join(f"CASE WHEN told AND event_type = '{k}' THEN g ELSE {k} END" for k in _KINDS)}, CASE WHEN told THEN g ELSE f END FROM
    (SELECT *, least(8, greatest(0.15, f * least(2, greatest(0.5, pow(observed / p, 0.5 * own * f / p))))) AS g, observed > 0 AND NOT (p < 2 AND observed < 2) AS told FROM
    (SELECT t.scope, t.n, t.seq, t.event_type, t.own, t.base, t.observed, s.b, {', '.join(f's.{k}' for k in _KINDS)}, {_FACTOR} AS f, t.own * {_FACTOR} + t.base * s.b AS p FROM s JOIN t ON t.scope = s.scope AND t.n = s.n + 1)))
    SELECT scope, seq, round(predicted, 6) AS predicted, round(b, 6) AS base_factor, round(own, 6) AS own_factor FROM s WHERE n > 0""")
def learned_factors(spark, sf_dir):
    """Factors of estimates learned from one task after the other."""
    t = made(spark, sf_dir, _TASKS)
    tasks = t.withColumn("parts", F.create_map("event_type", F.col("own").cast("double"), F.lit("base"), F.col("base").cast("double")))
    found = cache.learned(tasks).join(t.select("seq", "event_type"), "seq")
    return found.select("scope", "seq", F.round("predicted", 6).alias("predicted"), F.round(F.col("factors")["base"], 6).alias("base_factor"), F.round(F.element_at("factors", F.col("event_type")), 6).alias("own_factor"))
