"""The queries of this subpackage for the driver: name to (spark, sf_dir) -> DataFrame, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html, negatives, packing, pii, quality, sharding, simhash, tokencount, tokenfile, topk, trie, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate(table(spark, sf_dir, "documents"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("source")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_bpe, op2_simhash, op3_quality, op4_packing, op5_sharding, op6_warc, op7_topk, op8_tokenfile, op9_html, op10_pii, op11_negatives, op12_trie, op13_tokencount)
}

_ORIGINAL = "CASE WHEN html IS NULL THEN '' ELSE html END"
ORACLE_SQL: dict[str, str] = {
    "op6_warc": f"""
        WITH p AS (SELECT page_id, {_ORIGINAL} AS html FROM pages),
             h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM h)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> original THEN original END AS refers_to
        FROM g""",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
                   FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                          CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
                   FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_trie": """
        WITH t AS (SELECT conv_id, md5(concat(octet_length(encode(r)), ':', r, x)) AS d, octet_length(encode(x)) AS b, turn
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
             o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM t),
             c AS (SELECT DISTINCT conv_id FROM o),
             -- CRC-32: each byte of the decimal id is one step, followed by eight shifts
             i AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                          lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                          lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h FROM c),
             r AS (SELECT i.conv_id, pos, d, b FROM i JOIN o ON o.conv_id = i.conv_id - i.conv_id % 5 AND pos <= h
                   UNION ALL SELECT i.conv_id, pos, d, b FROM i JOIN o ON o.conv_id = i.conv_id AND pos > h),
             s AS (SELECT conv_id, b, row_number() OVER w AS depth, string_agg(d, '') OVER w AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
             n AS (SELECT conv_id, coalesce(max(depth), 0) AS turns FROM c LEFT JOIN s USING (conv_id) GROUP BY conv_id),
             m AS (SELECT conv_id, depth, b, key, left(key, 32 * (depth - 1)) AS up, depth = turns AS ends FROM s JOIN n USING (conv_id)
                   UNION ALL SELECT conv_id, 0, 0, '', NULL, turns = 0 FROM n),
             g AS (SELECT key, min(up) AS up, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(b) AS saved,
                          coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended FROM m GROUP BY key),
             k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
             u AS (SELECT DISTINCT a.key, z.key AS below FROM m a JOIN m z ON a.conv_id = z.conv_id AND z.depth >= a.depth),
             l AS (SELECT u.key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
                   FROM u JOIN g ON g.key = below LEFT JOIN k ON k.key = below GROUP BY u.key)
        SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(g.ended) AS ends_sha256
        FROM g JOIN l USING (key) LEFT JOIN k USING (key) LEFT JOIN g p ON p.key = g.up""",
}
