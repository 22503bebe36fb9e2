"""Queries of elements and relations; their input is made from the driver's tables by one SELECT for both engines, while
operators and SQL are written apart."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T, tokens as K
from ..operators import compare as C, elements as E, keywords as W, structure as D
from . import queries as Q
from .queries import TABLES, query, read


#: Rows of a table, about, that one task takes where they are dealt.
DEALT = 150_000


def tasks(spark, rows):
    """The tasks that so many rows are dealt to."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // DEALT))


def dealt(table, *keys, rows=None):
    """Rows dealt by their keys to as many tasks as the table's size asks for; windows and sums within the keys shuffle nothing more."""
    return table.repartition(tasks(table.sparkSession, table.count() if rows is None else rows), *keys)


def made(spark, sf_dir, sql, by=None):
    """The rows of a plain SELECT over the driver's tables, some dealt (``by``: table to key)."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    quoted = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        quoted = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", quoted)
    tables = {t: read(spark, sf_dir, t) for t in used}
    return spark.sql(quoted, **{t: dealt(df, by[t]) if by and t in by else df for t, df in tables.items()})


_ELEMENTS = """SELECT p_partkey % 50 AS doc_id, CAST(floor(p_partkey / 100) AS BIGINT) AS page, p_partkey AS ord,
    CASE p_size % 8 WHEN 0 THEN 'heading' WHEN 1 THEN 'title' WHEN 2 THEN 'table' WHEN 3 THEN 'footnote' WHEN 4 THEN 'figure' WHEN 5 THEN 'page_header' ELSE 'text' END AS type,
    CASE WHEN p_size % 8 = 3 THEN concat(CAST(p_size AS STRING), '. ', p_name) WHEN p_size % 16 = 0 THEN concat('## ', p_name, chr(10), ' ', p_brand) WHEN p_size % 16 = 6 THEN '' ELSE concat('<i>', p_name, '</i> **', p_brand, '**') END AS text,
    CASE WHEN p_size % 3 = 0 THEN 'plain' ELSE 'markdown' END AS text_format, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS level, CASE WHEN p_size % 7 > 1 THEN 'pass' END AS level_signal,
    CASE WHEN p_size % 8 = 3 AND p_partkey % 3 > 0 THEN 'footnote-marker' END AS role_signal, CASE WHEN p_partkey % 8 = 0 THEN 'tatr' WHEN p_partkey % 5 = 0 THEN 'pp-doclayoutv3' END AS signal,
    p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN concat('assets/', CAST(p_partkey AS STRING), '.png') END AS asset FROM part"""
_E = "e AS (" + _ELEMENTS.replace("STRING", "VARCHAR") + ")"


def _elements(spark, sf_dir):
    cell = lambda text, header: F.struct(text.alias("text"), F.lit(header).alias("header"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    two = F.array(F.array(cell(F.col("p_brand"), True), cell(F.col("p_type"), True)), F.array(cell(F.col("ord").cast("string"), False), cell(F.lit("x"), False)))
    cells = F.when((F.col("type") == "table") & (F.col("ord") % 4 == 0), two)
    return made(spark, sf_dir, _ELEMENTS).withColumn("rows", cells)


_LINE = "array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ')"
_HEADING = _LINE.format(x="CASE WHEN text_format = 'markdown' THEN regexp_replace(ltrim(text, chr(10)), '^ {0,3}#{1,6}[ \\t]+', '') ELSE text END")
_BODY = "CASE WHEN ord % 8 = 0 THEN '| ' || p_brand || ' | ' || p_type || ' |' || chr(10) || '|---|---|' || chr(10) || '| ' || ord || ' | x |' WHEN ord % 4 = 0 THEN p_brand || ' ' || p_type || chr(10) || ord || ' x' ELSE text END"
_UNIT = f"""CASE WHEN type IN ('heading', 'title') AND level_signal IS NOT NULL THEN repeat('#', coalesce(level, 2)) || ' ' || {_HEADING}
    WHEN type IN ('heading', 'title') AND signal = 'pp-doclayoutv3' THEN repeat('#', coalesce(level, 2)) || ' ' || replace(text, chr(10), ' ')
    WHEN type = 'table' AND asset IS NOT NULL THEN ({_BODY}) || CASE WHEN ({_BODY}) = '' THEN '' ELSE chr(10) || chr(10) END || '![Table image](' || asset || ')' WHEN type = 'table' THEN {_BODY}
    WHEN role_signal IS NOT NULL THEN regexp_replace(text, '^(\\s*)([0-9]{{1,2}})[.)]?[ \\t]+', '\\1[^\\2]: ') WHEN type = 'figure' AND asset IS NOT NULL THEN '![](' || asset || ')' ELSE text END"""


@query(f"WITH {_E} SELECT ord, {_UNIT} AS unit FROM e")
def rendered_elements(spark, sf_dir):
    e = _elements(spark, sf_dir)
    return e.select("ord", E.render(e, assets=True).alias("unit"))


_PAGES = """r AS (SELECT doc_id, ord, page, unit FROM u WHERE unit <> '' {where}), n AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM r),
    g AS (SELECT *, sum(CASE WHEN before = page THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM n),
    p AS (SELECT doc_id, run, regexp_replace(string_agg(unit, chr(10) || chr(10) ORDER BY ord), '^\\s+|\\s+$', '', 'g') AS part FROM g GROUP BY ALL)
    SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY run) AS markdown FROM p WHERE part <> '' GROUP BY doc_id"""


@query(f"WITH {_E}, u AS (SELECT *, {_UNIT} AS unit FROM e), " + _PAGES.format(where=""))
def page_markdown(spark, sf_dir):
    e = _elements(spark, sf_dir)
    return E.to_markdown(e.withColumn("unit", E.render(e, assets=True)))


@query(f"WITH {_E}, u AS (SELECT *, {_UNIT} AS unit FROM e), " + _PAGES.format(where="AND type NOT IN ('page_header', 'page_footer', 'page_number')"))
def reader_markdown(spark, sf_dir):
    e = _elements(spark, sf_dir)
    return E.to_markdown(e.withColumn("unit", E.render(e, assets=True)), reader=True)


@query(
    f"""WITH {_E} SELECT ord, trim(CASE WHEN text_format = 'markdown' THEN regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '(?m)^#{{1,6}}\\s+', '', 'g'), '\\*+|_{{2,}}', '', 'g') ELSE text END) AS words FROM e"""
)
def plain_element_text(spark, sf_dir):
    return _elements(spark, sf_dir).select("ord", E.plain_text(F.col("text"), F.col("text_format")).alias("words"))


@query(
    f"""WITH {_E} SELECT ord, '{{' || CASE WHEN level IS NOT NULL THEN '"level":' || level || ',' ELSE '' END || '"page":' || page || ',"source":"' || replace(p_type, '"', '\\"') || '","type":"' || type || '"}}' AS json FROM e"""
)
def element_json(spark, sf_dir):
    e = _elements(spark, sf_dir).withColumnRenamed("p_type", "source")
    return e.select("ord", E.to_json(e, "type", "source", "page", "level").alias("json"))


@query("SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ord, o_orderstatus AS type, o_orderkey AS number FROM orders")
def elements_from_json(spark, sf_dir):
    one = F.to_json(F.struct(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("type"), F.lit(1).alias("other")))
    docs = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("ir"))
    return E.from_json(docs, "ir", "type: string, number: long")


_RELATIONS = "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'caption_of' ELSE 'footnote_for' END AS type, o_orderkey AS source, o_orderkey + 1 + o_custkey % 2 AS target FROM orders"
_IDS = "SELECT o_custkey AS doc_id, o_orderkey AS old, o_orderkey * 10 AS new FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""WITH r AS ({_RELATIONS}), i AS ({_IDS}) SELECT r.doc_id, r.type, coalesce((SELECT new FROM i WHERE i.doc_id = r.doc_id AND i.old = r.source), r.source) AS source,
    coalesce((SELECT new FROM i WHERE i.doc_id = r.doc_id AND i.old = r.target), r.target) AS target FROM r""")
def remapped_relations(spark, sf_dir):
    return E.remapped(made(spark, sf_dir, _RELATIONS), made(spark, sf_dir, _IDS))


@query(f"""WITH g AS ({_RELATIONS}), d AS (SELECT * FROM g WHERE source % 5 > 0), m AS (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders WHERE o_orderkey % 7 > 0)
    SELECT doc_id, type, source, target FROM g WHERE (doc_id, source) IN (SELECT doc_id, k FROM m) AND (doc_id, target) IN (SELECT doc_id, k FROM m) AND (doc_id, type, source, target) IN (SELECT doc_id, type, source, target FROM d)""")
def relations_found(spark, sf_dir):
    gold = made(spark, sf_dir, _RELATIONS)
    matches = read(spark, sf_dir, "orders").where("o_orderkey % 7 > 0").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("gold"), (F.col("o_orderkey") + 1000).alias("output"))
    drawn = gold.where("source % 5 > 0").withColumns({"source": F.col("source") + 1000, "target": F.col("target") + 1000})
    return E.found_relations(gold, drawn, matches)


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS ord, lower(l_returnflag) || '|' || lower(l_linestatus) AS h FROM lineitem)
    SELECT a.doc_id, a.page, a.ord AS source, min(b.ord) AS target FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page = b.page AND a.h = b.h AND b.ord > a.ord GROUP BY a.doc_id, a.page, a.ord, a.h""")
def table_panels(spark, sf_dir):
    t = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page"), F.col("l_linenumber").alias("ord"), F.array("l_returnflag", "l_linestatus").alias("header"))
    return E.panels(t.distinct())


@query("""WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS id, o_orderstatus AS s, lag(o_orderkey) OVER w AS before, lag(o_orderstatus) OVER w AS bs FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    g AS (SELECT *, sum(CASE WHEN s = bs THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY id) AS run FROM o)
    SELECT doc_id, id, min(id) OVER (PARTITION BY doc_id, run) AS head FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1""")
def table_chains(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.lag("o_orderkey").over(w).alias("target"), F.lag("o_orderstatus").over(w).alias("s"))
    return E.chains(o.where("s = o_orderstatus").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("source"), "target"))


@query("""WITH a AS (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS element, l_returnflag AS type, sum(CAST(l_quantity AS BIGINT)) AS own FROM lineitem GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, element ORDER BY own DESC, type) AS k, sum(own) OVER (PARTITION BY doc_id, element) AS total FROM a)
    SELECT doc_id, element, type FROM k WHERE k = 1 AND 2 * own >= total""")
def relabelled_elements(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("element"), F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("long").alias("area"))
    return E.relabel(lines)


_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, {_W} AS w FROM conversations), g AS (SELECT conv_id, turn, x, count(*) AS n FROM (SELECT conv_id, turn, unnest(w) AS x FROM t) GROUP BY ALL),
    s AS (SELECT a.conv_id AS doc_id, a.turn AS gold, b.turn AS output, sum(least(a.n, b.n)) AS shared FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.x = b.x GROUP BY ALL),
    z AS (SELECT conv_id, turn, len(w) AS n FROM t), f AS (SELECT s.*, p.n AS ng, q.n AS no FROM s JOIN z p ON p.conv_id = doc_id AND p.turn = gold JOIN z q ON q.conv_id = doc_id AND q.turn = output)
    SELECT doc_id, 'split' AS kind, gold AS block, count(*) AS n FROM f WHERE shared >= 2 AND 10 * shared >= ng GROUP BY ALL HAVING count(*) >= 2
    UNION ALL SELECT doc_id, 'merge', output, count(*) FROM f WHERE shared >= 2 AND 10 * shared >= no GROUP BY ALL HAVING count(*) >= 2""")
def block_splits(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain_words(F.col("text")).alias("w"))
    g = t.select("conv_id", "turn", F.size("w").alias("size"), F.explode("w").alias("x")).groupBy("conv_id", "turn", "size", "x").agg(F.count("*").alias("n"))
    other = g.select("conv_id", F.col("turn").alias("output"), F.col("size").alias("n_output"), "x", F.col("n").alias("m"))
    shared = g.join(other, ["conv_id", "x"]).groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("gold"), "output", F.col("size").alias("n_gold"), "n_output").agg(F.sum(F.least("n", "m")).alias("shared"))
    return E.splits_and_merges(shared)


_LEVELS = "SELECT p_partkey % 100 AS doc_id, CASE WHEN p_partkey % 11 > 0 THEN p_size % 5 END AS gold, CASE WHEN p_partkey % 7 > 0 THEN p_size % 5 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END END AS output FROM part"


@query(f"""WITH h AS ({_LEVELS}), a AS (SELECT DISTINCT doc_id, gold AS l FROM h WHERE gold IS NOT NULL), b AS (SELECT DISTINCT doc_id, output AS l FROM h WHERE output IS NOT NULL),
    r AS (SELECT *, (SELECT count(*) FROM a WHERE a.doc_id = h.doc_id AND a.l <= h.gold) AS rg, (SELECT count(*) FROM b WHERE b.doc_id = h.doc_id AND b.l <= h.output) AS ro FROM h)
    SELECT doc_id, count(*) FILTER (gold IS NOT NULL AND output IS NOT NULL) AS hits, count(gold) AS n_gold, count(output) AS n_output,
    round(avg(CASE WHEN gold IS NOT NULL AND output IS NOT NULL THEN CASE WHEN rg = ro THEN 1.0::DOUBLE ELSE 0.0 END END), 6) AS level_accuracy FROM r GROUP BY doc_id""")
def heading_level_scores(spark, sf_dir):
    return E.level_scores(made(spark, sf_dir, _LEVELS))


@query("""WITH o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    i AS (SELECT *, n - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY n) AS island FROM o) SELECT o_custkey, o_orderstatus, min(n) AS first, max(n) AS last FROM i GROUP BY o_custkey, o_orderstatus, island""")
def page_runs(spark, sf_dir):
    return E.runs(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])


@query("SELECT a.event_id, (SELECT min(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id > a.event_id) AS next_id FROM events a WHERE a.event_type = 'view' AND next_id IS NOT NULL")
def first_match_forward(spark, sf_dir):
    return E.next_match(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase").select("event_id", "next_id")


@query("SELECT conv_id, turn, 'e' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id FROM conversations")
def conversation_ids(spark, sf_dir):
    return D.element_ids(read(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "id")


_LINES = """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN concat('- ', CAST(p_size AS STRING), ' -') WHEN 1 THEN concat('Page ', CAST(p_size AS STRING), ' of 90') WHEN 2 THEN concat('Table ', CAST(p_size AS STRING), '. ', p_name)
    WHEN 3 THEN concat(CAST(p_size AS STRING), '.', CAST(p_partkey % 9 AS STRING), ' ', p_name) WHEN 4 THEN concat(p_name, ' (continued)') WHEN 5 THEN concat(p_name, '<sup>', CAST(p_size AS STRING), ', 3</sup> and <sup>7</sup>')
    WHEN 6 THEN concat(p_name, ' and so on.') WHEN 7 THEN concat('xiv') WHEN 8 THEN concat('Fig. ', CAST(p_size AS STRING), ' ', p_brand) WHEN 9 THEN concat('"', lower(p_name)) WHEN 10 THEN concat(p_name, ' hyphen-') ELSE p_type END AS line FROM part"""


@query(
    f"""WITH l AS ({_LINES.replace('STRING', 'VARCHAR')}), n AS (SELECT *, regexp_extract(line, '^\\s*([0-9]{{1,2}}(\\.[0-9]{{1,2}})*)\\.?\\s+[^\\s]', 1) AS num FROM l)
    SELECT p_partkey, regexp_full_match(lower(line), '[\\s\\-–—|.]*(page\\s+)?([0-9]{{1,4}}[a-z]?|[ivxlc]{{1,7}})(\\s+of\\s+[0-9]{{1,4}})?[\\s\\-–—|.]*') AS page_number,
    regexp_matches(lower(line), '^[\\s*_]*(table|figure|fig\\.|chart|plate|map)\\s*[0-9ivx]+') AS caption, regexp_matches(lower(line), '\\bcont(inued|inuation|''d|\\.)') AS continued,
    CASE WHEN num = '' THEN 0 ELSE len(string_split(num, '.')) END AS depth, len(regexp_extract_all(line, '[\\p{{L}}]{{2,}}')) >= 3 AS prose,
    regexp_matches(line, '^[ \\t"''‘“(*_]*[a-z]') AS lower_start, CASE WHEN p_partkey % 12 = 5 THEN regexp_extract(line, '<sup>([0-9]+)', 1) || ',3,7' ELSE '' END AS notes FROM n"""
)
def line_tests(spark, sf_dir):
    x = F.col("line")
    return made(spark, sf_dir, _LINES).select(
        "p_partkey", T.is_page_number(x).alias("page_number"), K.caption_start(x).alias("caption"), K.says_continued(x).alias("continued"), K.decimal_depth(x).alias("depth"), T.is_prose(x).alias("prose"),
        T.lower_start(x).alias("lower_start"), F.array_join(F.transform(K.superscripts(x), lambda n: n.cast("string")), ",").alias("notes"),
    )


@query(
    """SELECT p_partkey, b.name || CASE WHEN k = 1 THEN '' ELSE '-' || k END || '.md' AS filename FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') AS name,
    row_number() OVER (PARTITION BY p_brand, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') ORDER BY p_partkey) AS k FROM part) b"""
)
def unique_filenames(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.col("p_brand").alias("batch"), F.col("p_partkey").alias("ord"), T.markdown_filename(F.concat("p_type", F.lit(".pdf"))).alias("name"))
    return T.unique_names(files).select(F.col("ord").alias("p_partkey"), F.col("filename"))


_URLS = "SELECT p_partkey, concat('https://h.example/a/', replace(p_name, ' ', '%20'), CASE WHEN p_size % 2 = 0 THEN '%2Bx.PDF?q=1' ELSE '/%C3%A9%20(1).pdf#p' END) AS url FROM part"


@query(f"WITH u AS ({_URLS}) SELECT p_partkey, CASE WHEN url LIKE '%.PDF%' THEN replace(p_name, ' ', '-') || '-x.pdf' ELSE '1-.pdf' END AS filename FROM u JOIN part USING (p_partkey)".replace("'1-.pdf'", "'1.pdf'"))
def pdf_names_from_urls(spark, sf_dir):
    return made(spark, sf_dir, _URLS).select("p_partkey", T.pdf_filename(F.col("url")).alias("filename"))


_TITLED = """SELECT conv_id, turn, concat(CASE WHEN conv_id % 3 = 0 THEN concat('```', chr(10), '# not this', chr(10), '```', chr(10)) ELSE '' END, CASE WHEN conv_id % 2 = 0 THEN concat('## Part ', CAST(turn AS STRING), ': a/b', chr(10)) ELSE '' END,
    CASE WHEN conv_id % 5 > 0 THEN concat(chr(10), '# The "', role, '" of ', CAST(conv_id AS STRING), ' *now*', chr(10)) ELSE '' END, 'text') AS text FROM conversations"""


@query(
    """SELECT conv_id, turn, CASE WHEN conv_id % 5 > 0 THEN 'The ' || role || ' of ' || conv_id || ' now' WHEN conv_id % 2 = 0 THEN 'Part ' || turn || ' a b' ELSE 'tail ' || turn END AS title FROM conversations"""
)
def shown_titles(spark, sf_dir):
    return made(spark, sf_dir, _TITLED).select("conv_id", "turn", T.shown_title(F.col("text"), F.concat(F.lit("https://h.example/x/tail-"), F.col("turn").cast("string"), F.lit("/?q"))).alias("title"))


_MARKS = """SELECT conv_id AS doc_id, concat('# Report ', CAST(conv_id AS STRING), chr(10), chr(10), '> quoted **bold words** here', chr(10), chr(10), '```', chr(10), 'code = 1', chr(10), '```', chr(10), '- item [link](http://x.y)', chr(10), '1. second `code`', chr(10), chr(10),
    '| a | b |', chr(10), '|---|---|', chr(10), '| c | d |', chr(10), chr(10), '---', chr(10), '## Part <b>', CAST(turn AS STRING), '</b>', chr(10), 'wrapped line', chr(10), 'goes on ![pic](p.png)') AS text FROM conversations WHERE turn = 1"""


@query(
    """SELECT conv_id AS doc_id, 'Report ' || conv_id AS title, 'Report ' || conv_id || ' . Part  1' AS headings, 'bold words' AS emphasis,
    array_to_string(['Report ' || conv_id || '.', '', 'quoted bold words here.', '', 'item link.', 'second code.', '', '.  a  .  b  .', '.  c  .  d  .', '', 'Part  1.', 'wrapped line', 'goes on  pic.'], chr(10)) AS prose FROM conversations WHERE turn = 1"""
)
def prose_zones(spark, sf_dir):
    return W.zones(made(spark, sf_dir, _MARKS))


# Every document, without the signs and digits that are Markdown, below a title of its first word.
_ZONED = """SELECT doc_id, concat('# ', CASE WHEN regexp_extract(text, '([A-Za-z]{3,})', 1) > '' THEN regexp_extract(text, '([A-Za-z]{3,})', 1) ELSE 'plain' END, ' summary', chr(10), chr(10), translate(text, '#*_`|<>[](){}!~-+=:$0123456789', '                              ')) AS text FROM documents"""
_PROSE = f"""SELECT doc_id, string_split(text, chr(10))[1][3:] AS title, concat(string_split(text, chr(10))[1][3:], '.', chr(10), chr(10), array_to_string(list_transform(string_split(text, chr(10))[3:], lambda x: trim(x)), chr(10))) AS text FROM ({_ZONED})"""
_ENDED = "CASE WHEN regexp_matches(text, '[.!?:;][\"'')\\]]?$') OR suffix(text, chr(10)) THEN text ELSE text || '.' END"


@query(f"""WITH prose AS (SELECT doc_id, title, {_ENDED} AS text FROM ({_PROSE})), {Q._GRAMS.replace('@least', '200').replace('FROM documents', 'FROM prose')},
    t AS (SELECT doc_id, concat(' ', array_to_string(list_transform(regexp_extract_all(lower(title), {Q._W}), lambda w: {Q._STEM}), ' '), ' . ') AS title FROM prose),
    s AS (SELECT doc_id, key, occurrences, size, contains(title, concat(' ', key, ' ')) AND key NOT IN ({', '.join(repr(n) for n in W.SECTION_NAMES)}) AS named FROM counted JOIN t USING (doc_id)),
    r AS (SELECT doc_id, key, occurrences, named, round(occurrences * [1.0, 1.4, 1.6, 1.6][size]::DOUBLE * CASE WHEN named THEN 4 ELSE 1 END, 6) AS score FROM s WHERE (occurrences >= 2 OR named) AND {Q._USABLE})
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, key) AS rank, key, score, occurrences, named AS in_title, named AS in_heading FROM r QUALIFY rank <= 20""")
def keyword_zones(spark, sf_dir):
    """Keywords of Markdown with a title, in which the title's words count more."""
    return W.prominent(made(spark, sf_dir, _ZONED))


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part QUALIFY count(*) OVER (PARTITION BY p_brand) >= 2".replace("SELECT p_partkey, dense_rank()", "SELECT p_partkey, p_brand, dense_rank()").replace("SELECT p_partkey, p_brand", "SELECT p_partkey, CAST(least(r, 6) AS INTEGER) AS level FROM (SELECT p_partkey, p_brand", 1) + ")")
def typed_levels(spark, sf_dir):
    h = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc_id"), F.col("p_size").alias("style"))
    return C.style_levels(h).select("p_partkey", F.col("level").cast("int").alias("level"))
