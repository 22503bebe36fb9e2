"""Queries of chapters by contents pages: books made of documents, whose chapters must be those documents again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contents as C
from .elements import made
from .queries import query

# Eight documents a book. Five forms of contents pages: leaders with entries of a second depth, a table, numbered links, a
# run without a label, bare titles; their chapters open with headings, bold lines, numbered headings, capitals, plain
# lines. The fourth opening differs by a letter, and the sixth has a subtitle, so they match by likeness (among lines that
# look like headings, so not in the last form).
_TITLED = """SELECT CAST(floor(doc_id / 8) AS BIGINT) AS book, doc_id % 8 AS k, CASE WHEN text IS NULL THEN '' ELSE text END AS text,
    concat(CASE WHEN regexp_extract(text, '([A-Za-z]{4,12})', 1) > '' THEN regexp_extract(text, '([A-Za-z]{4,12})', 1) ELSE 'Untitled' END, ' of ', CASE doc_id % 8 WHEN 0 THEN 'Alpha' WHEN 1 THEN 'Bravo' WHEN 2 THEN 'Charlie'
        WHEN 3 THEN 'Deltas' WHEN 4 THEN 'Echo' WHEN 5 THEN 'Foxtrot' WHEN 6 THEN 'Golf' ELSE 'Hotel' END) AS title FROM documents WHERE doc_id >= 0"""
_OPENED = f"""SELECT book, k, text, title, book % 5 AS form, CASE WHEN book % 5 = 4 THEN title WHEN k = 3 THEN replace(title, ' of ', ' off ') WHEN k = 5 THEN concat(title, ': a sequel') ELSE title END AS named FROM ({_TITLED}) AS t"""
_PARTS = f"""SELECT book, k, form, CASE WHEN form = 2 THEN concat(k + 1, '. ', title) ELSE title END AS title, CASE form WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS level,
    concat(CASE form WHEN 0 THEN concat('## ', named) WHEN 1 THEN concat('**', named, '**') WHEN 2 THEN concat('### Chapter ', k + 1, ': ', named) WHEN 3 THEN upper(named) ELSE named END, chr(10), chr(10), text) AS part,
    CASE form WHEN 0 THEN concat(title, ' ', repeat('.', 12), ' ', k * 10 + 3, chr(10), '  ', k + 1, '.1 Details ', repeat('. ', 6), k * 10 + 4) WHEN 1 THEN concat('| ', title, ' | ', k * 10 + 3, ' |')
        WHEN 2 THEN concat('- [', k + 1, '. ', title, '](#c', k, ')') WHEN 3 THEN concat(title, '    ', k * 10 + 3) ELSE title END AS entry FROM ({_OPENED}) AS t"""
_FRONT = """concat('# Book ', book, chr(10), chr(10), 'By several hands, printed for those who like to read a text more than once, and for nobody else.', chr(10), chr(10),
    CASE form WHEN 0 THEN concat('## Contents', chr(10)) WHEN 1 THEN concat('**Table of Contents**', chr(10), chr(10), '| Title | Page |', chr(10), '| --- | --- |', chr(10))
    WHEN 2 THEN concat('## In this issue', chr(10)) WHEN 3 THEN '' ELSE concat('# Contents', chr(10), chr(10)) END)"""


@query(f"""WITH p AS ({_PARTS}), b AS (SELECT book, form, count(*) AS n, concat({_FRONT}, string_agg(entry, chr(10) ORDER BY k), chr(10)) AS front, list_sort(list(length(part)))[count(*) // 2 + 1] AS middle FROM p GROUP BY book, form),
    c AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY k) AS ord, level, title, part AS text FROM p UNION ALL SELECT book, 0, 0, concat('Book ', book), front FROM b)
    SELECT book, ord, CAST(level AS INTEGER) AS level, title, length(c.text) AS n_chars, md5(c.text) AS digest FROM c JOIN (SELECT book FROM b WHERE n >= 4 AND middle >= 200) USING (book)""")
def book_chapters(spark, sf_dir):
    """Chapters by the contents pages of books, from all documents; the SQL has them from the documents themselves."""
    parts = made(spark, sf_dir, _PARTS)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c))), lambda x: x[c]), "\n")
    books = parts.groupBy("book", "form").agg(F.count("*").alias("n"), joined("entry").alias("entries"), joined("part").alias("parts")).where("n >= 4")
    docs = books.select(F.col("book").alias("doc_id"), F.concat(F.expr(_FRONT), "entries", F.lit("\n\n"), "parts").alias("text"))
    found = C.contents_chapters(docs)
    return found.select(F.col("doc_id").alias("book"), "ord", "level", "title", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
