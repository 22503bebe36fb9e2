import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliospark.functions import tokens as K
from foliospark.sources import bundle, words
from foliospark.streaming import windows


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "x string").select(*columns).collect()]


def test_words_and_captions(spark):
    x = F.col("x")
    got = values(spark, ["Moss grows on 3 walls", "xqz ||| aaa fooBar", ""], K.plausible_words(x), K.reads_as_words(x), K.decimal_depth(x))
    assert [(tuple(a), b, c) for a, b, c in got] == [((5, 5), True, 0), ((0, 3), False, 0), ((0, 0), False, 0)]
    assert values(spark, ["1.2.3 Moss", "Table 4 Counts", "Table 4 (continued)"], K.decimal_depth(x), K.caption_start(x), K.says_continued(x)) == [(3, False, False), (0, True, False), (0, True, True)]
    assert values(spark, ["a<sup>2,4</sup> b<sup>7</sup>", "none"], K.superscripts(x)) == [([2, 4, 7],), ([],)]
    assert values(spark, ["- (a), *b*!", "# x.y"], K.punctuation(x)) == [("(),!",), (".",)]
    assert values(spark, ["https://a", "javascript:x", "//evil", "/ok"], K.safe_url(x)) == [(True,), (False,), (False,), (True,)]


def test_similarities(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], "abc", "abd"), ([], [], "", "")], "a array<string>, b array<string>, s string, t string")
    assert [tuple(r) for r in df.select(F.round(K.jaccard(F.col("a"), F.col("b")), 3), F.round(K.normalized_distance(F.col("s"), F.col("t")), 3)).collect()] == [(0.333, 0.333), (1.0, 0.0)]


def test_guard(spark):
    df = spark.createDataFrame([("moss fern", "moss fern bark roots"), ("moss fern", "xq zz moss")], "a string, b string")
    assert [r[0] for r in df.select(K.choose_reading(F.col("a"), F.col("b"))).collect()] == ["moss fern bark roots", "moss fern"]


def test_scan_words(spark, tmp_path):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext", "4\t1\t1\t1\t1\t0\t0\t0\t99\t9\t-1\t", '5\t1\t1\t1\t1\t2\t30\t0\t20\t10\t90\t"two', "5\t1\t1\t1\t1\t1\t0\t1\t20\t11\t90\tone", "5\t1\t1\t1\t2\t1\t0\t20\t5\t5\t10\t "]
    (tmp_path / "a.tsv").write_text("\n".join(rows))
    got = words.word_lines(words.scan_words(spark, str(tmp_path / "a.tsv"))).collect()
    assert [(r.line, r.text, tuple(r.box)) for r in got] == [(1, 'one "two', (0, 0, 50, 12))]


def test_needs_recognition(spark):
    df = spark.createDataFrame([("a page of text, long enough", 0.0, 0.0), ("a page of text, long enough", 1.0, 0.95), (None, None, None)], "t string, i double, g double")
    need = lambda mode: [r[0] for r in df.select(words.needs_recognition(F.col("t"), F.col("i"), F.col("g"), mode)).collect()]
    assert need("auto") == [False, True, True] and need("off") == [False] * 3
    with pytest.raises(ValueError):
        words.needs_recognition(F.col("t"), F.col("i"), F.col("g"), "maybe")


def test_bundles(spark):
    df = spark.createDataFrame([(1, "# a", "{}", {"b.png": bytearray(b"1"), "a.png": bytearray(b"2")}), (2, None, None, None)], "doc_id long, markdown string, ir string, assets map<string,binary>")
    rows = {r.doc_id: bytes(r.bundle) for r in bundle.bundles(df).collect()}
    z = zipfile.ZipFile(io.BytesIO(rows[1]))
    assert z.namelist() == ["document.md", "document.json", "assets/a.png", "assets/b.png"] and z.read("assets/a.png") == b"2"
    assert rows == {r.doc_id: bytes(r.bundle) for r in bundle.bundles(df).collect()} and zipfile.ZipFile(io.BytesIO(rows[2])).read("document.md") == b""


def test_session_stream(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = windows.sessions(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "user_id", "ts")
    q = out.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in windows.sessions(e, "user_id", "ts").collect()}
    got = {tuple(r) for r in spark.table("runs").collect()}
    assert got <= want and len(got) > 0.9 * len(want)  # the last windows are still open
