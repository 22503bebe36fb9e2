"""Statistical keywords against plain Python; the cache and learned factors, batch and stream alike."""

import math
import re
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from foliospark.operators import keywords as K, statistical as Y
from foliospark.streaming import cache


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def brute(text, top_k):
    words, phrases = [], Counter()
    sentences = re.split(r"[.!?]+\s+|\n+", text)
    for s, sentence in enumerate(sentences):
        for c, chunk in enumerate(re.split(r"[^\w'’\- ]+", sentence)):
            ws = re.findall(r"\w+(?:['’\-]\w+)*", chunk)
            low = [w.lower() for w in ws]
            stop = [w in K.STOP or len(w) < 3 for w in low]
            for i, w in enumerate(ws):
                words.append((s, c, i, w, low[i], low[i - 1] if i else None, low[i + 1] if i + 1 < len(ws) else None, stop[i]))
                for n in (1, 2, 3):
                    if i + n <= len(ws) and not any(stop[i : i + n]) and re.search(r"[^\W\d_]", " ".join(low[i : i + n])):
                        phrases[" ".join(low[i : i + n])] += 1
    by = defaultdict(list)
    for x in words:
        by[x[4]].append(x)
    tf = {w: len(v) for w, v in by.items()}
    own = [n for w, n in tf.items() if not by[w][0][7]]
    if not own:
        return []
    usual, most, n_sentences, h = statistics.mean(own) + statistics.pstdev(own), max(tf.values()), len({x[0] for x in words}), {}
    for w, v in by.items():
        acronym = sum(len(x[3]) > 1 and x[3].upper() == x[3] and x[3].lower() != x[3] for x in v)
        capital = sum(x[3][0].isupper() and not (len(x[3]) > 1 and x[3].upper() == x[3]) and not (x[1] == 0 and x[2] == 0) for x in v)
        case, position = max(acronym, capital) / (1 + math.log(tf[w])), math.log(math.log(3 + statistics.median([x[0] for x in v])))
        side = lambda k: len({x[k] for x in v if x[k]}) / max(1, sum(x[k] is not None for x in v))  # noqa: E731, B023
        context = 1 + (side(5) + side(6)) * tf[w] / most
        h[w] = position * context / (case + tf[w] / usual / context + len({x[0] for x in v}) / n_sentences / context)
    scored = sorted((round(math.prod(h[w] for w in p.split()) / (n * (1 + sum(h[w] for w in p.split()))), 9), p) for p, n in phrases.items())[: min(400, max(40, 4 * top_k))]
    kept = []
    for score, p in scored:
        if len(kept) < top_k and all(1 - distance(p, o) / max(len(p), len(o)) < 0.9 for o, _ in kept):
            kept.append((p, score))
    return kept


def test_statistical(spark):
    texts = {
        1: "The Harbour Board met in May. The Harbour Board, which runs the harbour walls, said repair of the harbour walls costs 40 million.\nNASA sent no one! Repairs of harbour walls and harbour wall lights continue; NASA watched, and watched.",
        2: "a of the. 12 34", 3: "", 4: None, 5: "Überseehafen und Überseehäfen sind Häfen. Hafenbehörde, Hafenbehörden: Hafenbehördenchef.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = defaultdict(list)
    for r in Y.statistical(docs, 12).orderBy("doc_id", "rank").collect():
        got[r.doc_id].append((r.key, r.score))
    for doc, text in texts.items():
        want = brute(text or "", 12)
        assert [k for k, _ in got[doc]] == [k for k, _ in want] and all(math.isclose(a[1], b[1], abs_tol=2e-9) for a, b in zip(got[doc], want, strict=True)), doc
    assert "harbour walls" in [k for k, _ in got[1]][:4]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def streamed(spark, make, rows, schema, tmp_path):
    """The stream's rows after one batch for each list of rows."""
    where = str(tmp_path / "in")
    out = []
    for some in rows:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(where)
        q = make(spark.readStream.schema(schema).parquet(where)).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_cache(rocks, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    reads = [("a", at(0), 1, "v1", True), ("a", at(299), 2, "v2", True), ("a", at(300), 3, "v3", False), ("a", at(899), 4, "v4", True), ("a", at(900), 5, "v5", True), ("b", at(10), 6, "w", True)]
    later = [("b", at(305), 8, "w3", True), ("a", at(9000), 7, "v6", True)]
    last = [("a", at(100), 9, "late", True), ("b", at(9100), 10, "w4", True), ("a", at(9299), 11, "v7", True)]  # the first is beyond the watermark
    schema = "key string, time timestamp, seq long, value string, ok boolean"
    batch = {r.seq: (r.hit, r.value, r.ok) for r in cache.cached(rocks.createDataFrame(reads + later + last[1:], schema)).collect()}
    assert batch == {1: (False, "v1", True), 2: (True, "v1", True), 3: (False, "v3", False), 4: (True, "v3", False), 5: (False, "v5", True), 6: (False, "w", True), 8: (True, "w", True), 7: (False, "v6", True), 10: (False, "w4", True), 11: (True, "v6", True)}
    got = streamed(rocks, lambda s: cache.cached_stream(s, "10 minutes"), [reads, later, last], schema, tmp_path)
    assert {r.seq: (r.hit, r.value, r.ok) for r in got} == batch and len(got) == len(batch)


def test_learned(rocks, tmp_path):
    tasks = [("s", k, {"scan": 4.0 + k, "base": 2.0} if k % 2 else {"text": 1.0}, [30.0, 0.5, 9.0, None, 1.0, 400.0][k % 6]) for k in range(20)] + [("t", 1, {"scan": 1.0}, 1.5), ("t", 2, {}, 5.0)]
    schema = "scope string, seq long, parts map<string,double>, observed double"
    key = lambda rows: {(r.scope, r.seq): (r.predicted and round(r.predicted, 9), {k: round(v, 9) for k, v in r.factors.items()}) for r in rows}
    batch = key(cache.learned(rocks.createDataFrame(tasks, schema)).collect())
    assert batch["t", 1] == (None, {"scan": 1.0}) and batch["t", 2] == (None, {}) and batch["s", 0] == (1.0, {"text": 2.0})
    assert all(0.15 <= f <= 8 for _, fs in batch.values() for f in fs.values())
    assert key(streamed(rocks, cache.learned_stream, [tasks[:7], tasks[7:]], schema, tmp_path)) == batch


def test_canonical(spark):
    rows = [(1, 1, "harbour walls"), (1, 2, "harbour wall"), (1, 3, "boards")]
    got = Y.canonical(spark.createDataFrame(rows, "doc_id int, rank int, key string")).select("key", "rank").orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("harbour wall", 1), ("board", 3)]


def test_only_texts_are_shuffled(spark):
    """What is counted within a document is counted where its text was dealt to."""
    import re as regex

    docs = spark.createDataFrame([(k, f"# Harbour walls\n\nThe walls number {k} of harbours. Walls of harbours!") for k in range(40)], "doc_id long, text string")
    for df in (K.ngrams(docs), K.frequency(docs, min_text=1), K.prominent(docs, min_text=1), K.drop_subsumed(K.frequency(docs, min_text=1).drop("score")), Y.term_features(docs), Y.statistical(docs)):
        dealt = regex.findall(r"Exchange hashpartitioning\((.*?)\), (\w+)", df._jdf.queryExecution().executedPlan().toString())
        assert dealt and all(by.startswith("doc_id#") and by.count("#") == 1 and how == "REPARTITION_BY_NUM" for by, how in dealt), dealt
        assert df.count() > 0


def test_stemmed_words(spark):
    from pyspark.sql import functions as F

    from foliospark.functions import text as T

    texts = ["Walls' walls -boxes x_abcs _dogs 'cats ties cities gases buses classes dress Basis os ios xs as2s 3s bieses ies aies \u00c4ngstes dishes churches quizzes men's \u2019tis \u2019dogs houses--cats", "", "s es ses axes \u0130les\u0130es"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.stemmed_words(F.col("t")).alias("a"), F.transform(T.words(F.col("t")), T.s_stem).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got[0].a) > 25, got
