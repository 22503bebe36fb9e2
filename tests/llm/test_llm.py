"""The training-data operators against brute force, on small fixtures with nulls, empty and odd texts, ties and repeats."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import bpe, html, packing, pii, quality, sharding, simhash, tokenfile, topk, warc
from foliospark.llm.encoding import load, vocabulary

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, base_x string"
ODD = [None, "", " \n\t", "a", "two words", "Hello  wörld!! it's 123 <|endoftext|> ΣΑΣ İ", "x" * 5000, "日本 語 🙂", "a \n b\n\n c  ", "same text here", "same text here", "ab " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(900_000 + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, "x", "y") for i, t in enumerate(ODD)]
    rows += [(None, "no id here", "en", "s", 0, "x", "y"), rows[5], rows[5]]
    some = spark.read.parquet(f"{DIR}/documents.parquet").limit(60).withColumn("sequence_id", F.lit("x")).withColumn("base_x", F.lit("y"))
    return spark.createDataFrame(rows, SCHEMA).union(some).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe(docs, empty):
    tok = load(vocabulary("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.encode_decode(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.encode_decode(empty).count() == 0


def test_automaton_on_random_merges():
    import random

    rng = random.Random(5)
    for _ in range(200):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        for _ in range(12):
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                merges.append((u, v))
                vocab[u + v] = len(vocab)
        a = bpe.MergeAutomaton(vocab, merges)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for u, v in merges:
                out = []
                for p in parts:
                    if out and out[-1] == u and p == v:
                        out[-1] = u + v
                        continue
                    out.append(p)
                parts = out
            assert [a.labels[i] for i in a.encode(word)] == parts, (word, merges)


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    par = list(range(len(fps)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                par[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)].append(x)
    return [min(least[find(i)], default=None) for i in range(len(fps))]


def test_simhash(docs, empty):
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = [(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r.doc_id for r in rows]), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in simhash.near_duplicates(docs).collect()))) == sorted(map(repr, want))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 20])
def test_links_connect_all_within_three_bits(spark, block):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), replace=False)) for b in base for _ in range(25)}
    fps |= {0, (1 << 64) - 1, 7}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, block)).collect()}
    own = [x[0] for x in signed]
    want = brute_components([x % (1 << 64) for x in own], own)
    assert [roots.get(x, x) for x in own] == want


def test_links_under_hot_probes(spark):
    """Many fingerprints share one key, so each of its one-bit neighbours is reached by all of them; some have few owners, most none."""
    rng = np.random.default_rng(2)
    low = 0x00F0_1234
    fps = {int(x) << 32 | low for x in rng.integers(0, 1 << 32, 3000)}
    some = sorted(fps)[:40]
    fps |= {x ^ (1 << int(b)) ^ (1 << int(c)) for x, b, c in zip(some, rng.integers(0, 16, 40), rng.integers(32, 64, 40), strict=True)}
    fps |= {x ^ (1 << int(b)) ^ (1 << int(c)) for x, b, c in zip(some, rng.integers(32, 64, 40), rng.integers(32, 64, 40), strict=True)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    block = 100
    crowded = {r.key: r.owned for r in simhash._crowded(df, block).collect()}
    assert sum(not x for x in crowded.values()) > 3 and sum(crowded.values()) >= 3
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, block)).collect()}
    own = [x[0] for x in signed]
    arr = np.array([x % (1 << 64) for x in own], np.uint64)
    par = list(range(len(own)))

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 3):
            par[find(i)] = find(int(j))
    least = {}
    for i, x in enumerate(own):
        least[find(i)] = min(x, least.get(find(i), x))
    assert [roots.get(x, x) for x in own] == [least[find(i)] for i in range(len(own))]
    assert len(roots) >= 80


def test_join_counted(spark):
    from foliospark.llm.common import join_counted

    left = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") * 2)
    got = sorted(map(tuple, join_counted(left, right, "k", "n", 5000, least=10).collect()))
    assert got == sorted((k, i, 2 * k) for k, i in map(tuple, left.collect()))


def test_quality(docs, empty):
    def brute(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        w3 = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if w3[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)

    rated = quality.rate(docs).collect()
    want = sorted(repr((r.doc_id, *brute(r.text))) for r in docs.collect())
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rated) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.base_failed or not r.kept) for r in rated)
    assert quality.rate(empty).count() == 0
    p = np.array([[0.5, 0.5], [1.0, 0.0]])
    assert np.allclose(quality.js_distance(p, np.array([0.5, 0.5])), [0, 0.5579230452841438])


def test_quality_verdicts_by_brute_force(spark):
    """References, distances and verdicts in plain Python with math.log2; languages without a reference reject nothing."""
    import math

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("kept"))
    junk = " ".join(f"Q{i * 7919 % 10007}!" for i in range(150))
    docs = docs.union(spark.createDataFrame([(10_001, junk, "en", "x"), (10_002, junk, "it", "x"), (10_003, junk, None, "x"), (10_004, "汉字 " * 120 + junk, "en", "x")], docs.schema))
    rows = [(r, quality.counts(r.text)) for r in docs.collect()]
    failed = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
    refs = {}
    for lang in quality.COMMON:
        own = [c for r, c in rows if r.lang == lang and not failed(c)]
        if own:
            refs[lang] = ([sum(c[5][k] / sum(c[5]) for c in own) / len(own) for k in range(len(quality.CLASSES))], {w: sum(c[6][quality.WORDS.index(w)] / c[0] for c in own) / len(own) for w in quality.COMMON[lang]})

    def distance(p, q):
        kl = lambda x, y: sum(a * math.log2(a / b) for a, b in zip(x, y, strict=True) if a > 0)
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, (kl(p, m) + kl(q, m)) / 2))

    want = {}
    for r, c in rows:
        verdict = not failed(c)
        if verdict and (r.lang is None or r.lang in quality.COMMON):
            pairs = []
            for lang, (chars, words) in refs.items():
                own = [c[6][quality.WORDS.index(w)] / c[0] for w in quality.COMMON[lang]]
                ref = [words[w] for w in quality.COMMON[lang]]
                pairs.append((distance([x / sum(c[5]) for x in c[5]], [x / sum(chars) for x in chars]), distance([*own, max(0, 1 - sum(own))], [*ref, max(0, 1 - sum(ref))])))
            near = min(pairs, key=sum)
            verdict = not (c[1] >= quality.MIN_CHARS and near[0] > quality.MAX_CHAR_DISTANCE or c[0] >= quality.MIN_WORDS and near[1] > quality.MAX_WORD_DISTANCE)
        want[r.doc_id] = verdict
    assert {r.doc_id: r.kept for r in quality.rate(docs).collect()} == want
    assert {r.doc_id for r in quality.keep(docs).collect()} == {i for i, v in want.items() if v}
    assert not want[10_001] and want[10_002] and not want[10_003] and not want[10_004]


def test_quality_agrees_with_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.rate(d).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept for r in rows if r.quality == 1) == sum(r.quality for r in rows)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in rows)


def test_packing(docs, empty):
    tok = load(vocabulary("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.pack(docs).collect()
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(map(repr, want))
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_plan_places_every_piece():
    import random

    rng = random.Random(2)
    for h in ({}, {1024: 3}, {1: 5000}, {n: 1 for n in range(1, 1025)}, Counter(rng.randint(300, 400) for _ in range(5000)), Counter(min(1024, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(5000))):
        bins = packing.plan(dict(h))
        placed = Counter()
        for content, n in bins:
            assert n > 0 and sum(content) <= 1024
            for s in content:
                placed[s] += n
        assert placed == Counter(h)
        plain = sum(n for _, n in packing._best_fit([], Counter(h), 1024))
        assert sum(n for _, n in bins) <= plain


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    want = sorted(repr((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))) for r in docs.collect())
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in rows) == want
    slots = defaultdict(list)
    mix = Counter((r.shard, r.source) for r in rows)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for source, n in Counter(r.source for r in rows).items():
        assert all(abs(mix[k, source] - n / 8) <= 2 for k in range(8))
    assert sharding.shard(empty).count() == 0


def test_sharding_by_brute_force(spark, docs):
    """Ranks by md5 order within sources, fractions, and the cut, in plain Python; hot ids and equal rows included."""
    rows = [(5, "hot id", "en", "s", 1, "x", "y")] * 300 + [(None, f"text {i % 7}", "en", "t", 1, "x", "y") for i in range(200)]
    df = docs.union(spark.createDataFrame(rows, SCHEMA))
    each = [(r.source, hashlib.md5(f"{sharding.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id if r.doc_id is not None else -(10**18), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in df.collect()]
    stratum = lambda s: "n" if s is None else "s" + s
    placed = []
    for source in {e[0] for e in each}:
        own = sorted(e[1:] for e in each if e[0] == source)
        start = int(hashlib.md5(f"{sharding.SEED}:{'null' if source is None else source}".encode()).hexdigest()[:8], 16) / 2**32
        placed += [((k + start) / len(own), stratum(source), k, e) for k, e in enumerate(own)]
    placed.sort()
    n, want = len(placed), []
    for at, (_, _, _, (_, doc_id, crc, size)) in enumerate(placed):
        shard = at * 8 // n
        want.append((doc_id, size, crc, shard, at - -(-shard * n // 8)))
    got = [(r.doc_id if r.doc_id is not None else -(10**18), r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(df).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("shards", [None, 7])
def test_token_files_with_a_hot_id(spark, tmp_path, shards):
    df = spark.range(900).selectExpr("if(id % 3 = 0, 4, if(id % 3 = 1, null, id)) AS doc_id", "concat('word ', id % 5, ' and more') AS text").repartition(5)
    path = f"file://{tmp_path}/t"
    from foliospark.llm.common import materialize

    held = materialize(tokenfile.write(df, path, shards=shards), "held")
    got = sorted(tokenfile.read(path, held).collect(), key=lambda r: r.start)
    assert len(got) == 900 and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and Counter(ids)[4] == 301 - (0 if 4 % 3 == 0 else 1) and Counter(ids)[-1] == 300
    if shards:
        assert held.count() == 7 and held.agg(F.max("n_docs")).first()[0] < 300


def test_warc(spark):
    schema = "page_id long, url string, html string, refers_to string"
    big, odd = "é\r\n\r\nWARC/1.1\r\n" * 200, "x" * 2000
    rows = [(1, "http://a", big), (7, None, big), (3, "http://c\r\nEvil: 1", big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (8, "u", "small"), (None, "u", odd), (9, "u", odd), (10, "u", "y" * 999), (11, "u", "y" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame([(*r, "x") for r in rows], schema)).collect()}
    assert len(got) == len(rows)
    revisits = {1: 7, 3: 7, None: 9, 12: 13}
    for i, _, h in rows:
        b = (h or "").encode()
        assert got[i] == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if i in revisits else "response", revisits.get(i))
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_warc_files_are_bounded_and_hot_payloads_resolve(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    hot = "h" * 1500
    rows = [(i, "u", hot if i % 3 == 0 else "".join(rng.choice(list("abcdefgh"), 3000))) for i in range(150)] + [(149, "u", hot), (None, "u", hot)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    want = sorted(repr((i, len(h), hashlib.sha1(h.encode()).hexdigest(), *(("revisit", 149) if h == hot and i != 149 else ("response", None)))) for i, _, h in rows)
    for most in (1_000_000, 0):
        monkeypatch.setattr(warc, "BROADCAST", most)
        got = warc.round_trip(df, file_bytes=20_000).collect()
        assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want
    path = f"file://{tmp_path}/w"
    files = warc.write(df, path, file_bytes=20_000).collect()
    assert len(files) > 4 and all(f.n_bytes < 25_000 for f in files) and sum(f.n_records for f in files) == len(rows)
    assert warc.read(spark, path).count() == len(rows)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0, 0.2, (400, 8)), 2)
    v[50:60] = v[40]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(400)]
    bad = [(1000, None, 0), (1020, [None] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [float("inf")] * 8, 0), (None, [0.5] * 8, 0)]
    zero = [(1080, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows + bad + zero, "vec_id long, embedding array<float>, label int")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()}
    ids = np.array([*range(400), 1080])
    q = np.floor(64 * np.vstack([v, np.zeros((1, 8))]).astype(np.float32).astype(float)).astype(int)
    want = set()
    for a in np.flatnonzero(ids % 20 == 0):
        s = q @ q[a]
        order = [b for b in np.lexsort((ids, -s)) if b != a][:20]
        want |= {(int(ids[a]), k, int(ids[b]), int(s[b])) for k, b in enumerate(order, 1)}
    assert got == want
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_top_k_of_huge_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(100, 6))
    v[::3] *= 1e7  # scores beyond doubles
    v[::7] *= 1e13  # and beyond 64 bits
    v[40] = 1e300
    v[41] = -1e300
    whole = [[math.floor(64 * x) for x in r] for r in v.tolist()]
    want = set()
    for q in range(0, 100, 20):
        scores = sorted((-min(max(sum(map(int.__mul__, whole[q], w)), -(1 << 63)), (1 << 63) - 1), i) for i, w in enumerate(whole) if i != q)
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:20], 1)}
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()} == want


def test_top_k_stops_early_where_few_dimensions_carry_the_score():
    """With dimensions that fall off, over half of the queries stop before the entries read outnumber the vectors; with 64
    alike none does."""

    def share(decay):
        rng = np.random.default_rng(4)
        v = np.floor(64 * rng.normal(size=(4000, 64)) * decay ** np.arange(64))
        block = topk.Block(np.arange(4000), v, np.argsort(v, axis=0, kind="stable").T.astype(np.int32), np.float64)
        kth = np.array([np.sort(np.delete(v @ q, i))[-20] for i, q in enumerate(v[:100])])
        return (block.stops(v[:100], kth) * np.count_nonzero(v[:100], axis=1) < 4000).mean()

    assert share(0.3) > 0.5 and share(1.0) == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Small blocks, so that k-th scores are carried; lengths differ, ids repeat, components are huge, and many scores tie."""
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    monkeypatch.setattr(topk, "DEPTH", 2)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.round(x, 1)) for x in rng.normal(0, 0.3, 4 if i % 5 else 6)]) for i in range(500)]
    rows += [(7, [0.1] * 4), (7, [0.1] * 4), (20, [0.2] * 4), (2000, [1e30] * 4), (2001, [1e7, 0.0, 0.0, 0.0]), (2020, [-1e7, 1.0, 0.0, 0.0]), (2040, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v]
    fit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = Counter()
    for own in {i for i, _ in q if i % 20 == 0}:
        met = sorted((-fit(sum(a * b for a, b in zip(u, v, strict=True))), j) for i, u in q if i == own for j, v in q if j != own and len(u) == len(v))
        want.update((own, k, j, -s) for k, (s, j) in enumerate(met[:20], 1))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()) == want


def test_token_files(docs, empty):
    tok = load(vocabulary("word_bpe_49k.json"))
    got = tokenfile.round_trip(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert tokenfile.round_trip(empty).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><div class="cookie-notice">We use cookies and a long text about it all</div>
      <div id="main"><article><h1>Head &eacute;</h1><p><b>First   one<br>goes on<p>Sh.<ul><li>one<li>two</ul><div class="ad">Buy a lot of things now</div><form>Name <input></form>
      <p>Last &lt;p&gt; &copy;</article><div class="comments"><p>I like this very much indeed</p></div></div><aside>Side text that is long enough</aside><footer>&copy; all</footer>"""
    assert html.main_text(page) == "Head é\n\nFirst one goes on\n\nSh.\n\none\n\ntwo\n\nLast <p> ©"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<p>" * 3000 + "deep") == "deep"


@pytest.mark.parametrize("part", ["section", "div"])
def test_html_article_over_siblings(part):
    long, short = "A long sentence of the first part. " * 16, "Some sentence of the second part. " * 4
    page = f"<body><div class=post><h1>T</h1><{part}><p>{long}<p>{long}</{part}><{part}><h2>S</h2><p>{short}</{part}></div><footer>&copy; all</footer></body>"
    assert html.main_text(page) == "\n\n".join(["T", long.strip(), long.strip(), "S", short.strip()])
    alone = f"<body><div><a href=/>Home</a> <a href=/>B</a> <a href=/>C</a></div><div><a href=/>D</a></div><h2>R</h2><h1>T</h1><{part}><p>{long}<p>{long}</{part}></body>"
    assert html.main_text(alone) == "\n\n".join(["R", "T", long.strip(), long.strip()])


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-comments", "header-fixed", "sidebar", "wide sidebar"])
def test_html_marked_wrappers(name):
    body = "<h1>T</h1><p>A long sentence of the article. And one more of it.</p><div class='sidebar'>Other text</div><div class='ad-box'>Buy now</div>"
    want = "T\n\nA long sentence of the article. And one more of it."
    assert html.main_text(f"<body><div class='{name}'><main>{body}</main></div></body>") == want
    assert html.main_text(f"<body><div class='{name}'>{body}</div></body>") == want
    assert html.main_text("<body><div class='cookie-bar'><p>We use cookies and more</p></div></body>") == ""


def test_html_clusters_choose():
    """Nothing is marked here: the ratios alone tell the article from a menu, and constant ratios do not."""
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(12))
    prose = [f"Paragraph {i} has a good many words, and a second sentence that goes on for a while." for i in range(5)]
    page = f"<body><div><ul>{menu}</ul></div><div><h1>Title</h1>{''.join(f'<p>{p}</p>' for p in prose)}</div><div><ul>{menu}</ul></div></body>"
    assert html.main_text(page) == "\n\n".join(["Title", *prose])
    clusters = html._clusters
    html._clusters = lambda page: list(range(len(page.lines)))
    try:
        assert "Item 3" in html.main_text(page)
    finally:
        html._clusters = clusters


@pytest.mark.parametrize("name", ["layout has-sidebar", "post comments-enabled", "article-with-tags", "page no-header", "search-results-alert body", "sidebar", "ad"])
def test_html_names_above_an_article_drop_nothing(name):
    prose = "A long sentence of the article. " * 3
    inner = f"<h1>T</h1><p>{prose}<label>Lab</label> and <span class='tag notice'>new</span> x</p><section class='related-work'><p>RW</p></section><div id='disclaimer-analysis'>DA</div><span class='notice'>alone</span><div class='ad'>Buy</div>"
    assert html.main_text(f"<body><nav>M</nav><div class='{name}'><article>{inner}</article></div></body>") == f"T\n\n{prose}Lab and new x\n\nRW\n\nDA"


@pytest.mark.parametrize("part", ["<div>", "<span>", "<p><span>", "<b><div>", "<span class=ad>", "<hr>"])
def test_html_deep_and_long_pages(part):
    import time

    began = time.process_time()
    assert html.main_text(part * 30_000 + "deep" + "</b>" * 30_000) in ("deep", "")
    assert time.process_time() - began < 10


def test_html_extract(spark):
    rows = [(1, "u", "<p>one two</p>", "x", 9), (2, None, None, None, None), (2, None, None, None, None), (None, "v", "", "t", 1), (3, "w", "<nav>m</nav>", "", 0), (4, "w", "<p>" + "word " * 100_000, "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect())
    long = ("word " * 100_000).strip()
    assert got == Counter([(1, "u", "one two", 7), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0), (4, "w", long, len(long))])
    assert html.extract(df.where("false")).count() == 0


PROSE = "A paragraph with a good many words, and a second sentence that goes on."


@pytest.mark.parametrize(("page", "want"), [
    (f"<form id=aspnet><div><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></div></form>", ["T", PROSE, PROSE]),
    (f"<form id=aspnet><nav>M</nav><p>{PROSE}</p><p>{PROSE}</p><form><p>Name</p></form></form>", [PROSE, PROSE]),
    (f"<article><header><h1>Title</h1><p>by me</p><nav>M</nav></header><p>{PROSE}</p></article>", ["Title", PROSE]),
    (f"<main><header><h2>Site</h2><h1>Title</h1></header><p>{PROSE}</p></main>", ["Title", PROSE]),
    (f"<main><article><h1>T</h1><p>{PROSE}</p></article><article class='comment'><p>{PROSE} I like it</p></article></main>", ["T", PROSE]),
    (f"<main><p>{PROSE}</p><div class='comment-body'><p>c {PROSE}</p></div><div class='user-comments'>c</div><ol class='commentlist'><li>c</li></ol></main>", [PROSE]),
    (f"<article><p>{PROSE}</p><p class='alert'>Mind the gap</p><div class='alert'>Site down</div></article>", [PROSE, "Mind the gap"]),
    (f"<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>{f'<p>{PROSE}</p>' * 5}<ul><li>one</li></ul><div>&copy; all rights are with the owner of this page and nobody else</div>", [PROSE] * 5 + ["one"]),
    (f"<div><p>{PROSE}</p><ul><li><a href=/>More</a></li></ul><h2>Next</h2><p>{PROSE}</p><p>Sh.</p></div><div><h2>Links</h2><a href=/>A</a></div>", [PROSE, "More", "Next", PROSE, "Sh."]),  # a line between those of a cluster is in it
])
def test_html_regions(page, want):
    assert html.main_text(f"<body>{page}</body>") == "\n\n".join(want)


def test_html_without_names(spark):
    """On the driver's pages without tags and names that tell, clusters find the article: exactly on most, and no part of
    it is lost on any. With every line in a cluster they find it on hardly any."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [html.main_text(h) for h in pages]
    bare = [re.sub(r"<(/?)(article|main|nav|header|footer|aside)\b", r"<\1div", re.sub(r' (class|id|role)="[^"]*"', "", h)) for h in pages]
    got = [html.main_text(h) for h in bare]
    assert all(set(w.split("\n\n")) <= set(g.split("\n\n")) for w, g in zip(want, got, strict=True))
    assert sum(w == g for w, g in zip(want, got, strict=True)) >= 0.8 * len(pages)
    clusters = html._clusters
    html._clusters = lambda page: list(range(len(page.lines)))
    try:
        assert sum(w == html.main_text(h) for w, h in zip(want, bare, strict=True)) < 0.1 * len(pages)
    finally:
        html._clusters = clusters


def test_html_brute_force(spark):
    """On the driver's pages the article element is the main text: its blocks by a plain reading of the source."""
    from html import unescape

    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>)", r.html, re.S)[1]
        inner = re.sub(r"<!--.*?-->|</?(b|i|em|strong|a)( [^>]*)?>", "", inner, flags=re.S)
        blocks = [re.sub(r"\s+", " ", unescape(x)).strip() for x in re.split(r"</?(?:p|h1|ul|li|div)(?: [^>]*)?>", inner.replace("<br>", " "))]
        assert html.main_text(r.html) == "\n\n".join(b for b in blocks if b)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_pii(spark, docs, empty):
    odd = ["a@b.c_x@d.e.f+ é🙂 a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.2.3 001.2.3.4 1.2.3", "+1-2 +123 +12 +1 (234) 555-1234--.", "4111 1111-1111 1111 41111111111111111 4111  1111111111111 4111111111111111", "1" * 9000 + " a@" + "b." * 9000 + "c", "x" * 20000 + "@ " + "1 " * 5000]
    extra = spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra)
    texts = defaultdict(set)
    for r in df.collect():
        texts[r.doc_id].add(r.text)
    rows = pii.report(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        (text,) = texts[r.doc_id]
        want = base_spans(text)
        assert r.base_sha256 == sha(",".join(want)), text[:80]
        assert set(want) <= set(r.spans.split(",")) or not want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
    assert pii.report(empty).count() == 0


def test_pii_adds_what_base_misses(spark):
    text = 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" or call (555) 123-4567, mail joe [at] site [dot] org'
    df = spark.createDataFrame([(1, text), (2, "a number 1234567890123456 and version 3.0 of 2024-01-15"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: 'key token = "<secret>" or call <phone>, mail <email>', 2: "a number 1234567890123456 and version 3.0 of 2024-01-15", 3: None}


def test_pii_long_secrets(spark):
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list(letters), n)) for letters in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for n in (513, 700, 5000)]
    made = [f"a1{x}" for x in made]
    rows = [(i, t) for i, x in enumerate(made) for t in (f'here key = "{x}" ends', f"here auth {x} ends")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in pii.redact(df).collect()} == {'here key = "<secret>" ends', "here auth <secret> ends"}


def test_pii_chains_and_base_overlaps(spark, monkeypatch):
    # candidates by pattern: a meets b, b meets c, a does not meet c; the score is that of the generator's order
    monkeypatch.setattr(pii, "model", lambda *_: ([(0, 0.5, 3.0, (0, 1.5, 2.0, 1.0))], {k: 0.0 for k in pii.KINDS}))
    monkeypatch.setattr(pii, "GENERATORS", (("ssn", "a", "aabb"), ("iban", "b", "bbcc"), ("card", "c", "ccdd|[+]4912345678 x+")))
    df = spark.createDataFrame([(1, "z aabbccdd z"), (2, "call +4912345678 xxx now")], "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.base) for r in pii.find(df).collect()}
    assert [tuple(s) for s in got[1][0]] == [("card", 6, 10), ("ssn", 2, 6)]
    assert [tuple(s) for s in got[2][0]] == [("card", 5, 20), ("phone", 5, 16)] and [tuple(s) for s in got[2][1]] == [("phone", 5, 16)]
    assert [r.text for r in pii.redact(df).sort("doc_id").collect()] == ["z <ssn><card> z", "call <phone> now"]


def test_pii_many_matches_and_clashing_names(spark):
    import time

    n = 10_000
    rng = np.random.default_rng(1)
    text = " ".join(f"call ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)} or mail a{i}@b{i}.com x" for i in range(n))
    schema = "doc_id long, text string, spans string, base string, candidates string, _base string, row int"
    df = spark.createDataFrame([(1, text, "s", "b", "c", "d", 5), (2, None, None, None, None, None, None)], schema)
    began = time.time()
    one, none = pii.redact(df).sort("doc_id").collect()
    assert tuple(one)[2:] == ("s", "b", "c", "d", 5)
    assert one.text.count("or mail <email> x") == n and one.text.count("call <phone> or") > 0.95 * n
    rest = re.sub(r"call (<phone>|\(\d{3}\) \d{3}-\d{4}) or mail <email> x ?", "", one.text)
    assert rest == ""
    assert none.text is None and none.spans is None
    assert time.time() - began < 120
    got = pii.find(df).where("doc_id = 1").select("candidates", "_base", "row", F.size("base").alias("n"), F.size("spans").alias("m")).first()
    assert tuple(got) == ("c", "d", 5, n, n + one.text.count("<phone>"))
    assert pii.report(df).where("doc_id = 1").first().n_email == n


def test_pii_spans_by_brute_force(spark):
    """Candidates, scores, thresholds and the choice in plain Python; only the features of single spans come from the library."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    extra = ["token = 'a1b2c3d4e5f6a7b8' and (555) 123-4567, 555-12-3456", "key: 0123456789abcdef0123456789abcdef card 4111/1111/1111/1111", "joe [at] site [dot] org. Then", "iban DE89370400440532013000 ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334"]
    df = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    trees, limits = pii.model(spark)
    want = {}
    for r in df.select("doc_id", "text", F.concat(*pii._candidates(F.col("text"))).alias("c")).collect():
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(r.text))]
        found = []
        for g, (kind, _, pattern) in enumerate(pii.GENERATORS):
            for m in re.finditer(re.sub(r"\(\?:(\(\?<!.*?\))\|\\G\)", r"\1", pattern).replace("\\x20", " "), r.text):
                tail = re.search("[A-Za-z0-9+/_-]+$", m[0])[0] if kind == "secret" else m[0]
                found.append((kind, m.end() - len(tail), m.end(), tail))
        assert Counter(found) == Counter((c.kind, c.start, c.stop, c.value) for c in r.c)
        scored = []
        for c in r.c:
            score = float(sum(pii._apply(t, np.array([c.x]))[0] for t in trees))
            if score >= limits[c.kind] and not any(a <= c.start and c.stop <= b for _, a, b in base):
                scored.append((-score, c.start - c.stop, c.start, sorted(pii.KINDS, reverse=True).index(c.kind), c.stop, c.kind))
        kept = []
        for s in sorted(scored):
            if not any(s[2] < o[4] and o[2] < s[4] for o in kept):
                kept.append(s)
        spans = {(pii.KINDS.index(k), a, b, k) for k, a, b in base} | {(pii.KINDS.index(s[5]), s[2], s[4], s[5]) for s in kept}
        want[r.doc_id] = ",".join(f"{k}:{a}:{b}" for _, a, b, k in sorted(spans))
    assert {r.doc_id: r.spans for r in pii.report(df).collect()} == want
    assert sum("secret" in w for w in want.values()) > 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    cols = corpus_pipeline.COLUMNS
    docs.select(*cols).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    every = docs.select(*cols).collect()
    kept = {r.doc_id for r in quality.rate(docs).where("kept").collect()}
    good = [r for r in every if r.doc_id in kept]
    comps = brute_components([brute_fingerprint(r.text) for r in good], [r.doc_id for r in good])
    left = {r.doc_id for r, c in zip(good, comps, strict=True) if r.doc_id == c}
    assert {r.doc_id for r in rows} == left and len(left) > 10
    clean = spark.createDataFrame([r for r in good if r.doc_id in left], docs.select(*cols).schema)
    want = Counter((r.doc_id, r.piece, r.ids_crc32) for r in packing.pack(pii.redact(clean)).collect())
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows) == want


def test_stages_with_shared_and_missing_ids(spark):
    import corpus_pipeline

    prose = " ".join(f"the word{i} of item{i * 7 % 97} and" for i in range(60))
    other = " ".join(f"the line{i} of point{i * 5 % 83} and" for i in range(60))
    third = " ".join(f"the place{i} of group{i * 3 % 71} and" for i in range(60))
    rows = [(1, prose), (1, "short"), (1, prose), (2, other), (2, other), (2, prose), (None, third), (None, third), (None, other), (3, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("extra", F.lit(1))
    good = corpus_pipeline.keep_good(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter(r for r in rows if r[1] not in (None, "short"))
    left = corpus_pipeline.drop_copies(spark, good, "").collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([(1, prose), (2, other), (None, third)])
    assert list(left[0].asDict()) == list(corpus_pipeline.COLUMNS)
    kept = Counter(r.doc_id for r in quality.rate(docs).where("kept").collect())
    assert kept == Counter(r.doc_id for r in good.collect())
    none = docs.where("false")
    assert corpus_pipeline.drop_copies(spark, corpus_pipeline.keep_good(spark, none, ""), "").count() == 0


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize(("block", "few"), [(512, 1_000_000), (7, 1_000_000), (7, 3)])
def test_near_duplicates_by_jaccard(spark, block, few):
    from foliospark.llm import shingles

    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(30)]
    texts = [None, "", " ", "a b", "A  b", "a b c d e f"]
    for n in [5, 9, 12, 30, 60, 90, 150, 400, 1000]:
        base = [f"w{k}" for k in rng.integers(0, 5000, n)] + (passage if n % 20 == 10 else [])
        for _ in range(14):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 2 + n // 30)):
                words[at] = f"x{rng.integers(0, 9)}"
            texts.append(" ".join(words[: len(words) - int(rng.integers(0, 1 + n // 8))]))
    sets = [brute_set(t) for t in texts]
    roots, far = list(range(len(sets))), 0

    def find(a):
        while roots[a] != a:
            a = roots[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                roots[y] = x
                far += (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 3
    want = {i for i in range(len(texts)) if find(i) == i}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.doc_id for r in shingles.representatives(df.union(df.where("doc_id % 3 = 0")), block=block, few=few).collect()]
    assert set(got) == want and len(got) == len(want)
    assert far > 50 and 20 < len(want) < len(texts) - 20


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_ship_texts_that_may_be_near(spark, monkeypatch, block):
    """Texts that share shingles, so that they form a coarse group, but are not near each other are told apart by their fingerprints."""
    from foliospark.llm import shingles

    rng, asked, told = np.random.default_rng(5), [], shingles._told
    monkeypatch.setattr(shingles, "_told", lambda rows, key, keys, few: asked.append(keys.count()) or told(rows, key, keys, few))
    monkeypatch.setattr(shingles, "_common", lambda docs, width: np.zeros(0, np.uint64))  # shared shingles are not put last
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join([passage, *(f"w{k}" for k in rng.integers(0, 90_000, 60 + i % 50))]) for i in range(150)]
    texts += [texts[0] + " more", texts[1] + " more words", texts[1] + " some more words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in shingles.representatives(df, block=block).collect()} == set(range(150))
    assert 5 <= asked[0] <= 25  # texts to compare, of 153 in one coarse group


def test_prints_bound_the_difference():
    from foliospark.llm import shingles

    rng = np.random.default_rng(9)
    for n in (1, 2, 5, 40, 64, 65, 300, 5000, 40_000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.random(n) < 0.95], rng.integers(0, 1 << 64, n // 20, dtype=np.uint64)])
        if len(b) * 5 < n * 4:
            continue
        power = min(shingles._buckets(len(a)), shingles._buckets(len(b)))
        assert abs(shingles._buckets(len(a)) - shingles._buckets(len(b))) <= 1
        x, y = (np.frombuffer(shingles._print(s, power), np.uint8) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("rows", [10_000, 7])
def test_meetings_by_chance_make_no_pairs(rows):
    """Sets that share a shingle only are told apart where they meet; near ones, also in chains and across sizes of sketches, stay connected."""
    import pyarrow as pa

    from foliospark.llm import shingles

    rng = np.random.default_rng(17)
    some = lambda n: np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    near, chance, entries = [], [], []
    for n in (30, 120, 380, 410, 790, 830, 1580, 1650):
        base, shared = some(n), rng.integers(0, 1 << 64, 1, dtype=np.uint64)
        near.append([np.unique(np.r_[base[rng.random(len(base)) < 0.97], some(n // 50)]) for _ in range(40 if n == 120 else 5)])
        chance += [[np.r_[some(n), shared] for _ in range(20)]]
    for key, group in enumerate(near + chance):  # all sets of a group meet under one key
        rows_of = sorted((len(s), shingles._name(s), shingles._sketch(s)) for s in group)
        entries += [(key, *row) for row in rows_of for _ in range(2)]
    cols = [pa.array(x, t) for x, t in zip(zip(*entries, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
    batch = pa.RecordBatch.from_arrays(cols, names=["key", "n", "fp", "sketch"])
    pairs = [tuple(p) for b in shingles._meetings(iter(batch.slice(k, rows) for k in range(0, len(entries), rows))) for p in zip(*b.to_pydict().values(), strict=True)]
    root = {row[2]: row[2] for row in entries}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    for group in near:
        for x in group:
            for y in group:
                same = len(np.intersect1d(x, y))
                assert same * 9 < 4 * (len(x) + len(y)) or find(shingles._name(x)) == find(shingles._name(y))
    own = {shingles._name(s) for group in chance for s in group}
    assert sum(a in own for a, _ in pairs) < 0.02 * 8 * 190
    assert len(pairs) < 200


def test_chunk_encoder_with_a_full_memo(monkeypatch):
    from foliospark.llm import encoding

    monkeypatch.setattr(encoding, "MEMO_SIZE", 50)
    rng = np.random.default_rng(11)
    letters = list("abcABéßøɐʰ''.,!?:_-&#$()  \n\t019²½ªº\"/\\`|<>\x85sıſ¡")
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 3000)]
    texts += ["it's he'll don't' x's' 's 'S a'S.", "a" * 100 + "...", "word" * 30 + "!!", "''s", "ª. º, ʰ!", "x</w> </w> w</w>.", "a¡! a¡", ""]
    content = vocabulary("word_bpe_49k.json")
    enc, tok = encoding.ChunkEncoder(content), load(content)
    for at, some in encoding.grouped(texts):
        for text, ids in zip(some, enc.encode(some), strict=True):
            assert ids == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
