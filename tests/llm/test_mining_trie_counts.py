"""Hard negatives, the conversation trie and token counts against brute force: nulls, empty and odd rows, ties, repeats."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import negatives, runs, tokencount, trie
from foliospark.llm.encoding import load, vocabulary

DIR = "/root/testdata/sf0.001"


def with_extras(df):
    """Columns with names that the operators use inside."""
    for name in ("n_bytes", "digest", "width", "block", "spread", "pos", "k1", "of"):
        df = df.withColumn(name, F.lit("x"))
    return df


def brute_negatives(rows, every):
    v = []
    for i, e, label in rows:
        if i is not None and label is not None and e and all(x is not None and math.isfinite(x) for x in e):
            v.append((i, [math.floor(x * 256) for x in e], (label + 1) % 10 if i % 7 == 0 else label))
    anchors = {}
    for i, e, label in v:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, e)), (label, e))
    out, ends = [], (-(1 << 63), (1 << 63) - 1)
    for a, (label, e) in anchors.items():
        score = sorted((-min(max(sum(x * y for x, y in zip(e, o, strict=True)), ends[0]), ends[1]), i, of) for i, o, of in v if i != a and len(o) == len(e))
        for n, i, _ in [s for s in score if s[2] == label][:5]:
            fits = [s for s in score if s[2] != label and 80 * -n <= 100 * -s[0] <= 100 * -n][:5]
            out += [(a, i, r, j, -n, -m) for r, (m, j, _) in enumerate(fits, 1)]
    return sorted(map(repr, out))


def test_negatives(spark):
    rng = random.Random(2)
    vec = lambda n, s: [rng.gauss(0, s) for _ in range(n)]
    middles = [vec(20, 1) for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(middles)], rng.randint(0, 4)) for i in range(300)]
    rows += [(300 + i, rows[100][1], rng.randint(0, 3)) for i in range(100)]  # copies
    rows += [(1000 + i, vec(3, 1), 1) for i in range(20)] + [(2000 + i, vec(20, 1e9), i % 3) for i in range(30)]  # another length; beyond doubles
    rows += [(3000, [1e300] * 20, 1), (3010, [1e300] * 20, 2), (3011, [math.inf] * 20, 2), (3012, None, 1), (3013, [], 1), (3014, [None] * 20, 2)]
    rows += [(None, [1.0] * 20, 1), (3020, [0.0] * 20, None), (10, rows[10][1], 3), (10, rows[11][1], 1), (4000, [0.0] * 20, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.mine(with_extras(df), every=10).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(rows, 10) and len(got) > 500
    assert negatives.mine(df.limit(0)).count() == 0


def test_index_reads_less_and_finds_all():
    rng = np.random.default_rng(4)
    decay = 0.8 ** np.arange(64)
    v = np.floor(256 * rng.normal(size=(4000, 64)) * decay)
    index = negatives.Index(np.arange(4000), np.zeros(4000, int), v, float(np.abs(v).max()))
    read = []
    for q in v[:40]:
        score = v @ q
        for least in (int(0.9 * score.max()), int(0.5 * score.max()), 1, -5):
            at, got, entries = index.reaching(q, least)
            assert sorted(at) == np.flatnonzero(score >= least).tolist() and (got == score[at]).all()
            read.append(entries)
    assert np.mean(read[::4]) < 0.2 * v.size and np.mean(read[1::4]) < 0.7 * v.size  # high thresholds omit most of the index


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append(((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()), (r, x)))
    conv = {c: [y for _, y in sorted(v)] for c, v in conv.items()}
    built, members, under, leaves, saved, out = {}, defaultdict(set), defaultdict(set), {}, {}, []
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = conv.get(c - int(math.fmod(c, 5)), [])[:h] + conv[c][h:]
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].add(c)
    for p in members:
        if p:
            under[p[:-1]].add(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in under[p]) or 1
        saved[p] = sum(saved[k] for k in under[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(under[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


TURNS = "conv_id long, turn long, role string, text string"


def test_trie(spark):
    rng = random.Random(1)
    rows = []
    for c in range(-12, 200):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 12, 14])):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["u", "a", None]), rng.choice(["x", "y", "é", None, "zz"])))
    rows += rows[:40] + [(None, 1, "u", "x"), (8003, 0, "u", "only")]
    rows += [(7000, i, "u", f"t{i % 7}") for i in range(3000)] + [(7001, i, "u", f"t{i % 7}") for i in range(2900)]  # over many ranges
    df = spark.createDataFrame(rows, TURNS).repartition(16)
    got = trie.trie(with_extras(df)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_trie(rows)
    assert trie.trie(df.limit(0)).count() == 0


def test_trie_with_a_full_sketch(spark, monkeypatch):
    """A sketch that is too small proves little; the exact way finds the same nodes."""
    monkeypatch.setattr(trie, "LEAST", 16)
    monkeypatch.setattr(trie, "MOST", 16)
    rows = [(c, t, "u", f"{c % 3 if t < 3 else c % 11}-{t}") for c in range(60) for t in range(7)]
    got = trie.trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_trie(rows)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACK", 50)
    rows = [(c * 5, 0, "u", "same") for c in range(700)]
    got = trie.trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_trie(rows) and len(got) == 2


@pytest.mark.parametrize("ordered", [7, 1000])
def test_runs(spark, monkeypatch, ordered):
    monkeypatch.setattr(runs, "ORDERED", ordered)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, -4]), i, rng.randint(0, 99), rng.randbytes(16)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, pos long, v long, d binary")
    r = runs.Runs(df, "k", [F.col("pos")], sums=("v",), digest="d")
    resolve = r.resolver()

    def out(batches):
        import pyarrow as pa

        for b in batches:
            f = resolve(b)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (f["at"], f["last"], f["sum0"], f["lanes"][0].astype("int64")))], names=["k", "pos", "at", "last", "s", "lane"])

    got = sorted(tuple(x) for x in r.table.mapInArrow(out, "k long, pos long, at long, last boolean, s long, lane long").collect())
    want = []
    for k in {x[0] for x in rows}:
        mine, total, lane = sorted(x for x in rows if x[0] == k), 0, 0
        for at, (_, pos, v, d) in enumerate(mine, 1):
            total += v
            lane = (lane * runs.POINTS[0] + int.from_bytes(d[:4], "little")) % int(runs.PRIME)
            want.append((k, pos, at, at == len(mine), total, lane))
    assert got == sorted(want)


@pytest.mark.parametrize(("step", "overlap"), [(40, 20), (100, 10)])
def test_token_counts(spark, step, overlap):
    rng = random.Random(3)
    bits = ["<|endoftext|>", "<|endof", "text|>", "'re", "'s", "'", "r", " ", "  ", "\n", "\n\n \t", "hello", "World", "123", "é", "日本", "🙂", "...", "!?", "x" * 30, "'ll've", " ", "　 "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 300)))) for i in range(500)]
    rows += [(None, "null id " * 50), rows[7], rows[7], (9001, None), (9002, "a" * 5000), (9003, " " * 700 + "b"), (9004, "ab " * 10 + "c" * 900 + " tail " * 40)]
    tok = load(vocabulary("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    df = with_extras(spark.createDataFrame(rows, "doc_id long, text string"))
    got = tokencount.count_tokens(df, limit=100, step=step, overlap=overlap).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want))
    assert tokencount.count_tokens(df.limit(0)).count() == 0


def test_token_counts_of_other_vocabularies(spark):
    tok = load(vocabulary("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(20)
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, vocabulary_name="word_bpe_49k.json", step=50).collect()}
    assert got == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
