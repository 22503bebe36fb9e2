"""Hard negatives by threshold joins in the manner of L2AP, exactly.

Candidates of one length and group of labels form blocks, each with an inverted index: its dimensions in stages, those with the most
mass first, and for each stage the vectors in the order of the norm of what they have from there on. For a
threshold, a stage lists only vectors whose norm from there on, times the anchor's, reaches it; the others' remaining
dimensions are covered by that bound, as without a score before them they cannot reach the threshold. Partial scores
are accumulated stage by stage; a vector is pruned when its partial score and the product of the remaining norms stay below the
threshold, and what is left is scored in full. Thresholds start high and are lowered until the windows are full or
nothing below can be in them.

Anchors first meet the blocks of their own group, which gives their positives; with these as windows they meet all others.
Each meeting of an anchor and a block gives at most k rows a window, so ties and copies do not add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import floored, materialize

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 5, 256
#: A negative has between LOW / 100 of the positive's score and all of it.
LOW = 80
RELABELLED, LABELS = 7, 10
#: Vectors of a block of candidates and of anchors, blocks of anchors that meet a block of candidates in one task, and
#: dimensions of a stage.
CANDIDATES, ANCHORS, TOGETHER, STEP = 16_384, 1024, 16, 8
#: Labels are dealt to so many groups, so that any number of labels gives few small blocks.
GROUPS = 64
#: Each threshold's distance from the top, as a part of the whole range, and what rounding may add to a bound.
STEPS, SLACK = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1), 1e-9
_ENDS = (-(1 << 63), (1 << 63) - 1)


class Index:
    """A block's inverted index; ``exact`` scores are whole numbers, held within 64 bits."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        self.ids, self.labels, self.width = ids, labels, vectors.shape[1]
        self.dims = np.argsort(-np.square(vectors / max(np.abs(vectors).max(initial=0), 1)).sum(axis=0), kind="stable")
        self.cuts = [*range(0, self.width, STEP), self.width]
        self.v = vectors[:, self.dims]
        with np.errstate(over="ignore"):
            tails = [np.linalg.norm(self.v[:, c:], axis=1) for c in self.cuts]
        self.tails = np.stack(tails)  # the norm of what a vector has from each stage on
        self.order = [np.argsort(-t, kind="stable") for t in tails[:-1]]
        self.norms = [np.ascontiguousarray(-t[o]) for t, o in zip(tails, self.order, strict=False)]  # rising, for bisection
        self.parts = [np.ascontiguousarray(self.v[o, a:b]) for o, a, b in zip(self.order, self.cuts, self.cuts[1:], strict=False)]
        self.fits = float(np.abs(vectors).max(initial=0)) * most * self.width < 1 << 53
        self.whole = None if self.fits else np.vectorize(int, otypes=[object])(self.v)

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The scores of some vectors, exactly; one beyond 64 bits counts as the nearest such number."""
        if self.fits:
            return (self.v[at] @ query[self.dims]).astype(np.int64)
        q = [int(x) for x in query[self.dims]]
        return np.array([min(max(sum(map(int.__mul__, row, q)), _ENDS[0]), _ENDS[1]) for row in self.whole[at]], np.int64)

    def top(self, query: np.ndarray) -> float:
        """No score is above this."""
        if not self.fits:
            return float(_ENDS[1])
        return float(np.linalg.norm(query) * -self.norms[0][0]) * (1 + SLACK) + 1 if len(self.ids) else 0.0

    def reaching(self, query: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of all vectors whose score is at least ``least``, and the entries of the index that were read."""
        n, q = len(self.ids), query[self.dims]
        if least <= 0 or not self.fits or not np.isfinite(least):  # no norm is below that
            at = np.arange(n)
            score = self.scores(at, query)
            keep = score >= least
            return at[keep], score[keep], n * self.width
        rest = [float(np.linalg.norm(q[c:])) * (1 + SLACK) for c in self.cuts]
        partial, stages, read = np.zeros(n), np.zeros(n, np.int64), 0
        alive = np.zeros(n, bool)
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            listed = int(np.searchsorted(self.norms[s], -(least - 1) / rest[s], "right")) if rest[s] > 0 else 0
            at = self.order[s][:listed]
            if not listed:
                break
            if s:
                use = alive[at]
                at = at[use]
                partial[at] += self.parts[s][:listed][use] @ q[a:b]
            else:
                alive[at] = True
                partial[at] = self.parts[s][:listed] @ q[a:b]
            read += len(at) * (b - a)
            stages[at] = s + 1
            alive[at] = partial[at] + self.tails[s + 1, at] * rest[s + 1] >= least - 1
        at = np.flatnonzero(alive)
        at = at[partial[at] + self.tails[stages[at], at] * np.asarray(rest)[stages[at]] >= least - 1]
        score = self.scores(at, query)
        keep = score >= least
        return at[keep], score[keep], read

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to the smaller id."""
        if len(at) > 4 * k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[keep], score[keep]
        order = np.lexsort((self.ids[at], ~score))[:k]  # not minus: the least number has no opposite
        return self.ids[at[order]], score[order]

    def windows(self, own: int, label: int, same: bool, query: np.ndarray, spans: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each span of scores (least, most), both included, the k best vectors in it that are not the anchor's own and
        have its label, or not its label."""
        high = min(self.top(query), max((b for _, b in spans), default=0))
        low = min((a for a, _ in spans), default=0)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2] * len(spans)
        fit = (self.ids != own) & ((self.labels == label) == same)
        if high < low or not fit.any():
            return found
        for step in STEPS if self.fits else STEPS[-1:]:  # beyond doubles all are scored at once
            least = max(low, int(high - (high - low) * step)) if step < 1 else low
            at, score, _ = self.reaching(query, least)
            at, score = at[fit[at]], score[fit[at]]
            full = True
            for i, (a, b) in enumerate(spans):
                within = (score >= a) & (score <= b)
                found[i] = self.best(at[within], score[within], k)
                full &= len(found[i][0]) == k or least <= a
            if full:
                break
        return found


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows (width, label, vec_id, v, spans) as numbered blocks (width, of, block, ids, labels, vectors, spans), as bytes."""
    spans = "spans" in rows.columns
    rows = rows if spans else rows.withColumn("spans", F.lit(None).cast("array<long>"))
    of = F.pmod(F.col("label"), F.lit(GROUPS)).alias("of")
    rows = materialize(rows.select("width", of, "label", "vec_id", "v", "spans").withColumn("spread", F.monotonically_increasing_id()), f"{name}_rows")
    sizes = rows.groupBy("width", "of").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    sizes = materialize(sizes, f"{name}_sizes")  # a row for each group and length
    dealt = rows.join(sizes, ["width", "of"]).withColumn("block", F.pmod(F.xxhash64("spread"), F.col("blocks")).cast("int"))
    names = ["width", "of", "block", "ids", "labels", "vectors", "spans"]

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        flat = lambda c, kind: np.asarray(t[c].combine_chunks().flatten(), kind).tobytes()
        cols = [t["width"][:1], t["of"][:1], t["block"][:1], pa.array([np.asarray(t["vec_id"], "<i8").tobytes()]), pa.array([np.asarray(t["label"], "<i4").tobytes()]), pa.array([flat("v", "<f8")]), pa.array([flat("spans", "<i8") if spans else b""])]
        return pa.table(cols, names=names)

    packed = dealt.select("width", "of", "block", "label", "vec_id", "v", "spans").groupBy("width", "of", "block").applyInArrow(pack, "width int, of int, block int, ids binary, labels binary, vectors binary, spans binary")
    return materialize(packed, name)


def _meet(anchors: DataFrame, candidates: DataFrame, same: bool, positives: int, k: int) -> DataFrame:
    """Every block of anchors with every block of candidates of its own group, or with all: rows (anchor_id, positive,
    vec_id, score) of vectors with the anchor's label, or with another one; ``positive`` is the number of a span."""
    blocks = candidates.select("width", F.col("of").alias("other"), "block")  # a row for each block, without its bytes
    last = anchors.groupBy("width", "of").agg(F.max((F.col("block") / TOGETHER).cast("int")).alias("last"))
    groups = last.join(blocks, "width").where("of = other" if same else "true")  # at most GROUPS rows a block and length
    to = groups.select("width", "of", "other", F.col("block").alias("c"))
    left = anchors.withColumn("g", (F.col("block") / TOGETHER).cast("int")).drop("block").join(to, ["width", "of"])
    grid = groups.select("width", "of", "other", "block", F.explode(F.sequence(F.lit(0), "last")).alias("g"))
    right = candidates.withColumnRenamed("of", "other").drop("spans").join(grid, ["width", "other", "block"]).withColumnRenamed("block", "c")
    names = ["anchor_id", "positive", "vec_id", "score"]

    def run(asking: pa.Table, block: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if asking.num_rows and block.num_rows:
            c = block.slice(0, 1).to_pylist()[0]
            read = lambda r: (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["labels"], "<i4"), np.frombuffer(r["vectors"], "<f8").reshape(-1, c["width"]))
            asked = [(*read(r), np.frombuffer(r["spans"], "<i8").reshape(-1, positives, 2)) for r in asking.select(["ids", "labels", "vectors", "spans"]).to_pylist()]
            index = Index(*read(c), max(float(np.abs(q).max(initial=0)) for _, _, q, _ in asked))
            for own, labels, queries, spans in asked:
                for i, q in enumerate(queries):
                    use = [(int(a), int(b)) for a, b in spans[i] if a <= b] if not same else [_ENDS]
                    for j, (vec, score) in enumerate(index.windows(own[i], labels[i], same, q, use, k)):
                        for col, x in zip(rows, (np.full(len(vec), own[i]), np.full(len(vec), j), vec, score), strict=True):
                            col.append(x)
        return pa.table([pa.array(np.concatenate(c)) for c in rows], names=names)

    keys = ["width", "of", "other", "c", "g"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both hold columns of the same tables
    return left.groupby(*keys).cogroup(right.groupby(*keys)).applyInArrow(run, "anchor_id long, positive long, vec_id long, score long")


def mine(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """Per anchor (vec_id divisible by ``every``), positive and rank: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Rows with a null label or vec_id, or a vector that is null or empty or holds null or non-finite components, take no part.
    Where vec_id is divisible by 7 the label becomes (label + 1) % 10. Components become floor(scale * x) and scores are
    exact, whatever their size; one that does not fit 64 bits counts as the nearest number that does. Vectors of different lengths
    do not meet. Rows with the anchor's id are neither positives nor negatives of it; of rows that share an anchor's
    id the one with the smallest label, then vector, is the anchor. Other repeated rows count each. Ties go to the smaller
    vec_id. Fewer candidates give fewer rows; an empty table none. Columns beyond vec_id, label and embedding are not read.
    """
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("int")
    whole = F.transform(x, lambda e: floored(e.cast("double") * scale))
    vectors = materialize(embeddings.where(fine).select(F.size(x).alias("width"), label.alias("label"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")), "vectors")
    candidates = _blocks(vectors, CANDIDATES, "candidates")
    asking = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v", "width")).alias("one")).select("one.width", "one.label", "vec_id", "one.v")
    anchors = _blocks(asking, ANCHORS, "anchors")
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = materialize(_meet(anchors, candidates, True, positives, positives).withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives).drop("positive"), "positives")
    # spans of scores in which the negatives of each positive lie: 80 * positive <= 100 * negative <= 100 * positive
    least = F.ceil(F.col("score").cast("decimal(25,0)") * LOW / 100).cast("long")
    spans = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("at", least.alias("least"), "score"))).alias("of"))  # at most ``positives`` each
    none = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    filled = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.get(F.transform("of", lambda s: F.array(s["least"], s["score"])), i - 1), none)))
    spanned = asking.join(spans.select(F.col("anchor_id").alias("vec_id"), filled.alias("spans")), "vec_id")
    found = _meet(_blocks(spanned, ANCHORS, "spanned"), candidates, False, positives, negatives)
    # spans that no score can be in (of negative positives) come last, as positives fall, so numbers of spans are places
    order = Window.partitionBy("anchor_id", "positive").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    of = near.select("anchor_id", (F.col("at") - 1).cast("long").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(of, ["anchor_id", "positive"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
