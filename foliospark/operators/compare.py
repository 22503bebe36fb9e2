"""Comparison of readings and pages: surveys, paired differences, rule search, best reading, votes, draws, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Differences of a cost up to this count as none.
SAME = 0.0005
NEAR_EMPTY, MANY_NUMBERS, SOME_NUMBERS = 150, 0.30, 0.12


def survey(pages: DataFrame) -> DataFrame:
    """(page, words, num_share, columns, kind, reader) of pages (page, text, columns): a page with many numbers or one
    column goes to the default reader. A null text has no words."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    read = pages.select("page", words.alias("w"), F.coalesce("columns", F.lit(1)).alias("columns"))
    numbers = F.size(F.filter("w", lambda x: x.rlike(r"\p{Nd}")))
    read = read.select("page", F.size("w").cast("long").alias("words"), (numbers / F.greatest(F.size("w"), F.lit(1))).alias("share"), "columns")
    two = F.when(F.col("share") < SOME_NUMBERS, "two-column prose").otherwise("two-column + data")
    kind = F.when(F.col("words") < NEAR_EMPTY, "near-empty").when(F.col("share") >= MANY_NUMBERS, "tables").when(F.col("columns") >= 2, two).otherwise("single column")
    reader = F.when((F.col("share") >= MANY_NUMBERS) | (F.col("columns") == 1), "default").otherwise("heavy")
    return read.select("page", "words", F.round("share", 3).alias("num_share"), "columns", kind.alias("kind"), reader.alias("reader"))


def paired(scores: DataFrame, control: str) -> DataFrame:
    """Each engine against the control on the pages both have, for each set and over all of them (set ``all``), from
    scores (set, page, engine, cost). Null costs are left out."""
    known = scores.where(F.col("cost").isNotNull())
    base = known.where(F.col("engine") == control).select("set", "page", F.col("cost").alias("base"))
    both = known.where(F.col("engine") != control).join(base, ["set", "page"]).withColumn("d", F.col("cost") - F.col("base"))
    counts = [F.count_if(c).alias(n) for n, c in (("better", F.col("d") < -SAME), ("worse", F.col("d") > SAME), ("same", F.abs("d") <= SAME))]
    found = both.rollup("engine", "set").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("cost").alias("cost"), F.avg("d").alias("delta"), *counts)
    return found.where("g < 3").withColumn("set", F.when(F.col("g") == 1, "all").otherwise(F.col("set"))).drop("g")


def threshold_rules(rows: DataFrame, k: int = 8, least: int = 3) -> DataFrame:
    """The k rules "feature >= t" or "feature <= t" whose pages lower the cost most on the development rows, with what
    they do on the held-out rows, from rows (page, feature, value, delta, held).

    Running sums over the distinct values of a feature give all rules in one pass, without joining thresholds with
    pages; only the k rules are broadcast. Gains are means over all rows of the feature in that part; ties go by
    feature, side and threshold.
    """
    known = rows.where("value IS NOT NULL AND delta IS NOT NULL")
    dev = known.where("NOT held").groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("delta").alias("d"))
    w = Window.partitionBy("feature")
    up = w.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = w.orderBy("value").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sides = [F.struct(F.lit(s).alias("side"), F.sum("n").over(x).alias("fires"), (F.sum("d").over(x) / F.sum("n").over(w)).alias("gain")) for s, x in ((">=", down), ("<=", up))]
    rules = dev.select("feature", F.col("value").alias("t"), F.array(*sides).alias("s")).select("feature", "t", F.inline("s")).where(F.col("fires") >= least)
    best = rules.orderBy("gain", "feature", "side", "t").limit(k)
    held = known.where("held").select("feature", "value", "delta")
    sizes = held.groupBy("feature").agg(F.count("*").alias("size"))
    on = (F.col("r.feature") == F.col("h.feature")) & F.when(F.col("side") == ">=", F.col("value") >= F.col("t")).otherwise(F.col("value") <= F.col("t"))
    seen = held.alias("h").join(F.broadcast(best.select("feature", "side", "t")).alias("r"), on).groupBy("r.feature", "side", "t")
    seen = seen.agg(F.count("*").alias("held_fires"), F.sum("delta").alias("hd"))
    out = best.join(seen, ["feature", "side", "t"], "left").join(sizes, "feature", "left")
    return out.select("feature", "side", "t", "fires", "gain", F.coalesce("held_fires", F.lit(0)).alias("held_fires"), F.coalesce(F.col("hd") / F.col("size"), F.lit(0.0)).alias("held_gain"))


def best_reading(scores: DataFrame) -> DataFrame:
    """(page, engine, cost): the cheapest engine of each page; ties go by name. Null costs are left out."""
    found = scores.where("cost IS NOT NULL").groupBy("page").agg(F.min(F.struct("cost", "engine")).alias("m"))
    return found.select("page", "m.engine", "m.cost")


def complete_pages(scores: DataFrame) -> DataFrame:
    """The pages that every engine of the table has read."""
    pairs = scores.select("page", "engine").where("page IS NOT NULL AND engine IS NOT NULL").distinct()
    every = pairs.select("engine").distinct().agg(F.count("*").alias("every"))
    return pairs.groupBy("page").agg(F.count("*").alias("n")).join(F.broadcast(every), F.col("n") == F.col("every")).select("page")


def disagreements(readings: DataFrame, least: int = 2) -> DataFrame:
    """(slot, word, families): for each slot, the word other than the pivot's on which most families agree, if at
    least ``least`` do, from readings (slot, family, word, pivot); ties go by word."""
    other = readings.where(~F.col("word").eqNullSafe(F.col("pivot")) & F.col("word").isNotNull())
    votes = other.groupBy("slot", "word").agg(F.count_distinct("family").alias("families"))
    top = votes.groupBy("slot").agg(F.min(F.struct((-F.col("families")).alias("n"), "word")).alias("m"))
    return top.select("slot", "m.word", (-F.col("m.n")).alias("families")).where(F.col("families") >= least)


def quota_draw(pages: DataFrame, quota: int, seed: str) -> DataFrame:
    """Of pages (page, kind, low), ``quota`` of each kind in the order of a seeded digest, split between low and high
    in proportion, each with one at least where that can be. Repeated pages count each."""
    low = F.coalesce("low", F.lit(False))
    pages = pages.select("page", "kind", low.alias("low"), F.md5(F.concat(F.lit(seed + ":"), F.col("page").cast("string"))).alias("key"))
    n = pages.groupBy("kind").agg(F.count_if("low").alias("a"), F.count_if(~F.col("low")).alias("b"))
    share = F.bround(quota * F.col("a") / (F.col("a") + F.col("b"))).cast("long")
    if quota >= 2:
        share = F.when((F.col("a") > 0) & (F.col("b") > 0), F.greatest(F.lit(1), F.least(share, F.lit(quota - 1)))).otherwise(share)
    take = n.select("kind", F.least(share, "a").alias("of_low"), "b").select("kind", "of_low", F.least(quota - F.col("of_low"), "b").alias("of_high"))
    rank = F.row_number().over(Window.partitionBy("kind", "low").orderBy("key", "page"))
    first = pages.withColumn("rank", rank).where(F.col("rank") <= quota)  # a partial limit before the shuffle
    return first.join(take, "kind").where(F.col("rank") <= F.when(F.col("low"), F.col("of_low")).otherwise(F.col("of_high"))).select("page", "kind", "low")


def admit(files: DataFrame, cap: int, total: int) -> DataFrame:
    """The files (batch, ord, size) of each batch with ``state``: ``too large`` for those over ``cap``, which use none
    of the budget, ``over budget`` from where the sizes of the others pass ``total``, else ``ok``. A null size is 0."""
    size = F.coalesce("size", F.lit(0))
    used = F.sum(F.when(size <= cap, size).otherwise(0)).over(Window.partitionBy("batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(size > cap, "too large").when(used > total, "over budget").otherwise("ok")
    return files.withColumn("state", state)


def heading_parents(headings: DataFrame, deepest: int = 6) -> DataFrame:
    """(doc_id, ord, level, parent): the nearest heading before with a smaller level, null at the top. Levels are from
    1 to ``deepest``; others count as the nearest of these, null as 1."""
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(deepest)).cast("int")
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == x, F.col("ord"))).over(before) for x in range(1, deepest)]
    under = reduce(lambda found, x: found.when(F.col("level") == x + 1, F.greatest(*last[:x]) if x > 1 else last[0]), range(1, deepest), F.when(F.lit(False), F.lit(None)))
    return headings.select("doc_id", "ord", level.alias("level")).select("doc_id", "ord", "level", under.alias("parent"))


def style_levels(headings: DataFrame, largest_first: bool = True) -> DataFrame:
    """``level`` of each heading: the rank of its style among those of its document, at most 6; null where the document
    has fewer than two headings or styles."""
    w = Window.partitionBy("doc_id")
    rank = F.dense_rank().over(w.orderBy(F.desc("style") if largest_first else F.asc("style")))
    ranked = headings.withColumn("_rank", rank).withColumn("_most", F.max("_rank").over(w))
    return ranked.withColumn("level", F.when(F.col("_most") >= 2, F.least("_rank", F.lit(6)))).drop("_rank", "_most")


def fence_mask(lines: DataFrame) -> DataFrame:
    """``fenced``: whether a line (doc_id, ord, text) is inside a code fence or one of its marks."""
    mark = F.coalesce(F.col("text").rlike(r"^ {0,3}(```|~~~)"), F.lit(False)).cast("int")
    to = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_m", mark).withColumn("fenced", (F.sum("_m").over(to) % 2 == 1) | (F.col("_m") == 1)).drop("_m")


def surfaces(found: DataFrame) -> DataFrame:
    """(key, surface, n): the form in which a key is written most, of equally frequent ones the first by its letters."""
    counted = found.groupBy("key", "surface").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "surface")).alias("m")).select("key", "m.surface", (-F.col("m.n")).alias("n"))


def correction(factor: Column, ratio: Column, share: Column) -> Column:
    """The next factor of an estimate after a task took ``ratio`` times as long, which was ``share`` of the work."""
    step = F.least(F.greatest(F.pow(ratio, 0.5 * share), F.lit(0.5)), F.lit(2.0))
    return F.least(F.greatest(factor * step, F.lit(0.15)), F.lit(8.0))


def flips(pages: DataFrame, old: Column, new: Column) -> DataFrame:
    """The pages on which two rules decide differently, a rule without a verdict counting as false."""
    a, b = (F.coalesce(c, F.lit(False)) for c in (old, new))
    return pages.withColumns({"old": a, "new": b}).where("old <> new")


def block_scores(counts: DataFrame) -> DataFrame:
    """``precision``, ``recall`` and ``f1`` of rows (gold, output, matched); null where nothing is to be divided by."""
    p, r = F.try_divide("matched", "output"), F.try_divide("matched", "gold")
    return counts.withColumns({"precision": p, "recall": r, "f1": F.try_divide(2 * F.col("matched"), F.col("gold") + F.col("output"))})
