"""Personal data: base patterns, and further spans by gradient boosting over candidates.

High-recall generators propose spans that may overlap; boosted trees score each from its format and its context; a
threshold for each kind, calibrated on held-out rows, selects. The base patterns' spans always stay. All of it is
column expressions: regular expressions, array functions and, for the trees, nested CASE. The trees are fitted on the
driver from a bounded set of generated labelled sentences (TRAIN_ROWS), whose features come from the same expressions.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Sentences that the trees are fitted on; a third of them is held out for the thresholds.
TRAIN_ROWS = 2400
#: A threshold is the least score from SURE (a chance of four in five) on that has this precision on held-out rows.
PRECISION, SURE = 0.98, float(np.log(4))
TREES, DEPTH, RATE = 40, 3, 0.3
#: Characters before a span that are its context.
LEFT = 24
#: Spans up to which a text is cut by substrings.
FEW = 64

#: Kinds in the order of the span list; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")

#: Base patterns, as matched by leftmost search: possessive where nothing can be given back, and begun where a run
#: of characters or the last match ends, so that very long runs take linear time and no deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Candidate generators: kind, what a text must hold for the search to be worth it, pattern. The span is the last run
#: without white space and quotes for secrets, else the whole match.
GENERATORS = (
    ("secret", "=|:", r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|key)[\"' ]{0,3}[=:][\"' ]{0,3}[a-z0-9+/_-]{8,}+"),
    ("secret", "[0-9]", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+"),
    ("phone", "[0-9]{3}", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"),
    ("email", r"[\[({](?:at|AT)[\])}]", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]++)++"),
    ("card", "[0-9]{4}", r"(?<![0-9.])[0-9]{4}[ ./_-]{1,3}[0-9]{4}[ ./_-]{1,3}[0-9]{4}[ ./_-]{1,3}[0-9]{1,7}(?![0-9])"),
    ("card", "[0-9]{13}", r"(?<![0-9A-Za-z])[0-9]{13,15}(?![0-9A-Za-z])"),
    ("ip", ":[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ssn", "[0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
CONTEXT = r"(?i)(?:token|secret|passw|pwd|key|auth|phone|tel|call|mobile|fax|mail|contact|card|visa|credit|pay|ip|addr|host|ssn|social|iban|account|bank)[^\n]{0,16}$"
FEATURES = ("generator", "n_chars", "n_digits", "n_letters", "distinct", "luhn", "context", "hex", "separators", "quoted", "sized", "mixed")


def _matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if needs is None else F.when(text.rlike(needs), found).otherwise(F.array().cast("array<string>"))


#: Elements that a running sum passes through as one piece: sums of pieces come first, so its work stays near linear.
PIECE = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it uses the value."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints, what ``add`` makes of all before it, from 0 on."""
    zero, none = F.lit(0), F.array().cast("array<int>")
    state = F.struct(zero.alias("at"), none.alias("out"))
    step = lambda a, x: F.struct(add(a["at"], x).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def of_pieces(pieces: Column) -> Column:
        sums = F.transform(pieces, lambda p: F.aggregate(p, zero, lambda a, x: add(a, x).cast("int")))
        firsts = F.aggregate(sums, state, step, lambda a: a["out"])
        inner = lambda p, first: F.aggregate(p, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])
        return _let(firsts, lambda f: F.flatten(F.transform(pieces, lambda p, i: inner(p, F.coalesce(F.get(f, i), zero)))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PIECE).cast("int")), lambda i: F.slice(v, i * PIECE + 1, F.lit(PIECE)))
    return _let(xs, lambda v: F.when(F.size(v) > 0, _let(cut(v), of_pieces)).otherwise(none))


_SPANS = "array<struct<kind:string,start:int,stop:int,value:string,left:string>>"


def _placed(text: Column, pattern: str, found: Column, kind: str) -> Column:
    """Spans (kind, start, stop, value, left = some characters before it) of the matches: a match starts after all
    that lies before it."""

    def spans(values: Column, between: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.length(F.get(between, i)) + F.length(v))

        def one(before: Column) -> Column:
            def span(v: Column, i: Column) -> Column:
                gap = F.get(between, i)
                start = F.get(before, i) + F.length(gap)
                left = F.right(F.concat(F.coalesce(F.get(between, i - 1), F.lit("")), F.coalesce(F.get(values, i - 1), F.lit("")), gap), F.lit(LEFT))
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(v)).alias("stop"), v.alias("value"), left.alias("left"))

            return F.transform(values, span)

        return _let(_running(steps, lambda a, x: a + x), one)

    return _let(found, lambda v: F.when(F.size(v) > 0, _let(F.split(text, pattern, -1), lambda b: spans(v, b))).otherwise(F.array().cast(_SPANS)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, F.get(doubled, c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _features(c: Column, generator: int) -> list[Column]:
    value, digits = c["value"], _digits(c["value"])
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    n = F.length(digits)
    sized = {"phone": n.between(9, 12), "card": n.between(13, 19), "ssn": ~value.rlike("^(?:000|666|9)|-00-|0000$"), "iban": F.length(F.regexp_replace(value, " ", "")).between(15, 34)}.get(GENERATORS[generator][0], F.lit(True))
    number = lambda x: x.cast("double")
    return [
        F.lit(float(generator)), number(F.length(value)), number(n), number(letters), number(F.size(F.array_distinct(F.split(value, "")))) / F.length(value),
        number(_luhn(digits) & (n > 0)), number(c["left"].rlike(CONTEXT)), number(value.rlike("^[0-9a-fA-F]+$")), number(F.length(value) - n - letters),
        number(F.right(c["left"], F.lit(1)).isin('"', "'")), number(sized), number(value.rlike("[0-9]") & value.rlike("[A-Za-z]")),
    ]


def _with_features(spans: Column, generator: int) -> Column:
    return F.transform(spans, lambda c: c.withField("x", F.array(*_features(c, generator))))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda c: c["kind"] == kind)


def _holding(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda c: _holds(kind, c["value"]))


def _value(c: Column) -> Column:
    """Of an assignment, the value only; what stands before it belongs to what is left of it."""
    return _let(F.regexp_extract(c["value"], "[A-Za-z0-9+/_-]+$", 0), lambda v: F.struct(
        c["kind"].alias("kind"), (c["stop"] - F.length(v)).alias("start"), c["stop"].alias("stop"), v.alias("value"),
        F.right(F.concat(c["left"], F.left(c["value"], F.length(c["value"]) - F.length(v))), F.lit(LEFT)).alias("left"),
    ))


def _candidates(text: Column) -> list[Column]:
    """Arrays of (kind, start, stop, value, left, x = features), one for each generator."""
    parts = []
    for g, (kind, needs, pattern) in enumerate(GENERATORS):
        spans = _placed(text, pattern, _matches(text, pattern, needs), kind)
        if kind == "secret":
            spans = F.transform(spans, _value)
        parts.append(_with_features(spans, g))
    return parts


# ---------------------------------------------------------------------------------------------------------------
# Fitting, on the driver: a few thousand generated rows.


def labelled_sentences(rows: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated sentences and the spans of personal data in them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def card(n: int, good: bool) -> str:
        body = rng.choice("3456") + digits(n - 2)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
        check = -total % 10
        return body + str(check if good else (check + rng.randint(1, 9)) % 10)

    def four(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    good = [
        lambda: (rng.choice(['token = "', "secret: ", "password=", 'api_key = "', "access key: "]), rng.choice([hexes(40), hexes(32), digits(4) + word() + hexes(16), hexes(24)])),
        lambda: (rng.choice(["auth ", "key ", "token "]), hexes(rng.choice([32, 40, 64]))),
        lambda: (rng.choice(["call ", "phone ", "tel ", "mobile: ", "fax "]), rng.choice(["(%s) %s-%s", "%s-%s-%s", "%s.%s.%s", "%s %s %s"]) % (digits(3), digits(3), digits(4))),
        lambda: (rng.choice(["mail ", "contact ", "write to "]), f"{word()}{rng.choice([' [at] ', '(at)', ' {at} '])}{word()}{rng.choice([' [dot] ', '(dot)', '.'])}com"),
        lambda: (rng.choice(["card ", "visa ", "pay with "]), four(card(16, True), rng.choice([".", "/", "_", " - "]))),
        lambda: (rng.choice(["card ", "credit "]), card(15, True)),
        lambda: (rng.choice(["host ", "ip ", "from "]), ":".join(hexes(4) for _ in range(8))),
        lambda: (rng.choice(["ssn ", "social "]), f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        lambda: (rng.choice(["iban ", "account ", "bank "]), rng.choice(["DE", "FR", "GB", "ES"]) + digits(2) + digits(rng.choice([16, 18, 20]))),
    ]
    bad = [
        lambda: ("", "-".join(word() for _ in range(6))), lambda: ("key: ", "".join(word() for _ in range(3))), lambda: ("token: ", word() + word() + word()),
        lambda: ("pages ", f"{digits(3)}-{digits(3)}-{digits(3)}"), lambda: ("", f"{digits(4)} {digits(3)} {digits(3)}"), lambda: ("", f"{digits(2)}-{digits(4)}-{digits(4)}"),
        lambda: ("", four(card(16, False), rng.choice([".", "/", " - "]))), lambda: ("", card(rng.choice([13, 14, 15]), False)), lambda: ("", card(16, False)),
        lambda: ("order ", digits(rng.choice([13, 14, 15]))), lambda: ("at ", ":".join(digits(2) for _ in range(4))), lambda: ("", "2024-01-15"), lambda: ("", "version 3.0"),
        lambda: ("", f"{rng.choice(['000', '666', '900'])}-{digits(2)}-{digits(4)}"), lambda: ("", "chapter-" + "-".join(word() for _ in range(5)) + "-" + digits(1)), lambda: ("", "AB12 " + word().upper() + " " + word().upper()),
    ]
    out = []
    for i in range(rows):
        lead = " ".join(word() for _ in range(rng.randint(1, 6))) + " "
        positive = i % 2 == 0
        context, value = rng.choice(good if positive else bad)()
        text = lead + context
        at = len(text)
        out.append((f"{text}{value} {word()} {word()}.", [(at, at + len(value))] if positive else []))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, threshold, left, right) or a leaf's value."""
    leaf = float(RATE * g.sum() / (h.sum() + 1))
    if not depth or len(g) < 16:
        return leaf
    best, score = None, g.sum() ** 2 / (h.sum() + 1) + 1e-6
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)))[:-1]:
            low = x[:, f] <= t
            if 4 <= low.sum() <= len(g) - 4:
                s = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low))
                if s > score:
                    best, score = (f, float(t), low), s
    if not best:
        return leaf
    f, t, low = best
    return f, t, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1)


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _apply(low, x), _apply(high, x))


def fit(x: np.ndarray, y: np.ndarray) -> list:
    trees, score = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, y - p, p * (1 - p), DEPTH)
        trees.append(tree)
        score += _apply(tree, x)
    return trees


_models: dict[int, tuple[list, dict[str, float]]] = {}


def model(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[list, dict[str, float]]:
    """Trees and, by kind, the calibrated score from which candidates are selected."""
    if rows not in _models:
        said = labelled_sentences(rows)
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "id int, text string")
        got = df.select("id", F.explode(F.concat(*_candidates(F.col("text")))).alias("c")).select("id", "c.kind", "c.start", "c.stop", "c.x").collect()
        got.sort(key=lambda r: (r["id"], r["kind"], r["start"], r["stop"], r["x"]))
        x = np.array([r["x"] for r in got])
        y = np.array([any(a <= r["start"] and r["stop"] <= b for a, b in said[r["id"]][1]) for r in got], float)
        kinds, held = np.array([r["kind"] for r in got]), np.array([r["id"] % 3 == 2 for r in got])
        trees = fit(x[~held], y[~held])
        score = sum(_apply(t, x) for t in trees)
        limits = {}
        for kind in KINDS:
            m = held & (kinds == kind)
            tried = [SURE, *(s for s in np.unique(score[m]) if s > SURE)]
            fine = [s for s in tried if (m & (score >= s)).any() and y[m & (score >= s)].mean() >= PRECISION]
            limits[kind] = float(fine[0]) - 1e-9 if fine else float("inf")
        _models[rows] = trees, limits
    return _models[rows]


def _score(trees: list, x: str) -> str:
    """The sum of the trees for the features ``x``, as SQL: one text is parsed far sooner than thousands of columns are made."""

    def one(tree) -> str:
        if isinstance(tree, float):
            return f"{tree!r}D"
        f, t, low, high = tree
        return f"CASE WHEN {x}[{f}] <= {t!r}D THEN {one(low)} ELSE {one(high)} END"

    return " + ".join(f"({one(t)})" for t in trees)


# ---------------------------------------------------------------------------------------------------------------


def _chosen(above: Column) -> Column:
    """Of candidates that overlap, the one with the best score, then each that meets none that stays.

    By start, candidates fall into runs that nothing joins, so a choice is within a run.
    """
    ties = F.array(*map(F.lit, sorted(KINDS, reverse=True)))
    none = F.array().cast("array<struct<o:double,n:int,start:int,t:bigint,stop:int,kind:string>>")
    best = lambda c: F.struct((-c["score"]).alias("o"), (c["start"] - c["stop"]).alias("n"), c["start"].alias("start"), F.array_position(ties, c["kind"]).alias("t"), c["stop"].alias("stop"), c["kind"].alias("kind"))
    meets = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    add = lambda kept, c: F.when(F.exists(kept, lambda o: meets(o, c)), kept).otherwise(F.concat(kept, F.array(c)))
    of_run = lambda run: F.when(F.size(run) == 1, F.transform(run, best)).otherwise(F.aggregate(F.array_sort(F.transform(run, best)), none, add))

    def runs(by_start: Column) -> Column:
        reach = _running(F.transform(by_start, lambda c: c["stop"]), lambda a, x: F.greatest(a, x))

        def split(reach: Column) -> Column:
            first = F.filter(F.transform(by_start, lambda c, i: F.when(c["start"] >= F.get(reach, i), i)), lambda i: i.isNotNull())
            cut = lambda f: F.transform(f, lambda at, k: F.slice(by_start, at + 1, F.coalesce(F.get(f, k + 1), F.size(by_start)) - at))
            return _let(first, lambda f: F.flatten(F.transform(cut(f), of_run)))

        return _let(reach, split)

    return F.when(F.size(above) > 0, _let(F.array_sort(above), runs)).otherwise(none)


def _beyond(spans: Column, base: Column) -> Column:
    """The spans that do not lie within a base span. By start, and longer ones first, the furthest stop of the base spans
    met so far tells."""
    both = F.concat(
        F.transform(base, lambda c: F.struct(c["start"].alias("start"), (-c["stop"]).alias("end"), F.lit(0).alias("new"), F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), F.lit(0.0).alias("score")).alias("c"))),
        F.transform(spans, lambda c: F.struct(c["start"].alias("start"), (-c["stop"]).alias("end"), F.lit(1).alias("new"), c.alias("c"))),
    )

    def left(by_start: Column) -> Column:
        reach = _running(F.transform(by_start, lambda x: F.when(x["new"] == 0, -x["end"]).otherwise(0)), lambda a, x: F.greatest(a, x))
        return _let(reach, lambda r: F.transform(F.filter(F.transform(by_start, lambda x, i: F.when((x["new"] == 1) & (-x["end"] > F.get(r, i)), x["c"])), lambda c: c.isNotNull()), lambda c: c))

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), _let(F.array_sort(both), left)).otherwise(spans)


def _found(docs: DataFrame, rows: int) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` (never null), ``base`` and ``spans``: nothing of ``docs`` can clash with these."""
    trees, limits = model(docs.sparkSession, rows)
    text = F.col("text")
    needs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{14}", "phone": r"\+[0-9]"}
    df = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))

    above = " OR ".join(f"(c.kind = '{k}' AND c.score >= {v!r}D)" for k, v in limits.items() if v != float("inf")) or "false"
    scored = f"filter(transform(candidates, c -> named_struct('start', c.start, 'stop', c.stop, 'kind', c.kind, 'score', {_score(trees, 'c.x')})), c -> {above})"
    short = lambda spans: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"), F.lit(0.0).alias("score")))
    base = F.concat(*(short(_holding(_placed(text, p, _matches(text, p, needs[k]), k), k)) for k, p in BASE.items()))
    df = df.select("row", "text", base.alias("base"), F.concat(*_candidates(text)).alias("candidates"))
    df = df.select("row", "text", "base", F.when(F.size("candidates") > 0, F.expr(scored)).otherwise(F.array().cast("array<struct<start:int,stop:int,kind:string,score:double>>")).alias("above"))
    order = F.array(*map(F.lit, KINDS))
    plain = lambda spans: F.transform(spans, lambda c: F.struct(F.array_position(order, c["kind"]).alias("o"), c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    once = lambda by_place: F.filter(by_place, lambda c, i: (i == 0) | (c != F.get(by_place, i - 1)))
    out = lambda spans: F.transform(_let(F.array_sort(spans), once), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    new = _let(_beyond(F.col("above"), F.col("base")), _chosen)
    return df.select("row", "text", out(plain(F.col("base"))).alias("base"), out(F.concat(plain(F.col("base")), plain(new))).alias("spans"))


def find(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, stop), by kind as in KINDS and then start; columns
    of these names are replaced.

    Of candidates that overlap, the one with the best score stays, then each that meets none that stays. One inside a
    base span is left out; one that goes beyond a base span stays whole beside it, so these may overlap.
    Positions count code points from 0, the stop is exclusive. A null or empty text has none. Each row stands for
    itself, so repeated rows and null ids need no care; there is no shuffle. The work grows with the length of a text
    and its matches, but for candidates that all overlap in one run. The text is the column ``text``; other columns may
    have any name.
    """
    return _found(docs, rows).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("base", "spans")), "base", "spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"))), ",")


def report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    df = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows)
    count = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; a null text stays null.

    Overlapping spans are replaced as one, under the kind of the first. All other columns stay as they are.
    """
    text = F.col("text")

    def clean(by_start: Column, part: Callable[[Column, Column], Column]) -> Column:
        def parts(reach: Column) -> Column:
            piece = lambda c, i: F.when(c["start"] >= F.get(reach, i), F.concat(part(F.get(reach, i), c["start"] - F.get(reach, i)), F.lit("<"), c["kind"], F.lit(">"))).otherwise("")
            last = F.greatest(F.element_at(reach, -1), F.element_at(by_start, -1)["stop"])
            return F.concat(F.array_join(F.transform(by_start, piece), ""), part(last, F.greatest(F.length(text) - last, F.lit(0))))

        return _let(_running(F.transform(by_start, lambda c: c["stop"]), lambda a, x: F.greatest(a, x)), parts)

    few = lambda spans: clean(spans, lambda at, n: F.substring(text, at + 1, n))
    # a substring is counted from the start of the text; for many of them its characters are laid out once
    many = lambda spans: _let(F.split(text, ""), lambda chars: clean(spans, lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")))
    by_start = F.array_sort(F.transform("spans", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["kind"].alias("kind"))))
    whole = F.col("row")["text"]
    done = F.when(whole.isNull() | (F.size("spans") == 0), whole.cast("string")).when(F.size("spans") <= FEW, _let(by_start, few)).otherwise(_let(by_start, many))
    return _found(docs, rows).select(*(done.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
