"""Personal data by weak supervision, in DataFrame functions only.

*Base* spans come from four patterns with checks (e-mail, IP address, card number with Luhn digit, phone number). The
method adds spans of kind ``secret`` (keys, tokens, passwords, identity numbers) from wider *candidates*: runs of letters and
digits with a digit in them, and numbers in dashed groups, that touch no base span. Four labelers vote yes, no or not at all on
each candidate: a strict pattern, a gazetteer of known prefixes and harmless words, the words just before it, and its shape.

Votes are counted over the whole corpus together with the candidates' features (a bounded table, as both are small
codes). Expectation-maximisation over the vote patterns estimates each labeler's reliability and, with that, how likely each
pattern is personal data; a logistic span classifier is trained on the features with these likelihoods as soft labels, and
its weights become part of the plan that scores every candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed patterns. Each starts only where a match can start and gives nothing back, so that time is linear
#: in the text; what they match is what the plain patterns match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = r"(?<![A-Za-z0-9])(?:[0-9]{3}[ .-][0-9]{2,3}[ .-][0-9]{4}(?![A-Za-z0-9])|(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{8,}+)"
STRICT_YES = r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*+[a-f])[0-9a-f]{16,}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"
STRICT_NO = r"^(?:[A-Za-z]+[0-9]{1,4}|[0-9]+)$"
KNOWN_PREFIXES = r"^(?:AKIA|ASIA|AIza|ghp|gho|xox|sk|pk|eyJ)"
HARMLESS = r"(?i)(?:version|license|chapter|section|figure|table|january|february|april|august|october)"
CUES = r"(?i)(?:password|passwd|pwd|passwort|contrase.a|mot de passe|clave|token|secret|api.?key|key|ssn|account|konto|cuenta|compte|phone|tel|call)[\s\"'=:>]{0,6}$"
NO_CUES = r"(?i)(?:version|section|page|chapter|licen[sc]e|article|figure|isbn|no\.)[\s:]{0,3}$"
CONTEXT = 24  # code points looked at before a candidate
STEP = 256
VOTERS = ("strict", "gazetteer", "context", "shape")
FEATURES = {"form": 2, "size": 5, "digits": 4, "case": 4, "opened": 2, "cued": 2, "mixed": 3, "known": 2}
THRESHOLD = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(values: Column) -> Column:
    """For each element of an integer array, the sum of those before it; chunk by chunk, so that long
    arrays don't take quadratic time."""

    def running(start: Column, xs: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, first, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda c: F.slice(values, c * STEP + 1, STEP))

    def within(cs: Column) -> Column:
        totals = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        return let(running(F.lit(0), totals), lambda bases: F.flatten(F.transform(cs, lambda c, i: running(F.get(bases, i), c))))

    return F.when(F.size(values) > 0, let(chunks, within)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str) -> Column:
    """Leftmost, non-overlapping matches with their places: ``s, e`` (code points, end exclusive) and ``m``."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    found = F.filter(pieces, lambda p: p["m"].isNotNull())

    def placed(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: p["gap"] + F.length(p["m"]))
        return let(sums_before(sizes), lambda at: F.transform(ps, lambda p, i: F.struct((F.get(at, i) + p["gap"]).alias("s"), (F.get(at, i) + p["gap"] + F.length(p["m"])).alias("e"), p["m"].alias("m"))))

    return let(found, placed)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column, back: Column) -> Column:
        d = (F.ascii(F.substring(back, i, F.lit(1))) - 48) * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return let(F.reverse(digits), lambda back: F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda t, i: add(t, i, back)) % 10 == 0)


def small_parts(m: Column) -> Column:
    """Every dotted part is at most 255."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def checked(kind: str, m: Column) -> Column:
    if kind == "ip":
        return small_parts(m)
    if kind == "card":
        return let(digits_of(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<s:int,k:int,e:int>>"
#: What a text must hold before a pattern is worth trying.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(text: Column) -> Column:
    """The checked spans of the four patterns, by start and kind."""
    none = F.array().cast(SPAN)
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])), spans_of(located(text, PATTERNS[kind]), kind, k)).otherwise(none))
    return F.when(text.rlike("[0-9@]"), F.array_sort(F.concat(*parts))).otherwise(none)


def spans_of(found: Column, kind: str, k: int) -> Column:
    kept = F.filter(found, lambda x: checked(kind, x["m"]))
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def vote(yes: Column, no: Column) -> Column:
    """1, 0, or 2 for no vote."""
    return F.when(yes, F.lit(1)).when(no, F.lit(0)).otherwise(F.lit(2))


def judged(m: Column, before: Column) -> Column:
    """A candidate's votes and features."""
    n, digits = F.length(m), F.length(digits_of(m))
    turns = F.regexp_count(m, F.lit("[A-Za-z][0-9]"))
    return F.struct(
        vote(m.rlike(STRICT_YES), m.rlike(STRICT_NO)).alias("strict"),
        vote(m.rlike(KNOWN_PREFIXES), m.rlike(HARMLESS)).alias("gazetteer"),
        vote(before.rlike(CUES), before.rlike(NO_CUES)).alias("context"),
        vote((n >= 16) & (digits >= 2) & (turns >= 2), (n < 12) & (turns < 2)).alias("shape"),
        m.rlike("^[0-9]+[ .-]").cast("int").alias("form"),
        F.when(n < 12, 0).when(n < 16, 1).when(n < 24, 2).when(n < 40, 3).otherwise(4).alias("size"),
        F.when(digits * 5 < n, 0).when(digits * 2 < n, 1).when(digits < n, 2).otherwise(3).alias("digits"),
        (m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") * 2).alias("case"),
        before.rlike("[=:\"']\\s?$").cast("int").alias("opened"),
        before.rlike(CUES).cast("int").alias("cued"),
        F.when(turns < 1, 0).when(turns < 3, 1).otherwise(2).alias("mixed"),
        m.rlike(KNOWN_PREFIXES).cast("int").alias("known"),
    )


def candidates(text: Column, base: Column) -> Column:
    """``s, e`` and :func:`judged` of each candidate that touches no base span."""

    def free(c: Column) -> Column:
        return ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    def told(c: Column) -> Column:
        before = F.substring(text, F.greatest(c["s"] - CONTEXT, F.lit(0)) + 1, F.least(c["s"], F.lit(CONTEXT)))
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), judged(c["m"], before).alias("j"))

    empty = F.filter(F.transform(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit("").alias("m"))), told), lambda c: F.lit(False))
    return F.when(text.rlike("[0-9]"), F.transform(F.filter(located(text, CANDIDATES), free), told)).otherwise(empty)


def with_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``__text`` (null: empty), ``__base`` and ``__cand``."""
    first = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    second = first.withColumn("__base", base_spans(F.col("__text")))
    return second.withColumn("__cand", candidates(F.col("__text"), F.col("__base")))


@dataclass
class SpanModel:
    """``reliability``: each labeler's chance to say yes to personal data, and to other candidates."""

    reliability: dict[str, tuple[float, float]]
    weights: dict[str, list[float]]
    bias: float

    def accepts(self, j: Column) -> Column:
        total = F.lit(self.bias)
        for name, ws in self.weights.items():
            total = total + F.get(F.array(*map(F.lit, ws)), j[name])
        return total >= math.log(THRESHOLD / (1 - THRESHOLD))


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[float, list[list[float]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns and their counts: the share of personal data, each labeler's two
    chances of a yes, and each pattern's likelihood of being personal data. No vote says nothing."""
    share, says = 0.5, [[0.9, 0.1] for _ in VOTERS]
    post: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(share / (1 - share))
            for v, (a, b) in zip(p, says, strict=True):
                odds += math.log(a / b) if v == 1 else math.log((1 - a) / (1 - b)) if v == 0 else 0.0
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        n = sum(patterns.values())
        share = (sum(c * post[p] for p, c in patterns.items()) + 1) / (n + 2)
        for i in range(len(VOTERS)):
            for z in (0, 1):  # two pseudo-votes keep the chances off 0 and 1, and a yes the likelier for personal data
                seen = [(c * (post[p] if z == 0 else 1 - post[p]), p[i]) for p, c in patterns.items() if p[i] != 2]
                yes = sum(w for w, v in seen if v == 1)
                says[i][z] = (yes + (1.8 if z == 0 else 0.2)) / (sum(w for w, _ in seen) + 2)
    return share, says, post


def soft_logistic(rows: list[tuple[tuple[int, ...], float, float]], steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[dict[str, list[float]], float]:
    """Logistic weights of one-hot features from (features, weight, likelihood) rows, by gradient descent."""
    weights = {name: [0.0] * n for name, n in FEATURES.items()}
    bias, total = 0.0, sum(w for _, w, _ in rows) or 1.0
    for _ in range(steps):
        grad = {name: [ridge * x for x in ws] for name, ws in weights.items()}
        grad_bias = 0.0
        for f, w, target in rows:
            z = bias + sum(weights[name][x] for name, x in zip(FEATURES, f, strict=True))
            err = w / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - target)
            grad_bias += err
            for name, x in zip(FEATURES, f, strict=True):
                grad[name][x] += err
        bias -= rate * grad_bias
        for name, g in grad.items():
            weights[name] = [w - rate * x for w, x in zip(weights[name], g, strict=True)]
    return weights, bias


def train(docs: DataFrame) -> SpanModel:
    """The span model of a corpus. What reaches the driver is one row for each combination of votes and
    features: at most 3**4 * 3840 however large the corpus."""
    names = [*VOTERS, *FEATURES]
    told = with_candidates(docs.select("text")).select(F.explode("__cand").alias("c")).select("c.j.*")
    rows = [tuple(r) for r in told.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns: dict[tuple[int, ...], int] = {}
    for r in rows:
        patterns[r[: len(VOTERS)]] = patterns.get(r[: len(VOTERS)], 0) + r[-1]
    _, says, post = reliabilities(patterns)
    merged: dict[tuple[int, ...], list[float]] = {}
    for r in sorted(rows):
        m = merged.setdefault(r[len(VOTERS) : -1], [0.0, 0.0])
        m[0] += r[-1]
        m[1] += r[-1] * post[r[: len(VOTERS)]]
    weights, bias = soft_logistic([(f, n, p / n) for f, (n, p) in sorted(merged.items())])
    if not rows:
        bias = -1.0  # nothing learned, nothing added
    return SpanModel({v: tuple(s) for v, s in zip(VOTERS, says, strict=True)}, weights, bias)


def find_spans(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` plus ``__text``, ``__base`` and ``__spans``: arrays of (s, k, e) by start and kind, ``k`` counting ``KINDS``.

    Null texts are empty and have no spans. Rows are looked at one by one, so repeated rows and ids each keep theirs;
    an empty table gives an empty table.
    """
    model = model or train(docs)
    told = with_candidates(docs)
    more = F.transform(F.filter("__cand", lambda c: model.accepts(c["j"])), lambda c: F.struct(c["s"].alias("s"), F.lit(4).alias("k"), c["e"].alias("e")))
    return told.withColumn("__spans", F.array_sort(F.concat("__base", more))).drop("__cand")


def mask(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; spans that overlap become one, named by the first.
    ``n_chars``, if there is such a column, counts the new text. Rows without spans stay as they are."""
    row = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    found = find_spans(row, model)
    start = F.struct(F.lit(0).alias("e"), F.array().cast(SPAN).alias("all"))

    def merged(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["e"]
        last = F.element_at(acc["all"], -1)
        grown = F.concat(F.slice(acc["all"], 1, F.size(acc["all"]) - 1), F.array(F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.struct(F.greatest(acc["e"], x["e"]).alias("e"), F.when(inside, grown).otherwise(F.concat(acc["all"], F.array(x))).alias("all"))

    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def rebuilt(spans: Column) -> Column:
        parts = F.transform(spans, lambda x, i: let(F.when(i > 0, F.get(spans, i - 1)["e"]).otherwise(F.lit(0)), lambda at: F.concat(F.substring(F.col("__text"), at + 1, x["s"] - at), F.get(names, x["k"]))))
        return F.concat(F.array_join(parts, ""), F.substring(F.col("__text"), F.element_at(spans, -1)["e"] + 1, F.length("__text")))

    text = F.when(F.size("__spans") > 0, let(F.aggregate("__spans", start, merged)["all"], rebuilt)).otherwise(F.col("text"))
    out = found.withColumn("__new", text)
    changed = F.size("__spans") > 0

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__new").alias(c)
        old = F.col("__row").getField(c)
        counted = F.when(changed, F.length("__new").cast(docs.schema[c].dataType)).otherwise(old)
        return (counted if c == "n_chars" else old).alias(c)

    return out.select(*[column(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    found = find_spans(docs)
    names = F.array(*map(F.lit, KINDS))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("__base", lambda x: x["k"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(listed("__base"), 256).alias("base_sha256"), listed("__spans").alias("spans"))
