import hashlib
import random
import re

from pyspark.sql import functions as F

from qualis.llm import pii

from . import cases

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        odd = [int(c) for c in reversed(digits)]
        return 12 <= len(digits) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    names = list(PLAIN)
    found = sorted((m.start(), k, m.end()) for k, kind in enumerate(names) for m in re.finditer(PLAIN[kind], text or "") if good(kind, m.group()))
    return [sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest(), [f"{names[k]}:{s}:{e}" for s, k, e in found]


def rows():
    rng = random.Random(5)
    signs = "0123456789012345..@@+-- ()ab_%é\U0001f600 \n"
    return [*cases.texts(), *((10_000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 80)))) for i in range(600)), (20_000, "+1 2" * 3_000), (20_001, "a@" + "b.c" * 5_000), (20_002, "1.2.3.4 " * 900)]


def test_base_spans_against_plain_patterns(spark):
    got = cases.bag((r.doc_id, [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in pii.digest(cases.docs(spark, rows())).collect())
    assert got == cases.bag((d, *plain(t)[:2]) for d, t in rows())


def test_base_spans_stay_and_secrets_are_added(spark):
    by_text = {r.text: r for r in pii.digest(cases.docs(spark)).join(cases.docs(spark).select("doc_id", "text"), "doc_id").collect()}
    found = 0
    for text, r in by_text.items():
        spans = r.spans.split(",") if r.spans else []
        if len(plain(text)[2]) and sum(t == text for _, t in cases.texts()) == 1 and r.doc_id != 100:
            assert [s for s in spans if not s.startswith("secret")] == plain(text)[2]
        found += sum(s.startswith("secret") for s in spans)
    assert found >= 1
    assert pii.digest(cases.empty(spark)).collect() == []


def test_em_finds_the_better_labeler():
    """Two labelers that agree outweigh one that says yes to everything."""
    patterns = {(1, 2, 1, 1): 40, (0, 2, 0, 0): 50, (1, 2, 0, 0): 30}
    _, says, post = pii.reliabilities(patterns)
    assert post[1, 2, 1, 1] > 0.9 and post[1, 2, 0, 0] < 0.1 and says[2][0] - says[2][1] > says[0][0] - says[0][1]


def test_span_model_learns_soft_labels():
    yes, no = (0, 4, 2, 1, 1, 1, 2, 1), (0, 0, 3, 0, 0, 0, 0, 0)
    weights, bias = pii.soft_logistic([(yes, 30.0, 0.95), (no, 70.0, 0.05)])
    score = lambda f: bias + sum(weights[n][x] for n, x in zip(pii.FEATURES, f, strict=True))
    assert score(yes) > 0 > score(no)


def test_sums_before_long_arrays(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000)), lambda x: x % 7).alias("a"), F.array().cast("array<int>").alias("none"))
    r = df.select("a", pii.sums_before(F.col("a")).alias("s"), pii.sums_before(F.col("none")).alias("n")).first()
    assert r.s == [sum(r.a[:i]) for i in range(1_000)] and r.n == []


def test_masking_keeps_rows_and_columns(spark):
    masked = pii.mask(cases.docs(spark))
    assert masked.columns == cases.COLUMNS
    out = masked.collect()
    assert len(out) == len(cases.texts())
    left = " ".join(r.text or "" for r in out)
    assert "bob.1@" not in left and "<EMAIL>" in left and "<IP>" in left and "10.0.0.256" in left
    assert all(r.text is None or r.n_chars == len(r.text) for r in out)
    same = {t for _, t in cases.texts() if t and not re.search("[0-9@]", t)}
    assert same <= {r.text for r in out}
    assert pii.mask(cases.empty(spark)).collect() == []


def test_plan_is_native(spark):
    plan = pii.digest(cases.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
