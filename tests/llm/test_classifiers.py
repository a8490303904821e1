import random
import zlib

import numpy as np
import pytest

from qualis.llm import quality, toxicity
from qualis.llm.labelled import remainder, sample

from . import cases


def crc(d, m):
    return zlib.crc32(("" if d is None else str(d)).encode()) % m


def made(n=240, seed=1):
    """Documents, and labels that follow from their texts: junk is of low quality, insulted ones are toxic."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiostrnl") for _ in range(rng.randint(2, 7)))
    rows, marks = [], []
    for i in range(n):
        ws, kind = [word() for _ in range(rng.randint(20, 60))], i % 4
        if kind == 1:
            ws = [w.upper() + "!!" for w in ws]
        if kind == 2:
            ws[5:5] = ["you", rng.choice(["grunkel", "blortig"])]
        rows.append((i, " ".join(ws) + "."))
        marks.append((i, int(kind != 1), int(kind == 2)))
    return rows, marks


def test_quality_on_held_out_rows(spark):
    rows, marks = made()
    want = {d: q for d, q, _ in marks}
    got = quality.digest(cases.docs(spark, rows), cases.labels(spark, marks)).collect()
    assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_learns_unknown_insults(spark):
    rows, marks = made(400)
    want = {d: t for d, _, t in marks}
    got = toxicity.digest(cases.docs(spark, rows), cases.labels(spark, marks)).collect()
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_awkward_rows(spark, op):
    rows, marks = made(60)
    marks += [(None, 1, 1), (3, None, None), (7, 0, 1), (100, 0, 1), (100, 1, 0), (100_000, 1, 1), (9, 5, 5)]
    got = op.digest(cases.docs(spark), cases.labels(spark, marks)).collect()
    assert cases.bag((r.doc_id,) for r in got) == cases.bag((d,) for d, _ in cases.texts())
    assert all(0 <= r.score <= 1 for r in got)
    assert op.digest(cases.empty(spark), cases.labels(spark, marks)).collect() == []
    for few in ([], [(101, 1, 1)]):  # nothing to learn from, and one class only
        out = op.digest(cases.docs(spark), cases.labels(spark, few)).collect()
        assert len(out) == len(cases.texts()) and all(0 <= r.score <= 1 for r in out)


def test_held_out_labels_teach_nothing(spark):
    rows, marks = made(60)
    flipped = [(d, 1 - q if crc(d, 3) == 1 else q, t) for d, q, t in marks]
    a, b = (quality.train(cases.docs(spark, rows), cases.labels(spark, m)) for m in (marks, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_sample_is_bounded_and_repeatable(spark):
    rows, marks = made(60)
    takes = [cases.bag(sample(cases.docs(spark, rows), cases.labels(spark, marks), "quality", 3, 1, 10).collect()) for _ in range(2)]
    assert takes[0] == takes[1] and len(takes[0]) == 10 and all(crc(r[0], 3) != 1 for r in takes[0])
    df = cases.docs(spark, [(None, "x"), (17, "y")])
    assert {r.doc_id: r.m for r in df.select("doc_id", remainder(df.doc_id, 4).alias("m")).collect()} == {None: crc(None, 4), 17: crc(17, 4)}


def test_sample_is_bounded_with_one_id_on_many_rows(spark):
    rows, marks = made(60)
    many = [(0, f"text {i}") for i in range(50)] + [(0, "again")] * 40 + [(0, None)] * 3 + rows
    got = sample(cases.docs(spark, many), cases.labels(spark, marks), "quality", 3, 1, 10).collect()
    assert len(got) == 10
    every = sample(cases.docs(spark, many), cases.labels(spark, marks), "quality", 3, 1, 1_000).collect()
    taught = [r for r in many if crc(r[0], 3) != 1]
    assert {(r.doc_id, r.text): r.n for r in every} == {r: taught.count(r) for r in taught} and len(every) == len(set(taught))


def test_weighted_fits_are_as_of_repeated_rows():
    x = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]])
    y, times = np.array([1.0, 0.0, 1.0, 0.0]), np.array([3, 1, 2, 4])
    once, each = toxicity.logistic(x, y, times=times), toxicity.logistic(np.repeat(x, times, 0), np.repeat(y, times))
    assert np.allclose(once[0], each[0]) and np.isclose(once[1], each[1])
    rows = [np.array([1, 5]), np.array([2, 6]), np.array([3, 5]), np.array([4, 6])]
    a, b = quality.fit(rows, y, times), quality.fit([r for r, n in zip(rows, times, strict=True) for _ in range(n)], np.repeat(y, times))
    assert np.allclose(a.ratios, b.ratios)
    assert all((a.score(r) >= 0.5) == (b.score(r) >= 0.5) == bool(t) for r, t in zip(rows, y, strict=True))


def test_dual_coordinate_descent_separates():
    rows = [np.array([1, 5]), np.array([2, 5]), np.array([3, 6]), np.array([4, 6])] * 5
    y = np.array([1, 1, 0, 0] * 5)
    m = quality.fit(rows, y)
    assert all((m.score(x) >= 0.5) == bool(t) for x, t in zip(rows, y, strict=True))
    assert m.ratios[5] > 0 > m.ratios[6] and m.ratios[7] == 0


def test_shapes_and_repeats():
    assert quality.shape("Don't!!") == "Aa'a!" and quality.shape("ABC12%%%") == "Ad%" and quality.shape("") == ""
    assert quality.longest_run(np.array([1, 1, 0, 1, 1, 1], bool)) == 3 and quality.longest_run(np.zeros(0, bool)) == 0
    read = quality.Indicators()
    assert len(read("")) == 0 and len(read(None)) == 0
    assert set(read("a b c")) < set(read("a b c d"))
    long = read("w " * 50_000)
    assert len(long) == len(set(long.tolist()))


def grammar():
    g = toxicity.Grammar({"grunkel": 3.0, "blort*": 2.0})
    g.weights[:] = 0
    return g


def test_clause_patterns():
    def patterns(text):
        x = grammar().clauses(text)
        return {int(i): round(float(np.expm1(v))) for i, v in enumerate(x[: toxicity.PATTERNS]) if v}

    target, negated, reported, several, threat = 4, 2, 1, 8, 16
    assert patterns("You are an idiot.") == {target: 1}
    assert patterns("you are not an idiot") == {target + negated: 1}
    assert patterns("no, you idiot!") == {target: 1}  # the negation ends with its clause
    assert patterns("she said you idiot") == {target + reported: 1}
    assert patterns("idiot. idiot") == {0: 2}
    assert patterns("idiot moron") == {several: 1}
    assert patterns("I will kill you") == {threat + target: 1}
    assert patterns("kill the idiot") == {threat + 8: 1}
    assert patterns("a grunkel, or Blorting") == {0: 2}
    assert patterns("") == {} and patterns("nothing here.") == {}


def test_composition_is_closed():
    assert toxicity.TABLE.shape == (len(toxicity.STATES), 1 + len(toxicity.SEEDS))
    assert toxicity.TABLE.max() < len(toxicity.STATES) and len(set(toxicity.STATES)) == len(toxicity.STATES)
