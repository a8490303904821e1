"""Selection and ordered scans against pandas: ties, signs, extremes, string orders, many partitions."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from qualis.operators import orderstats as OS

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def columns(n=5000):
    rng = np.random.default_rng(1)
    return pd.DataFrame({
        "normal": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "wide": np.exp(rng.normal(0, 90, n)) * rng.choice([-1, 1], n),
        "constant": np.full(n, 7.25), "zeros": rng.choice([0.0, -0.0, 1.0], n), "some null": np.where(rng.random(n) < 0.6, np.nan, rng.random(n)),
        "whole": rng.integers(-(1 << 62), 1 << 62, n).astype(float), "one hot": np.where(rng.random(n) < 0.34, 5.0, rng.random(n) * 10),
    })


@pytest.mark.parametrize("bins, exact", [(2, 1), (64, 16), (4096, 4096)])
def test_quantiles_equal_pandas(spark, monkeypatch, bins, exact):
    monkeypatch.setattr(OS, "BINS", bins)
    monkeypatch.setattr(OS, "EXACT", exact)
    pdf = columns(1500 if bins == 2 else 5000)
    if bins == 2:
        pdf = pdf[["ties", "zeros", "constant"]]
    df = spark.createDataFrame(pdf).repartition(5)
    got = {(r.column_name, r.p): r.q for r in OS.column_quantiles(df, pdf.columns, PROBS).collect()}
    for c in pdf.columns:
        for p in PROBS:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12), (c, p)


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    df = spark.range(n).selectExpr("cast((id * 7919) % 10000000 as double) / 3 - 1000000 as v", "cast(null as double) as nothing")
    got = {(r.column_name, r.p): r.q for r in OS.column_quantiles(df, ["v", "nothing"], [0.25, 0.5]).collect()}
    want = pd.Series((np.arange(n) * 7919 % n) / 3 - 1000000)
    assert got == {("v", p): pytest.approx(want.quantile(p), rel=1e-12) for p in (0.25, 0.5)}


def test_no_value_is_shuffled(spark, monkeypatch):
    """A pass exchanges counts of bins only."""
    seen = []
    real = OS._pass
    monkeypatch.setattr(OS, "_pass", lambda frame, brackets, read: seen.append(brackets) or real(frame, brackets, read))
    df = spark.range(200_000).selectExpr("rand(3) as v")
    OS.column_quantiles(df, ["v"], [0.5]).collect()
    assert 2 <= len(seen) <= 4 and all(len(b) <= 2 for b in seen)


@pytest.mark.parametrize("parts", [1, 7])
def test_gaps_over_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.choice([rng.randrange(1000), 5, rng.randrange(1 << 50)])) for k in ("a", "b") for _ in range(700)] + [("c", 1), ("d", 4), ("d", 4), ("e", None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "k string, v bigint")
        gaps = OS.consecutive_gaps(df, "k", "v")
        got = {}
        for r in gaps.collect():
            got.setdefault(r.k, []).extend([r.gap] * r.weight)
        med = {r.k: r.q for r in OS.weighted_quantiles(gaps, "k", "gap", "weight", [0.5]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for k in "abd":
        v = np.sort([x for g, x in rows if g == k])
        assert sorted(got[k]) == sorted(np.diff(v).tolist())
        assert med[k] == np.median(np.diff(v))
    assert set(got) == {"a", "b", "d"}


@pytest.mark.parametrize("order", ["name", "n", "day"])
@pytest.mark.parametrize("parts", [1, 6])
def test_monotonic_in_orders_of_any_type(spark, order, parts):
    n = 400
    rows = [(k, f"{i:05d}", i, v) for k, f in (("up", lambda i: i // 3), ("down", lambda i: -i), ("same", lambda i: 4), ("dip", lambda i: i if i != 251 else 3)) for i, v in ((i, f(i)) for i in range(n))]
    random.Random(1).shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "k string, name string, n int, v bigint").selectExpr("*", "date_add(date'2020-01-01', n) as day")
        got = {r.k: (r.increasing, r.decreasing, r.is_monotonic) for r in OS.monotonic_flags(df, "k", "v", order).collect()}
        tied = {r.k: r.increasing for r in OS.monotonic_flags(df.selectExpr("k", "1 as one", "n", "v"), "k", "v", "one", tie="n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {"up": (True, False, True), "down": (False, True, True), "same": (True, True, True), "dip": (False, False, False)}
    assert tied == {"up": True, "down": False, "same": True, "dip": False}
