"""Sketches: measured error against exact values, merges of runs, text and empty columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from qualis.operators import sketches as SK


def table(spark, n=40_000):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 3).cast("string").alias("few"), F.xxhash64("id").cast("string").alias("many"), F.randn(5).alias("normal"),
        F.lit(None).cast("double").alias("nothing"), F.when(F.col("id") % 2 == 0, F.col("id") % 1000).alias("a.b"))


def estimates(sketches):
    return {r.column_name: r.distinct_estimate for r in SK.distinct_estimates(sketches).collect()}


def test_error_against_exact(spark):
    df = table(spark)
    pdf = df.toPandas()
    sketches = SK.column_sketches(df, "t", "r1").cache()
    got = estimates(sketches)
    for c in pdf.columns:
        assert abs(got[c] - pdf[c].nunique()) <= 2 + 0.05 * pdf[c].nunique(), c
    for r in SK.quantile_estimates(sketches, [0.1, 0.5, 0.9]).collect():
        rank = (pdf[r.column_name].dropna() <= r.q).mean()
        step = 1 / pdf[r.column_name].dropna().nunique()
        assert abs(rank - r.p) < 0.03 + step, (r.column_name, r.p)
    top = {(r.column_name, r.value): r["count"] for r in SK.top_estimates(sketches, 3).collect()}
    want = pdf["few"].value_counts()
    assert {v: n for (c, v), n in top.items() if c == "few"} == want.to_dict()
    assert not [c for c, _ in top if c == "nothing"]


def test_two_runs_merge_into_one(spark, tmp_path):
    df = table(spark)
    for k, run in enumerate("abc"):  # kept as files between runs
        SK.column_sketches(df.where(F.col("id") % 3 == k), "t", run).write.mode("append").parquet(str(tmp_path / "sketches"))
    kept = spark.read.parquet(str(tmp_path / "sketches"))
    whole = SK.column_sketches(df, "t")
    one, many = estimates(whole), estimates(SK.merged(kept))
    assert set(one) == set(many) and all(abs(one[c] - many[c]) <= 1 + 0.02 * one[c] for c in one)
    q = lambda s: {(r.column_name, r.p): r.q for r in SK.quantile_estimates(s).collect()}
    a, b = q(whole), q(SK.merged(kept))
    values = {c: np.sort(v.dropna()) for c, v in table(spark).toPandas().select_dtypes("number").items()}
    for (c, p), v in b.items():
        assert abs(np.searchsorted(values[c], v) - np.searchsorted(values[c], a[c, p])) < 0.04 * len(values[c])
    rows = {r.column_name: (r.row_count, r.value_count) for r in SK.merged(kept).collect()}
    assert rows["a.b"] == (40_000, 20_000) and rows["nothing"] == (40_000, 0)


def test_empty_table(spark):
    got = SK.merged(SK.column_sketches(table(spark).limit(0), "t"))
    assert estimates(got) == {c: 0 for c in table(spark).columns}
    assert SK.quantile_estimates(got).collect() == [] and SK.top_estimates(got).collect() == []
