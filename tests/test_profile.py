"""Profiler statistics against pandas / NumPy computed on the same parquet file."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from qualis.operators.profile import Profiler
from qualis.sources import read_table


@pytest.fixture(scope="module")
def events(spark, sf):
    df = read_table(spark, sf, "events")
    return df, pd.read_parquet(f"{sf}/events.parquet")


@pytest.fixture(scope="module")
def prof(events):
    return Profiler(events[0], "events", order_by="event_id")


def test_numeric_stats_match_pandas(prof, events):
    pdf = events[1]
    r = {x["column_name"]: x for x in prof.numeric().collect()}["value"]
    s = pdf["value"].dropna()
    assert r["min"] == pytest.approx(s.min()) and r["max"] == pytest.approx(s.max())
    assert r["mean"] == pytest.approx(s.mean())
    assert r["stddev"] == pytest.approx(s.std())  # sample stddev
    for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert r[name] == pytest.approx(s.quantile(q)), name  # linear interpolation


def test_histogram_matches_numpy(prof, events):
    s = events[1]["value"].dropna().to_numpy()
    counts, edges = np.histogram(s, bins=10)
    rows = sorted((x["bin"], x["bin_start"], x["bin_end"], x["count"])
                  for x in prof.histogram().collect() if x["column_name"] == "value")
    assert [r[3] for r in rows] == counts.tolist()
    assert [r[1] for r in rows] == pytest.approx(edges[:-1].tolist())
    assert sum(r[3] for r in rows) == len(s)  # invariant: every non-null value lands in one bin


def test_histogram_of_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "v double")
    rows = sorted((x["bin"], x["bin_start"], x["count"]) for x in Profiler(df, "c").histogram().collect())
    counts, edges = np.histogram(np.array([5.0, 5.0, 5.0]), bins=10)
    assert [r[2] for r in rows] == counts.tolist()
    assert [r[1] for r in rows] == pytest.approx(edges[:-1].tolist())


def test_outliers_match_iqr_rule(prof, events):
    s = events[1]["value"].dropna()
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    r = {x["column_name"]: x for x in prof.outliers().collect()}["value"]
    assert r["outlier_count"] == int(((s < lo) | (s > hi)).sum())


def test_granularity_and_gaps_match_pandas(prof, events):
    ts = events[1]["ts"].dropna().sort_values()
    gaps = ts.diff().dropna()
    r = {x["column_name"]: x for x in prof.datetime().collect()}["ts"]
    assert r["gap_count"] == len(gaps)
    assert r["median_gap_seconds"] == pytest.approx(gaps.median().total_seconds(), abs=1e-6)
    assert r["min_ts"] == ts.min().to_pydatetime() and r["max_ts"] == ts.max().to_pydatetime()


@pytest.mark.parametrize("seconds,label", [(1, "second"), (120, "minute"), (7200, "hour"), (2 * 86400, "day"),
                                           (10 * 86400, "week"), (40 * 86400, "month"), (100 * 86400, "quarter"),
                                           (400 * 86400, "year")])
def test_granularity_bands(spark, seconds, label):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(seconds=seconds * i),) for i in range(4)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    assert Profiler(df, "t").datetime().first()["granularity"] == label


def test_monotonic_in_explicit_order(prof, events):
    pdf = events[1].sort_values("event_id")
    r = {x["column_name"]: x for x in prof.monotonic().collect()}["ts"]
    assert r["increasing"] == bool(pdf["ts"].is_monotonic_increasing)
    assert r["decreasing"] == bool(pdf["ts"].is_monotonic_decreasing)


def test_distinct_top_values_and_cardinality(spark, sf):
    df = read_table(spark, sf, "orders")
    pdf = pd.read_parquet(f"{sf}/orders.parquet")
    p = Profiler(df, "orders")
    d = {x["column_name"]: x for x in p.distinctness().collect()}
    for c in pdf.columns:
        assert d[c]["distinct_count"] == pdf[c].nunique(), c
    assert d["o_orderkey"]["cardinality_category"] == "unique" and d["o_orderkey"]["pk_candidate"]
    top = [(x["value"], x["count"]) for x in p.top_values().orderBy("rank").collect()
           if x["column_name"] == "o_orderstatus"]
    vc = pdf["o_orderstatus"].value_counts()
    assert top == sorted(((k, int(v)) for k, v in vc.items()), key=lambda t: (-t[1], t[0]))[:10]


@pytest.mark.parametrize("distinct,rows,expected", [(10, 10, "unique"), (1, 10, "constant"), (96, 100, "high"),
                                                    (50, 100, "medium"), (5, 100, "low")])
def test_cardinality_bands(spark, distinct, rows, expected):
    df = spark.createDataFrame([(i % distinct,) for i in range(rows)], "k bigint")
    assert Profiler(df, "t").distinctness().first()["cardinality_category"] == expected


def test_duplicate_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, "b")], "k int, v string")
    r = Profiler(df, "t").duplicates().first()
    assert (r["row_count"], r["duplicate_row_count"], r["empty_row_count"]) == (5, 2, 2)


def test_nan_is_missing(spark):
    from qualis.sources import fold_nan
    df = fold_nan(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double"))
    r = Profiler(df, "t").completeness().first()
    assert r["null_count"] == 2


def test_case_and_patterns(spark):
    rows = [(f"user{i}@example.com", "ACTIVE" if i % 2 else "CLOSED") for i in range(20)]
    df = spark.createDataFrame(rows, "email string, status string")
    s = {x["column_name"]: x for x in Profiler(df, "t").strings().collect()}
    assert s["email"]["case_consistency"] == "lowercase"
    assert s["status"]["case_consistency"] == "uppercase"
    pats = {x["column_name"]: x for x in Profiler(df, "t").patterns().collect()}
    assert pats["email"]["is_email"] and pats["email"]["email_rate"] == 1.0 and not pats["status"]["is_email"]


def test_pii_by_name_and_content(spark):
    df = spark.createDataFrame([("Ann Lee", "a@b.com", "10.0.0.1")] * 5, "full_name string, contact string, ip string")
    r = {x["column_name"]: x for x in Profiler(df, "t").pii().collect()}
    assert r["full_name"]["contains_pii"] and r["contact"]["contains_pii"] and r["ip"]["contains_pii"]
    assert r["contact"]["email_values"] == 5 and r["ip"]["ip_values"] == 5


def test_policy_roles(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x", 1.5, "open", "US")],
                               "order_id bigint, email string, created_date string, amount double, status string, "
                               "o_orderdate string")
    roles = {x["column_name"]: x["role"] for x in Profiler(df, "t").roles().collect()}
    assert roles == {"order_id": "identifier", "email": "identifier", "created_date": "timestamp",
                     "amount": "measure", "status": "status", "o_orderdate": "dimension"}


@pytest.mark.parametrize("bins, exact", [(3, 1), (50, 10), (4096, 4096)])
def test_selection_agrees_with_pandas_in_few_or_many_passes(spark, sf, events, monkeypatch, bins, exact):
    from qualis.operators import orderstats as OS
    monkeypatch.setattr(OS, "BINS", bins)
    monkeypatch.setattr(OS, "EXACT", exact)
    df = read_table(spark, sf, "lineitem")
    pdf = pd.read_parquet(f"{sf}/lineitem.parquet")
    p = Profiler(df, "lineitem")
    got = {r["column_name"]: r for r in p.quantiles().collect()}
    for c in ("l_extendedprice", "l_quantity", "l_orderkey"):
        s = pdf[c].astype(float)
        assert got[c]["q1"] == pytest.approx(s.quantile(0.25)), c
        assert got[c]["median"] == pytest.approx(s.quantile(0.5)), c
        assert got[c]["q3"] == pytest.approx(s.quantile(0.75)), c
    ts = events[1]["ts"].sort_values().diff().dropna()
    r = Profiler(events[0], "events").datetime().where("column_name = 'ts'").first()
    assert r["median_gap_seconds"] == pytest.approx(ts.median().total_seconds(), abs=1e-6)
    assert r["gap_count"] == len(ts)


def test_long_text_distinct_and_duplicates(spark, sf):
    df = read_table(spark, sf, "documents")
    pdf = pd.read_parquet(f"{sf}/documents.parquet")
    p = Profiler(df, "documents")
    d = {r["column_name"]: r["distinct_count"] for r in p.distinct_counts.collect()}
    assert d["text"] == pdf["text"].nunique()
    r = p.duplicates().first()
    assert r["duplicate_row_count"] == int(pdf.duplicated().sum())


def test_gaps_do_not_depend_on_session_time_zone(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 3, 10, 1, 30),), (dt.datetime(2024, 3, 10, 3, 30),), (dt.datetime(2024, 3, 10, 5, 30),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = Profiler(df, "t").datetime().first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["median_gap_seconds"] == 7200.0  # wall-clock gaps, as pandas gives for naive datetimes
