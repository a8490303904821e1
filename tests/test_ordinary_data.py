"""Ordinary data that used to break: quoted CSV, name clashes, integer axes, retried runs, common near-variants."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from qualis.functions import names as N
from qualis.operators import charts as C
from qualis.operators import remediate as R
from qualis.operators import rules as RU
from qualis.operators.grain import Grain
from qualis.operators.profile import Profiler
from qualis.plans import wide as W
from qualis.policy import Policy
from qualis.sources import sinks as SK
from qualis.sources.readers import read_csv


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "c string")


def test_common_near_variants_survive(spark):
    """Both values are frequent, so neither is a misspelling of the other."""
    p = Profiler(column(spark, ["Category A"] * 85 + ["Category B"] * 15), "t")
    assert RU.canonical_mapping(p).collect() == []


def test_rare_misspelling_among_many_values(spark):
    """More than a hundred distinct values don't switch the rule off."""
    values = ["Category Alpha"] * 900 + ["Category Alpba"] + [f"{i:03d}-{i * 7919 % 997:03d}-other-{i}" for i in range(130)]
    p = Profiler(column(spark, values), "t")
    got = {r.variant: r.canonical for r in RU.canonical_mapping(p).collect()}
    assert got == {"Category Alpba": "Category Alpha"}
    fixed = RU.canonicalize(p.df, p)
    assert fixed.where("c = 'Category Alpha'").count() == 901 and fixed.count() == len(values)


def test_csv_quotes_and_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x ""y"", z",1\n"two\nlines",2\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv")).collect()] == [('x "y", z', "1"), ("two\nlines", "2")]


def test_names_stay_different():
    assert N.unique_names(["Region Name", "region_name", "event_date"], ("event_date",)) == ["region_name", "region_name_2", "event_date_2"]
    a, b = N.wide_table_name("x" * 80 + "a"), N.wide_table_name("x" * 80 + "b")
    assert a != b and len(a) <= 63 and len(b) <= 63


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, 2000 + i % 5, f"r{i}", "x", dt.date(2020, 1, 1 + i % 28)) for i in range(40)]
    return spark.createDataFrame(rows, "customer_id int, fiscal_year int, `Region Name` string, region_name string, event_date date")


def grain(keys, axis):
    return Grain("t", keys, axis, [], 40, 0, 1.0)


def test_integer_axis_gives_no_calendar_columns(spark, clashing):
    plan = W.build_plan(clashing, "t", grain=grain(["customer_id", "fiscal_year"], "fiscal_year"))
    assert plan.derived == [] and W.materialise(clashing, plan).count() == 40


def test_event_columns_and_snake_case_clashes(spark, clashing):
    plan = W.build_plan(clashing, "t", grain=grain(["customer_id", "event_date"], "event_date"))
    wide = W.materialise(clashing, plan)
    assert len(set(c.lower() for c in wide.columns)) == len(wide.columns)
    assert {r.test_id: r.passed for r in W.validate(plan, wide).collect()} == {f"WTT-V{i}": True for i in range(1, 5)}


def test_one_null_in_many_rows_is_nullable(spark):
    df = spark.range(40_000).select(F.col("id").alias("customer_id"), F.when(F.col("id") != 7, F.col("id").cast("double")).alias("amount"))
    plan = W.build_plan(df, "t", grain=Grain("t", ["customer_id"], None, [], 40_000, 0, 1.0))
    assert {c.name: c.nullable for c in plan.columns}["amount"]


def test_validation_sees_what_was_written(spark, clashing):
    plan = W.build_plan(clashing, "t", grain=grain(["customer_id"], None))
    wide = W.materialise(clashing, plan)
    twice = wide.unionByName(wide)
    assert not {r.test_id: r.passed for r in W.validate(plan, twice).collect()}["WTT-V2"]
    assert not {r.test_id: r.passed for r in W.validate(plan, wide.withColumn("stray", F.lit(1))).collect()}["WTT-V3"]
    holes = wide.withColumn("customer_id", F.when(F.col("customer_id") > 3, F.col("customer_id")))
    assert not {r.test_id: r.passed for r in W.validate(plan, holes).collect()}["WTT-V3"]


def test_a_retried_run_replaces_its_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, entity_name string").withColumn("entity_name", F.lit("t"))
    other = df.withColumn("entity_name", F.lit("u"))
    for frame in (df, other, df):
        SK.write_artifact(frame, str(tmp_path), "x", "run1")
    SK.write_artifact(df, str(tmp_path), "x", "run2")
    back = SK.read_artifact(spark, str(tmp_path), "x", fmt="parquet")
    assert {(r.run_id, r.entity_name): r["count"] for r in back.groupBy("run_id", "entity_name").count().collect()} == {("run1", "t"): 3, ("run1", "u"): 3, ("run2", "t"): 3}
    with pytest.raises(ValueError):
        SK.save_original(df.withColumn("run_id", F.lit("mine")), str(tmp_path), "run3", "t")


def test_bar_sums_beyond_64_bits(spark):
    df = spark.createDataFrame([("a", 2**62)] * 4, "k string, v bigint")
    assert int(C.bar(df, "k", "v").first().value) == 2**64


def test_monotonic_does_not_depend_on_row_order(spark):
    rows = [(1, 1, dt.datetime(2020, 1, 2)), (1, 2, dt.datetime(2020, 1, 1)), (2, 1, dt.datetime(2020, 1, 3))]
    for order in (rows, rows[::-1], [rows[1], rows[2], rows[0]]):
        df = spark.createDataFrame(order, "o int, line int, ts timestamp").repartition(1)
        p = Profiler(df, "t")
        assert not p.monotonic("o", ["line"]).first().increasing
        assert p.monotonic("o").first().increasing


ISSUE = {"column_name": "c", "issue_type": "null_tokens_detected", "owner": "programmatic", "action": "convert_to_proper_null", "count": 1}


def test_monitor_only_changes_nothing(spark):
    df = column(spark, ["N/A", "a@b.com", " x "])
    plan = R.compile_fixes(df, [ISSUE], Policy(enforcement_mode="monitor_only"), {"c": "hash"})
    assert R.apply_fixes(df, plan).collect() == df.collect()


def test_zero_is_null_where_the_role_says_so(spark):
    df = column(spark, ["0", "1"])
    pol = Policy(zero_string_as_null=True)
    role = sorted(pol.zero_string_roles)[0]
    fixed = lambda roles: [r.c for r in R.apply_fixes(df, R.compile_fixes(df, [ISSUE], pol, roles=roles)).collect()]
    assert fixed({"c": role}) == [None, "1"] and fixed({"c": "none"}) == ["0", "1"]
