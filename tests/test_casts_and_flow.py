"""Applied casts with their rejects, stored bytes, and the flow's clean, quarantine, validation and load."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from qualis.catalog import load
from qualis.operators import rules as R
from qualis.operators.profile import Profiler, dataset_totals, stored_files
from qualis.plans.flow import run_entities
from qualis.policy import Policy
from qualis.sources import readers as RD
from qualis.sources import sinks as SK


@pytest.mark.parametrize("target, values, typed", [
    ("integer", ["12", " -3 ", "1.0", "99999999999999999999", "x", None], [12, -3, None, 99999999999999999999, None, None]),
    ("decimal", ["1.5", "abc", None], [1.5, None, None]),
    ("boolean", ["Yes", "f", "0", "maybe", None], [True, False, False, None, None]),
    ("date", ["2024-02-29", "2023-02-29", "2024/01/01", None], [dt.date(2024, 2, 29), None, None, None]),
    ("datetime", ["2024-01-01 10:00:00", "13/45/2020", None], [dt.datetime(2024, 1, 1, 10), None, None]),
])
def test_bad_values_become_null_flagged_and_kept(spark, target, values, typed):
    df = spark.createDataFrame(list(enumerate(values)), "k int, `a.b` string").withColumn("_dq_flags", F.array(F.lit("old")))
    cast = R.apply_casts(df, {"a.b": target})
    rows = cast.orderBy("k").collect()
    assert [None if r["a.b"] is None else (int(r["a.b"]) if target == "integer" else r["a.b"]) for r in rows] == typed
    bad = [i for i, (v, t) in enumerate(zip(values, typed, strict=True)) if v is not None and t is None]
    assert [i for i, r in enumerate(rows) if r._dq_flags == ["old", "cast_failed:a.b"]] == bad
    rejects = sorted(tuple(r) for r in R.cast_rejects(cast, ["k"]).collect())
    assert rejects == [(i, "a.b", values[i], f"safe_cast_{target}") for i in bad]


def test_no_casts_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x")], "k int, s string")
    assert [tuple(r) for r in R.apply_casts(df, {}).collect()] == [(1, "x", [], [])]
    assert R.cast_rejects(R.apply_casts(df, {}), ["k"]).collect() == []
    assert R.apply_casts(df.limit(0), {"s": "integer"}).collect() == []


def test_targets_come_from_the_profile(spark):
    rows = [(i, "2024-01-01" if i else "soon", str(i), "yes" if i % 2 else "no", f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, d string, n string, b string, t string")
    targets = R.cast_targets(Profiler(df, "t"))
    assert targets == {"d": "date", "n": "integer", "b": "boolean"}
    assert [tuple(r) for r in R.cast_rejects(R.apply_casts(df, targets), ["k"]).collect()] == [(0, "d", "soon", "safe_cast_date")]


def test_bytes_come_from_the_file_index(spark, sf, tmp_path):
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "a b%20c"))
    ents = {"t": spark.read.parquet(str(tmp_path / "a b%20c")), "none": spark.range(3).toDF("id"), "nation": RD.read_table(spark, sf, "nation")}
    got = {r.entity_name: (r.file_count, r.size_bytes) for r in stored_files(spark, ents).collect()}
    parts = [f for f in (tmp_path / "a b%20c").iterdir() if f.name.startswith("part-")]
    assert got == {"t": (len(parts), sum(f.stat().st_size for f in parts)), "none": (0, None), "nation": (1, os.path.getsize(f"{sf}/nation.parquet"))}
    assert {r.entity_name: r.size_bytes for r in dataset_totals(ents).collect()}["t"] == got["t"][1]


@pytest.mark.parametrize("hold_back", [False, True])
def test_flow_publishes_clean_quarantine_and_validation(spark, sf, tmp_path, hold_back):
    src = load(spark, sf, "dirty_customers")
    rule = {"id": "late", "column": "customer_id", "check": "between", "min": 0, "max": 10}
    run = "2024-01-01_00-00-00"
    for _ in range(2):  # a retry leaves the same
        res = run_entities(spark, {"dirty_customers": src}, str(tmp_path), run, Policy(custom_rules=[rule]), load_tables=True, hold_back=hold_back)[0]
    read = lambda name: SK.read_artifact(spark, str(tmp_path), name, run)
    clean, quarantine = read("clean/dirty_customers"), read("quarantine/dirty_customers")
    assert clean.count() + quarantine.count() == src.count() and quarantine.count() > 0
    assert quarantine.where("_quarantine_reason = ''").count() == 0
    assert clean.where(F.array_contains("_dq_flags", "rule:late")).count() == clean.where("customer_id > 10").count() > 0
    checks = {r.test_id: r.passed for r in read("validation").collect()}
    assert len(checks) == 4 and res["failed_checks"] == [k for k, ok in checks.items() if not ok]
    wide = read(f"wide/{res['wide_table']}").count()
    assert wide == (clean.count() if hold_back else src.count())
    summary = read("remediation_summary").first()
    assert summary.original_rows == summary.remediated_rows == src.count()
    if res["loaded"]:
        assert spark.table(res["wide_table"]).count() == wide
        spark.sql(f"DROP TABLE {res['wide_table']}")
