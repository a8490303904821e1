"""Sources, run-partitioned sinks and the wide-table load."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from qualis.catalog import load
from qualis.plans import wide as W
from qualis.sources import readers as RD
from qualis.sources import sinks as SK


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="qualis-io-", dir="/tmp")


def test_detect_format():
    assert RD.detect_format("a.csv") == "csv" and RD.detect_format("a.TXT") == "csv"
    assert RD.detect_format("x.parquet") == "parquet" and RD.detect_format("x.jsonl") == "json"
    with pytest.raises(ValueError):
        RD.detect_format("book.xlsx")
    with pytest.raises(ValueError):
        RD.detect_format("file.bin")


def test_csv_encoding_fallback(spark, scratch):
    utf = os.path.join(scratch, "utf.csv")
    lat = os.path.join(scratch, "lat.csv")
    with open(utf, "w", encoding="utf-8") as f:
        f.write("name,city\nAnn,Zürich\n")
    with open(lat, "wb") as f:
        f.write("name,city\nBo,Zürich\n".encode("latin-1"))
    assert RD.read_csv(spark, utf).first()["city"] == "Zürich"
    assert RD.read_csv(spark, lat).first()["city"] == "Zürich"  # latin-1 decoded, not U+FFFD


def test_entities_and_sample(spark, sf):
    ents = RD.read_entities(spark, [f"{sf}/region.parquet", f"{sf}/nation.parquet"])
    assert set(ents) == {"region", "nation"} and ents["nation"].count() == 25
    a = [r[0] for r in RD.sample_rows(ents["nation"], 5, seed=42).select("n_nationkey").collect()]
    b = [r[0] for r in RD.sample_rows(ents["nation"], 5, seed=42).select("n_nationkey").collect()]
    c = [r[0] for r in RD.sample_rows(ents["nation"], 5, seed=7).select("n_nationkey").collect()]
    assert len(a) == 5 and a == b and a != c


def test_run_partitioned_artifacts(spark, sf, scratch):
    df = RD.read_table(spark, sf, "region")
    run1, run2 = "2024-01-01_00-00-00", "2024-01-02_00-00-00"
    SK.save_profile(df, scratch, run1)
    SK.save_profile(df.limit(2), scratch, run2)
    assert SK.read_artifact(spark, scratch, "profile", run1).count() == 5
    assert SK.read_artifact(spark, scratch, "profile", run2).count() == 2
    assert SK.read_artifact(spark, scratch, "profile").count() == 7
    assert len(SK.new_run_id()) == 19


def test_wide_load_creates_typed_partitioned_table(spark, sf, scratch):
    df = load(spark, sf, "dirty_orders")
    plan = W.build_plan(df, "dirty_orders")
    stmt = W.ddl(plan, "t_wide")
    assert "PARTITIONED BY (event_month)" in stmt and "NOT NULL" in stmt
    name = W.load(spark, df, plan, table=f"wide_{os.path.basename(scratch).replace('-', '_')}")
    t = spark.table(name)
    assert t.count() == df.count()
    assert "event_month" in t.columns
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_plans_per_time_axis(spark, sf):
    df = load(spark, sf, "dirty_customers").withColumn("closed_date", F.col("created_date"))
    plans = W.plans_per_time_axis(df, "dirty_customers")
    assert 1 <= len(plans) <= 5
    axes = {p.grain.time_axis for p in plans}
    assert len(axes) == len(plans)


def test_run_entities_writes_every_stage(spark, sf, scratch):
    from qualis.plans.flow import run_entities
    src = load(spark, sf, "dirty_customers")
    res = run_entities(spark, {"dirty_customers": src}, scratch, run_id="2024-01-01_00-00-00")
    assert res[0]["issues"] > 0 and res[0]["fix_steps"] > 0
    for name in ("original/dirty_customers", "profile", "issues", "remediated/dirty_customers", "remediation_log",
                 "wide_plan", f"wide/{res[0]['wide_table']}"):
        assert os.path.isdir(os.path.join(scratch, name)), name
    fixed = SK.read_artifact(spark, scratch, "remediated/dirty_customers", "2024-01-01_00-00-00", fmt="parquet")
    wide = SK.read_artifact(spark, scratch, f"wide/{res[0]['wide_table']}", "2024-01-01_00-00-00", fmt="parquet")
    assert fixed.count() == src.count() == wide.count()
    assert fixed.where(F.col("email").contains("@")).count() == 0


def test_dataset_totals_bytes(spark, sf):
    from qualis.operators.profile import dataset_totals
    ents = {t: RD.read_table(spark, sf, t) for t in ("region", "nation")}
    rows = {r["entity_name"]: r for r in dataset_totals(ents).collect()}
    assert rows["nation"]["row_count"] == 25 and rows["nation"]["column_count"] == 3
    assert rows["region"]["size_bytes"] == os.path.getsize(f"{sf}/region.parquet")
    assert rows["__all__"]["size_bytes"] == sum(os.path.getsize(f"{sf}/{t}.parquet") for t in ents)
