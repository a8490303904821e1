"""Published artifacts and loaded tables: retries, empty results, failures, awkward source columns."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from qualis.catalog import load
from qualis.operators import rules
from qualis.plans import wide as W
from qualis.sources import sinks as SK


def table(spark, n, **more):
    return spark.range(n).select("id", *[F.lit(v).alias(k) for k, v in more.items()])


def test_a_retry_with_fewer_rows_or_none_leaves_nothing_stale(spark, tmp_path):
    base = str(tmp_path)
    for n in (5, 2, 0):
        SK.save_remediated(table(spark, n, month="2024-01").withColumn("month", F.concat("month", F.col("id"))), base, "r1", "t")
        assert SK.read_artifact(spark, base, "remediated/t", "r1").count() == n
    for n in (7, 1):
        SK.write_artifact(table(spark, n).withColumn("month", F.col("id").cast("string")), base, "p", "r1", partition_by=["month"])
        assert SK.read_artifact(spark, base, "p", "r1").count() == n
    SK.save_profile(table(spark, 0, entity_name="t"), base, "r1", entity="t")
    empty = SK.read_artifact(spark, base, "profile", "r1")
    assert empty.columns == ["id", "entity_name", "run_id"] and empty.count() == 0
    assert SK.read_artifact(spark, base, "p", "another run").count() == 0


def test_source_columns_keep_their_values(spark, tmp_path):
    rows = [("007", "2024-01-01", f"n{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "entity_name string, event_month string, `a.b` string").withColumn("entity_name", F.concat(F.col("entity_name"), F.substring("`a.b`", 2, 2)))
    SK.save_original(df, str(tmp_path), "r1", "t")
    back = SK.read_artifact(spark, str(tmp_path), "original/t", "r1").drop("run_id")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
    SK.write_artifact(df, str(tmp_path), "parts", "r1", partition_by=["entity_name"], source=True)
    assert SK.read_artifact(spark, str(tmp_path), "parts").select(*[F.col(f"`{c}`") for c in df.columns]).schema == df.schema


def test_runs_and_entities_side_by_side(spark, tmp_path):
    for run, entity, n in (("r1", "t", 3), ("r1", "u", 4), ("r2", "t", 5), ("r1", "t", 2)):
        SK.save_issues(table(spark, n, entity_name=entity), str(tmp_path), run, entity=entity)
    counts = lambda **k: SK.read_artifact(spark, str(tmp_path), "issues", **k).count()
    assert counts() == 11 and counts(run_id="r1") == 6 and counts(run_id="r1", entity="u") == 4 and counts(entity="t") == 7


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    SK.write_artifact(table(spark, 3), str(tmp_path), "x", "r1")
    with pytest.raises(Exception):
        SK.write_artifact(table(spark, 3).select(F.raise_error(F.lit("lost")).alias("id")), str(tmp_path), "x", "r1")
    assert SK.read_artifact(spark, str(tmp_path), "x", "r1").count() == 3


@pytest.fixture()
def orders(spark, sf):
    df = load(spark, sf, "dirty_orders")
    return df, W.build_plan(df, "dirty_orders"), f"t_{uuid.uuid4().hex[:10]}"


@pytest.mark.parametrize("buckets", [0, 4])
def test_loading_twice_leaves_one_copy_and_a_failure_the_old_table(spark, orders, buckets):
    df, plan, name = orders
    for _ in range(2):
        W.load(spark, df, plan, name, buckets)
        assert spark.table(name).count() == df.count()
    axis = plan.grain.time_axis
    with pytest.raises(Exception):
        W.load(spark, df.withColumn(axis, F.when(F.col(axis).isNotNull(), F.raise_error(F.lit("lost")).cast("timestamp_ntz"))), plan, name, buckets)
    assert spark.table(name).count() == df.count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(name + "__")]
    W.load(spark, df.limit(3), plan, name, buckets)
    assert spark.table(name).count() == 3
    shown = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    assert ("CLUSTERED BY" in shown) == bool(buckets) and "PARTITIONED BY (event_month)" in shown
    spark.sql(f"DROP TABLE {name}")


def test_tables_loaded_alike_rejoin_without_an_exchange(spark, orders):
    df, name = orders[0].where("order_id is not null and customer_id is not null and order_date is not null"), orders[2]
    plan = W.build_plan(df, "dirty_orders")
    plan.sparse = [c for c in plan.columns if c.name not in plan.key_names().values()][:1]
    W.load(spark, df, plan, name, buckets=4)
    W.load_sidecar(spark, df, plan, "sparse", name + "_sparse", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = spark.table(name + "_sparse")
        side = side.select(*plan.key_names().values(), *[F.col(c.name).alias("side_" + c.name) for c in plan.sparse])
        joined = W.rejoin(spark.table(name), side, plan, check_unique=False)
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "Join" in text and "Exchange" not in text
        assert joined.count() == df.count()
        plain = W.rejoin(W.materialise(df, plan), W.sidecar(df, plan, "sparse").select(*plan.key_names().values(), *[F.col(c.name).alias("side_" + c.name) for c in plan.sparse]), plan, False)
        assert sorted(map(repr, joined.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE {name}")
        spark.sql(f"DROP TABLE {name}_sparse")


def test_values_a_type_cannot_hold_are_null_and_counted(spark, sf):
    df = load(spark, sf, "dirty_orders")
    plan = W.build_plan(df, "dirty_orders")
    big = df.withColumn("amount", F.when(F.col("order_id") % 5 == 0, F.lit(1e35)).otherwise(F.col("amount")))
    wide = W.materialise(big, plan)
    n = big.where("amount = 1e35").count()
    col = next(c.name for c in plan.columns if c.source == "amount")
    assert n and wide.where(F.col(col).isNull()).count() == n + big.where("amount is null").count()
    assert {r.source_column: r.failed_count for r in W.cast_failures(big, plan).collect()}["amount"] == n


def test_sums_of_duplicates_past_64_bits(spark):
    df = spark.createDataFrame([(1, 2**62, "b"), (1, 2**62, "a"), (1, 2**62, "c")], "k int, v bigint, d string")
    row = rules.aggregate_duplicates(df, ["k"], ["v"], ["d"]).first()
    assert (row.row_count, int(row.sum_v), row.min_d) == (3, 3 * 2**62, "a")


def test_time_axes_beyond_the_limit_are_reported(spark):
    df = spark.range(5).select("id", *[F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,int(id))").alias(f"t{i}") for i in range(7)])
    with pytest.warns(UserWarning, match="t5, t6"):
        plans = W.plans_per_time_axis(df, "e")
    assert len(plans) == 5 and {p.lineage["time_axes_left_out"] for p in plans} == {"t5,t6"}
    assert len(W.plans_per_time_axis(df, "e", most=None)) == 7
