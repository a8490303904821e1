"""Invariants of the remediation, quarantine, issue and wide-table stages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from qualis.catalog import load
from qualis.operators import issues as I
from qualis.operators import remediate as R
from qualis.operators import rules as RL
from qualis.operators.profile import Profiler
from qualis.plans import wide as W


@pytest.fixture(scope="module")
def dirty(spark, sf):
    return load(spark, sf, "dirty_customers")


@pytest.fixture(scope="module")
def prof(dirty):
    return Profiler(dirty, "dirty_customers")


@pytest.fixture(scope="module")
def found(prof):
    return I.detect_issues(prof)


@pytest.fixture(scope="module")
def plan(dirty, prof, found):
    return R.compile_fixes(dirty, I.issue_list(found), prof.policy)


def test_remediation_keeps_every_row(dirty, plan):
    fixed = R.apply_fixes(dirty, plan)
    assert fixed.count() == dirty.count()


def test_fixes_compile_to_one_projection(dirty, plan):
    """The whole fix chain is a single Project over the scan: no shuffle, no Python."""
    fixed = R.apply_fixes(dirty, plan)
    text = fixed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "EvalPython" not in text


def test_trim_and_null_tokens_are_idempotent(dirty, prof, found):
    only = {"trim_whitespace", "convert_null_tokens"}
    once = R.apply_fixes(dirty, R.compile_fixes(dirty, I.issue_list(found), prof.policy, only=only))
    twice = R.apply_fixes(once, R.compile_fixes(once, I.issue_list(found), prof.policy, only=only))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_no_null_tokens_left(dirty, plan, prof):
    from qualis.functions import text as X
    fixed = R.apply_fixes(dirty, plan)
    assert fixed.where(X.null_token("segment", prof.policy, include_nulls=False)).count() == 0
    assert fixed.where(F.col("email").contains("@")).count() == 0  # every address hashed


def test_issue_rollups_agree(found):
    n = found.count()
    r = I.issues_summary(found).first()
    assert r["total_issues"] == n
    assert r["errors"] + r["warnings"] + r["infos"] == n
    assert r["programmatic"] + r["human"] == n
    by_type = I.issues_by_type(found).agg(F.sum("column_count")).first()[0]
    assert by_type == n


def test_clean_plus_quarantine_is_input(dirty, prof):
    rules = RL.row_rules(prof, outliers=False)
    clean, quar = RL.split_quarantine(dirty, rules)
    assert clean.count() + quar.count() == dirty.count()
    assert quar.where(F.col("_quarantine_reason").isNull() | (F.col("_quarantine_reason") == "")).count() == 0


@pytest.mark.parametrize("table", ["dirty_customers", "documents"])
def test_sidecar_rejoin_restores_source_columns(spark, sf, table):
    df = load(spark, sf, table)
    p = Profiler(df, table)
    plan = W.build_plan(df, table, p)
    wide = W.materialise(df, plan)
    sides = [(w, c) for w, c in (("sparse", plan.sparse), ("text", plan.excluded)) if c]
    assert sides  # dirty_customers.sparse_score is sparse; documents.text is free text
    for which, cols in sides:
        back = W.rejoin(wide, W.sidecar(df, plan, which), plan)
        assert back.count() == df.count()
        for c in cols:
            # the re-attached column equals the source value on every row
            k = [F.col(x).cast("string") for x in plan.keys]
            as_val = "double" if which == "sparse" else "string"  # sparse columns carry their plan type
            orig = df.select(F.concat_ws("|", *k).alias("k"), F.col(c.source).cast(as_val).alias("v"))
            k2 = [F.col(W.N.snake_case(x)).cast("string") for x in plan.keys]
            got = back.select(F.concat_ws("|", *k2).alias("k"), F.col(c.name).cast(as_val).alias("v"))
            assert orig.exceptAll(got).count() == 0
    assert all(r["passed"] for r in W.validate(plan, wide).collect())
