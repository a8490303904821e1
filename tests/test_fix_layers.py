"""The fix chain: plans that grow with the steps, counts measured by the job that writes."""

from __future__ import annotations

from qualis.catalog import load
from qualis.operators import issues as I
from qualis.operators import remediate as R
from qualis.operators.profile import Profiler
from qualis.policy import Policy

KINDS = [("whitespace_not_trimmed", "trim"), ("null_tokens_detected", "convert"), ("casing_inconsistency", "apply_lowercase"), ("unmasked_pii", "hash")]


def issue_rows(column, n):
    return [{"column_name": column, "issue_type": t, "owner": "programmatic", "action": a, "count": 1} for t, a in KINDS[:n]]


def test_plan_text_grows_with_the_steps(spark):
    df = spark.createDataFrame([(" A@b.c ",), ("n/a",)], "email string")
    size = [len(R.apply_fixes(df, R.compile_fixes(df, issue_rows("email", n)))._jdf.queryExecution().optimizedPlan().toString()) for n in range(5)]
    steps = [b - a for a, b in zip(size, size[1:])]
    assert max(steps) < 3 * (steps[0] + steps[1]) and size[4] < 40_000


def test_measured_while_writing_equals_a_count_of_its_own(spark, sf, tmp_path):
    p = Profiler(load(spark, sf, "dirty_customers").repartition(5), "dirty_customers")
    plan = R.compile_fixes(p.df, I.issue_list(I.detect_issues(p)), p.policy)
    rows, seen = R.measured(p.df, plan)
    rows.write.parquet(str(tmp_path / "fixed"))
    written = spark.read.parquet(str(tmp_path / "fixed"))
    assert seen.get["rows"] == written.count() == p.df.count()
    log = R.measured_log(spark, plan, seen, "t", "r")
    apart = R.remediation_log(p.df, plan, "t", "r")
    assert log.collect() == apart.collect() and log.count() == len(plan.steps)
    assert sorted(map(repr, written.collect())) == sorted(map(repr, R.apply_fixes(p.df, plan).collect()))
    for r in log.collect():
        n = len(r.before_examples.split("|")) if r.changed_count else 0
        assert n <= 4 and (n >= 1) == (r.changed_count > 0)
        assert r.before_type and r.after_type
    lost = R.remediation_summary(p.df, written.limit(3), log, I.detect_issues(p)).first()
    assert lost.original_rows == p.df.count() and lost.remediated_rows == 3


def test_columns_named_like_the_layers(spark):
    df = spark.createDataFrame([(" a ", "x", "y")], "`a.b` string, __fix0_0 string, __fix_ string")
    plan = R.compile_fixes(df, issue_rows("a.b", 1), Policy())
    assert [tuple(r) for r in R.apply_fixes(df, plan).collect()] == [("a", "x", "y")]
