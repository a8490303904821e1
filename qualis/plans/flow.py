"""The whole flow for a set of entities: profile -> issues -> fixes -> wide table.

Every stage writes its result under ``out_dir`` (partitioned by ``run_id``) and
the next stage reads that written artifact back, so lineage is cut at each stage
boundary: a lost executor recomputes only inside the stage it was running, from
files in the shared output folder.  Only bounded metadata (issue rows, plan
columns) passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import issues as I
from ..operators import remediate as R
from ..operators import rules as RU
from ..operators.profile import Profiler
from ..policy import Policy
from ..sources import sinks as SK
from . import wide as W


def _read_back(spark: SparkSession, out_dir: str, name: str, run_id: str, fmt: str = "parquet") -> DataFrame:
    return SK.read_artifact(spark, out_dir, name, run_id, fmt=fmt).drop("run_id")


REASON = "_quarantine_reason"


def _tagged(df: DataFrame, rules: list, policy: Policy) -> DataFrame:
    """Rows with their flags and, where a rule sends them there, the reason for quarantine."""
    reason = RU.quarantine_reason(rules) if policy.quarantine_enabled else F.lit("")
    return RU.apply_flags(df.withColumn(REASON, reason), rules, policy.enforcement_mode, policy.flags_column)


def run_entities(spark: SparkSession, entities: Mapping[str, DataFrame], out_dir: str, run_id: str | None = None,
                 policy: Policy | None = None, load_tables: bool = False, hold_back: bool = False) -> list[dict]:
    """Run every stage for each entity; returns one small summary dict per entity.

    Fixed rows get their quality flags (the policy's custom rules among them) and are published as ``clean`` and
    ``quarantine`` (or the policy's name for it), which add up to the input; a switched-off quarantine stays empty. The
    policy's reports are written beside them. The wide table is checked as written (``validation``); it holds the quarantined
    rows too, flagged there, unless ``hold_back``. ``load_tables`` also loads it as a table if no check fails that
    rejects the plan."""
    run_id = run_id or SK.new_run_id()
    out = []
    for entity, df in entities.items():
        SK.save_original(df, out_dir, run_id, entity)
        src = _read_back(spark, out_dir, f"original/{entity}", run_id).select(*df.columns)

        p = Profiler(src, entity, policy)
        SK.save_profile(p.column_profile(), out_dir, run_id, fmt="parquet", entity=entity)
        SK.save_issues(I.detect_issues(p).withColumn("entity_name", F.lit(entity)), out_dir, run_id, fmt="parquet", entity=entity)
        found = _read_back(spark, out_dir, "issues", run_id).where(F.col("entity_name") == entity)
        issue_rows = I.issue_list(found)  # bounded: columns x issue types

        roles = {r.column_name: r.role for r in p.roles().collect()}  # one row a column
        fixes = R.compile_fixes(src, issue_rows, p.policy, roles=roles)
        rows, seen = R.measured(src, fixes)
        SK.save_remediated(rows, out_dir, run_id, entity)
        log = R.measured_log(spark, fixes, seen, entity, run_id)
        SK.write_artifact(log.select(*p.policy.log_fields) if p.policy.log_fields else log, out_dir, "remediation_log", run_id, entity=entity)
        fixed = _read_back(spark, out_dir, f"remediated/{entity}", run_id).select(*[F.col(f"`{c}`") for c in fixes.exprs])
        if "remediation_summary" in p.policy.reports:
            summary = R.remediation_summary(src, fixed, log, found, p.policy, seen.get["rows"])
            SK.save_summary(summary, out_dir, run_id, fmt="parquet", entity=entity)
        if "column_quality_ledger" in p.policy.reports:
            SK.write_artifact(RU.column_ledger(p, found), out_dir, "column_quality_ledger", run_id, entity=entity)

        after = Profiler(fixed, entity, p.policy)
        rules = RU.row_rules(after)
        SK.write_artifact(_tagged(fixed, rules, p.policy), out_dir, f"flagged/{entity}", run_id, source=True, entity=entity)
        flagged = _read_back(spark, out_dir, f"flagged/{entity}", run_id)  # read by both sinks, computed once
        clean = flagged.where(F.col(REASON) == "").drop(REASON)
        SK.write_artifact(clean, out_dir, f"clean/{entity}", run_id, source=True, entity=entity)
        held = flagged.where(F.col(REASON) != "")
        SK.write_artifact(held if p.policy.quarantine_reason else held.drop(REASON), out_dir, f"{p.policy.quarantine_target}/{entity}", run_id, source=True, entity=entity)
        after.release()
        if hold_back:
            fixed = _read_back(spark, out_dir, f"clean/{entity}", run_id).drop(p.policy.flags_column)

        plan = W.build_plan(fixed, entity)
        if "ai_readiness_score" in p.policy.reports:
            SK.write_artifact(RU.ai_readiness(p, found, plan.grain.confidence), out_dir, "ai_readiness_score", run_id, entity=entity)
        decided = RU.dataset_decision(p, found, plan.grain.human_review, grain_keys=plan.keys)
        SK.write_artifact(decided, out_dir, "dataset_decision", run_id, entity=entity)
        SK.save_plan(W.plan_frame(spark, plan), out_dir, run_id, fmt="parquet", entity=entity)
        wide = W.materialise(fixed, plan, {"_run_id": run_id, "_source_name": entity})
        SK.write_artifact(wide, out_dir, f"wide/{plan.table_name}", run_id,
                          partition_by=["event_month"] if plan.derived else None, entity=entity)
        for which, cols in (("sparse", plan.sparse), ("text", plan.excluded)):
            if cols:
                SK.write_artifact(W.sidecar(fixed, plan, which), out_dir, f"wide/{plan.table_name}_{which}", run_id, entity=entity)
        written = _read_back(spark, out_dir, f"wide/{plan.table_name}", run_id)
        checks = W.validate(plan, written.drop("_run_id", "_source_name"))
        SK.write_artifact(checks, out_dir, "validation", run_id, entity=entity)
        failed = [r.test_id for r in checks.where("not passed").collect()]  # four rows
        if load_tables and not failed:
            W.load(spark, fixed, plan)
        p.release()
        out.append({"entity": entity, "run_id": run_id, "issues": len(issue_rows),
                    "fix_steps": len(fixes.steps), "wide_table": plan.table_name, "grain_keys": plan.keys,
                    "grain_confidence": plan.grain.confidence, "human_review": plan.grain.human_review, "failed_checks": failed,
                    "loaded": load_tables and not failed})
    return out
