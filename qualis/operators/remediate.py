"""Row-level fixes compiled into layers of one projection each (P1-P12), plus the remediation log.

The issue list (bounded: columns x issue types) is read on the driver and turned
into steps per column, in the fixed order
trim -> text cleanup (where the policy asks for it) -> null tokens -> fill -> type -> PII -> casing -> global e-mail mask.
A step reads the column that the step before it made, so a plan grows with the number of steps and no
expression is repeated in those that follow; no layer needs a shuffle. The log counts, for each step, how many
values it changed: either in one aggregation (:func:`remediation_log`), or as metrics of the very job that
writes the fixed rows (:func:`measured` and :func:`measured_log`), without another scan.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from ..policy import Policy
from .rules import clean_text

STEP_ORDER = ["trim_whitespace", "clean_text", "convert_null_tokens", "fill_missing", "cast_to_numeric", "convert_to_datetime",
              "mask_pii", "casing", "global_email_mask"]


@dataclass
class Step:
    column: str
    action: str
    issue_type: str
    owner: str
    before: Column
    after: Column
    affected: int | None = None
    cast: bool = False
    before_type: str = ""
    after_type: str = ""


@dataclass
class FixPlan:
    """``exprs`` has each output column over the columns that ``layers`` make, one after the other."""

    exprs: dict[str, Column]
    dropped: list[str]
    steps: list[Step] = field(default_factory=list)
    layers: list[list[Column]] = field(default_factory=list)
    examples: int = 4


def compile_fixes(df: DataFrame, issues: list[dict], policy: Policy | None = None,
                  pii_methods: dict[str, str] | None = None, only: set[str] | None = None,
                  global_mask: bool = True, roles: dict[str, str] | None = None) -> FixPlan:
    """Compile issue rows into per-column expressions.

    ``pii_methods`` adds masking for detected personal data beyond e-mail columns
    (column -> hash | tokenize | drop).  ``roles`` (column -> role) says where '0' may be a null token.
    In monitor_only mode nothing is changed.  ``only`` restricts to a set of step names.
    """
    pol = policy or Policy()
    if pol.enforcement_mode == "monitor_only":
        only, pii_methods = set(), None
    want = (lambda s: True) if only is None else (lambda s: s in only)
    by_col: dict[str, dict[str, dict]] = {}
    for i in issues:
        if i.get("owner") == "programmatic" and pol.enforcement_mode != "monitor_only":
            by_col.setdefault(i["column_name"], {})[i["issue_type"]] = i
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs: dict[str, Column] = {}
    steps: list[Step] = []
    dropped: list[str] = []
    layers: list[list[Column]] = []
    made = "__fix"
    while any(c.startswith(made) for c in df.columns):
        made += "_"
    for at, name in enumerate(df.columns):
        x, depth = F.col(f"`{name}`"), 0
        dt = types[name]
        mine = by_col.get(name, {})
        string, method = N.is_string(dt), None

        def step(action, itype, new, affected=None, owner="programmatic", cast=False):
            nonlocal x, string, depth
            alias = f"{made}{at}_{depth}"
            if depth == len(layers):
                layers.append([])
            layers[depth].append(new.alias(alias))
            depth += 1
            steps.append(Step(name, action, itype, owner, x, F.col(alias), affected, cast, dt.simpleString() if len(steps) == 0 or steps[-1].column != name else steps[-1].after_type, ""))
            x = F.col(alias)
            if cast:
                string = False
            steps[-1].after_type = ("timestamp_ntz" if "datetime" in action else "double") if cast else "string" if method else steps[-1].before_type

        if want("trim_whitespace") and string and "whitespace_not_trimmed" in mine:
            step("trim_whitespace", "whitespace_not_trimmed", X.py_strip(x), mine["whitespace_not_trimmed"]["count"])
        if want("clean_text") and string and (pol.collapse_internal_whitespace or pol.normalize_unicode):
            step("clean_text", "string_cleanup", clean_text(x, pol.normalize_unicode, pol.collapse_internal_whitespace))
        if want("convert_null_tokens") and string and "null_tokens_detected" in mine:
            zero = pol.zero_string_as_null and (roles or {}).get(name) in pol.zero_string_roles
            pred = X.null_token(x, pol, include_nulls=False, zero_is_null=zero)
            step("convert_null_tokens", "null_tokens_detected", F.when(pred, F.lit(None).cast("string")).otherwise(x),
                 mine["null_tokens_detected"]["count"])
        if want("fill_missing"):
            for rule in pol.fill_rules:
                if re.search(rule["column_name_regex"], name) and string:
                    step(rule.get("action", "fill_missing"), "missing_value", F.coalesce(x, F.lit(rule["value"])))
        if want("cast_to_numeric") and "type_coercion_available" in mine:
            step("cast_to_numeric", "type_coercion_available", X.to_number(x) if string else x.cast("double"),
                 mine["type_coercion_available"]["count"], cast=True)
        if want("convert_to_datetime") and "timestamp_wrong_type" in mine:
            conv = X.serial_to_timestamp(x) if N.is_numeric(dt) else X.to_timestamp_safe(x)
            step("convert_to_datetime", "timestamp_wrong_type", conv, mine["timestamp_wrong_type"]["count"], cast=True)
        if "unmasked_pii" in mine:
            method = mine["unmasked_pii"]["action"]
        if pii_methods and name in pii_methods:
            method = pii_methods[name]
        if want("mask_pii") and method:
            if method == "drop":
                dropped.append(name)
                steps.append(Step(name, "mask_pii_drop", "unmasked_pii", "programmatic", x, F.lit(None), None))
                continue
            if method == "hash":
                email_col = "email" in name.lower() or (pii_methods or {}).get(name + ":type") == "email"
                new = X.mask_if_email(x) if (email_col and string) else X.hash16(x)
            else:  # tokenize
                new = X.tokenize(x)
            step(f"mask_pii_{method}", "unmasked_pii", new)
        if want("casing") and string and "casing_inconsistency" in mine:
            casing = mine["casing_inconsistency"]["action"].replace("apply_", "")
            step(mine["casing_inconsistency"]["action"], "casing_inconsistency", X.apply_casing(x, casing),
                 mine["casing_inconsistency"]["count"])
        if want("global_email_mask") and global_mask and string:
            step("global_email_mask", "pii_global_scan", X.mask_if_email(x))
        exprs[name] = x
    return FixPlan(exprs, dropped, steps, layers, min(4, pol.example_limit))


def layered(df: DataFrame, plan: FixPlan) -> DataFrame:
    """``df`` with a column for what each step makes."""
    for layer in plan.layers:
        df = df.select("*", *layer)
    return df


def apply_fixes(df: DataFrame, plan: FixPlan) -> DataFrame:
    """All fixes, in projections only."""
    return layered(df, plan).select(*[e.alias(n) for n, e in plan.exprs.items()])


def _changes(s: Step) -> tuple[Column, Column, Column]:
    """Whether a step changed a value, and the value as text before and after."""
    before, after = s.before.cast("string"), s.after.cast("string")
    if s.action == "mask_pii_drop":
        return s.before.isNotNull(), before, F.lit("DROPPED")
    return (s.before.isNotNull() if s.cast else ~before.eqNullSafe(after)), before, after


def _measures(plan: FixPlan) -> list[Column]:
    """Aggregates of every step: changed values and up to four examples (smallest, largest, and two by hash)."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, s in enumerate(plan.steps):
        changed, before, after = _changes(s)
        b = F.when(changed, F.coalesce(before, F.lit("NULL")))
        pair = F.struct(b.alias("b"), F.coalesce(after, F.lit("NULL")).alias("a"))
        mark = F.when(changed, F.xxhash64(b))
        aggs += [F.count_if(changed).alias(f"s{i}_n"), F.min_by(pair, b).alias(f"s{i}_e0"), F.max_by(pair, b).alias(f"s{i}_e1"),
                 F.min_by(pair, mark).alias(f"s{i}_e2"), F.max_by(pair, mark).alias(f"s{i}_e3")]
    return aggs


LOG = ("run_id string, dataset_id string, entity_name string, step int, column_name string, rule_id string, action string, "
       "issue_type string, owner string, confidence double, affected_count bigint, changed_count bigint, "
       "before_type string, after_type string, before_examples string, after_examples string")


def _log_row(plan: FixPlan, m: dict, i: int, entity: str, run_id: str, dataset_id: str) -> tuple:
    s, n = plan.steps[i], int(m[f"s{i}_n"] or 0)
    pairs = list(dict.fromkeys((e["b"], e["a"]) for e in (m[f"s{i}_e{k}"] for k in (0, 2, 3, 1)) if e is not None and e["b"] is not None))[: plan.examples]
    return (run_id, dataset_id, entity, i, s.column, f"fix_{s.action}", s.action, s.issue_type, s.owner, 1.0,
            n if s.affected is None else int(s.affected), n, s.before_type, s.after_type,
            "|".join(b for b, _ in pairs), "|".join(a for _, a in pairs))


def remediation_log(df: DataFrame, plan: FixPlan, entity: str = "entity", run_id: str = "",
                    dataset_id: str = "") -> DataFrame:
    """One row per applied step with changed-value counts, types and up to four examples.

    All counts and examples come from ONE aggregation over the input (one row reaches the driver).
    """
    m = layered(df, plan).agg(*_measures(plan)).first().asDict() if plan.steps else {}
    return df.sparkSession.createDataFrame([_log_row(plan, m, i, entity, run_id, dataset_id) for i in range(len(plan.steps))], LOG)


def measured(df: DataFrame, plan: FixPlan) -> tuple[DataFrame, Observation]:
    """The fixed rows, and metrics that the job writing them fills in: rows, and what :func:`remediation_log` counts.

    The rows go through no shuffle, so a metric counts each finished partition once, also if tasks are run again."""
    seen = Observation(f"fixes-{uuid.uuid4().hex}")
    out = layered(df, plan).observe(seen, *_measures(plan))
    return out.select(*[e.alias(n) for n, e in plan.exprs.items()]), seen


def measured_log(spark: SparkSession, plan: FixPlan, seen: Observation, entity: str = "entity", run_id: str = "",
                 dataset_id: str = "") -> DataFrame:
    """The remediation log from the metrics of a finished job; see :func:`measured`."""
    m = seen.get
    return spark.createDataFrame([_log_row(plan, m, i, entity, run_id, dataset_id) for i in range(len(plan.steps))], LOG)


def remediation_summary(original: DataFrame, remediated: DataFrame, log: DataFrame, issues: DataFrame,
                        policy: Policy | None = None, remediated_rows: int | None = None) -> DataFrame:
    """I16: shapes, applied actions and the human-review list size (one row).

    The rows of both sides are counted; ``remediated_rows`` is what the writing job has measured, if it has."""
    pol = policy or Policy()
    human = issues.agg(F.count_if(F.col("owner") == "human")).first()[0]
    acts = log.agg(F.count_if(F.col("changed_count") > 0), F.sum("changed_count")).first()
    after = remediated.count() if remediated_rows is None else remediated_rows
    row = (pol.version, original.count(), len(original.columns), after, len(remediated.columns), acts[0], acts[1], human)
    return original.sparkSession.createDataFrame([row], "policy_version string, original_rows bigint, original_columns int, remediated_rows bigint, "
                                                 "remediated_columns int, actions_applied bigint, values_changed bigint, human_review_count bigint")
