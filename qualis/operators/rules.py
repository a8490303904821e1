"""Policy rules declared without code in the reference.

Per-row rules are Column predicates gathered into one ``_dq_flags`` array in a
single projection.  Value-level rules (canonicalisation, rare values) work on the
value-frequency table and reach rows through a join on the value.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions import text as X
from ..policy import Policy
from .profile import Profiler

CURRENCY_CODES = {"$": "USD", "£": "GBP", "€": "EUR", "¥": "JPY"}
BOOLEAN_TEXT = ["true", "false", "yes", "no", "y", "n", "t", "f", "1", "0"]
TRUE_TEXT = ["true", "yes", "y", "t", "1"]


@dataclass
class RowRule:
    flag: str
    predicate: Column          # true -> the row violates the rule
    column: str | None = None
    nulls_value: bool = False  # enforce mode sets the column to NULL
    quarantine: bool = False   # the row leaves the clean rows


def percent_value(c: str, dt) -> Column:
    if N.is_string(dt):
        return X.to_number(F.regexp_replace(F.col(c), "%$", ""))
    return F.col(c).cast("double")


def _rule(flag: str, predicate: Column, column: str, action: str) -> RowRule:
    return RowRule(flag, predicate, column, action == "set_null_and_flag", action == "quarantine_row")


def row_rules(p: Profiler, custom: list[dict] | None = None, outliers: bool = True) -> list[RowRule]:
    """X1-X5 and X14 compiled from the profile and the policy; metadata is per column.

    ``custom`` rules stand in for the policy's own; a rule whose column the table doesn't have is left out."""
    pol = p.policy
    roles = {r["column_name"]: r["role"] for r in p.roles().collect()}
    types = {f.name: f.dataType for f in p.fields}
    rules: list[RowRule] = []
    for c, role in roles.items():
        if role in pol.required_roles:
            rules.append(_rule(f"missing_required:{c}", F.col(c).isNull(), c, pol.required_roles[role][0]))
    pats = {r["column_name"]: r["is_percentage"] for r in p.patterns().collect()}
    import re
    lo, hi = pol.percent_range
    for c, dt in types.items():
        if pol.ranges_enabled and ((re.search(pol.percent_name_regex, c) and (N.is_numeric(dt) or pats.get(c))) or pats.get(c)):
            v = percent_value(c, dt)
            rules.append(_rule(f"range:{c}", F.coalesce((v < lo) | (v > hi), F.lit(False)), c, pol.percent_action))
    if pol.ranges_enabled:
        for c, role in roles.items():
            if role in pol.non_negative_roles and N.is_numeric(types[c]):
                rules.append(_rule(f"negative:{c}", F.coalesce(F.col(c) < pol.non_negative_min, F.lit(False)), c, pol.non_negative_action))
    measures = [c for c, r in roles.items() if r == "measure" and N.is_numeric(types[c])]
    if outliers and measures and pol.outliers_enabled:
        bounds = {r["column_name"]: (r["lower_bound"], r["upper_bound"]) for r in p.outliers().collect()}
        for c in measures:
            b = bounds.get(c)
            if b and b[0] is not None:
                v = F.col(c).cast("double")
                rules.append(_rule(f"outlier:{c}", F.coalesce((v < b[0]) | (v > b[1]), F.lit(False)), c, pol.outlier_action))
    present = {c.lower() for c in types}
    for r in pol.custom_rules if custom is None else custom:
        if r["column"].lower() in present:
            rules.append(RowRule(f"rule:{r['id']}", F.coalesce(business_violation(r), F.lit(False)), r["column"]))
    return rules


def business_violation(rule: dict) -> Column:
    """A custom rule as a violation predicate (NULL values do not violate)."""
    c = F.col(rule["column"])
    kind = rule["check"]
    if kind == "positive":
        return c <= 0
    if kind == "non_negative":
        return c < 0
    if kind == "not_future":
        as_of = F.lit(rule["as_of"]).cast("timestamp_ntz") if rule.get("as_of") else F.current_timestamp().cast("timestamp_ntz")
        return c.cast("timestamp_ntz") > as_of
    if kind == "between":
        return (c < rule["min"]) | (c > rule["max"])
    if kind == "sql":
        return ~F.expr(rule["expr"])
    raise ValueError(f"unknown rule check {kind}")


def apply_flags(df: DataFrame, rules: list[RowRule], mode: str = "enforce", flags_column: str = "_dq_flags") -> DataFrame:
    """One projection adding the flag array; enforce mode nulls range failures."""
    flags = F.filter(F.array(*[F.when(r.predicate, F.lit(r.flag)) for r in rules]), lambda x: x.isNotNull()) \
        if rules else F.array().cast("array<string>")
    fixes: dict[str, Column] = {}
    for r in rules:
        if r.nulls_value and mode == "enforce":
            fixes[r.column] = fixes[r.column] | r.predicate if r.column in fixes else r.predicate
    cols = []
    for c in df.columns:
        if c in fixes:
            cols.append(F.when(fixes[c], F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols, flags.alias(flags_column))


def quarantine_reason(rules: list[RowRule]) -> Column:
    """The flags that send a row to quarantine, comma-joined; empty for rows that stay."""
    why = [F.when(r.predicate, F.lit(r.flag)) for r in rules if r.quarantine]
    return F.concat_ws(",", *why) if why else F.lit("")


def split_quarantine(df: DataFrame, rules: list[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Rows that break a rule whose action is quarantine (a missing required field) leave with their reasons."""
    tagged = df.withColumn("_quarantine_reason", quarantine_reason(rules))
    return (tagged.where(F.col("_quarantine_reason") == "").drop("_quarantine_reason"),
            tagged.where(F.col("_quarantine_reason") != ""))


def rule_counts(df: DataFrame, rules: list[RowRule]) -> DataFrame:
    """X3/X4/X5/X14 summary: violations per rule, one aggregation."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(r.predicate).alias(f"r{i}") for i, r in enumerate(rules)]
    rows = [F.struct(F.lit(r.flag.split(":")[0]).alias("rule"), F.lit(r.column).alias("column_name"),
                     F.col(f"r{i}").cast("bigint").alias("violations"), F.col("_n").cast("bigint").alias("checked_rows"))
            for i, r in enumerate(rules)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


# --------------------------------------------------------------- value-level rules
def canonical_mapping(p: Profiler, columns: list[str] | None = None) -> DataFrame:
    """Map a rare value to a frequent value of the same text column within the edit ratio.

    Only values below the low-frequency threshold are mapped, and only to values at or above it (so a column has at
    most 1/threshold targets, however many values it has). Texts are compared lower-cased and stripped; the target must
    hold the dominance share of the pair. Rare and frequent values meet on the column and the length, each
    frequent value once for every length the ratio allows. The closest, then the more frequent, then the smaller target wins.
    """
    pol = p.policy
    cols = columns if columns is not None else [f.name for f in p.string_fields]
    f = p.frequencies_of(cols)
    if not pol.canonicalize_enabled:
        f = f.where(F.lit(False))
    n = f.groupBy("column_name").agg(F.sum("count").alias("_n"))  # a row a column
    f = f.join(n, "column_name").withColumn("_norm", F.lower(X.py_strip(F.col("value")))).withColumn("_len", F.length("_norm"))
    rare = F.col("count") < F.col("_n") * pol.low_frequency_threshold
    slack = pol.max_edit_distance_ratio
    low, high = F.floor(F.col("_len") * (1 - slack)).cast("int"), F.ceil(F.col("_len") / (1 - slack)).cast("int")
    v = f.where(rare).select("column_name", F.col("value").alias("variant"), F.col("count").alias("variant_count"),
                             F.col("_norm").alias("_vn"), "_len")
    c = f.where(~rare).select("column_name", F.col("value").alias("canonical"), F.col("count").alias("canonical_count"),
                              F.col("_norm").alias("_cn"), F.explode(F.sequence(low, high)).alias("_len"))
    longest = F.greatest(F.length("_vn"), F.length("_cn"))
    share = F.col("canonical_count") / (F.col("canonical_count") + F.col("variant_count"))
    distance = F.levenshtein("_vn", "_cn")
    pairs = v.join(c, ["column_name", "_len"]).where(share >= pol.dominance_threshold).withColumn("distance", distance)
    pairs = pairs.withColumn("ratio", F.coalesce(F.round(F.col("distance") / F.nullif(longest, F.lit(0)), 4), F.lit(0.0)))
    best = pairs.where(F.col("ratio") <= slack).groupBy("column_name", "variant").agg(
        F.min(F.struct("ratio", (-F.col("canonical_count")).alias("_less"), "canonical", "canonical_count", "variant_count", "distance")).alias("b"))
    conf = F.round(1 - F.col("b.ratio"), 4)
    return best.select(F.lit(p.entity).alias("entity_name"), "column_name", "variant", F.col("b.canonical").alias("canonical"),
                       F.col("b.variant_count").cast("bigint").alias("variant_count"), F.col("b.canonical_count").cast("bigint").alias("canonical_count"),
                       F.col("b.distance").cast("int").alias("distance"), F.col("b.ratio").alias("ratio"), conf.alias("confidence"),
                       F.when(conf >= pol.canonicalize_confidence, "canonicalize").otherwise("human_review").alias("action"))


def aggregate_duplicates(df: DataFrame, keys: list[str], measures: list[str], dims: list[str]) -> DataFrame:
    """One row per grain key: measures summed (whole numbers as decimals, past 64 bits), dimensions by their smallest value.

    sum/min are combined map-side, so a hot key costs one row per task."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    whole = {m for m in measures if isinstance(df.schema[m].dataType, N.INTEGRAL_TYPES)}
    aggs += [F.sum(F.col(m).cast("decimal(38,0)") if m in whole else F.col(m)).alias(f"sum_{m}") for m in measures]
    aggs += [F.min(F.col(d)).alias(f"min_{d}") for d in dims]
    return df.groupBy(*keys).agg(*aggs)


def apply_value_map(df: DataFrame, column: str, mapping: DataFrame, src: str, dst: str) -> DataFrame:
    """Replace values of ``column`` through a mapping; Spark broadcasts it if its measured size allows."""
    m = mapping.select(F.col(src).alias("__from"), F.col(dst).alias("__to"))
    j = df.join(m, df[column] == m["__from"], "left")
    return j.select(*[(F.coalesce(F.col("__to"), F.col(column)).alias(column) if c == column else F.col(c))
                      for c in df.columns])


def canonicalize(df: DataFrame, p: Profiler, columns: list[str] | None = None) -> DataFrame:
    m = canonical_mapping(p, columns).where(F.col("action") == "canonicalize")
    for c in columns if columns is not None else [f.name for f in p.string_fields]:
        df = apply_value_map(df, c, m.where(F.col("column_name") == c), "variant", "canonical")
    return df


def rare_values(p: Profiler, column: str) -> DataFrame:
    """Values whose share of rows is below the low-frequency threshold."""
    n = p.completeness().where(F.col("column_name") == column).select(F.col("row_count").alias("_n"),
                                                                       F.lit(1).alias("_k"))
    f = p.frequencies_of([column]).withColumn("_k", F.lit(1))
    return (f.join(F.broadcast(n), "_k")  # one row
             .where(F.lit(p.policy.collapse_rare_enabled) & (F.col("count") / F.col("_n") < p.policy.low_frequency_threshold))
             .select("value", F.lit(p.policy.other_token).alias("to")))


def collapse_rare(df: DataFrame, p: Profiler, column: str) -> DataFrame:
    return apply_value_map(df, column, rare_values(p, column), "value", "to")


# --------------------------------------------------------------- casts, descriptors
def safe_cast_rates(p: Profiler) -> DataFrame:
    """Share of non-null text values castable to each target; the chosen target."""
    per = []
    for f in p.string_fields:
        c = F.col(f.name)
        t = F.trim(c)
        per.append((f.name, {
            "non_null_count": F.count(c),
            "integer_count": F.count_if(t.rlike(r"^[+-]?\d+$")),
            "decimal_count": F.count(X.to_number(c)),
            "boolean_count": F.count_if(F.lower(t).isin(BOOLEAN_TEXT)),
            "date_count": F.count_if(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull()),
            "datetime_count": F.count(X.to_timestamp_safe(c)),
        }))
    stats = {k: "bigint" for k in ("non_null_count", "integer_count", "decimal_count", "boolean_count", "date_count",
                                   "datetime_count")}
    s = p._long(stats, per)
    nn = F.col("non_null_count")
    rate = {k: F.round(F.col(f"{k}_count") / F.nullif(nn, F.lit(0)), 4) for k in ("integer", "decimal", "boolean", "date", "datetime")}
    thr = p.policy.parse_success_min
    target = F.when(nn == 0, F.lit(None).cast("string"))
    for kind, least in (("integer", 1), ("decimal", 1), ("boolean", 1), ("date", thr), ("datetime", thr)):
        if kind in p.policy.cast_targets:
            target = target.when(rate[kind] >= least, kind)
    return s.select("entity_name", "column_name", "ordinal_position", *[rate[k].alias(f"{k}_rate") for k in rate],
                    target.alias("cast_to"))


def cast_targets(p: Profiler) -> dict[str, str]:
    """The text columns that the policy lets cast safely, and to what (one row a column reaches the driver)."""
    if not p.policy.allow_safe_casts:
        return {}
    return {r.column_name: r.cast_to for r in safe_cast_rates(p).collect() if r.cast_to}


def typed_value(column: str, target: str) -> Column:
    """The value of a text column as its target type, null where it is none."""
    text = F.trim(F.col(f"`{column}`"))
    if target == "integer":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("decimal(38,0)"))
    if target == "decimal":
        return X.to_number(F.col(f"`{column}`"))
    if target == "boolean":
        low = F.lower(text)
        return F.when(low.isin(TRUE_TEXT), F.lit(True)).when(low.isin(BOOLEAN_TEXT), F.lit(False))
    if target == "date":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    if target == "datetime":
        return X.to_timestamp_safe(F.col(f"`{column}`"))
    raise ValueError(f"unknown cast target {target}")


def apply_casts(df: DataFrame, targets: dict[str, str], flags_column: str = "_dq_flags", rejects_column: str = "_rejects") -> DataFrame:
    """``df`` with the columns of ``targets`` typed, in one projection.

    A value its type can't hold becomes null; it is flagged as ``cast_failed:<column>`` (after flags the row has already) and kept,
    with the rule it broke, in ``rejects_column``, which :func:`cast_rejects` turns into rows."""
    fresh = {c: typed_value(c, t) for c, t in targets.items()}
    failed = {c: F.col(f"`{c}`").isNotNull() & v.isNull() for c, v in fresh.items()}
    kept = [fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in df.columns if c != flags_column]
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col(flags_column), none) if flags_column in df.columns else none
    flags = F.filter(F.array(*[F.when(b, F.lit(f"cast_failed:{c}")) for c, b in failed.items()]), lambda x: x.isNotNull()) if failed else none
    reject = [F.when(b, F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value"), F.lit(f"safe_cast_{targets[c]}").alias("rule"))) for c, b in failed.items()]
    rejects = F.filter(F.array(*reject), lambda x: x.isNotNull()) if reject else F.array().cast("array<struct<column_name:string,value:string,rule:string>>")
    return df.select(*kept, F.concat(given, flags).alias(flags_column), rejects.alias(rejects_column))


def cast_rejects(cast: DataFrame, keys: list[str], rejects_column: str = "_rejects") -> DataFrame:
    """The rejected values of :func:`apply_casts`, one row each with the row's ``keys``, the column, the value and the rule."""
    return cast.select(*[F.col(f"`{k}`") for k in keys], F.explode(rejects_column).alias("_r")).select(*[F.col(f"`{k}`") for k in keys], "_r.*")


def split_failed_casts(cast: DataFrame, roles: dict[str, str], policy: Policy, flags_column: str = "_dq_flags") -> tuple[DataFrame, DataFrame]:
    """X10 ``on_cast_failure``: the rows of :func:`apply_casts` that stay, and those that go.

    ``set_null_and_flag`` keeps all of them; ``reject_row`` rejects rows with a failed cast in a critical column (by its role)."""
    bad = [f"cast_failed:{c}" for c, role in roles.items() if policy.criticality(role) == "critical"]
    goes = F.arrays_overlap(F.col(flags_column), F.array(*map(F.lit, bad))) if bad and policy.on_cast_failure == "reject_row" else F.lit(False)
    goes = F.coalesce(goes, F.lit(False))
    return cast.where(~goes), cast.where(goes)


def metric_descriptors(df: DataFrame, p: Profiler, keys: list[str]) -> DataFrame:
    """Split formatted text measures into a number and a descriptor column."""
    pats = {r["column_name"]: r for r in p.patterns().collect()}
    out = [F.col(k) for k in keys]
    for f in p.string_fields:
        r = pats.get(f.name)
        if r is None:
            continue
        c = F.col(f.name)
        if r["is_currency"]:
            sym = F.regexp_extract(c, r"^([\$£€¥])", 1)
            code = F.create_map(*[F.lit(x) for kv in CURRENCY_CODES.items() for x in kv])[sym]
            out += [X.to_number(F.regexp_replace(c, r"[\$£€¥,]", "")).alias(f"{f.name}_value"),
                    code.alias(f"{f.name}_currency")]
        elif r["is_percentage"]:
            out += [X.to_number(F.regexp_replace(c, "%$", "")).alias(f"{f.name}_value"),
                    F.when(c.isNotNull(), F.lit("percent")).alias(f"{f.name}_unit")]
    return df.select(*out)


# --------------------------------------------------------------- dataset level
def column_ledger(p: Profiler, issues: DataFrame) -> DataFrame:
    """The column-quality ledger: profile row plus issue counts by owner."""
    cp = p.column_profile()
    agg = issues.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.count_if(F.col("owner") == "programmatic").alias("programmatic_fixes"),
        F.count_if(F.col("owner") == "human").alias("human_reviews"),
        F.count_if(F.col("severity") == "error").alias("errors"))
    j = cp.join(agg, "column_name", "left").fillna(0, ["issue_count", "programmatic_fixes", "human_reviews", "errors"])
    return j.select("entity_name", "column_name", "ordinal_position", "role", "criticality", "null_rate",
                    "distinct_rate", *[F.col(c).cast("bigint").alias(c) for c in
                                       ("issue_count", "programmatic_fixes", "human_reviews", "errors")])


def ai_readiness(p: Profiler, issues: DataFrame, grain_confidence: float) -> DataFrame:
    """X11: weighted score.  ambiguity = grain confidence; validity = share of columns
    without an error issue; consistency = share of text columns not 'mixed' in case;
    completeness = mean non-null rate."""
    w = p.policy.readiness_weights
    led = column_ledger(p, issues)
    s = p.strings().select("column_name", "case_consistency") if p.string_fields else None
    j = led.join(s, "column_name", "left") if s is not None else led.withColumn("case_consistency", F.lit(None).cast("string"))
    agg = j.groupBy("entity_name").agg(
        F.avg(1 - F.col("null_rate")).alias("completeness"),
        F.avg(F.when(F.col("errors") == 0, 1.0).otherwise(0.0)).alias("validity"),
        F.coalesce(F.avg(F.when(F.col("case_consistency").isNotNull(),
                                F.when(F.col("case_consistency") != "mixed", 1.0).otherwise(0.0))), F.lit(1.0)).alias("consistency"))
    amb = F.lit(float(grain_confidence))
    score = (w["ambiguity"] * amb + w["validity"] * F.col("validity") + w["consistency"] * F.col("consistency")
             + w["completeness"] * F.col("completeness"))
    return agg.select("entity_name", F.round(amb, 4).alias("ambiguity"), F.round("validity", 4).alias("validity"),
                      F.round("consistency", 4).alias("consistency"), F.round("completeness", 4).alias("completeness"),
                      F.round(score, 4).alias("ai_readiness_score"))


def dataset_decision(p: Profiler, issues: DataFrame, grain_review: bool, policy: Policy | None = None, grain_keys: list[str] | None = None) -> DataFrame:
    """The policy's decision on a data set and what it rests on; the strictest one wins.

    Personal data that is neither masked nor allowed, and a grain that can't be determined (no shape hint, no keys), are
    what the policy may reject for; an uncertain grain, and several or no time columns, are for a human unless the policy says otherwise."""
    pol = policy or p.policy
    found = p.pii().where("contains_pii").groupBy("entity_name").agg(F.count(F.lit(1)).alias("_pii"))
    j = p.record_shape().join(found, "entity_name", "left")
    unmasked = pol.enforcement_mode == "monitor_only" or not pol.mask_enabled()
    violation = (F.coalesce(F.col("_pii"), F.lit(0)) > 0) & F.lit(unmasked)
    ntime = F.when(F.col("time_candidates") == "", 0).otherwise(F.size(F.split("time_candidates", ",")))
    unknown = (F.col("wide_or_long_hint") == "unknown") & F.lit(grain_keys is not None and not grain_keys)
    found_out = [(violation, "pii_policy_violation", pol.pii_violation_decision),
                 (unknown, "unresolved_grain", pol.unresolved_grain_decision),
                 (F.lit(bool(grain_review)) & ~unknown, "unresolved_grain", pol.grain_review_decision),
                 (ntime > 1, "multiple_time_candidates", pol.many_time_decision),
                 (ntime == 0, "no_time_candidates", pol.no_time_decision)]
    met = lambda d: F.array_contains(F.array(F.lit(""), *[F.when(c, F.lit(x)).otherwise(F.lit("")) for c, _, x in found_out]), d)
    decision = F.when(met("reject"), "reject").when(met("human_required"), "human_required").otherwise("proceed")
    reasons = F.concat_ws(",", *[F.when(c, why) for c, why, x in found_out if x != "proceed"])
    return j.select("entity_name", decision.alias("decision"), reasons.alias("reasons"),
                    ntime.cast("int").alias("time_candidate_count"))


# --------------------------------------------------------------- text cleanup
@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC normalisation (X8); Spark has no built-in, so Arrow batches."""
    return s.map(lambda v: unicodedata.normalize("NFC", v) if isinstance(v, str) else v)


def clean_text(c: str | Column, normalize_unicode: bool = False, collapse: bool = True) -> Column:
    """Collapse inner whitespace; optional NFC normalisation, for which only values beyond ASCII go through Arrow."""
    x = X.collapse_whitespace(c) if collapse else X.col_of(c)
    return F.coalesce(nfc(F.when(x.rlike(r"[^\x00-\x7F]"), x)), x) if normalize_unicode else x
