"""Policy issues, their roll-ups and the dataset scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as X
from .profile import Profiler

ISSUE_COLUMNS = ["entity_name", "column_name", "issue_order", "issue_type", "severity", "count", "policy_section",
                 "owner", "action", "details", "examples"]


def casing_rule(policy, role: Column, name: Column) -> Column:
    """First matching casing rule (role list, then name regex); else the default."""
    out = None
    for rule in policy.casing_rules:
        conds = []
        if "column_role_in" in rule:
            conds.append(role.isin(list(rule["column_role_in"])))
        if "column_name_regex" in rule:
            rx = rule["column_name_regex"]
            conds.append(name.rlike(rx if rx.startswith("(?i)") else "(?i)" + rx))
        cond = conds[0]
        for c in conds[1:]:
            cond = cond | c
        out = F.when(cond, F.lit(rule["casing"])) if out is None else out.when(cond, F.lit(rule["casing"]))
    default = F.lit(policy.casing_default)
    return default if out is None else out.otherwise(default)


def free_text_pii(p: Profiler) -> DataFrame:
    """Personal data found inside free-text columns requires human review.

    Free-text columns come from the role rules (one row per column reaches the
    driver); all of them are then scanned in ONE aggregation for rows holding an
    e-mail address or an IPv4 address anywhere in the text."""
    free = [r["column_name"] for r in p.roles().where(F.col("role") == "free_text").select("column_name").collect()]
    schema = ("entity_name string, column_name string, issue_type string, severity string, count bigint, "
              "policy_section string, owner string, action string, details string, examples string")
    if not free:
        return p.spark.createDataFrame([], schema)
    aggs, rows = [], []
    for i, c in enumerate(free):
        em, ip = X.searches(c, X.EMAIL_PATTERN), X.searches(c, X.IP_ANYWHERE)
        aggs += [F.count_if(em | ip).alias(f"n{i}"), F.count_if(em).alias(f"e{i}"), F.count_if(ip).alias(f"i{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").cast("bigint").alias("count"),
                             F.concat(F.lit("email rows: "), F.col(f"e{i}").cast("string"), F.lit(", ip rows: "),
                                      F.col(f"i{i}").cast("string")).alias("details")))
    out = p.df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where(F.col("count") > 0)
    return out.select(F.lit(p.entity).alias("entity_name"), "column_name", F.lit("pii_in_free_text").alias("issue_type"),
                      F.lit("warn").alias("severity"), "count",
                      F.lit("pii_handling.human_review_required_if").alias("policy_section"),
                      F.lit("human").alias("owner"), F.lit("human_review").alias("action"), "details",
                      F.lit(None).cast("string").alias("examples"))


def policy_decisions(p: Profiler) -> DataFrame:
    """What the policy decides per column -- criticality, whether the field is
    required (with the failure action and owner), the casing rule, the masking
    method of the first personal-data type detected, and what happens to values out of range (the percentage rule first)."""
    pol = p.policy
    r = p.roles().select("entity_name", "column_name", "ordinal_position", "role", "criticality")
    j = r.join(p.pii().select("column_name", "pii_types"), "column_name", "left")
    j = j.join(p.patterns().select("column_name", "is_percentage"), "column_name", "left")
    role, numbers = F.col("role"), [f.name for f in p.fields if N.is_numeric(f.dataType)]
    number = F.col("column_name").isin(numbers) if numbers else F.lit(False)
    percent = F.lit(pol.ranges_enabled) & (F.coalesce(F.col("is_percentage"), F.lit(False)) | (number & F.col("column_name").rlike(pol.percent_name_regex)))
    floor = F.lit(pol.ranges_enabled) & number & (role.isin(pol.non_negative_roles) if pol.non_negative_roles else F.lit(False))
    req = list(pol.required_roles)
    act = F.create_map(*[F.lit(x) for k, (a, _) in pol.required_roles.items() for x in (k, a)])
    own = F.create_map(*[F.lit(x) for k, (_, o) in pol.required_roles.items() for x in (k, o)])
    methods = F.create_map(*[F.lit(x) for kv in pol.pii_mask_methods.items() for x in kv])
    kind = F.when(F.coalesce(F.col("pii_types"), F.lit("")) != "", F.split(F.col("pii_types"), ",").getItem(0))
    required = role.isin(req) if req else F.lit(False)
    return j.select("entity_name", "column_name", "ordinal_position", "role", "criticality", required.alias("required"),
                    F.when(required, act[role]).alias("failure_action"), F.when(required, own[role]).alias("failure_owner"),
                    casing_rule(pol, role, F.col("column_name")).alias("casing"), kind.alias("pii_type"),
                    F.when(kind.isNotNull(), F.coalesce(methods[kind], F.lit("hash"))).alias("mask_method"),
                    F.when(percent, pol.percent_action).when(floor, pol.non_negative_action).alias("range_action"),
                    F.when(percent, pol.percent_owner).when(floor, pol.non_negative_owner).alias("range_owner"))


def column_facts(p: Profiler) -> DataFrame:
    """Per-column inputs of the issue rules (one row per column)."""
    need = ("avg_length", "untrimmed_count", "null_token_count", "numeric_count")
    p.string_stats(*need)  # one pass for every string statistic the rules read
    r = p.roles().select("column_name", "ordinal_position", "native_type", "role", "criticality")
    d = p.distinctness().select("column_name", "row_count", "null_count", "null_rate", "distinct_count", "distinct_rate")
    c = p.completeness().select("column_name", "non_null_count")
    j = r.join(d, "column_name").join(c, "column_name")
    kinds = p.spark.createDataFrame(
        [(f.name, N.is_string(f.dataType), N.is_temporal(f.dataType), N.is_numeric_or_bool(f.dataType)) for f in p.fields],
        "column_name string, is_string boolean, is_temporal boolean, is_numeric boolean")
    j = j.join(kinds, "column_name")
    if p.string_fields:
        s = p.string_stats(*need).select("column_name", "untrimmed_count", "null_token_count", "numeric_count")
        j = j.join(s, "column_name", "left")
    else:
        j = (j.withColumn("untrimmed_count", F.lit(None).cast("bigint"))
              .withColumn("null_token_count", F.lit(None).cast("bigint"))
              .withColumn("numeric_count", F.lit(None).cast("bigint")))
    return j.withColumn("casing", casing_rule(p.policy, F.col("role"), F.col("column_name")))


def null_token_examples(p: Profiler, k: int = 5) -> DataFrame:
    """Up to k distinct non-null token values per column, smallest first."""
    pol = p.policy
    f = p.frequencies_of([x.name for x in p.string_fields])
    f = f.where(X.null_token(F.col("value"), pol, include_nulls=False))
    from pyspark.sql import Window
    w = Window.partitionBy("column_name").orderBy("value")
    top = f.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))


def detect_issues(p: Profiler, with_examples: bool = True) -> DataFrame:
    """I1-I8 as one DataFrame, one row per (column, issue)."""
    pol = p.policy
    f = column_facts(p)
    if with_examples:
        f = f.join(null_token_examples(p), "column_name", "left")
    else:
        f = f.withColumn("examples", F.lit(None).cast("string"))
    f = f.cache()  # one row per column, read by every rule below
    name, role = F.col("column_name"), F.col("role")
    nn = F.col("non_null_count")
    parts: list[DataFrame] = []

    def emit(order: int, cond: Column, itype, severity, count: Column, section, owner, action, details=None,
             examples: Column | None = None):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        parts.append(f.where(cond).select(
            F.lit(p.entity).alias("entity_name"), "column_name", (F.col("ordinal_position") * 10 + order).alias("issue_order"),
            lit(itype).alias("issue_type"), lit(severity).alias("severity"), count.cast("bigint").alias("count"),
            lit(section).alias("policy_section"), lit(owner).alias("owner"), lit(action).alias("action"),
            (lit(details) if details is not None else F.lit(None)).cast("string").alias("details"),
            (examples if examples is not None else F.lit(None)).cast("string").alias("examples")))

    tok = F.when(F.col("is_string"), F.col("null_token_count")).otherwise(F.col("null_count"))
    emit(1, tok > 0, "null_tokens_detected", "warn", tok, "null_handling.null_tokens_case_insensitive",
         "programmatic", "convert_to_proper_null", examples=F.coalesce(F.col("examples"), F.lit("")))
    req = list(pol.required_roles)
    if req:
        act = F.create_map(*[F.lit(x) for r, (a, _) in pol.required_roles.items() for x in (r, a)])
        own = F.create_map(*[F.lit(x) for r, (_, o) in pol.required_roles.items() for x in (r, o)])
        emit(2, role.isin(req) & (F.col("null_count") > 0), "missing_required_field", "error", F.col("null_count"),
             F.concat(F.lit("constraints.required_fields (role="), role, F.lit(")")), own[role], act[role])
    if pol.trim_whitespace:
        emit(3, F.col("is_string") & (F.col("untrimmed_count") > 0), "whitespace_not_trimmed", "warn",
             F.col("untrimmed_count"), "null_handling.trim_whitespace", "programmatic", "trim_whitespace")
    rate = F.coalesce(F.col("numeric_count") / F.nullif(nn, F.lit(0)), F.lit(0.0))
    is_measure_text = (role == "measure") & F.col("is_string")
    emit(4, is_measure_text & (rate < pol.parse_success_min), "measure_field_not_numeric", "error", nn,
         "type_coercion.parse_thresholds", "human", "reclassify_or_fix_data",
         F.concat(F.lit("parse_success_rate="), F.round(rate, 4).cast("string")))
    emit(4, is_measure_text & (rate >= pol.parse_success_min), "type_coercion_available", "warn", nn,
         "type_coercion.safe_cast_matrix", "programmatic", "cast_to_numeric",
         F.concat(F.lit("parse_success_rate="), F.round(rate, 4).cast("string")))
    emit(5, (role == "timestamp") & ~F.col("is_temporal"), "timestamp_wrong_type", "error", F.col("row_count"),
         "classification.column_roles.timestamp", "programmatic", "convert_to_datetime",
         F.concat(F.lit("current type: "), F.col("native_type")))
    if pol.mask_enabled():
        emit(6, F.lower(name).contains("email") & (nn > 0), "unmasked_pii", "warn", nn,
             "pii_handling.masking.methods.email", "programmatic", pol.pii_mask_methods.get("email", "hash"))
    emit(7, (role == "identifier") & (F.col("distinct_count") == F.col("row_count")) & (F.col("null_count") == 0),
         "primary_key_candidate", "info", F.col("row_count"), "constraints.uniqueness.inferred_pk_handling", "human",
         "flag_for_human_confirmation")
    emit(8, F.col("is_string") & (F.col("casing") != "preserve"), "casing_inconsistency", "info", nn,
         F.concat(F.lit("normalization.casing.rules (role="), role, F.lit(")")), "programmatic",
         F.concat(F.lit("apply_"), F.col("casing")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def issues_summary(issues: DataFrame) -> DataFrame:
    """Totals by severity and by owner (one row per entity)."""
    c = lambda col, v: F.count_if(F.col(col) == v).cast("bigint")
    return issues.groupBy("entity_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("total_issues"), c("severity", "error").alias("errors"),
        c("severity", "warn").alias("warnings"), c("severity", "info").alias("infos"),
        c("owner", "programmatic").alias("programmatic"), c("owner", "human").alias("human"))


def issues_by_type(issues: DataFrame) -> DataFrame:
    """Per owner and type: affected columns and total count."""
    return issues.groupBy("entity_name", "owner", "issue_type").agg(
        F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"),
        F.count(F.lit(1)).cast("bigint").alias("column_count"), F.sum("count").cast("bigint").alias("total_count"))


def issue_rollup(issues: DataFrame, columns: DataFrame) -> DataFrame:
    """Programmatic fixes and human reviews per column, plus an entity total row."""
    per = columns.select("entity_name", "column_name").join(
        issues.groupBy("entity_name", "column_name").agg(
            F.count_if(F.col("owner") == "programmatic").alias("programmatic_fixes"),
            F.count_if(F.col("owner") == "human").alias("human_reviews")), ["entity_name", "column_name"], "left")
    per = per.fillna(0, ["programmatic_fixes", "human_reviews"])
    r = per.rollup("entity_name", "column_name").agg(
        F.sum("programmatic_fixes").cast("bigint").alias("programmatic_fixes"),
        F.sum("human_reviews").cast("bigint").alias("human_reviews"))
    return r.where(F.col("entity_name").isNotNull()).select(
        "entity_name", F.coalesce("column_name", F.lit("__entity__")).alias("column_name"), "programmatic_fixes",
        "human_reviews")


def quality_scores(p: Profiler, issues: DataFrame) -> DataFrame:
    """Completeness, issue-based quality score and the dataset PII flag."""
    comp = p.completeness().groupBy("entity_name").agg(
        F.avg(1 - F.col("null_rate")).alias("_c"), F.count(F.lit(1)).alias("column_count"),
        F.max("row_count").alias("row_count"))
    iss = issues.groupBy("entity_name").agg(F.count(F.lit(1)).alias("issue_count"))
    pii = p.pii().groupBy("entity_name").agg(F.max(F.col("contains_pii").cast("int")).alias("_p"))
    j = comp.join(iss, "entity_name", "left").join(pii, "entity_name", "left")
    ic = F.coalesce(F.col("issue_count"), F.lit(0))
    q = F.greatest(F.lit(0.0), 1 - ic / F.greatest(2 * F.col("column_count"), F.lit(1)))
    return j.select("entity_name", F.col("row_count").cast("bigint"), F.col("column_count").cast("bigint"),
                    ic.cast("bigint").alias("issue_count"), F.round("_c", 4).alias("completeness_score"),
                    F.round(q, 4).alias("quality_score"), (F.coalesce("_p", F.lit(0)) > 0).alias("contains_pii"))


def issue_list(issues: DataFrame) -> list[dict]:
    """Issues as driver dicts to compile fixes from (bounded: columns x issue types)."""
    return [r.asDict() for r in issues.drop("examples").collect()]

