"""A policy file drives the run: every section changes a result or is refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from qualis.operators import issues as I
from qualis.operators import remediate as R
from qualis.operators import rules as RU
from qualis.operators.profile import Profiler
from qualis.plans.flow import run_entities
from qualis.policy import Policy, load_policy
from qualis.policy_file import PolicyError, compile_policy
from qualis.sources import sinks as SK

FILE = """
policy_spec_version: "9.9"
name: any
governance: {principles: [{id: P1, text: x}], audit: {enabled: true, sample_size: 2, emit_reports: [column_quality_ledger]}}
scoping: {default_enforcement_mode: enforce}
classification: {column_roles: {identifier: {criticality: critical}, measure: {criticality: low}}}
null_handling:
  null_tokens_case_insensitive: ["Nil"]
  treat_zero_string_as_null: {enabled: true, applies_to_roles: [status]}
  fill_missing: [{match: {column_name_regex: "(?i)mail"}, value: "none@x.org", action: fill_unknown_member}]
normalization:
  casing: {default: preserve, rules: [{match: {column_role_in: [status]}, action: {casing: uppercase}}]}
  string_cleanup: {collapse_internal_whitespace: true, normalize_unicode: true}
enumerations:
  auto_build_mapping: {dominance_threshold: 0.7, similarity: {method: fuzzy, max_edit_distance_ratio: 0.3}}
  actions: {collapse_rare_to_other: {enabled: false, other_token: REST}}
type_coercion:
  safe_cast_matrix: [{from: string, to: integer, allowed_if: all_values_match_regex}]
  failure_behavior: {on_cast_failure: reject_row}
constraints: {required_fields: [{role: identifier, required: true, failure_action: flag_only, owner: human}]}
range_validations:
  built_in:
    percentage: {detect_if: {any: [{column_name_regex: share}]}, range: {min: 0, max: 1}, invalid_action: quarantine_row, owner: human}
    non_negative: {detect_if: {column_role_in: [measure]}, range: {min: -5}, invalid_action: set_null_and_flag, owner: human}
  outliers: {detection: {enabled: false}}
pii_handling: {masking: {methods: {email: tokenize}}, enforcement: {if_contains_pii_true_and_not_allowed: human_required}}
grain_and_time: {time_column_candidate_handling: {enabled: true, if_multiple_candidates: reject_dataset, if_no_candidates_and_time_required: proceed}}
business_rules: {orders: {enabled: true, rules: [{if_column: amount, must_be: between, min: 0, max: 50}, {if_column: elsewhere, must_be: positive}]}}
outputs:
  remediation_log: {schema: {fields: [column_name, action, affected_count]}}
  quality_flags_column: {name: _flags}
  quarantine: {target: held, include_reason: false}
  ai_readiness_score: {weights: {ambiguity: 1, validity: 0, consistency: 0, completeness: 0}}
"""


@pytest.fixture(scope="module")
def policy(tmp_path_factory):
    path = tmp_path_factory.mktemp("policy") / "p.yaml"
    path.write_text(FILE)
    return load_policy(str(path))


@pytest.mark.parametrize("doc", [
    {"nul_handling": {}}, {"null_handling": {"trim": True}}, {"null_handling": {"trim_whitespace": "yes"}}, {"null_handling": 3},
    {"null_handling": {"null_token_regexes": ["("]}}, {"default_time_zone": "CET"}, {"governance": {"audit": {"enabled": False}}},
    {"outputs": {"ai_readiness_score": {"weights": {"ambiguity": 1, "validity": 1, "consistency": 0, "completeness": 0}}}},
    {"range_validations": {"built_in": {"percentage": {"range": {"min": 2, "max": 1}}}}}, {"business_rules": {"a": {"rules": [{"if_column": "x", "must_be": "odd"}]}}},
    {"business_rules": {"a": {"rules": [{"if_column": "x", "must_be": "between", "min": 1}]}}}, {"free_text": {"optional_nlp_enrichment": {"enabled": True}}},
    {"type_coercion": {"safe_cast_matrix": [{"from": "string", "to": "blob", "allowed_if": "x"}]}}, {"constraints": {"uniqueness": {"enforce_primary_key_uniqueness": {"enabled": True}}}},
    {"pii_handling": {"masking": {"methods": {"email": "rot13"}}}}, {"outputs": {"remediation_log": {"schema": {"fields": ["nothing"]}}}}, {"enumerations": {"auto_build_mapping": {"dominance_threshold": 3}}},
])
def test_what_is_not_known_is_refused(doc):
    with pytest.raises(PolicyError):
        compile_policy(doc)


def test_an_empty_file_is_the_built_in_policy():
    assert compile_policy({}) == Policy() == load_policy()


def test_switched_off_sections_win_over_what_they_say():
    p = compile_policy({"grain_and_time": {"time_column_candidate_handling": {"enabled": False, "if_multiple_candidates": "reject_dataset"}},
                        "governance": {"audit": {"store_before_after_samples": False, "sample_size": 50}}, "outputs": {"ai_readiness_score": {"enabled": False}}})
    assert (p.many_time_decision, p.no_time_decision, p.example_limit) == ("proceed", "proceed", 0)
    assert p.reports == ["remediation_summary", "column_quality_ledger"]


def orders(spark):
    rows = [(i, float(i), i / 100, "ok", f"v{i}") for i in range(100)] + [(None, -7.0, 3.0, "ok", "Nil"), (101, -2.0, 0.5, "ok", "a  é")]
    return spark.createDataFrame(rows, "order_id int, amount double, share double, status string, note string")


def test_rules_follow_the_file(spark, policy):
    p = Profiler(orders(spark), "orders", policy, role_overrides={"order_id": "identifier", "amount": "measure", "share": "measure"})
    rules = {r.flag: r for r in RU.row_rules(p)}
    assert set(rules) == {"missing_required:order_id", "range:share", "negative:amount", "negative:share", "rule:orders_1"}
    assert not rules["missing_required:order_id"].quarantine and rules["range:share"].quarantine and rules["negative:amount"].nulls_value
    out = RU.apply_flags(p.df, list(rules.values()), policy.enforcement_mode, policy.flags_column)
    row = out.where("order_id IS NULL").first()
    assert set(row["_flags"]) == {"missing_required:order_id", "range:share", "negative:amount", "rule:orders_1"} and row.amount is None and row.share == 3.0
    assert out.where(F.array_contains("_flags", "rule:orders_1")).count() == 51  # 51..99, -7 and -2
    clean, held = RU.split_quarantine(p.df, list(rules.values()))
    assert (clean.count(), held.count()) == (101, 1)
    assert RU.rare_values(p, "status").count() == 0 and policy.other_token == "REST"
    plain = {r.flag for r in RU.row_rules(Profiler(p.df, "orders", role_overrides=p.role_overrides))}
    assert "outlier:amount" in plain or "negative:amount" in plain
    assert "range:share" not in plain and "rule:orders_1" not in plain


def test_range_failures_name_action_and_owner(spark, policy):
    def decided(pol):
        p = Profiler(orders(spark), "orders", pol, role_overrides={"order_id": "identifier", "amount": "measure", "share": "measure"})
        return {r.column_name: (r.range_action, r.range_owner) for r in I.policy_decisions(p).collect()}
    none = (None, None)
    assert decided(policy) == {"order_id": none, "amount": ("set_null_and_flag", "human"), "share": ("quarantine_row", "human"), "status": none, "note": none}
    assert decided(Policy())["amount"] == ("flag_only", "human")
    assert set(decided(compile_policy({"range_validations": {"enable": False}})).values()) == {none}


def test_casts_follow_the_file(spark, policy):
    df = spark.createDataFrame([("1", "1.5"), ("2", "2.5")], "k string, x string")
    assert RU.cast_targets(Profiler(df, "t", policy)) == {"k": "integer"}
    assert RU.cast_targets(Profiler(df, "t")) == {"k": "integer", "x": "decimal"}
    assert RU.cast_targets(Profiler(df, "t", compile_policy({"type_coercion": {"allow_safe_casts": False}}))) == {}
    cast = RU.apply_casts(spark.createDataFrame([("1", "a"), ("b", "2")], "k string, x string"), {"k": "integer", "x": "integer"})
    kept, gone = RU.split_failed_casts(cast, {"k": "identifier", "x": "measure"}, policy)
    assert [r.k for r in kept.collect()] == [1] and [r.x for r in gone.collect()] == [2]
    kept, gone = RU.split_failed_casts(cast, {"k": "identifier", "x": "measure"}, Policy())
    assert (kept.count(), gone.count()) == (2, 0)


def test_text_cleanup_joins_the_chain_where_asked_for(spark, policy):
    plan = R.compile_fixes(orders(spark), [], policy)
    assert "clean_text" in {s.action for s in plan.steps} and plan.examples == 2
    assert R.apply_fixes(orders(spark), plan).where("order_id = 101").first().note == "a é"
    assert "clean_text" not in {s.action for s in R.compile_fixes(orders(spark), [], Policy()).steps}


def test_decisions_follow_the_file(spark, policy):
    def decided(pol, df, review=False, keys=("k",)):
        r = RU.dataset_decision(Profiler(df, "t", pol), None, review, grain_keys=list(keys)).first()
        return r.decision, r.reasons
    two = spark.createDataFrame([(1, "a", "b")], "k int, from_date string, to_date string")
    none = spark.createDataFrame([(1, "a")], "k int, x string")
    assert decided(policy, two) == ("reject", "multiple_time_candidates") and decided(Policy(), two) == ("human_required", "multiple_time_candidates")
    assert decided(policy, none) == ("proceed", "") and decided(Policy(), none) == ("human_required", "no_time_candidates")
    wide = spark.createDataFrame([tuple(range(12))], ", ".join(f"c{i} int" for i in range(12)))
    assert decided(policy, wide, keys=()) == ("reject", "unresolved_grain")
    late = compile_policy({"dataset_decisions": {"reject_dataset_if": [{"condition": "pii_policy_violation", "owner": "programmatic"}]}})
    assert decided(late, wide, keys=())[0] == "human_required"
    mail = spark.createDataFrame([(1, "a@b.com", "c")], "k int, email string, event_date string")
    off = {"pii_handling": {"enabled": False}}
    assert decided(compile_policy(off), mail) == ("reject", "pii_policy_violation")
    off["pii_handling"]["enforcement"] = {"if_contains_pii_true_and_not_allowed": "human_required"}
    assert decided(compile_policy(off), mail) == ("human_required", "pii_policy_violation")


def test_the_flow_follows_the_file(spark, policy, tmp_path):
    src, run = orders(spark), "2024-01-01_00-00-00"
    run_entities(spark, {"orders": src}, str(tmp_path), run, policy)
    read = lambda name: SK.read_artifact(spark, str(tmp_path), name, run)
    clean, held = read("clean/orders"), read("held/orders")
    assert clean.count() + held.count() == src.count() and held.count() == 1 and "_quarantine_reason" not in held.columns
    assert "_flags" in clean.columns and clean.where(F.array_contains("_flags", "rule:orders_1")).count() == 50
    assert {"column_name", "action", "affected_count"} <= set(read("remediation_log").columns) and "issue_type" not in read("remediation_log").columns
    assert read("column_quality_ledger").count() == len(src.columns) and read("dataset_decision").count() == 1
    assert not (tmp_path / "remediation_summary").exists() and not (tmp_path / "ai_readiness_score").exists()
