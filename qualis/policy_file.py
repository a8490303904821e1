"""Policy files: YAML checked against a schema and compiled into a :class:`~qualis.policy.Policy`.

Every key of a file is either read into the policy, which the operators turn into Column expressions, or may only have the
value the library works by (``only``), or is a remark (``note``). Anything else, an unknown key or a value of
the wrong type included, raises :class:`PolicyError` with the key's path, so that no part of a policy is ignored without a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from .policy import CAST_TARGETS, REPORTS, Policy

MODES = ("monitor_only", "enforce")
OWNERS = ("programmatic", "human", "ai")
ROW_ACTIONS = ("flag_only", "set_null_and_flag", "quarantine_row")
CASINGS = ("preserve", "titlecase", "lowercase", "uppercase")
MASKS = ("hash", "tokenize", "drop")
DECISIONS = {"human_required": "human_required", "reject_dataset": "reject", "reject": "reject", "proceed": "proceed"}
CHECKS = ("positive", "non_negative", "not_future", "between", "sql")

OFF = "off"

Leaf = Callable[[Any, str], dict[str, Any]]


class PolicyError(ValueError):
    """A policy file says something the library can't do, or doesn't know."""


def _fail(path: str, why: str):
    raise PolicyError(f"{path}: {why}")


def _typed(value: Any, kind: type, path: str) -> Any:
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (kind is not bool and isinstance(value, bool)):
        _fail(path, f"{kind.__name__} expected, not {value!r}")
    return value


def note(value: Any, path: str) -> dict[str, Any]:
    return {}


def only(*allowed: Any) -> Leaf:
    """A setting the library has no other way for."""
    def leaf(value, path):
        if value not in allowed or isinstance(value, bool) != isinstance(allowed[0], bool):
            _fail(path, f"only {' or '.join(map(repr, allowed))} can be done, not {value!r}")
        return {}
    return leaf


def into(name: str, kind: type, among: tuple | None = None, low: float | None = None, high: float | None = None) -> Leaf:
    def leaf(value, path):
        value = _typed(value, kind, path)
        if among is not None and value not in among:
            _fail(path, f"one of {', '.join(map(str, among))} expected, not {value!r}")
        if (low is not None and value < low) or (high is not None and value > high):
            _fail(path, f"{value} is out of range")
        return {name: value}
    return leaf


def pattern(name: str) -> Leaf:
    def leaf(value, path):
        return {name: _regex(value, path)}
    return leaf


def texts(name: str, among: tuple | None = None, lower: bool = False, regex: bool = False) -> Leaf:
    def leaf(value, path):
        out = []
        for i, x in enumerate(_typed(value, list, path)):
            x = _typed(x, str, f"{path}[{i}]")
            if among is not None and x not in among:
                _fail(f"{path}[{i}]", f"one of {', '.join(among)} expected, not {x!r}")
            out.append(_regex(x, f"{path}[{i}]") if regex else x.lower() if lower else x)
        return {name: out}
    return leaf


def decision(name: str) -> Leaf:
    def leaf(value, path):
        if value not in DECISIONS:
            _fail(path, f"one of {', '.join(DECISIONS)} expected, not {value!r}")
        return {name: DECISIONS[value]}
    return leaf


def mapping(name: str, among: tuple) -> Leaf:
    def leaf(value, path):
        for k, v in _typed(value, dict, path).items():
            if v not in among:
                _fail(f"{path}.{k}", f"one of {', '.join(among)} expected, not {v!r}")
        return {name: dict(value)}
    return leaf


def switch(**off: Any) -> Leaf:
    """True: as it is. False: the given fields, whatever else the section says."""
    return lambda value, path: {} if _typed(value, bool, path) else {OFF: off}


def _regex(value: Any, path: str) -> str:
    try:
        re.compile(_typed(value, str, path))
    except re.error as exc:
        _fail(path, f"no pattern: {exc}")
    return value


def _keys(value: Any, path: str, need: set[str], may: set[str] = frozenset()) -> dict:
    keys = set(_typed(value, dict, path))
    if keys - need - may:
        _fail(path, f"unknown {', '.join(sorted(map(str, keys - need - may)))}")
    if need - keys:
        _fail(path, f"without {', '.join(sorted(need - keys))}")
    return value


def _entries(value: Any, path: str):
    return ((x, f"{path}[{i}]") for i, x in enumerate(_typed(value, list, path)))


def _among(value: Any, path: str, allowed) -> Any:
    if value not in allowed:
        _fail(path, f"one of {', '.join(map(str, allowed))} expected, not {value!r}")
    return value


# ------------------------------------------------------------------- lists and tables of rules
def _roles(value, path):
    out = {}
    for role, x in _typed(value, dict, path).items():
        out[role] = _typed(_keys(x, f"{path}.{role}", {"criticality"})["criticality"], str, f"{path}.{role}.criticality")
    return {"role_criticality": out}


def _fills(value, path):
    rules = []
    for r, at in _entries(value, path):
        _keys(r, at, {"match", "value"}, {"action"})
        match = _keys(r["match"], f"{at}.match", {"column_name_regex"})
        rules.append({"column_name_regex": _regex(match["column_name_regex"], f"{at}.match.column_name_regex"),
                      "value": _typed(r["value"], str, f"{at}.value"), "action": _typed(r.get("action", "fill_missing"), str, f"{at}.action")})
    return {"fill_rules": rules}


def _casings(value, path):
    rules = []
    for r, at in _entries(value, path):
        _keys(r, at, {"match", "action"})
        match = dict(_keys(r["match"], f"{at}.match", set(), {"column_role_in", "column_name_regex"}))
        if len(match) != 1:
            _fail(f"{at}.match", "either column_role_in or column_name_regex expected")
        if "column_name_regex" in match:
            _regex(match["column_name_regex"], f"{at}.match.column_name_regex")
        else:
            _typed(match["column_role_in"], list, f"{at}.match.column_role_in")
        rules.append({**match, "casing": _among(_keys(r["action"], f"{at}.action", {"casing"})["casing"], f"{at}.action.casing", CASINGS)})
    return {"casing_rules": rules}


HOW = {"integer": "all_values_match_regex", "decimal": "all_values_match_regex", "boolean": "values_in_allowed_set",
       "date": "parse_success_rate_above_threshold", "datetime": "parse_success_rate_above_threshold"}


def _casts(value, path):
    targets = []
    for r, at in _entries(value, path):
        _keys(r, at, {"from", "to", "allowed_if"})
        _among(r["from"], f"{at}.from", ("string",))
        targets.append(_among(r["to"], f"{at}.to", CAST_TARGETS))
        _among(r["allowed_if"], f"{at}.allowed_if", (HOW[r["to"]],))
    return {"cast_targets": targets}


def _required(value, path):
    out = {}
    for r, at in _entries(value, path):
        _keys(r, at, {"role"}, {"required", "failure_action", "owner"})
        if _typed(r.get("required", True), bool, f"{at}.required"):
            out[r["role"]] = (_among(r.get("failure_action", "flag_only"), f"{at}.failure_action", ("flag_only", "quarantine_row")),
                              _among(r.get("owner", "human"), f"{at}.owner", OWNERS))
    return {"required_roles": out}


def _percent_names(value, path):
    out = {}
    for r, at in _entries(_keys(value, path, {"any"})["any"], f"{path}.any"):
        _keys(r, at, set(), {"column_name_regex", "semantic_inference.domain_specific.is_percentage"})
        if "column_name_regex" in r:
            out["percent_name_regex"] = _regex(r["column_name_regex"], f"{at}.column_name_regex")
        if r.get("semantic_inference.domain_specific.is_percentage", True) is not True:
            _fail(at, "columns whose values look like percentages are always found")
    return out


def _percent_range(value, path):
    _keys(value, path, {"min", "max"})
    lo, hi = (_typed(value[k], float, f"{path}.{k}") for k in ("min", "max"))
    return {"percent_range": (lo, hi)} if lo <= hi else _fail(path, "min is above max")


def _grain_rules(value, path):
    out = {}
    for r, at in _entries(value, path):
        _keys(r, at, {"id", "detect_if", "action"}, {"description"})
        want = [{"record_shape.wide_or_long_hint": "unknown"}, {"record_shape.grain_hypothesis": ""}]
        if _keys(r["detect_if"], f"{at}.detect_if", {"all"})["all"] != want:
            _fail(f"{at}.detect_if", f"only {want} can be done")
        out |= decision("grain_review_decision")(r["action"], f"{at}.action")
    return out


def _rejections(value, path):
    found = set()
    for r, at in _entries(value, path):
        _keys(r, at, {"condition"}, {"owner"})
        found.add(_among(r["condition"], f"{at}.condition", ("pii_policy_violation", "unresolved_grain")))
        _among(r.get("owner", "human"), f"{at}.owner", OWNERS)
    out = {} if "pii_policy_violation" in found else {"pii_violation_decision": "human_required"}
    return out | {"unresolved_grain_decision": "reject" if "unresolved_grain" in found else "human_required"}


def _conditions(value, path):
    for r, at in _entries(value, path):
        _among(_keys(r, at, {"condition"})["condition"], f"{at}.condition",
               ("only_optional_columns_affected", "all_critical_fields_valid_after_remediation"))
    return {}


def _weights(value, path):
    out = {k: _typed(v, float, f"{path}.{k}") for k, v in _keys(value, path, {"ambiguity", "validity", "consistency", "completeness"}).items()}
    return {"readiness_weights": out} if abs(sum(out.values()) - 1) < 1e-9 else _fail(path, "the weights don't add up to 1")


def _business(value, path):
    """``name: {enabled, rules: [{if_column, must_be, ...}]}``: rules for tables that have the column."""
    out = []
    for name, group in _typed(value, dict, path).items():
        _keys(group, f"{path}.{name}", {"rules"}, {"enabled"})
        if not _typed(group.get("enabled", True), bool, f"{path}.{name}.enabled"):
            continue
        for i, (r, at) in enumerate(_entries(group["rules"], f"{path}.{name}.rules"), 1):
            _keys(r, at, {"if_column", "must_be"}, {"id", "min", "max", "as_of", "expr"})
            check = _among(r["must_be"], f"{at}.must_be", CHECKS)
            need = {"between": {"min", "max"}, "sql": {"expr"}}.get(check, set())
            _keys(r, at, {"if_column", "must_be"} | need, {"id"} | ({"as_of"} if check == "not_future" else set()))
            out.append({"id": r.get("id", f"{name}_{i}"), "column": _typed(r["if_column"], str, f"{at}.if_column"), "check": check,
                        **{k: r[k] for k in ("min", "max", "as_of", "expr") if k in r}})
    ids = [r["id"] for r in out]
    return {"custom_rules": out} if len(set(ids)) == len(ids) else _fail(path, "two rules share an id")


def _log_schema(value, path):
    from .operators.remediate import LOG

    known = tuple(x.split()[0] for x in LOG.split(", "))
    return texts("log_fields", known)(_keys(value, path, {"fields"})["fields"], f"{path}.fields")


SCHEMA: dict[str, Any] = {
    "policy_spec_version": into("version", str),
    "name": note,
    "purpose": note,
    "default_locale": only("en-US"),
    "default_time_zone": only("UTC"),
    "governance": {
        "principles": note,
        "audit": {"enabled": only(True), "sample_size": into("example_limit", int, low=0),
                  "store_before_after_samples": switch(example_limit=0), "emit_reports": texts("reports", tuple(REPORTS))},
    },
    "scoping": {
        "applies_to": note,
        "severity_levels": only(["info", "warn", "error"]),
        "enforcement_modes": only(list(MODES), list(MODES[::-1])),
        "default_enforcement_mode": into("enforcement_mode", str, MODES),
    },
    "classification": {"column_roles": _roles},
    "null_handling": {
        "trim_whitespace": into("trim_whitespace", bool),
        "whitespace_tokens": texts("whitespace_tokens"),
        "null_tokens_case_insensitive": texts("null_tokens", lower=True),
        "null_token_regexes": texts("null_token_regexes", regex=True),
        "preserve_phrases": texts("preserve_phrases"),
        "treat_zero_string_as_null": {"enabled": into("zero_string_as_null", bool), "applies_to_roles": texts("zero_string_roles"), "note": note},
        "fill_missing": _fills,
    },
    "normalization": {
        "casing": {"default": into("casing_default", str, CASINGS), "rules": _casings},
        "string_cleanup": {"collapse_internal_whitespace": into("collapse_internal_whitespace", bool),
                           "normalize_unicode": into("normalize_unicode", bool)},
    },
    "enumerations": {
        "enable_canonicalization": switch(canonicalize_enabled=False),
        "auto_build_mapping": {
            "enabled": switch(canonicalize_enabled=False),
            "dominance_threshold": into("dominance_threshold", float, low=0, high=1),
            "low_frequency_threshold": into("low_frequency_threshold", float, low=0, high=1),
            "similarity": {"method": only("fuzzy"), "max_edit_distance_ratio": into("max_edit_distance_ratio", float, low=0, high=0.99)},
        },
        "actions": {
            "canonicalize": {"automation": only("programmatic"), "confidence_required": into("canonicalize_confidence", float, low=0, high=1),
                             "fallback": only("human_review")},
            "collapse_rare_to_other": {"enabled": switch(collapse_rare_enabled=False), "other_token": into("other_token", str),
                                       "automation": only("programmatic"), "confidence_required": note},  # a counted share is certain
        },
    },
    "type_coercion": {
        "allow_safe_casts": into("allow_safe_casts", bool),
        "safe_cast_matrix": _casts,
        "parse_thresholds": {"date_time_parse_success_rate_min": into("parse_success_min", float, low=0, high=1)},
        "failure_behavior": {"on_cast_failure": into("on_cast_failure", str, ("set_null_and_flag", "reject_row"))},
    },
    "constraints": {
        "required_fields": _required,
        "uniqueness": {
            "enforce_primary_key_uniqueness": {"enabled": only(False), "note": note},
            "inferred_pk_handling": {"if_primary_key_candidate_true": {"action": only("flag_for_human_confirmation"), "owner": only("human")}},
        },
    },
    "range_validations": {
        "enable": into("ranges_enabled", bool),
        "built_in": {
            "percentage": {"detect_if": _percent_names, "range": _percent_range, "invalid_action": into("percent_action", str, ROW_ACTIONS),
                           "owner": into("percent_owner", str, OWNERS)},
            "non_negative": {"detect_if": {"column_role_in": texts("non_negative_roles")}, "range": {"min": into("non_negative_min", float)},
                             "invalid_action": into("non_negative_action", str, ROW_ACTIONS), "owner": into("non_negative_owner", str, OWNERS)},
        },
        "outliers": {
            "detection": {"enabled": into("outliers_enabled", bool), "method": only("iqr"), "iqr_multiplier": into("iqr_multiplier", float, low=0)},
            "action": into("outlier_action", str, ROW_ACTIONS), "owner": into("outlier_owner", str, OWNERS), "note": note,
        },
    },
    "pii_handling": {
        "enabled": into("pii_enabled", bool),
        "classification": into("pii_classification", str),
        "detection_sources": only(["semantic_inference.pii", "regex_signatures"]),
        "default_action_by_classification": mapping("pii_actions", ("drop_or_mask", "mask", "allow")),
        "masking": {"methods": mapping("pii_mask_methods", MASKS)},
        "enforcement": {"if_contains_pii_true_and_not_allowed": decision("pii_violation_decision")},
        "owner": only("programmatic"),
        "human_review_required_if": only(["pii_detected_in_free_text"]),
    },
    "grain_and_time": {
        "grain_validation": {"enabled": switch(grain_review_decision="proceed"), "rules": _grain_rules},
        "time_column_candidate_handling": {"enabled": switch(many_time_decision="proceed", no_time_decision="proceed"),
                                           "if_multiple_candidates": decision("many_time_decision"),
                                           "if_no_candidates_and_time_required": decision("no_time_decision")},
    },
    "free_text": {
        "default_action": only("preserve_raw_exclude_from_metrics"),
        "optional_nlp_enrichment": {"enabled": only(False), "tasks": note, "owner": note},
    },
    "dataset_decisions": {"reject_dataset_if": _rejections, "proceed_if": _conditions},
    "business_rules": _business,
    "outputs": {
        "remediation_log": {"enabled": only(True), "schema": _log_schema},
        "quality_flags_column": {"enabled": only(True), "name": into("flags_column", str), "format": only("array<string>")},
        "quarantine": {"enabled": into("quarantine_enabled", bool), "target": into("quarantine_target", str), "include_reason": into("quarantine_reason", bool)},
        "ai_readiness_score": {"enabled": switch(), "weights": _weights},
    },
}


def _compile(doc: Any, schema: dict, path: str) -> list[dict[str, Any]]:
    out = []
    for key, value in _typed(doc, dict, path or "policy").items():
        at = f"{path}.{key}" if path else str(key)
        if key not in schema:
            _fail(at, "unknown key")
        out += _compile(value, schema[key], at) if isinstance(schema[key], dict) else [schema[key](value, at)]
    return out


def compile_policy(doc: dict) -> Policy:
    """The policy of a parsed file; keys left out keep their built-in values. Where a section is switched off, that wins."""
    found: dict[str, Any] = {}
    off: dict[str, Any] = {}
    for fields in _compile(doc, SCHEMA, ""):
        off |= fields.pop(OFF, {})
        found |= fields
    policy = Policy(**(found | off))
    if doc.get("outputs", {}).get("ai_readiness_score", {}).get("enabled") is False:
        policy.reports = [r for r in policy.reports if r != "ai_readiness_score"]
    return policy


def read_policy(path: str) -> Policy:
    """The policy of a YAML file."""
    try:
        import yaml  # optional
    except ImportError as exc:  # pragma: no cover
        raise RuntimeError("pyyaml is needed to read a policy file") from exc
    with open(path, encoding="utf-8") as fh:
        return compile_policy(yaml.safe_load(fh) or {})
