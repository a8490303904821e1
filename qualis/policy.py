"""Data-quality policy and wide-table spec.

The policy is plain driver-side configuration; it is compiled into Column
expressions by :mod:`qualis.functions` and the operators.  A YAML file with the
same layout may be loaded with :func:`load_policy` (needs ``pyyaml``).
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the reference policy for identical results.
# ---------------------------------------------------------------------------
POLICY_VERSION = "0.1.0"
WHITESPACE_TOKENS = ["", " ", "\t", "\n", "\r", "\u00a0"]
NULL_TOKENS = ["null", "n/a", "na", "none", "nan"]
NULL_TOKEN_REGEXES = ["^-+$"]
PRESERVE_PHRASES = ["No challenges encountered", "none required"]
ROLE_CRITICALITY = {
    "identifier": "critical",
    "timestamp": "critical",
    "measure": "high",
    "dimension": "medium",
    "status": "medium",
    "free_text": "low",
    "geo": "medium",
    "foreign_key": "high",
    "derived": "low",
    "metadata": "low",
}
FILL_RULES = [{"column_name_regex": "(?i)email", "value": "unknown@domain.com", "action": "fill_unknown_member"}]
CASING_RULES = [
    {"column_role_in": ["status"], "casing": "titlecase"},
    {"column_name_regex": "(?i)email", "casing": "lowercase"},
]
CASING_DEFAULT = "preserve"
PARSE_SUCCESS_MIN = 0.98
REQUIRED_ROLES = {"identifier": ("quarantine_row", "human"), "timestamp": ("quarantine_row", "human")}
PII_MASK_METHODS = {"email": "hash", "phone": "hash", "name": "tokenize", "ssn": "drop", "ip": "hash"}
PII_ACTION_BY_CLASSIFICATION = {
    "public": "drop_or_mask",
    "internal": "mask",
    "confidential": "mask",
    "restricted": "mask",
}
PERCENT_RANGE = (0.0, 100.0)
PERCENT_NAME_REGEX = "(?i)percent|pct|rate"
IQR_MULTIPLIER = 1.5
DOMINANCE_THRESHOLD = 0.80
LOW_FREQUENCY_THRESHOLD = 0.005
MAX_EDIT_DISTANCE_RATIO = 0.15
CANONICALIZE_CONFIDENCE = 0.90
OTHER_TOKEN = "OTHER"
READINESS_WEIGHTS = {"ambiguity": 0.40, "validity": 0.25, "consistency": 0.20, "completeness": 0.15}
FLAGS_COLUMN = "_dq_flags"
CAST_TARGETS = ["integer", "decimal", "boolean", "date", "datetime"]
REPORTS = ["remediation_summary", "column_quality_ledger", "ai_readiness_score"]

# Wide-table spec fixed values.
TIME_NAME_REGEX = "(?i)date|time|month|week|year|period|as_of|snapshot"
PLAN_ROLE_RULES = [
    {"id": "WTT-R1", "role_hints_contains": "identifier", "assign": "identifier_code"},
    {"id": "WTT-R2", "role_hints_contains": "timestamp", "assign": "time_dimension"},
    {"id": "WTT-R3", "logical_type_in": ["integer", "decimal"], "assign": "measure"},
    {"id": "WTT-R4", "role_hints_contains": "free_text", "assign": "free_text"},
    {"id": "WTT-R5", "column_name_regex": "(?i)status|state|flag", "assign": "analytic_dimension"},
]
GRAIN_CONFIDENCE_THRESHOLD = 0.75
SPARSE_NULL_RATE = 0.85
YES_NO_VALUES = ["yes", "no", "true", "false", "1", "0", "1.0", "0.0"]
TABLE_NAME_MAX = 63
MAX_WIDE_TABLES = 5


@dataclass
class Policy:
    """Driver-side view of the policy; every field has the reference default."""

    trim_whitespace: bool = True
    whitespace_tokens: list[str] = field(default_factory=lambda: list(WHITESPACE_TOKENS))
    null_tokens: list[str] = field(default_factory=lambda: list(NULL_TOKENS))
    null_token_regexes: list[str] = field(default_factory=lambda: list(NULL_TOKEN_REGEXES))
    preserve_phrases: list[str] = field(default_factory=lambda: list(PRESERVE_PHRASES))
    zero_string_as_null: bool = False
    zero_string_roles: list[str] = field(default_factory=lambda: ["dimension", "status"])
    fill_rules: list[dict] = field(default_factory=lambda: copy.deepcopy(FILL_RULES))
    casing_rules: list[dict] = field(default_factory=lambda: copy.deepcopy(CASING_RULES))
    casing_default: str = CASING_DEFAULT
    collapse_internal_whitespace: bool = False  # text cleanup joins the fix chain where a policy file asks for it
    normalize_unicode: bool = False
    parse_success_min: float = PARSE_SUCCESS_MIN
    role_criticality: dict[str, str] = field(default_factory=lambda: dict(ROLE_CRITICALITY))
    required_roles: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(REQUIRED_ROLES))
    pii_enabled: bool = True
    pii_classification: str = "internal"
    pii_mask_methods: dict[str, str] = field(default_factory=lambda: dict(PII_MASK_METHODS))
    pii_actions: dict[str, str] = field(default_factory=lambda: dict(PII_ACTION_BY_CLASSIFICATION))
    pii_violation_decision: str = "reject"
    ranges_enabled: bool = True
    percent_range: tuple[float, float] = PERCENT_RANGE
    percent_name_regex: str = PERCENT_NAME_REGEX
    percent_action: str = "set_null_and_flag"
    percent_owner: str = "programmatic"
    non_negative_roles: list[str] = field(default_factory=lambda: ["measure"])
    non_negative_min: float = 0.0
    non_negative_action: str = "flag_only"
    non_negative_owner: str = "human"
    outliers_enabled: bool = True
    iqr_multiplier: float = IQR_MULTIPLIER
    outlier_action: str = "flag_only"
    outlier_owner: str = "human"
    canonicalize_enabled: bool = True
    collapse_rare_enabled: bool = True
    dominance_threshold: float = DOMINANCE_THRESHOLD
    low_frequency_threshold: float = LOW_FREQUENCY_THRESHOLD
    max_edit_distance_ratio: float = MAX_EDIT_DISTANCE_RATIO
    canonicalize_confidence: float = CANONICALIZE_CONFIDENCE
    other_token: str = OTHER_TOKEN
    readiness_weights: dict[str, float] = field(default_factory=lambda: dict(READINESS_WEIGHTS))
    allow_safe_casts: bool = True
    cast_targets: list[str] = field(default_factory=lambda: list(CAST_TARGETS))
    on_cast_failure: str = "set_null_and_flag"
    unresolved_grain_decision: str = "reject"
    grain_review_decision: str = "human_required"
    many_time_decision: str = "human_required"
    no_time_decision: str = "human_required"
    reports: list[str] = field(default_factory=lambda: list(REPORTS))
    example_limit: int = 4
    log_fields: list[str] | None = None  # None: all
    flags_column: str = FLAGS_COLUMN
    quarantine_enabled: bool = True
    quarantine_target: str = "quarantine"
    quarantine_reason: bool = True
    enforcement_mode: str = "enforce"
    custom_rules: list[dict] = field(default_factory=list)
    version: str = POLICY_VERSION

    def criticality(self, role: str) -> str:
        return self.role_criticality.get(role, "low")

    def mask_enabled(self) -> bool:
        action = self.pii_actions.get(self.pii_classification, "mask")
        return self.pii_enabled and action in ("mask", "drop_or_mask")


def load_policy(path: str | None = None) -> Policy:
    """The policy of a YAML file; see :mod:`qualis.policy_file`. Without a path, the built-in one."""
    if path is None:
        return Policy()
    from .policy_file import read_policy

    return read_policy(path)
