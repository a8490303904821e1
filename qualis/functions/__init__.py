"""Column builders (per-row expressions) and schema helpers."""

from .text import (  # noqa: F401
    apply_casing, collapse_whitespace, hash16, is_lower, is_title, is_untrimmed, is_upper,
    mask_if_email, matches, null_token, py_strip, searches, serial_to_timestamp, title_case,
    to_number, to_timestamp_safe, tokenize,
)
from .names import snake_case, sql_type, wide_table_name  # noqa: F401
