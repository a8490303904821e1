"""Column builders for string semantics.

All builders return native Spark ``Column`` expressions (no Python UDF), so the
compiled fixes stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import Policy

# Characters Python's ``str.strip()`` removes (``str.isspace``), as one regex class
# valid for Java regex and RE2 alike.
WS_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
STRIP_REGEX = f"^{WS_CLASS}+|{WS_CLASS}+$"

# Pattern signatures that must equal the reference's.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL_FULL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_FULL = r"^[\+\(]?[1-9][0-9 .\-\(\)]{8,}[0-9]$"
CURRENCY_FULL = r"^[\$£€¥]?[\d,]+\.?\d{0,2}$"
PERCENT_FULL = r"^\d+\.?\d*%$"
ALNUM_ID_FULL = r"(?i)^[A-Z0-9\-_]+$"
IP_PREFIX = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
# An IPv4-looking token anywhere in a text (free-text scan), same in Java regex and RE2.
IP_ANYWHERE = r"(^|[^0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}([^0-9.]|$)"

# Text accepted by a pandas-style ``to_numeric(errors='coerce')``: decimal or
# scientific notation with optional sign and surrounding blanks, or inf/infinity.
NUMERIC_TEXT = r"(?i)^\s*[+-]?(((\d+\.?\d*)|(\.\d+))(e[+-]?\d+)?|inf|infinity)\s*$"


# Texts longer than this are grouped by their 128-bit MD5 when only equality matters
# (distinct and duplicate counts): the shuffle then moves 37 characters, not the
# text.  The hashed form is longer than the limit, so it never equals a kept text.
LONG_TEXT = 32


def group_key(c: str | Column) -> Column:
    """Equality key of a string: itself when short, a marked MD5 digest when long."""
    x = col_of(c)
    return F.when(F.length(x) <= LONG_TEXT, x).otherwise(F.concat(F.lit("\u0000md5:"), F.md5(x)))


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace and U+001C..U+001F."""
    return F.regexp_replace(col_of(c), STRIP_REGEX, "")


def is_untrimmed(c: str | Column) -> Column:
    """True for strings that differ from their stripped form (NULL stays false)."""
    x = col_of(c)
    return F.coalesce(x != py_strip(x), F.lit(False))


def collapse_whitespace(c: str | Column) -> Column:
    """Runs of inner whitespace become one space (policy string_cleanup)."""
    return F.regexp_replace(col_of(c), f"{WS_CLASS}+", " ")


def anchored(pattern: str) -> str:
    """Python ``re.match`` anchors at the start only; Spark ``rlike`` searches."""
    flags = ""
    if pattern.startswith("(?i)"):
        flags, pattern = "(?i)", pattern[4:]
    return f"{flags}^(?:{pattern})"


def null_token(c: str | Column, policy: Policy | None = None, include_nulls: bool = True,
               zero_is_null: bool = False) -> Column:
    """Policy null-token predicate on a string column.

    True for: a raw whitespace token; a stripped value that is empty, a whitespace
    token, a case-insensitive null token, or matches a null-token regex at its
    start -- unless the stripped value is a preserve phrase.  Real NULLs count when
    ``include_nulls`` (detection); fixes pass ``include_nulls=False``.
    """
    pol = policy or Policy()
    x = col_of(c)
    s = py_strip(x)
    tokenish = (
        x.isin(list(pol.whitespace_tokens))
        | (s == F.lit(""))
        | s.isin(list(pol.whitespace_tokens))
        | F.lower(s).isin([t.lower() for t in pol.null_tokens])
    )
    for rx in pol.null_token_regexes:
        tokenish = tokenish | s.rlike(anchored(rx))
    if zero_is_null:
        tokenish = tokenish | (s == F.lit("0"))
    pred = tokenish & ~s.isin(list(pol.preserve_phrases)) if pol.preserve_phrases else tokenish
    pred = F.coalesce(pred, F.lit(False))
    return (x.isNull() | pred) if include_nulls else pred


def title_case(c: str | Column) -> Column:
    """Python ``str.title()``: the first letter of every run of letters upper-cased,
    the rest lower-cased ("in-progress o'neil x1y" -> "In-Progress O'Neil X1Y")."""
    runs = F.regexp_extract_all(F.lower(col_of(c)), F.lit(r"(\pL+|\PL+)"), 1)
    capped = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30)))
    return F.when(col_of(c).isNull(), F.lit(None).cast("string")).otherwise(F.array_join(capped, ""))


def has_cased(c: str | Column) -> Column:
    x = col_of(c)
    return F.lower(x) != F.upper(x)


def is_lower(c: str | Column) -> Column:
    """Python ``islower``: no upper-case letter and at least one cased letter."""
    x = col_of(c)
    return (x == F.lower(x)) & has_cased(x)


def is_upper(c: str | Column) -> Column:
    x = col_of(c)
    return (x == F.upper(x)) & has_cased(x)


# A letter run starting lower-case, or an upper-case letter inside a run: either
# makes ``x != x.title()``.
NOT_TITLE = r"(?<!\pL)\p{Ll}|\pL\p{Lu}"


def is_title(c: str | Column) -> Column:
    """Python ``istitle``: equals its title case and has a cased letter (one regex search)."""
    x = col_of(c)
    return ~x.rlike(NOT_TITLE) & has_cased(x)


def to_number(c: str | Column) -> Column:
    """pandas ``to_numeric(errors='coerce')`` on text: unparseable -> NULL, 'nan' -> NULL."""
    x = col_of(c)
    return F.when(x.rlike(NUMERIC_TEXT), F.trim(x).try_cast("double")).otherwise(F.lit(None).cast("double"))


DEFAULT_DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy"]


def to_timestamp_safe(c: str | Column, formats: Iterable[str] | None = None) -> Column:
    """String -> TIMESTAMP_NTZ; unparseable -> NULL.  ISO text through ``try_cast``,
    then an ordered list of explicit formats (first success wins), each tried only on text with its punctuation."""
    x = F.trim(col_of(c))
    tries = [x.try_cast("timestamp_ntz")]
    for fmt in formats if formats is not None else DEFAULT_DATETIME_FORMATS[3:]:
        mark = next((ch for ch in fmt if ch in "/.:"), "")
        tries.append(F.when(x.contains(mark), F.try_to_timestamp(x, F.lit(fmt)).cast("timestamp_ntz")))
    return F.coalesce(*tries)


def serial_to_timestamp(c: str | Column) -> Column:
    """Spreadsheet serial day number (fractional days since 1899-12-30) -> TIMESTAMP_NTZ."""
    micros = F.round(col_of(c).cast("double") * F.lit(86400000000.0)).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1899-12-30 00:00:00").cast("timestamp_ntz"))


def hash16(c: str | Column) -> Column:
    """First 16 hex digits of SHA-256 of the value's text; NULL stays NULL."""
    return F.substring(F.sha2(col_of(c).cast("string"), 256), 1, 16)


def tokenize(c: str | Column, salt: str = "qualis") -> Column:
    """Stable pseudonymous token for a PII value (salted SHA-256)."""
    x = col_of(c).cast("string")
    return F.when(x.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(salt), x), 256), 1, 16)))


def mask_if_email(c: str | Column) -> Column:
    """Hash only values containing '@'; other values unchanged."""
    x = col_of(c)
    return F.when(x.contains("@"), hash16(x)).otherwise(x)


def matches(c: str | Column, pattern: str) -> Column:
    """Python ``re.match`` of ``pattern`` (anchored at start), false for NULL."""
    return F.coalesce(col_of(c).rlike(anchored(pattern)), F.lit(False))


def searches(c: str | Column, pattern: str) -> Column:
    return F.coalesce(col_of(c).rlike(pattern), F.lit(False))


def apply_casing(c: str | Column, casing: str) -> Column:
    x = col_of(c)
    if casing == "titlecase":
        return title_case(x)
    if casing == "lowercase":
        return F.lower(x)
    if casing == "uppercase":
        return F.upper(x)
    return x
