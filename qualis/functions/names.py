"""Driver-side helpers over schema metadata (column names and types only)."""

from __future__ import annotations

import itertools
import re
import zlib

from pyspark.sql import types as T

from ..policy import TABLE_NAME_MAX

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


_WORD = re.compile(r"[^\s_-]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def snake_case(name: str) -> str:
    """The name's words (apart at blanks, hyphens, underscores and where a capital follows a small letter), small,
    joined by single underscores."""
    return "_".join(part for word in _WORD.findall(name) for part in _HUMP.split(word)).lower()


def short_name(name: str, limit: int = TABLE_NAME_MAX) -> str:
    """A name over the limit keeps its head and gets a hash of the whole, so long names stay different."""
    return name if len(name) <= limit else f"{name[:limit - 9]}_{zlib.crc32(name.encode()):08x}"


def wide_table_name(entity: str) -> str:
    return short_name(snake_case(entity).removesuffix("_wide") + "_wide")


def unique_names(names: list[str], taken: tuple[str, ...] = ()) -> list[str]:
    """Snake-case column names; where two fall together, or fall on a ``taken`` one, later ones are numbered."""
    out: list[str] = []
    for name in map(snake_case, names):
        used = {n.lower() for n in (*out, *taken)}
        tries = (name if i == 1 else f"{name}_{i}" for i in itertools.count(1))
        out.append(next(t for t in tries if t.lower() not in used))
    return out


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_numeric_or_bool(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES + (T.BooleanType,))


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, TEMPORAL_TYPES)


def native_type(dt: T.DataType) -> str:
    """Spark's own type name, used where the reference keeps the raw dtype string."""
    return dt.simpleString()


def generic_logical_type(dt: T.DataType) -> str:
    """Typed columns map directly; strings are refined from data by the profiler."""
    if is_temporal(dt):
        return "datetime"
    if isinstance(dt, INTEGRAL_TYPES):
        return "integer"
    if isinstance(dt, FRACTIONAL_TYPES):
        return "decimal"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_string(dt):
        return "string"
    return "unknown"


def sql_type(dt: T.DataType) -> str:
    """Target SQL type of a column in the wide table."""
    if isinstance(dt, INTEGRAL_TYPES):
        return "BIGINT"
    if isinstance(dt, FRACTIONAL_TYPES):
        return "DECIMAL(38,10)"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    return "TEXT"


def spark_type_for_sql(sql: str) -> str:
    """Spark DDL type for a target SQL type."""
    return {
        "BIGINT": "bigint",
        "DECIMAL(38,10)": "decimal(38,10)",
        "TIMESTAMP": "timestamp_ntz",
        "DATE": "date",
        "BOOLEAN": "boolean",
        "TEXT": "string",
    }.get(sql, "string")


def label(name: str) -> str:
    """Display label: underscores to blanks, then Python-style title case."""
    text = name.replace("_", " ")
    return re.sub(r"[^\W\d_]+", lambda m: m.group(0)[0].upper() + m.group(0)[1:].lower(), text.lower())
