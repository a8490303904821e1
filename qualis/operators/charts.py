"""Chart-ready aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N


def column_kinds(df: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Numeric columns, text columns, and columns whose name contains 'date'."""
    numeric = [f.name for f in df.schema.fields if N.is_numeric(f.dataType)]
    text = [f.name for f in df.schema.fields if N.is_string(f.dataType)]
    dates = [c for c in df.columns if "date" in c.lower()]
    return numeric, text, dates


def summary_stats(df: DataFrame, limit: int = 5) -> DataFrame:
    """sum/mean/min/max of the first numeric columns, one aggregation."""
    numeric = column_kinds(df)[0][:limit]
    aggs = []
    for i, c in enumerate(numeric):
        v = F.col(c).cast("double")
        aggs += [F.sum(v).alias(f"s{i}"), F.avg(v).alias(f"a{i}"), F.min(v).alias(f"n{i}"), F.max(v).alias(f"x{i}")]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i + 1).alias("position"), F.col(f"s{i}").alias("sum"),
                     F.col(f"a{i}").alias("mean"), F.col(f"n{i}").alias("min"), F.col(f"x{i}").alias("max"))
            for i, c in enumerate(numeric)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def bar(df: DataFrame, category: str | None = None, measure: str | None = None, limit: int = 10) -> DataFrame:
    """Sum of the measure per category; NULL category dropped; first groups in key order."""
    numeric, text, _ = column_kinds(df)
    k, m = category or text[0], measure or numeric[0]
    whole = isinstance(df.schema[m].dataType, N.INTEGRAL_TYPES)  # a sum of longs can pass 64 bits
    v = F.col(m).cast("decimal(38,0)") if whole else F.col(m)
    return (df.where(F.col(k).isNotNull()).groupBy(k).agg(F.sum(v).alias("value"))
              .orderBy(k).limit(limit).select(F.col(k).cast("string").alias("label"), "value"))


def pie(df: DataFrame, category: str | None = None, limit: int = 5) -> DataFrame:
    """The most frequent categories (ties by label)."""
    k = category or column_kinds(df)[1][0]
    return (df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("value"))
              .orderBy(F.desc("value"), F.asc(k)).limit(limit).select(F.col(k).cast("string").alias("label"), "value"))


def line(df: DataFrame, x: str | None = None, y: str | None = None, limit: int = 20) -> DataFrame:
    """P20: first rows of (date column, first measure) in date order."""
    numeric, _, dates = column_kinds(df)
    xc, yc = x or dates[0], y or numeric[0]
    return df.select(F.col(xc).alias("x"), F.col(yc).alias("y")).orderBy("x", "y").limit(limit)


def kpis(df: DataFrame, limit: int = 4) -> DataFrame:
    """Totals of the first numeric columns with display labels."""
    numeric = column_kinds(df)[0][:limit]
    aggs = [F.sum(F.col(c).cast("double")).alias(f"t{i}") for i, c in enumerate(numeric)]
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.lit(N.label(c)).alias("label"),
                     F.col(f"t{i}").alias("total")) for i, c in enumerate(numeric)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sample_rows(df: DataFrame, key: str | list[str], n: int = 10) -> DataFrame:
    """The first rows in key order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)
