"""The approximate mode: mergeable sketches of every column, kept as binary columns of a profile table.

An explicit choice of the caller, never made by size. One scan makes one row a column: a HyperLogLog sketch of its distinct values, a
KLL sketch of its numbers, a frequent-items sketch of its texts. Rows of several runs, files or partitions merge into one without the
data; what is asked of a sketch is asked at reading time.

Expected errors: distinct counts 1.04 / sqrt(2**``LOG_K``) relative (0.8 % at 14; the tests allow five times that), quantile ranks about
1.3 % (``k`` 200 of Spark's KLL sketches), frequent items exact while a column has fewer than three quarters of ``TRACKED`` values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

#: Log of a distinct sketch's registers, and items that a frequent-items sketch keeps.
LOG_K, TRACKED = 14, 1024
KEYS = ["entity_name", "column_name"]


def column_sketches(df: DataFrame, entity: str, run_id: str = "") -> DataFrame:
    """``entity_name, column_name, run_id, row_count, value_count, distinct_sketch, number_sketch, top_sketch`` of every column,
    from one scan. ``number_sketch`` is null for columns that are not numeric."""
    rows, aggs = [], [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        text = c.cast("string")
        numeric = N.is_numeric(f.dataType)
        aggs += [F.count(c).alias(f"v{i}"), F.hll_sketch_agg(text, LOG_K).alias(f"d{i}"),
                 F.expr(f"approx_top_k_accumulate(cast(`{f.name.replace('`', '``')}` as string), {TRACKED})").alias(f"t{i}")]
        if numeric:
            aggs.append(F.kll_sketch_agg_double(c.cast("double")).alias(f"k{i}"))
        rows.append(F.struct(F.lit(entity).alias("entity_name"), F.lit(f.name).alias("column_name"), F.lit(run_id).alias("run_id"), F.col("n").alias("row_count"),
                             F.col(f"v{i}").alias("value_count"), F.col(f"d{i}").alias("distinct_sketch"),
                             (F.col(f"k{i}") if numeric else F.lit(None).cast("binary")).alias("number_sketch"), F.col(f"t{i}").alias("top_sketch")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merged(sketches: DataFrame) -> DataFrame:
    """One row for each entity and column, over all runs in ``sketches``; the same columns but ``run_id``."""
    return sketches.groupBy(*KEYS).agg(
        F.sum("row_count").alias("row_count"), F.sum("value_count").alias("value_count"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.when(F.count("number_sketch") > 0, F.kll_merge_agg_double("number_sketch")).alias("number_sketch"), F.expr(f"approx_top_k_combine(top_sketch, {TRACKED})").alias("top_sketch"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """``entity_name, column_name, row_count, value_count, distinct_estimate``."""
    return sketches.select(*KEYS, "row_count", "value_count", F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"))


def quantile_estimates(sketches: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``entity_name, column_name, p, q`` of the numeric columns that have values."""
    sketch = F.when(F.col("value_count") > 0, F.col("number_sketch"))  # a sketch of nothing can't be asked
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))).alias("q")) for p in probs]))
    return sketches.select(*KEYS, each.alias("r")).select(*KEYS, "r.*").where(F.col("q").isNotNull())


def top_estimates(sketches: DataFrame, k: int = 10) -> DataFrame:
    """``entity_name, column_name, value, count`` of the most frequent values."""
    items = F.explode(F.expr(f"approx_top_k_estimate(top_sketch, {int(k)})"))
    return sketches.where(F.col("value_count") > 0).select(*KEYS, items.alias("r")).select(*KEYS, F.col("r.item").alias("value"), F.col("r.count").alias("count"))
