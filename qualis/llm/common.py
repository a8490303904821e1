"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qualis.session import checkpoint_dir

ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
ARROW |= {f"array<{k}>": pa.list_(v) for k, v in ARROW.items()}
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors
    and gives the planner the measured size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(docs: DataFrame, label: str) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text``, and ``file``, ``at``: the row's place in the Parquet files it comes
    from, a key of its own also for rows repeated whole, and the same on a retry. Other frames are stored first."""
    columns = [
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
    ]
    try:
        return docs.select(*columns)
    except AnalysisException:  # not read from Parquet
        return stored(docs, label).select(*columns)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def key_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so extra columns can't clash with derived ones."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


_KEPT: dict[str, object] = {}
_USED: set[str] = set()


def in_worker(key: str, make: Callable[[], object]):
    """What ``make`` returns, kept by the Python worker from task to task as long as each task asks for it."""
    _USED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def begun(make: Callable[[], Callable]) -> Callable:
    """``make()`` for a new task; what earlier tasks kept and this one doesn't use is let go: a reused worker would
    hold the tables of all stages so far."""
    _USED.clear()
    fn = make()
    for key in _KEPT.keys() - _USED:
        del _KEPT[key]
    return fn


def per_text(
    df: DataFrame, make: Callable[[], Callable[[list[str | None]], dict[str, list]]], schema: str, keep: list[str] | None = None
) -> DataFrame:
    """Apply a text function to whole texts, in bounded Arrow batches; no shuffle.

    ``make()`` runs once in each task and returns a function from a list of texts (None where null)
    to the new columns, named as in ``schema``. The columns of ``keep`` (default: all) stay.
    """
    kinds = dict(f.strip().split(" ") for f in schema.split(","))
    names = list(kinds)
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    out = df.select(*[df[f"`{c}`"] for c in keep], df["text"].alias("__text"))
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name != "__text"] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = begun(make)
        for whole in batches:
            for b in sliced(whole):
                cols = fn(b.column("__text").to_pylist())
                arrays = [b.column(c) for c in keep] + [pa.array(cols[n], ARROW[kinds[n]]) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return out.mapInArrow(run, fields)


def sliced(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes, one row at least, so that Python objects made of a batch
    stay small however long its texts are."""
    n = max(1, batch.num_rows)
    step = max(1, int(n * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
