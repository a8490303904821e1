"""Sinks of a run, and the readers of what earlier stages wrote.

An artifact is a folder with ``data/`` and ``manifest/``. A write goes to a new folder under ``data/`` and counts only once a small manifest
entry names it, as the job's last step; for each run and entity the newest entry is the one that readers follow. So a
job that fails leaves what was there before, and a retry replaces it whole, also with fewer rows or none. Entries keep the
schema, so no type is guessed from folder names or text files.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = "run_id string, entity string, folder string, fmt string, schema string, published bigint"


def new_run_id(now: _dt.datetime | None = None) -> str:
    """Run identifier ``YYYY-MM-DD_HH-MM-SS`` (UTC)."""
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return now.strftime("%Y-%m-%d_%H-%M-%S")


def write_artifact(df: DataFrame, base: str, name: str, run_id: str, fmt: str = "parquet",
                   partition_by: list[str] | None = None, source: bool = False, entity: str | None = None) -> str:
    """Write ``df`` as ``name`` of the run and entity, replacing what they had, and return the artifact's path.

    Without ``entity``, a report's rows tell it (its ``entity_name``, if it is one for all rows); else the artifact is
    the run's as a whole. ``source`` marks a copy of source data, whose columns mean nothing here."""
    if source and "run_id" in df.columns:
        raise ValueError("a source column is called run_id: rename it first")
    if entity is None and not source and "entity_name" in df.columns:
        some = [r[0] for r in df.select(F.col("entity_name").cast("string")).distinct().limit(2).collect()]
        entity = some[0] if len(some) == 1 else None
    path = os.path.join(base, name)
    at = time.time_ns()
    folder = f"data/{at:020d}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.format(fmt).save(os.path.join(path, folder))
    entry = [(run_id, entity or "", folder, fmt, df.schema.json(), at)]
    df.sparkSession.createDataFrame(entry, ENTRY).coalesce(1).write.json(os.path.join(path, "manifest", folder[5:]))
    return path


def manifest(spark: SparkSession, base: str, name: str) -> list:
    """The newest entry of each run and entity (one row each)."""
    rows = spark.read.schema(ENTRY).option("recursiveFileLookup", "true").json(os.path.join(base, name, "manifest"))
    newest = rows.groupBy("run_id", "entity").agg(F.max_by(F.struct("folder", "fmt", "schema"), F.struct("published", "folder")).alias("e"))
    return newest.select("run_id", "entity", "e.*").orderBy("run_id", "entity").collect()


def save_original(df: DataFrame, base: str, run_id: str, entity: str) -> str:
    return write_artifact(df, base, f"original/{entity}", run_id, source=True, entity=entity)


def save_remediated(df: DataFrame, base: str, run_id: str, entity: str, fmt: str = "parquet") -> str:
    return write_artifact(df, base, f"remediated/{entity}", run_id, fmt=fmt, source=True, entity=entity)


def save_profile(column_profile: DataFrame, base: str, run_id: str, fmt: str = "json", entity: str | None = None) -> str:
    return write_artifact(column_profile, base, "profile", run_id, fmt=fmt, entity=entity)


def save_issues(issues: DataFrame, base: str, run_id: str, fmt: str = "json", entity: str | None = None) -> str:
    return write_artifact(issues, base, "issues", run_id, fmt=fmt, entity=entity)


def save_plan(plan_columns: DataFrame, base: str, run_id: str, fmt: str = "json", entity: str | None = None) -> str:
    return write_artifact(plan_columns, base, "wide_plan", run_id, fmt=fmt, entity=entity)


def save_summary(summary: DataFrame, base: str, run_id: str, fmt: str = "json", entity: str | None = None) -> str:
    """What the run changed, one row an entity (see :func:`qualis.operators.remediate.remediation_summary`)."""
    return write_artifact(summary, base, "remediation_summary", run_id, fmt=fmt, entity=entity)


def read_artifact(spark: SparkSession, base: str, name: str, run_id: str | None = None,
                  fmt: str | None = None, entity: str | None = None) -> DataFrame:
    """Published rows of an artifact with their ``run_id``: of all runs and entities, or of the ones named.

    ``fmt`` picks entries of one format. An artifact never published has no manifest, which Spark reports as a missing path."""
    entries = manifest(spark, base, name)
    kept = [e for e in entries if run_id in (None, e.run_id) and entity in (None, e.entity) and fmt in (None, e.fmt)]
    if not kept:  # nothing of that run: no rows, in the columns of the newest entry
        schema = T.StructType.fromJson(json.loads(entries[-1].schema))
        return spark.createDataFrame([], schema).withColumn("run_id", F.lit(run_id))
    out = None
    for e in kept:
        schema = T.StructType.fromJson(json.loads(e.schema))
        part = spark.read.schema(schema).format(e.fmt).load(os.path.join(base, name, e.folder)).select(*[F.col(f"`{c}`") for c in schema.names])
        part = part.withColumn("run_id", F.lit(e.run_id))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

