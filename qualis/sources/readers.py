"""Readers: test tables, files by suffix, CSV with encoding fallback, multi-entity sets."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_splits as CS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FORMATS = {".csv": "csv", ".txt": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}
ENCODINGS = ["utf-8", "iso-8859-1"]  # latin-1 decodes any byte, so later fallbacks are unreachable


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes NULL: a missing value is missing whatever its encoding."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(F.col(f.name)), F.lit(None).cast(f.dataType))
                         .otherwise(F.col(f.name)).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs) if changed else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return fold_nan(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))


def detect_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in FORMATS:
        return FORMATS[ext]
    if ext in (".xlsx", ".xls", ".xlsm"):
        raise ValueError(f"spreadsheet files have no Spark source; export each sheet to CSV/parquet: {path}")
    if os.path.isdir(path):
        return "parquet"
    raise ValueError(f"Unsupported file type: {ext or path}")


def read_csv(spark: SparkSession, path: str, infer_schema: bool = False, multi_line: bool = True, sep: str = ",") -> DataFrame:
    """Header CSV; UTF-8 unless the file holds undecodable bytes, then latin-1.

    Quotes follow RFC 4180: doubled inside quoted values, which may hold new lines (unless ``multi_line`` is off). Large
    files are split either way, see :mod:`qualis.sources.csv_splits`: one scan finds the encoding and whether any
    record spans lines; if none does, Spark's line-wise reader takes over. Values are kept as raw strings (null tokens
    are a policy matter, see :func:`qualis.functions.null_token`). ``infer_schema`` infers types by Spark's own
    reader, which takes a whole file in one task if records span lines.
    """
    splits, valid, spans = CS.scan(spark, path, sep)
    encoding = ENCODINGS[0] if valid else ENCODINGS[1]
    spans = spans and multi_line
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": str(spans).lower()}
    reader = spark.read.options(header=True, encoding=encoding, inferSchema=infer_schema, **options)
    if not spans:
        return fold_nan(reader.csv(path))
    names = reader.csv(path).schema
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in names)
    text = F.regexp_replace(F.decode("text", encoding), "\r$", "")
    rows = CS.records(spark, path, splits, sep).where("not header").select(text.alias("text")).where(F.col("text") != "")
    return fold_nan(rows.select(F.from_csv("text", ddl, options).alias("r")).select("r.*"))


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or detect_format(path)
    if fmt == "csv":
        return read_csv(spark, path)
    return fold_nan(spark.read.format(fmt).load(path))


def read_entities(spark: SparkSession, paths: str | Iterable[str] | Mapping[str, str]) -> dict[str, DataFrame]:
    """Several inputs as named entities (the reference's sheets): name -> DataFrame."""
    if isinstance(paths, str):
        paths = [paths]
    if not isinstance(paths, Mapping):
        paths = {os.path.splitext(os.path.basename(p.rstrip("/")))[0]: p for p in paths}
    return {name: read_any(spark, p) for name, p in paths.items()}


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Iterable[str] | None = None) -> DataFrame:
    """Fixed-size seeded sample: the n rows with the smallest seeded hash of the key
    (all columns by default).  ``orderBy().limit()`` runs as a distributed top-n."""
    cols = list(key) if key else df.columns
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), *cols).limit(n)
