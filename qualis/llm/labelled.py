"""Labelled rows for the classifiers: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """``doc_id, text, y, n`` of at most ``rows`` different labelled rows outside the held-out remainder; ``n`` says
    how often the row is there, which is its weight.

    The rows are those with the smallest hash of their id and text: the same ones at every run, and at most ``rows``
    however many rows share an id. Null labels and ids teach nothing; a key labelled more than once counts once, with
    its smallest label. Of rows that share an id, each different text may be taken.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), modulus) != held))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    taken = hashed.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).join(known, "doc_id").orderBy("h", "doc_id").limit(rows)
    found = hashed.join(F.broadcast(taken), ["doc_id", "h"])  # broadcast: `rows` rows of 28 bytes
    return found.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y"), F.first("n").alias("n")).select("doc_id", "text", "y", "n")
