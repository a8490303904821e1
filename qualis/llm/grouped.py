"""Corpus-wide counts of hashed keys, for operators that work on groups of whole texts.

Texts are dealt by hash to groups of about so many bytes, compressed. Every group lists its distinct keys with their
counts; the lists meet partitioned by key, so a frequent key comes once from each group; and each group gets back the
corpus count of every key it listed, in the order of its list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import per_text, stored


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    width = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def unpacked(column: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(x.as_py()) for x in column]


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b


def packed(docs: DataFrame, groups: int) -> DataFrame:
    """``doc_id, g, z``: every row's UTF-8 text (null: empty), compressed, and its group.

    Rows are dealt by their place in the Parquet files they come from, so rows repeated whole or under one id spread
    like any others, and a retry deals them the same way. Other frames are stored first.
    """

    def make():
        tool = zstandard.ZstdCompressor(level=3)
        return lambda texts: {"z": [tool.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts]}

    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    try:
        placed = docs.select("doc_id", "text", place.alias("at"))
    except AnalysisException:  # not read from Parquet
        placed = stored(docs.select("doc_id", "text"), "grouped-rows").select("doc_id", "text", place.alias("at"))
    keyed = placed.select("doc_id", "text", F.pmod("at", F.lit(groups)).alias("g"))
    return per_text(keyed, make, "z binary", ["doc_id", "g"])


def corpus_counts(rows: DataFrame, keys_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], parts: int, bits: int) -> DataFrame:
    """``g, part, sums`` of the groups in ``rows`` (from :func:`packed`).

    ``keys_of`` gives a group's distinct keys (ascending, spread evenly over ``bits`` bits, as each part counts an equal
    range of them) and their counts. A plan that also joins
    ``rows`` by group reads the same exchange of texts again.
    """
    edges = np.array([(p << bits) // parts if p < parts else (1 << bits) - 1 for p in range(parts + 1)], np.uint64)

    def listed(table: pa.Table) -> pa.Table:
        keys, counts = keys_of(unpacked(table.column("z")))
        at = np.searchsorted(keys, edges)
        at[-1] = len(keys)
        held = [p for p in range(parts) if at[p + 1] > at[p]] or [0]
        deltas = [np.diff(keys[at[p] : at[p + 1]], prepend=edges[p]) for p in held]
        return pa.table({
            "part": pa.array(held, pa.int64()), "g": pa.array([table.column("g")[0].as_py()] * len(held), pa.int64()),
            "keys": pa.array([planes(d) for d in deltas], pa.binary()), "counts": pa.array([planes(counts[at[p] : at[p + 1]].astype("<u4")) for p in held], pa.binary()),
        })

    lists = rows.groupBy("g").applyInArrow(listed, "part bigint, g bigint, keys binary, counts binary")

    def joined(table: pa.Table) -> pa.Table:
        first = edges[table.column("part")[0].as_py()]
        keys = [np.cumsum(unplanes(k.as_py(), "<u8")) + first for k in table.column("keys")]
        counts = [unplanes(c.as_py(), "<u4") for c in table.column("counts")]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts), len(every)).astype("<u8")  # exact below 2**53
        ends = np.cumsum([0, *map(len, keys)])
        back = [planes(sums[place[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"g": table.column("g"), "part": table.column("part"), "sums": pa.array(back, pa.binary())})

    return lists.groupBy("part").applyInArrow(joined, "g bigint, part bigint, sums binary")


def sums_of(table: pa.Table) -> np.ndarray:
    """A group's corpus counts, in the order of its list."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("sums"), strict=True), key=lambda r: r[0])
    return np.concatenate([unplanes(s.as_py(), "<u8") for _, s in rows]) if rows else np.zeros(0, "<u8")
