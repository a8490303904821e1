"""SimHash near-duplicates with a pigeonring filter.

A fingerprint's bits are cut into ``most + 1`` segments, laid out as a ring. If two fingerprints differ in at most
``most`` bits, some segment of the ring starts a chain whose differences, summed over its first ``l`` segments,
stay within ``l * most / segments`` for every ``l``. The first budget is zero (that segment is equal) and the second
is one (the next differs in one bit at most, so of three parts of it two are equal). Those equal bits are the key
on which candidates meet; the rest of the chain is checked before the full Hamming distance.

Fingerprints meet as distinct values, so copies cost nothing here. In a group that shares a key, members are
reached from one another and leave the search as soon as they are linked: a group of ``n`` that hang together gives
``n - 1`` links, never all its pairs. Groups over ``BLOCK`` members are dealt out in pairs of blocks, all of which
are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import per_text, stored
from qualis.llm.components import components

SHINGLE, MOST, SEED, BITS = 4, 4, 42, 64
BLOCK = 8_192


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes, repeats included.
    Words are runs without ASCII white space, A-Z lower-cased. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(whole[a:b], SEED) for a, b in spans), "<u8", n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``fp`` (the 64 bits as a signed long) beside the columns of ``docs`` (or ``keep``)."""

    def make():
        return lambda texts: {"fp": [v - (1 << BITS) if (v := fingerprint(t, shingle)) >> 63 else v for t in texts]}

    return per_text(docs, make, "fp bigint", keep)


def segments(most: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the ring."""
    cuts = np.linspace(0, BITS, most + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def keyed(fps: DataFrame, most: int) -> DataFrame:
    """``fp, start, g``: ``g`` hashes the bits that a linked pair shares if its chain begins at segment
    ``start``. With two segments or more, that is the segment and all but one third of the next one."""
    ring, keys = segments(most), []

    def bits(first: int, width: int):
        return F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1)

    for i, (first, width) in enumerate(ring):
        follow, size = ring[(i + 1) % len(ring)]
        cut = [size * t // 3 for t in range(4)]
        for t in range(3):
            mask = ((1 << size) - 1) & ~(((1 << cut[t + 1]) - 1) & ~((1 << cut[t]) - 1))
            g = F.xxhash64(F.lit(i), F.lit(t), bits(first, width), bits(follow, size).bitwiseAND(mask))
            keys.append(F.struct(F.lit(i).alias("start"), g.alias("g")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.g")


def near(a: np.ndarray, b: np.ndarray, start: int, ring: list[tuple[int, int]], most: int) -> np.ndarray:
    """Which pairs pass the chain that begins at ``start``, then the full distance."""
    diff = a ^ b
    ok = np.ones(np.broadcast(a, b).shape, bool)
    total = np.zeros(ok.shape, np.uint8)
    for step in range(len(ring) - 1):
        first, width = ring[(start + step) % len(ring)]
        total = total + np.bitwise_count(diff >> np.uint64(first) & np.uint64((1 << width) - 1))
        ok &= total <= (step + 1) * most // len(ring)
    return ok & (np.bitwise_count(diff) <= most)


def spanning(fps: np.ndarray, start: int, ring: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Links that connect what hangs together among distinct ``fps``."""
    rest, out = fps, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = near(rest, at, start, ring, most)
            if hit.any():
                found = rest[hit]
                out += [(int(at), int(x)) for x in found]
                front += list(found)
                rest = rest[~hit]
    return out


def links(fps: DataFrame, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (column ``fp``) at ``most`` differing bits or fewer (1 to 31):
    enough of them that every such pair is connected."""
    if not 1 <= most <= 31:
        raise ValueError("most: 1 to 31 bits")
    ring = segments(most)
    rows = keyed(fps, most)
    large = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block), "simhash-large")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / block)
    own = F.pmod(F.xxhash64("fp", F.lit(1)), blocks)
    dealt = (
        rows.join(large, "g", "left")
        .select("fp", "start", "g", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
        .select("fp", "start", F.when(F.col("own") == F.col("other"), F.xxhash64("g", "own")).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other"))).alias("g"))
    )
    grouped = dealt.select("g", "start", "fp").repartition("g").sortWithinPartitions("g", "start", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64) for _ in range(3)]
        for b in batches:
            cols = [np.concatenate([k, b.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
            if len(cols[0]):
                last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on in the next batch
                yield from found([c[:last] for c in cols])
                kept = [c[last:] for c in cols]
        yield from found(kept)

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        g, start, fp = cols[0], cols[1], cols[2].view(np.uint64)
        if len(g) < 2:
            return
        edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (start[1:] != start[:-1])) + 1, [len(g)]])
        size = np.diff(edges)
        u, v = [], []
        for s in range(len(ring)):  # most groups by far are of two: all at once
            at = edges[:-1][(size == 2) & (start[edges[:-1]] == s)]
            hit = near(fp[at], fp[at + 1], s, ring, most)
            u.append(fp[at][hit])
            v.append(fp[at + 1][hit])
        more = [x for i in np.flatnonzero(size > 2) for x in spanning(fp[edges[i] : edges[i + 1]], int(start[edges[i]]), ring, most)]
        if more:
            pairs = np.array(more, np.uint64)
            u.append(pairs[:, 0])
            v.append(pairs[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return grouped.mapInArrow(run, "u bigint, v bigint").where("u <> v")


def classes(rows: DataFrame, most: int = MOST, key: str = "doc_id") -> DataFrame:
    """``rows`` (with ``fp``) plus ``component_id``, the smallest key reachable over links, itself included, and
    ``root``, the smallest fingerprint reachable.

    Rows with one fingerprint are one node, so copies, repeated rows and texts without words (fingerprint zero) are
    linked like any others. Null keys take part; a class of null keys only has a null id. An empty table gives an empty one.
    """
    nodes = stored(rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    joined = components(links(nodes.select("fp"), most), "simhash-links")
    rooted = nodes.join(joined.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs`` (``doc_id, text``; other columns are not read)."""
    rows = stored(fingerprints(docs.select("doc_id", "text"), shingle, ["doc_id"]), "simhash-rows")
    return classes(rows, most).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """One row of each class of near copies, with the columns of ``docs``: the row whose id is the class id
    (null last); of several such rows, the first as stored. Classes with one id (an id on unrelated texts) stay apart."""
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    held = stored(fingerprints(tagged, shingle, ["doc_id", "row"]), "simhash-stage")
    rows = held.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    best = (
        classes(rows.select("doc_id", "fp", "file", "at"), most)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(F.struct("file", "at")).alias("k"))
        .select("k.*")
    )
    return rows.join(best, ["file", "at"], "left_semi").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` of every row."""
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
