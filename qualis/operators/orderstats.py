"""Exact order statistics at any size: quantiles by selection, sorted gaps and monotonic checks by ordered scans.

*Selection.* A quantile needs the values at a few ranks, not an order of all. Values map to integers of the same order; a pass
counts them in ``BINS`` equal bins between two integers, and the bin that holds a wanted rank, shrunk to
the values it really has, is what the next pass divides. A bin of at most ``EXACT`` rows is counted value by value. No value is
shuffled: a task hands on counts only, and each pass leaves about one in ``BINS`` of the rows (64 bits need six passes at the very most).

*Ordered scan.* Rows are range partitioned on (key, order, tie, row), sorted in their partition and read in that order once; what a
neighbour in the next partition needs is the first and last row of each partition and key, which are carried across afterwards.
The row number in the range keeps many equal rows from filling one partition.

Group keys are few (one per profiled column), so the per-partition rows of the carry and the counts of a pass are small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a pass, and rows of a bracket that are counted value by value.
BINS, EXACT = 4096, 4096
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- selection
def to_keys(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the values: integers as they are, doubles by their bits (both zeros alike)."""
    if values.dtype.kind in "iu":
        return values.astype(np.int64)
    bits = (values.astype(np.float64) + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & HIGHEST)


def to_value(key: int, integral: bool) -> float:
    if integral:
        return float(key)
    return float(np.int64(key if key >= 0 else key ^ HIGHEST).view(np.float64))


@dataclass(frozen=True)
class Bracket:
    """Part of a group's values that a pass counts: integers from ``low`` to ``high``, in bins or one by one."""

    group: str
    low: int
    high: int
    exact: bool

    @property
    def width(self) -> int:
        return (self.high - self.low) // BINS + 1


class Counts:
    """A task's counts of one bracket: per bin its rows, weight, smallest and largest key."""

    def __init__(self, bracket: Bracket):
        self.bracket, self.bins = bracket, {}

    def add(self, keys: np.ndarray, weights: np.ndarray | None) -> None:
        """Counts sorted keys."""
        b = self.bracket
        a, e = np.searchsorted(keys, b.low, "left"), np.searchsorted(keys, b.high, "right")
        if a == e:
            return
        keys, w = keys[a:e], None if weights is None else weights[a:e]
        at = keys if b.exact else ((keys.view(np.uint64) - np.uint64(b.low % (1 << 64))) // np.uint64(b.width)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:], [len(at)]])
        rows = last - first
        weight = rows if w is None else np.add.reduceat(w, first)
        for i, n, m, lo, hi in zip(at[first].tolist(), rows.tolist(), weight.tolist(), keys[first].tolist(), keys[last - 1].tolist(), strict=True):
            old = self.bins.get(i)
            self.bins[i] = (n, m, lo, hi) if old is None else (old[0] + n, old[1] + m, min(old[2], lo), max(old[3], hi))


PASS = "bracket int, bin bigint, rows bigint, weight bigint, low bigint, high bigint"


def _pass(frame: DataFrame, brackets: list[Bracket], read: Callable) -> dict[Bracket, list[tuple[int, int, int, int]]]:
    """For each bracket, (rows, weight, low, high) of its bins in order; at most ``BINS`` or ``EXACT`` rows each reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counts(b) for b in brackets]
        by_group: dict[str, list[Counts]] = {}
        for c in counts:
            by_group.setdefault(c.bracket.group, []).append(c)
        for batch in batches:
            for group, values, weights in read(batch):
                if group in by_group and len(values):
                    keys = to_keys(values)
                    order = np.argsort(keys) if weights is not None else None
                    keys = np.sort(keys) if order is None else keys[order]
                    for c in by_group[group]:
                        c.add(keys, None if order is None else weights[order])
        rows = [(i, at, *v) for i, c in enumerate(counts) for at, v in c.bins.items()]
        if rows:
            kinds = [pa.int32()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["bracket", "bin", "rows", "weight", "low", "high"])

    met = frame.mapInArrow(run, PASS).groupBy("bracket", "bin").agg(
        F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[Bracket, list[tuple[int, int, int, int]]] = {b: [] for b in brackets}
    for r in met.collect():
        out[brackets[r.bracket]].append((r.rows, r.weight, r.low, r.high))
    return {b: sorted(rows, key=lambda r: r[2]) for b, rows in out.items()}


def _select(frame: DataFrame, groups: list[str], probs: Sequence[float], integral: bool, read: Callable) -> list[tuple[str, float, float]]:
    """(group, p, quantile) with linear interpolation; groups without values are left out."""
    spread = _pass(frame, [Bracket(g, LOWEST, HIGHEST, False) for g in groups], read)
    totals = {b.group: sum(r[1] for r in rows) for b, rows in spread.items() if rows}
    ranks = {g: sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) for g, n in totals.items()}
    found: dict[tuple[str, int], float] = {}
    # ranks still open: (group, rank, rank within the bracket) by bracket
    todo = {b: [(b.group, r, r) for r in ranks[b.group]] for b in spread if b.group in ranks}
    while todo:
        following: dict[Bracket, list[tuple[str, int, int]]] = {}
        for b, open_ in todo.items():
            ends = np.cumsum([r[1] for r in spread[b]])
            for group, rank, inside in open_:
                at = int(np.searchsorted(ends, inside, side="right"))
                rows, weight, low, high = spread[b][at]
                if low == high:
                    found[group, rank] = to_value(low, integral)
                else:
                    nearer = Bracket(group, low, high, rows <= EXACT)
                    following.setdefault(nearer, []).append((group, rank, inside - int(ends[at]) + weight))
        todo = following
        if todo:
            spread = _pass(frame, list(todo), read)
    out = []
    for g, n in totals.items():
        for p in probs:
            h = p * (n - 1)
            low, high = found[g, math.floor(h)], found[g, math.ceil(h)]
            out.append((g, float(p), low if low == high else low + (h - math.floor(h)) * (high - low)))
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles (pandas ``quantile``, SQL ``quantile_cont``) of columns as doubles:
    (column_name, p, q). Nulls and NaN take no part; a column without values has no rows."""
    names = list(columns)
    frame = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])

    def read(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, None]]:
        for i, c in enumerate(names):
            v = batch.column(i).drop_null().to_numpy()
            yield c, v[~np.isnan(v)], None

    rows = _select(frame, names, probs, False, read) if names else []
    return df.sparkSession.createDataFrame(rows, "column_name string, p double, q double")


def weighted_quantiles(freq: DataFrame, key: str, value: str, weight: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of integers that come with how often each occurs: (``key``, p, q). ``freq`` is read
    several times, so it should be cheap to read (stored or cached)."""
    frame = freq.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(F.col(key).cast("string").alias("k"), F.col(value).cast("bigint").alias("v"), F.col(weight).cast("bigint").alias("w"))

    def read(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        keys = batch.column("k")
        for k in pc.unique(keys).to_pylist():
            part = batch.filter(pc.equal(keys, k))
            yield k, part.column("v").to_numpy(), part.column("w").to_numpy()

    groups = [r.k for r in frame.select("k").distinct().collect()]  # one a profiled column
    rows = _select(frame, groups, probs, True, read) if groups else []
    return freq.sparkSession.createDataFrame(rows, f"`{key}` string, p double, q double")


# ------------------------------------------------------------- ordered scan
def _ordered(df: DataFrame, *order: str) -> DataFrame:
    """Rows range partitioned and sorted; rows equal in ``order`` may go to several partitions."""
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.repartitionByRange(*order, "_row").sortWithinPartitions(*order).drop("_row")


def _parts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of one key, in order."""
    for b in batches:
        if b.num_rows:
            codes = b.column(key).dictionary_encode().indices
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(pc.not_equal(codes.slice(1), codes.slice(0, b.num_rows - 1))).to_pylist()), b.num_rows]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                yield b.column(key)[a].as_py(), b.slice(a, e - a)


def consecutive_gaps(values: DataFrame, key: str, value: str) -> DataFrame:
    """Gaps between consecutive sorted integers (as ``diff()`` of a sorted series): (``key``, gap, weight).

    ``values`` has (key, value) with repeats, which give zero gaps; distinct values are scanned in order. The result is cached; unpersist it when done.
    """
    freq = values.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ends: dict[str, list[int]] = {}
        for k, b in _parts(batches, "k"):
            v, n = b.column("v").to_numpy(), b.column("n").to_numpy()
            before = ends[k][1:] if k in ends else []
            gaps, weights = np.unique(np.diff(np.concatenate([np.array(before, np.int64), v])), return_counts=True)
            repeats = int(n.sum()) - len(n)
            rows = [(k, int(g), int(w)) for g, w in zip(gaps, weights, strict=True)] + ([(k, 0, repeats)] if repeats else [])
            ends[k] = [ends[k][0] if k in ends else int(v[0]), int(v[-1])]
            if rows:
                columns = list(zip(*rows, strict=True))
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), none, none, none], names=names)
        if ends:
            none = pa.nulls(len(ends), pa.int64())
            first, last = zip(*ends.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.string()), none, none, pa.array([part] * len(ends), pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=names)

    names = ["k", "gap", "weight", "part", "first", "last"]
    rows = _ordered(freq, "k", "v").mapInArrow(run, "k string, gap bigint, weight bigint, part bigint, first bigint, last bigint").persist()
    across = Window.partitionBy("k").orderBy("part")
    between = rows.where(F.col("part").isNotNull()).select("k", (F.col("first") - F.lag("last").over(across)).alias("gap"), F.lit(1).cast("bigint").alias("weight"))
    inside = rows.where(F.col("gap").isNotNull()).select("k", "gap", "weight")
    every = inside.unionByName(between.where(F.col("gap").isNotNull()))
    gaps = every.groupBy(F.col("k").alias(key), "gap").agg(F.sum("weight").alias("weight")).persist()
    gaps.count()
    rows.unpersist()
    return gaps


def _sign(cur: Column, prev: Column) -> Column:
    return F.when(cur < prev, -1).when(cur > prev, 1).when(prev.isNotNull(), 0)


def monotonic_flags(df: DataFrame, key: str, value: str, order: str, tie: str | None = None) -> DataFrame:
    """Is ``value`` non-decreasing / non-increasing when rows are read in ``order`` (of any type that has an order)?

    ``tie`` orders rows that share an order value (the value itself if there is none, so the answer never depends on how
    rows came). Returns (``key``, increasing, decreasing, is_monotonic).
    """
    base = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(tie or value).alias("t"), F.col(value).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept: dict[str, list] = {}
        for k, b in _parts(batches, "k"):
            v = b.column("v")
            first, last, down, up = kept.get(k, [v.slice(0, 1), None, 0, 0])
            if last is not None:
                v = pa.concat_arrays([last, v])
            a, e = v.slice(0, len(v) - 1), v.slice(1)
            down += pc.sum(pc.less(e, a)).as_py() or 0
            up += pc.sum(pc.greater(e, a)).as_py() or 0
            kept[k] = [first, v.slice(len(v) - 1), down, up]
        if kept:
            first, last, down, up = zip(*kept.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array([part] * len(kept), pa.int64()), pa.concat_arrays(first), pa.concat_arrays(last),
                                              pa.array(down, pa.int64()), pa.array(up, pa.int64())], names=["k", "part", "first", "last", "down", "up"])

    kind = base.schema["v"].dataType.simpleString()
    ends = _ordered(base, "k", "o", "t").select("k", "v").mapInArrow(run, f"k string, part bigint, first {kind}, last {kind}, down bigint, up bigint")
    step = ends.select("*", _sign(F.col("first"), F.lag("last").over(Window.partitionBy("k").orderBy("part"))).alias("s"))
    res = step.groupBy(F.col("k").alias(key)).agg((F.sum("down") + F.count_if(F.col("s") < 0)).alias("_dn"), (F.sum("up") + F.count_if(F.col("s") > 0)).alias("_up"))
    inc, dec = F.col("_dn") == 0, F.col("_up") == 0
    return res.select(key, inc.alias("increasing"), dec.alias("decreasing"), (inc | dec).alias("is_monotonic"))


def quantile_column(p_rows: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Pivot (keys, p, q) into one column per probability."""
    k = list(keys)
    aggs: list[Column] = [F.max(F.when(F.abs(F.col("p") - F.lit(float(p))) < 1e-12, F.col("q"))).alias(n)
                          for p, n in zip(probs, names)]
    return p_rows.groupBy(*k).agg(*aggs)
