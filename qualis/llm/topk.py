"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors become integers, ``floor(64 x)``. Candidates are cut, in the order of their ids, into *segments*, each a
forward index of ``BLOCK``-vector blocks with every term's (dimension's) largest and smallest weight in each block. For
a query, a block's bound is the sum over terms of the most that term can add. Blocks are taken in falling order of
their bounds and scored through the forward index until the bound falls below the query's k-th best score so far.

Queries travel in batches. Segments are dealt to groups, a number that grows with them; every batch meets every segment of
a group, its thresholds going from one segment to the next, and hands on ``k + 1`` results a query row. One of these is
the query itself, if it is among them: rows with its id and score can't be told apart in a result, so any one of them leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualis.llm.common import stored

SCALE, K, EVERY = 64, 20, 20
BLOCK, SEGMENT, BATCH = 128, 4_096, 512
GROUPS, PER_GROUP = 12, 64  # at least as many groups, and at most about as many segments in each
RUNS = 4  # full runs that a packing task is meant to make
HELD = 32  # query batches whose thresholds a task keeps at once
NONE = np.iinfo(np.int64).min
EXACT = 1 << 52


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(whole, F.lit(False))


def packed(rows: DataFrame, size: int, label: str) -> DataFrame:
    """``n, dims, ids, matrix`` (little-endian 64-bit integers): runs of ``size`` rows of ``vec_id, v`` in the
    order of ids; only vectors of one length share a run. ``place`` tells rows apart."""
    parts = -(-rows.count() // (RUNS * size)) or 1
    order = ["dims", "vec_id", "place"]  # the place parts rows that share an id
    dealt = rows.select(F.size("v").alias("dims"), "vec_id", "v", "place").repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, ids, flat, at = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            width = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(width[1:] != width[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    if width[lo] != dims and len(ids):
                        yield row(number + (at := at + 1), dims, ids, flat)
                        ids, flat = ids[:0], flat[:0]
                    dims, part = int(width[lo]), b.slice(lo, hi - lo)
                    ids = np.concatenate([ids, part.column(1).to_numpy()])
                    flat = np.concatenate([flat, part.column(2).flatten().to_numpy(zero_copy_only=False)])
                    while len(ids) >= size:
                        yield row(number + (at := at + 1), dims, ids[:size], flat[: size * dims])
                        ids, flat = ids[size:], flat[size * dims :]
        if len(ids):
            yield row(number + at + 1, dims, ids, flat)

    def row(n, dims, ids, flat) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([dims], pa.int32()), pa.array([ids.tobytes()]), pa.array([flat.astype(np.int64).tobytes()])], names=["n", "dims", "ids", "matrix"])

    return stored(dealt.mapInArrow(run, "n bigint, dims int, ids binary, matrix binary"), label)


class Best:
    """The k best of every query of a batch so far: by score, then smaller id. Candidates that share an id count each."""

    def __init__(self, ids: np.ndarray, k: int):
        self.queries, self.k = ids, k
        self.scores, self.ids = np.full((len(ids), k), NONE), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """New results: for the query at place ``at``, candidate ``ids`` with ``scores``."""
        touched, place = np.unique(at, return_inverse=True)
        k = self.k
        row = np.concatenate([np.repeat(np.arange(len(touched)), k), place])
        every, score = np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((every, ~score, row))  # ~x falls as x grows, without overflow
        first = np.searchsorted(row[order], np.arange(len(touched)))
        take = order[first[:, None] + np.arange(k)]
        self.ids[touched], self.scores[touched] = every[take], score[take]

    def rows(self, batch: int, q: np.ndarray) -> pa.RecordBatch:
        """All results: the query row (``batch``, ``place``), its id, the candidate's, the score, and whether it may be the query."""
        at, place = np.nonzero(self.scores > NONE)
        ids, scores = self.ids[at, place], self.scores[at, place]
        own = (ids == self.queries[at]) & (scores == (q * q).sum(axis=1)[at])
        columns = [np.full(len(at), batch, np.int64), at.astype(np.int64), self.queries[at], ids, scores, own]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["batch", "place", "query_id", "vec_id", "score", "own"])


def search(best: Best, q: np.ndarray, ids: np.ndarray, c: np.ndarray, block: int = BLOCK) -> int:
    """Score a segment ``c`` (its ``ids`` ascending) for the queries ``q``; returns how many blocks were scored."""
    if q.shape[1] and len(c) and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < EXACT:
        q, c = q.astype(np.float64), c.astype(np.float64)  # products and sums are exact below 2**52
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(c, starts, axis=0), np.minimum.reduceat(c, starts, axis=0)
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    scored = 0
    for step in range(len(starts)):
        now = order[:, step]
        alive = np.flatnonzero(bounds[np.arange(len(q)), now].astype(np.int64) >= best.scores[:, -1])
        if not len(alive):  # later bounds are smaller still
            break
        found = []
        for b in np.unique(now[alive]).tolist():
            rows = alive[now[alive] == b]
            scored += len(rows)
            span = slice(starts[b], starts[b] + block)
            scores = (q[rows] @ c[span].T).astype(np.int64)
            i, j = np.nonzero(scores >= best.scores[rows, -1][:, None])
            found.append((rows[i], ids[span][j], scores[i, j]))
        if found and sum(len(f[0]) for f in found):
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return scored


def usable_rows(df: DataFrame, label: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part, and ``place``, a hash of the row's place in its Parquet file: the same on
    a retry. Other frames are stored first."""
    rows = df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    columns = [F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v")]
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place")
    try:
        return rows.select(*columns, place)
    except AnalysisException:  # not read from Parquet
        return stored(rows.select(*columns), label).select("vec_id", "v", place)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, groups: int | None = None, batch: int = BATCH, segment: int = SEGMENT) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` the ``k`` rows of ``vectors`` (all, if fewer) of its
    own length with the highest inner product, ties to the smaller id, without the query row itself.

    ``queries`` are rows of ``vectors``; both have ``vec_id`` and ``embedding``. Null ids, and vectors that are null or hold
    null or non-finite components, take no part. Rows count each, also where they share an id or are repeated whole: each such
    query row has results of its own, and the others are candidates of it. Scores must fit in 64 bits. Empty tables give no
    rows; other columns are not read. ``groups``: into how many the segments are dealt, by default in proportion to them.
    """
    q = packed(usable_rows(queries, "topk-query-rows"), batch, "topk-queries")
    c = packed(usable_rows(vectors, "topk-rows"), segment, "topk-segments")
    groups = groups or max(GROUPS, -(-c.count() // PER_GROUP))
    asked = q.select(F.col("n").alias("batch"), "dims", F.col("ids").alias("q_ids"), F.col("matrix").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    held = c.select("dims", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int").alias("g"), "n", "ids", "matrix")
    met = asked.join(held, ["dims", "g"])  # every batch meets every segment, as the query set is given

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple[int, int], tuple[Best, np.ndarray]] = {}

        def done(key: tuple[int, int]) -> pa.RecordBatch:
            own, asked_ = open_.pop(key)
            return own.rows(key[0], asked_)

        for whole in batches:
            for i in range(whole.num_rows):
                dims, g, n, q_ids, qm, ids, m = (whole.column(x)[i].as_buffer() if x in (3, 4, 5, 6) else whole.column(x)[i].as_py() for x in range(7))
                key = (n, g)
                if key not in open_:
                    if len(open_) >= HELD:
                        yield done(next(iter(open_)))
                    mine = np.frombuffer(q_ids, np.int64).copy()
                    open_[key] = Best(mine, k + 1), np.frombuffer(qm, np.int64).reshape(len(mine), dims).copy()
                own, weights = open_[key]
                search(own, weights, ids := np.frombuffer(ids, np.int64), np.frombuffer(m, np.int64).reshape(len(ids), dims))
        while open_:
            yield done(next(iter(open_)))

    near = met.select("dims", "g", "batch", "q_ids", "q", "ids", "matrix").mapInArrow(run, "batch bigint, place bigint, query_id bigint, vec_id bigint, score bigint, own boolean")
    query = Window.partitionBy("batch", "place")
    best = near.withColumn("r", F.row_number().over(query.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    best = best.withColumn("self", F.min(F.when(F.col("own"), F.col("r"))).over(query))
    rank = F.col("r") - F.when(F.col("self") < F.col("r"), 1).otherwise(0)
    others = best.where(F.col("self").isNull() | (F.col("r") != F.col("self")))
    return others.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def digest(vectors: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by ``EVERY`` against all others."""
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


#: DuckDB SQL for the digest.
ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
