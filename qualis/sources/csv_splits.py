"""Quoted CSV with line breaks inside values, read in splits.

Whether a line begins inside quotes depends on all the text before it. But what one line does to either answer is
known from the line alone, so a split can tell, without knowing how it begins, how it would end in both cases:

1. one scan reduces every split of every file to that pair of answers (a row a split);
2. taking the splits of a file in order gives each its true beginning: a prefix composition on the driver, over as many small rows
   as the driver plans splits for;
3. every split then cuts its lines into records. What a split has of records that cross its borders are fragments;
   they meet by the split their record begins in.

If no line of the input leaves quotes open, no record spans lines and Spark's own line-wise reader is given the files instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FLAGS = ["open_outside", "open_inside", "begins_inside", "any_open", "valid"]


def leaves_open(sep: str = ",") -> Callable[[bytes], bool]:
    """A function telling whether a line that begins outside quotes ends inside.

    A value is quoted if it begins with a quote; quotes inside it are doubled; a quote elsewhere is an ordinary character.
    """
    s = re.escape(sep.encode())
    value = rb'(?:"(?:[^"]++|"")*+"[^' + s + rb']*+|(?!")[^' + s + rb"]*+)"
    closed = re.compile(rb"(?:" + value + s + rb")*+" + value)
    return lambda line: b'"' in line and closed.fullmatch(line) is None


@dataclass(frozen=True)
class Split:
    """What a split's lines do: its state at the end if it begins outside or inside quotes, and whether a record begins in it."""

    file: str
    start: int
    length: int
    open_outside: bool
    open_inside: bool
    begins_inside: bool


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                      F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("line"),
                      F.is_valid_utf8(F.col("value")).alias("valid"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], pa.RecordBatch]]:
    """Parts of batches that come from one split, in the order of its lines."""
    for b in batches:
        if not b.num_rows:
            continue
        coded = b.column("file").dictionary_encode().indices
        new = pc.or_(pc.not_equal(coded.slice(1), coded.slice(0, b.num_rows - 1)),
                     pc.not_equal(b.column("start").slice(1), b.column("start").slice(0, b.num_rows - 1)))
        cuts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), b.num_rows]
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(a, e - a)
            yield (part.column("file")[0].as_py(), part.column("start")[0].as_py(), part.column("length")[0].as_py()), part


def scan(spark: SparkSession, path: str, sep: str = ",") -> tuple[list[Split], bool, bool]:
    """The splits of the files under ``path``; whether all text is valid UTF-8; whether some line leaves quotes open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens = leaves_open(sep)
        seen: dict[tuple[str, int, int], list[bool]] = {}
        for key, part in _groups(batches):
            outside, inside, begins, some, valid = seen.get(key, (False, True, False, False, True))  # open, if it began so
            valid &= bool(pc.all(part.column("valid")).as_py())
            last = -1
            for i in pc.indices_nonzero(pc.match_substring(part.column("line"), '"')).to_pylist():
                begins |= not inside
                line = part.column("line")[i].as_py()
                after = {False: opens(line), True: opens(b'"' + line)}
                some |= after[False]
                outside, inside, last = after[outside], after[inside], i
            begins |= last + 1 < part.num_rows and not inside
            seen[key] = (outside, inside, begins, some, valid)
        if seen:
            columns = zip(*[(*k, *v) for k, v in seen.items()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "start", "length", *FLAGS])

    rows = _lines(spark, path).mapInArrow(run, "file string, start bigint, length bigint, " + ", ".join(f"{f} boolean" for f in FLAGS)).collect()
    splits = [Split(r.file, r.start, r.length, r.open_outside, r.open_inside, r.begins_inside) for r in rows]
    return splits, all(r.valid for r in rows), any(r.any_open for r in rows)


def beginnings(splits: list[Split]) -> dict[tuple[str, int], tuple[int, bool, int]]:
    """For every split its length, whether it begins inside quotes, and where the split begins that its first record begins in."""
    out: dict[tuple[str, int], tuple[int, bool, int]] = {}
    inside, origin, file = False, 0, None
    for s in sorted(splits, key=lambda s: (s.file, s.start)):
        if s.file != file:
            inside, origin, file = False, s.start, s.file
        out[s.file, s.start] = (s.length, inside, origin if inside else s.start)
        if not inside or s.begins_inside:
            origin = s.start
        inside = s.open_inside if inside else s.open_outside
    return out


class Cutter:
    """Cuts the lines of one split into records."""

    def __init__(self, key: tuple[str, int, int], begin: tuple[int, bool, int], opens: Callable[[bytes], bool]):
        self.file, self.start, _ = key
        _, self.inside, self.origin = begin
        self.opens, self.crossed, self.first, self.pending = opens, self.inside, self.start == 0, []

    def row(self) -> tuple:
        """What is pending as a piece; the next record begins here."""
        out = (self.file, self.origin, self.start, not self.crossed and not self.inside, self.first and not self.crossed, b"\n".join(self.pending))
        self.first, self.crossed, self.origin, self.pending = self.first and self.crossed, False, self.start, []
        return out

    def add(self, lines: pa.Array) -> Iterator[tuple]:
        for line in lines.to_pylist():
            self.pending.append(line)
            self.inside = self.opens(b'"' + line) if self.inside else self.opens(line)
            if not self.inside:
                yield self.row()

    def end(self) -> list[tuple]:
        return [self.row()] if self.pending else []


def records(spark: SparkSession, path: str, splits: list[Split], sep: str = ",") -> DataFrame:
    """``header, text``: every record of the files, as bytes, and whether it is the first of its file."""
    known = beginnings(splits)
    begin = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens, at, cutter = leaves_open(sep), None, None
        for key, part in _groups(batches):
            rows = []
            if key != at:
                rows += cutter.end() if cutter else []
                if begin.value.get(key[:2], (None,))[0] != key[2]:
                    raise RuntimeError(f"{key[0]} was split in another way than before: set spark.sql.files.minPartitionNum")
                at, cutter = key, Cutter(key, begin.value[key[:2]], opens)
            rows += cutter.add(part.column("line"))
            if rows:
                yield _pieces(rows)
        if cutter and cutter.pending:
            yield _pieces(cutter.end())

    pieces = _lines(spark, path).mapInArrow(run, "file string, start bigint, ordinal bigint, whole boolean, header boolean, text binary")
    out = pieces.where("whole").select("header", "text")
    if not any(inside for _, inside, _ in known.values()) and not any(s.open_outside for s in splits):
        return out  # no record crosses a border
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda p: p.text)
    met = pieces.where("not whole").groupBy("file", "start").agg(F.max("header").alias("header"), parts.alias("parts"))
    join = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), lambda whole, p: F.concat(whole, F.lit(bytearray(b"\n")), p))
    return out.union(met.select("header", join.alias("text")))


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "ordinal", "whole", "header", "text"])
