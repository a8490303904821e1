"""Splittable CSV: the same rows as a sequential parser's, however the files are split."""

from __future__ import annotations

import csv
import io
import random

import pytest

from qualis.sources import csv_splits as CS
from qualis.sources.readers import read_csv

COLUMNS = ["id", "a b", "text", "last"]


def table(seed, n, line="\n"):
    rng = random.Random(seed)
    pieces = ["x", "é", '"', ",", "\n", "\n\n", "word ", '""', "\n,\n", '"\n"', " ", "'", "longer text without anything " * 3]
    rows = [[str(i), *["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(3)]] for i in range(n)]
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=line)
    w.writerow(COLUMNS)
    w.writerows(rows)
    return rows, out.getvalue()


def want(rows):
    return sorted((tuple(v or None for v in r) for r in rows), key=repr)


@pytest.fixture()
def split_size(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(k) for k in keys]

    def fix(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")

    yield fix
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [97, 1500, 20_000, 10_000_000])
def test_rows_do_not_depend_on_splits(spark, tmp_path, split_size, size):
    every = []
    for k in range(3):
        rows, text = table(k, 80)
        every += rows
        (tmp_path / f"{k}.csv").write_text(text, encoding="utf-8", newline="")
    split_size(size)
    got = read_csv(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want(every)
    total = sum(f.stat().st_size for f in tmp_path.iterdir())
    splits, valid, spans = CS.scan(spark, str(tmp_path))
    assert valid and spans and len(splits) >= 0.5 * total / size
    if size == 97:
        known = CS.beginnings(splits)
        assert sum(inside for _, inside, _ in known.values()) > 10
        assert any(start > origin + 97 for (_, start), (_, inside, origin) in known.items() if inside)  # a record over three splits


def test_partitions_in_proportion_to_bytes(spark, tmp_path, split_size):
    rows, text = table(9, 4000)
    (tmp_path / "t.csv").write_text(text, newline="")
    for size in (200_000, 50_000):
        split_size(size)
        parts = CS.records(spark, str(tmp_path), CS.scan(spark, str(tmp_path))[0]).rdd.getNumPartitions()
        assert parts >= len(text) / size


def test_line_breaks_of_windows_and_latin_1(spark, tmp_path, split_size):
    rows, text = table(3, 120, line="\r\n")
    (tmp_path / "t.csv").write_bytes(text.encode("iso-8859-1"))
    split_size(700)
    assert sorted((tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv")).collect()), key=repr) == want(rows)


def test_no_record_over_lines_goes_to_the_line_reader(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, ""y"""\n\n2,5" pipe\n3,\n')
    got = read_csv(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in got.collect()] == [("1", 'x, "y"'), ("2", '5" pipe'), ("3", None)]
    assert "MapInArrow" not in got._jdf.queryExecution().toString()


def test_a_quote_inside_an_unquoted_value_opens_nothing(spark, tmp_path, split_size):
    (tmp_path / "t.csv").write_text('a,b\n1,5" pipe\n2,"two\nlines"\n3,6" pipe\n4,"last\n')
    for size in (5, 1000):
        split_size(size)
        got = [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv")).collect()]
        assert sorted(got)[:3] == [("1", '5" pipe'), ("2", "two\nlines"), ("3", '6" pipe')] and len(got) == 4


@pytest.mark.parametrize("line, ends_open", [(b"", False), (b'"', True), (b'""', False), (b'"a","b', True), (b'"a"",b', True), (b'"a""",b', False), (b'a"b', False), (b'a,"b""', True), (b',"",', False)])
def test_what_a_line_leaves_open(line, ends_open):
    assert CS.leaves_open()(line) is ends_open
