import hashlib
from collections import Counter

from qualis.llm import linededup

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, most=10, shortest=1):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= shortest)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if seen[key(x)] < most]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def lined():
    texts = cases.texts()
    rows = [(i, f"Shared Line\nown line {i}\n\n  rare {i % 3}\t\nshared line ") for i in range(12)]
    rows += [(None, "\tSHARED LINE\r"), (3, "nine times"), (3, "nine times\nnine times"), (4, "É\né\n\xa0\n\x1c"), (5, "\n\n\n"), (6, "a\n" * 5000)]
    return texts + rows + [(50 + i, "nine times") for i in range(7)] + [(None, "ten times\rhere\nkept")] * 10 + [(90, "x\n" + "Shared line\n" * 300 + "y")]


def test_against_brute_force(spark):
    rows = lined()
    got = linededup.without_shared_lines(cases.docs(spark, rows))
    assert got.columns == [*cases.COLUMNS, "kept", "n_lines", "n_dropped"]
    assert cases.bag((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == cases.bag(plain(rows))
    assert any(n for _, _, n, _ in plain(rows)) and any(k == "" and n for _, _, n, k in plain(rows))
    digests = linededup.digest(cases.docs(spark, rows)).collect()
    assert cases.bag(digests) == cases.bag((d, a, b, hashlib.sha256(k.encode()).hexdigest()) for d, a, b, k in plain(rows))


def test_thresholds_and_file_input(spark, tmp_path):
    rows = lined()
    cases.docs(spark, rows).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    for most, shortest in ((2, 1), (12, 1), (2, 0), (2, 8), (1, 1)):
        got = linededup.without_shared_lines(docs, most, shortest).collect()
        assert cases.bag((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == cases.bag(plain(rows, most, shortest))


def test_join_without_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = lined()
        got = linededup.without_shared_lines(cases.docs(spark, rows)).collect()
        assert cases.bag((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == cases.bag(plain(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_columns_with_the_names_used_inside(spark):
    df = spark.createDataFrame([(i, "same", 1, 2, 3, "p") for i in range(10)], "doc_id bigint, text string, file int, at int, pos int, key string")
    got = linededup.without_shared_lines(df)
    assert got.columns == ["doc_id", "text", "file", "at", "pos", "key", "kept", "n_lines", "n_dropped"]
    assert {(r.file, r.at, r.pos, r.key, r.kept, r.n_dropped) for r in got.collect()} == {(1, 2, 3, "p", "", 1)}


def test_empty(spark):
    assert linededup.digest(cases.empty(spark)).collect() == []
