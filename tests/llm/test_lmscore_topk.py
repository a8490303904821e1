import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from qualis.llm import lmscore, topk

from . import cases


def plain(rows, order=3):
    each = [(d, re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for d, t in rows]
    count = Counter(tuple(ws[i : i + n]) for _, ws in each for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    total = sum(len(ws) for _, ws in each)

    def one(ws, i):
        for n in range(min(order, i + 1), 0, -1):
            g = tuple(ws[i + 1 - n : i + 1])
            if n == 1 or count[g] >= 2:
                return math.log(count[g] / (count[g[:-1]] if n > 1 else total)) + (min(order, i + 1) - n) * math.log(0.4), n == order
        raise AssertionError

    out = []
    for d, ws in each:
        s = [one(ws, i) for i in range(len(ws))]
        out.append((d, len(ws), sum(f for _, f in s), round(sum(x for x, _ in s), 5) + 0.0))
    return cases.bag(out)


@pytest.mark.parametrize(("order", "group_bytes"), [(3, 10 << 20), (2, 5_000), (1, 5_000)])
def test_scores_against_brute_force(spark, order, group_bytes):
    got = lmscore.score(cases.docs(spark), order=order, group_bytes=group_bytes).collect()
    assert cases.bag((r.doc_id, r.n_words, r.n_full, round(r.log_score, 5) + 0.0) for r in got) == plain(cases.texts(), order)


def test_scores_of_nothing(spark):
    assert lmscore.digest(cases.empty(spark)).collect() == []
    assert [tuple(r) for r in lmscore.digest(cases.docs(spark, [(1, None), (2, " .")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id bigint, embedding array<double>, n int, dims int, score double").repartition(3)


def best(rows, k, every):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for m, (j, c) in enumerate(ok) if m != n and len(c) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k_with_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5).round(1)).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [math.nan] * 5), (303, [math.inf] * 5), (None, [9.0] * 5), (320, [1.0, 2.0]), (321, [2.0, 1.0]), (340, []), (341, [])]
    rows += [rows[20], (-20, [0.5] * 5), (-3, [100.0] * 5)]
    df = vectors(spark, rows)
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, k=7, groups=3, batch=4, segment=32)
    assert sorted(tuple(r) for r in got.collect()) == best(rows, 7, 20)


@pytest.mark.parametrize("groups", [None, 2])
@pytest.mark.parametrize("parquet", [False, True])
def test_rows_that_share_an_id_count_each(spark, tmp_path, groups, parquet):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4).round(1)).tolist()) for i in range(60)]
    rows += [(20, [0.5] * 4), (20, [3.0] * 4), (20, [3.0] * 4), (20, [3.001] * 4), (7, [3.0] * 4)]  # 3.001 quantises like 3
    rows += [(40, [2.0] * 4)] * 30 + [(0, [1.0] * 4)] * 3 + [(41, [2.0] * 4)] * 9
    df = vectors(spark, rows)
    if parquet:
        df.write.parquet(str(tmp_path / "v"))
        df = spark.read.parquet(str(tmp_path / "v"))
    got = topk.top_k(df.where("vec_id % 20 = 0"), df, k=6, groups=groups, batch=4, segment=16)
    assert sorted(tuple(r) for r in got.collect()) == best(rows, 6, 20)
    if parquet and groups:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/v/*.parquet')")
        assert cases.bag(con.execute(topk.ORACLE).fetchall()) == cases.bag(topk.digest(df).select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0])]
    assert sorted(tuple(r) for r in topk.digest(vectors(spark, rows)).collect()) == best(rows, 20, 20)
    assert topk.digest(vectors(spark, [])).collect() == []


def test_blocks_below_the_bound_are_not_scored():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 50
    c = np.concatenate([x + rng.normal(size=(64, 16)) for x in centres]).astype(np.int64)
    ids, q = np.arange(len(c)), centres[:4].astype(np.int64)
    own = topk.Best(np.array([-1, -2, -3, -4]), 5)
    scored = topk.search(own, q, ids, c, block=64)
    scores = q @ c.T
    for row, s in enumerate(scores):
        order = np.lexsort((ids, -s))[:5]
        assert own.ids[row].tolist() == ids[order].tolist() and own.scores[row].tolist() == s[order].tolist()
    assert scored < 4 * 8


def test_large_weights_stay_exact():
    big = 1 << 28
    c = np.array([[big, 1], [big, 2], [big, 3]], np.int64)
    own = topk.Best(np.array([9]), 2)
    topk.search(own, np.array([[big, 1]], np.int64), np.arange(3), c, block=2)
    assert own.ids.tolist() == [[2, 1]] and own.scores.tolist() == [[big * big + 3, big * big + 2]]
