import numpy as np
import pytest
import xxhash

from qualis.llm import simhash
from qualis.llm.components import components

from . import cases


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(items, most=4):
    """Class of each (key, fingerprint), by comparing all with all."""
    root = {f: f for _, f in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(b)] = find(a)
    least = {}
    for k, f in items:
        if k is not None:
            least[find(f)] = min(least.get(find(f), k), k)
    return [(k, f, least.get(find(f))) for k, f in items]


def test_awkward_rows_against_brute_force(spark):
    got = cases.bag((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(cases.docs(spark)).collect())
    assert got == cases.bag(linked([(d, plain(t)) for d, t in cases.texts()]))
    one = simhash.digest(cases.docs(spark, [(3, None), (1, ""), (2, "  ")])).collect()
    assert {(r.fingerprint, r.component_id) for r in one} == {("0" * 16, 1)}
    assert simhash.digest(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("block", [8192, 40])
def test_dense_balls_against_brute_force(spark, monkeypatch, block):
    """Many distinct fingerprints within a few bits: one large group, whole or dealt out in blocks."""
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(8):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(0, 6))).tolist():
                x ^= 1 << b
            fps.add(x)
    items = list(enumerate(sorted(fps)))
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda f, most: real(f, most, block))
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in items], "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in simhash.classes(df).collect()}
    assert got == {k: c for k, _, c in linked(items)}


def test_pigeonring_keys_lose_no_pair():
    rng = np.random.default_rng(5)
    ring = simhash.segments(4)
    assert sum(w for _, w in ring) == 64
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False).tolist():
            b ^= 1 << bit
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(simhash.near(x, y, s, ring, 4)[0] for s in range(len(ring)))


def test_keep_one_of_each_class(spark):
    kept = simhash.keep_one(cases.docs(spark))
    assert kept.columns == cases.COLUMNS
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, kept_ids(cases.texts())))
    assert simhash.keep_one(cases.empty(spark)).collect() == []


def roots(items, most=4):
    """Class of each fingerprint, by comparing all with all: the smallest fingerprint of the class."""
    fps = sorted({f for _, f in items})
    # linked() names a class by its smallest key; with fingerprints as keys that is the root
    return {f: c for _, f, c in linked([(f, f) for f in fps], most)}


def kept_ids(rows):
    """The smallest id of each class by root, null only where a class has no other."""
    root, least = roots([(d, plain(t)) for d, t in rows]), {}
    for d, t in rows:
        least.setdefault(root[plain(t)], []).append(d)
    return [min((d for d in ids if d is not None), default=None) for ids in least.values()]


def test_keep_one_keeps_classes_apart_that_share_an_id(spark):
    """A third of all rows under one id, on unrelated texts, and null ids: one row of every class by root."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice(list("abcdefghijklmnop"), 12).tolist())
    rows = [(1, text()) for _ in range(12)] + [(i, text()) for i in range(50, 74)] + [(None, text()), (None, text())]
    rows += [(90, rows[0][1]), (None, rows[1][1])]
    for given in (rows, cases.texts()):
        root = roots([(d, plain(t)) for d, t in given])
        kept = [(r.doc_id, plain(r.text)) for r in simhash.keep_one(cases.docs(spark, given)).collect()]
        assert sorted(root[f] for _, f in kept) == sorted(set(root.values()))
        least = {}
        for d, t in given:
            least.setdefault(root[plain(t)], []).append(d)
        assert all(d == min((x for x in least[root[f]] if x is not None), default=None) for d, f in kept)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.u: r.root for r in components(spark.createDataFrame(path + star, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
