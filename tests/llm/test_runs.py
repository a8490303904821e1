import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualis.llm import runs

from . import cases


@functools.cache
def _plain(w, shortest):
    """Every run by comparing each word with the one q places on, for every q."""
    best, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items() if b - a >= max(shortest, 2 * q))


def plain(w, shortest=12):
    return _plain(tuple(w), shortest)


def check(texts, shortest=1):
    got = runs.runs_in([np.array(t, np.int64) for t in texts], shortest)
    for t, r in zip(texts, got, strict=True):
        assert [tuple(x) for x in r.tolist()] == plain(t, shortest), t


@given(st.lists(st.lists(st.integers(0, 1), max_size=120), max_size=4))
@settings(max_examples=150, deadline=None)
def test_binary_words(texts):
    check(texts)


def doubled(rng, n, alphabet):
    """Nested repeats: pieces of what is there already, copied on, with a few changes."""
    w = [rng.randrange(alphabet) for _ in range(3)]
    while len(w) < n:
        k = rng.randint(1, len(w))
        piece = w[-k:] * rng.choice([1, 1, 2, 3, 7])
        if rng.random() < 0.4:
            piece[rng.randrange(len(piece))] = rng.randrange(alphabet)
        w += piece
    return w[:n]


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_nested_repeats(alphabet):
    rng = random.Random(alphabet)
    check([doubled(rng, rng.randint(1, 500), alphabet) for _ in range(60)])


def test_periodic_regions_side_by_side():
    """Squares whose halves are highly periodic themselves: no selected place, only the regions tell."""
    texts = []
    for root in ([0], [0, 1], [0, 1, 1], [0, 1, 0, 2]):
        for k in (9, 13, 30, 47):
            x = (root * 60)[:k]
            texts += [x + x, x + [5] + x, [7] + x + x[:-1] + [9] + x, x + x + x[:3], (root * 60)[1 : k + 1] + x, [8] + (x + [5, 6]) * 3, x[::-1] + x]
    texts += [[*([0, 1] * 40), 0, *([0, 1] * 30), 0, 0, *([1, 0] * 50)]]
    check(texts)
    check([sum(texts, [])[:1500]])


def test_fibonacci_and_thue_morse():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    check([b, thue, thue + thue, thue[:100] + b])


def test_a_collision_of_hashes_is_found_out():
    w = np.array([1, 2, 3, 1, 2, 9, 1, 2, 3, 1, 2, 3, 1, 2, 3], np.int64)
    wrong = np.array([[0, 15, 3]])
    assert runs.checked(w, wrong).tolist() == [[6, 15, 3]]
    assert runs.checked(w, np.array([[6, 15, 3]])).tolist() == [[6, 15, 3]]


def plain_digest(d, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(d).encode()) if d is not None else 1
    if h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    found = plain(ws)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (d, len(found), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(kept)), found, kept


def rows():
    rng = random.Random(2)
    more = [(1000 + i, " ".join(rng.choice("ab c\x1cd é".split(" ")) for _ in range(rng.randint(1, 200)))) for i in range(120)]
    return cases.texts() + more + [(2000, "a b c\t" * 700 + "tail"), (2000, "a b c\t" * 700 + "tail"), (None, "x\x0by " * 20)]


def test_digest_against_brute_force(spark):
    got = runs.digest(cases.docs(spark, rows()))
    assert got.columns == ["doc_id", *runs.FIGURES, "runs_sha256", "collapsed_sha256"]
    want = [plain_digest(d, t)[0] for d, t in rows()]
    assert cases.bag(got.collect()) == cases.bag(want)
    assert sum(r[1] > 0 for r in want) > 20


def test_operator_and_empty(spark):
    got = runs.periodic_runs(cases.docs(spark, rows()))
    assert got.columns == [*cases.COLUMNS, "starts", "lengths", "periods", "collapsed"]
    for r in got.collect():
        _, found, kept = plain_digest(None, r.text)
        assert list(zip(r.starts, r.lengths, r.periods, strict=True)) == found and r.collapsed == kept
    assert runs.digest(cases.empty(spark)).collect() == []
    assert runs.periodic_runs(cases.empty(spark)).collect() == []
