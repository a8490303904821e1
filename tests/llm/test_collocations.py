import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from qualis.llm import collocations, hattrie

from . import cases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, inside=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    around = Counter()
    for (lang, ph), a in cands.items():
        for m in range(2, len(ph)):
            for i in range(len(ph) - m + 1):
                around[lang, ph[i : i + m]] = max(around[lang, ph[i : i + m]], a)
    out = []
    for lang in n:
        best = []
        for (g, ph), a in cands.items():
            if g == lang and not (around[g, ph] and 100 * around[g, ph] >= inside * a):
                cuts = [(1000000 * a * a // (f[g, ph[:k]] * f[g, ph[k:]]), k, f[g, ph[:k]], f[g, ph[k:]]) for k in range(1, len(ph))]
                s, _, l, r = min(cuts)
                best.append((-s, -a, " ".join(ph).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], start=1)]
    return out


def rows(seed=4):
    rng = random.Random(seed)
    vocab = ["New", "york", "é", "ÉA", "x\x1cy", "the", "the", "the", "of", "city", "\U0001f600", "\x00", "a-b", "z\x85"]
    ends = [" ", " ", " ", " ", " ", "\t", ". ", ", ", "\n", "! ", "\r\n", "?", " \x0b"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice(ends) for _ in range(n))
    out = [(rng.choice(["en", "en", "fr", None, "und"]), text(rng.randint(0, 60))) for _ in range(80)]
    out += [("en", "New York city hall " * 30), ("en", None), (None, ""), ("de", " \t"), ("fr", "the the the the"), ("fr", "the " * 3000)]
    return out + [("en", t) for _, t in cases.texts()] + [("lone", "one two.")] * 2


def frame(spark, given):
    return spark.createDataFrame([(t, g, 1, "p", 2, 3) for g, t in given], "text string, lang string, n int, phrase string, prefix int, rank int").repartition(4)


@pytest.mark.parametrize("longest", [2, 3])
def test_against_brute_force(spark, longest):
    got = collocations.collocations(frame(spark, rows()), longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows(), longest)
    assert cases.bag(got.collect()) == cases.bag(want) and len(want) > 50


def test_thresholds_and_few_phrases_a_language(spark):
    got = collocations.collocations(frame(spark, rows()), least=3, inside=80, top=7)
    assert cases.bag(got.collect()) == cases.bag(plain(rows(), least=3, inside=80, top=7))


def test_small_tries_filters_and_many_hot_prefixes(spark, monkeypatch):
    """Spills all the time, a bitmap in which hashes meet, every prefix split: the same rows."""
    real = collocations.counts
    monkeypatch.setattr(collocations, "counts", lambda d, size, bits, hot, least: real(d, size, bits, hot, least, most=50, burst=4))
    monkeypatch.setattr(collocations.bitmap, "__defaults__", (1 << 15,))
    for name, value in (("HOT", 1 << 40), ("BYTES", 100), ("CHUNK", 7), ("NUMBERED", 60)):
        monkeypatch.setattr(collocations, name, value)
    assert cases.bag(collocations.collocations(frame(spark, rows())).collect()) == cases.bag(plain(rows()))


def test_empty(spark):
    assert collocations.digest(cases.empty(spark)).collect() == []
    assert collocations.digest(frame(spark, [("en", "no phrase twice")])).collect() == []


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 3), st.integers(0, (1 << 21) - 1)), max_size=300), st.integers(1, 40))
@settings(max_examples=100, deadline=None)
def test_trie_counts_and_spills_whole_subtrees(grams, keep):
    trie = hattrie.Node(3, 5)
    for i in range(0, len(grams), 50):
        trie.add(hattrie.packed([np.array(c, np.int64) for c in zip(*grams[i : i + 50], strict=True)]))
    assert len(trie) == len(set(grams))
    seen = Counter()
    for keys, n in [*trie.spill(keep), *([] if len(trie) > keep else trie.spill(0))]:
        for g, c in zip(zip(*[x.tolist() for x in hattrie.unpacked(keys, 3)], strict=True), n.tolist(), strict=True):
            assert g not in seen
            seen[g] += c
    assert seen == Counter(grams) and len(trie) == 0
    assert not grams or max(g[0] for g in seen) <= 20


def test_a_full_container_bursts_and_a_frequent_first_word_gets_a_subtree():
    trie = hattrie.Node(2, 8)
    trie.add(hattrie.packed([np.zeros(100, np.int64), np.arange(100)]))
    leaves, stack = [], [trie]
    while stack:
        node = stack.pop()
        stack += node.children
        leaves += [] if node.children else [node]
    assert len(trie) == 100 and max(len(x) for x in leaves) <= 8
    assert max(x.depth for x in leaves) > 21 // hattrie.DIGIT_BITS  # past the first word's digits


def test_tokens_are_a_column_without_empty_words():
    got = collocations.tokens([b"A,  b\t\xc3\x89", b"", b" c\r\n"])
    assert got.to_pylist() == [b"a", b"\xff", b"b", "É".encode(), b"\xff", b"\xff", b"c", b"\xff", b"\xff"]
    assert len(collocations.tokens([b""])) == 0
    task = collocations.Task(1, None, [], 10, 4)
    assert task.numbered(got).tolist() == [1, 0, 2, 3, 0, 0, 4, 0, 0]
