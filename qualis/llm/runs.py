"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words with smallest period q, at least two periods long. Words become integers; the texts of a
batch are laid end to end with separators that occur once, so that no run crosses texts and all of them are searched at once.

For a dyadic scale t, a place is *selected* if the hash of the t words there, or of the t words t places on, is the
smallest of the hashes in between (places whose t words have a period of at most t/3 don't compete). Whether a place is selected
depends on its 2t words alone, and every 3t-1 words hold a selected place among their first t unless they have a period of at most t/3.
So a run of period p in [3t, 6t) either

* has a selected place s among its first t words; then s and s+p have equal contexts of 2t words, and such pairs
  propose their distance, or
* begins inside a highly periodic region of period q <= t/3 that spans 3t-1 words. All regions of scale t are runs found at smaller
  scales. If the region ends before the run's last period, so does its copy p words on: ends of regions propose their
  distance. Otherwise it touches the next region of the same q, which holds the run's second half, and
  the two propose every p that brings their words in line.

Periods under 6 are compared directly. Proposals are extended to both sides by comparing hashes of growing stretches, and what is
found is then compared word by word. Of stretches found with several periods the smallest is the run's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import per_text, sliced

#: Words of the shortest run reported.
SHORTEST = 12
FIGURES = ["n_runs", "start", "length", "period", "exponent_milli"]
#: Two primes under 2**31 with a base each, for prefix hashes.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8; none of a null text."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of first, first + 1, ... (``count`` of them) for every row."""
    row = np.repeat(np.arange(len(first)), count)
    return row, np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(row))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Text:
    """Integers with prefix hashes: how far two places agree to the right or the left."""

    def __init__(self, w: np.ndarray, longest: int):
        self.w, self.longest, n = w, longest, len(w)
        self.sums, self.powers = [], []
        for p, base in zip(PRIMES, BASES, strict=True):
            power = np.ones(n + 1, np.int64)
            have = 1
            while have <= n:  # powers of the base by doubling
                step = power[have - 1] * base % p
                power[have : 2 * have] = power[: min(have, n + 1 - have)] * step % p
                have *= 2
            terms = (w % p) * power[:n] % p
            self.sums.append(np.concatenate([[0], np.cumsum(terms) % p]))
            self.powers.append(power)

    def alike(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from a and from b > a have equal hashes."""
        same = np.ones(len(a), bool)
        for p, sums, power in zip(PRIMES, self.sums, self.powers, strict=True):
            same &= (sums[a + size] - sums[a]) % p * power[b - a] % p == (sums[b + size] - sums[b]) % p
        return same

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool = False) -> np.ndarray:
        """Words from a and b > a on that agree (before them, if ``left``), at most ``most``."""
        got = np.zeros(len(a), np.int64)
        if not len(a):
            return got
        step = 1 << int(most.max()).bit_length()
        while step:
            try_ = np.flatnonzero(got + step <= most)
            if len(try_):
                at = -(got[try_] + step) if left else got[try_]
                ok = self.alike(a[try_] + at, b[try_] + at, np.full(len(try_), step))
                got[try_[ok]] += step
            step >>= 1
        return got

    def runs_at(self, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end, period`` of the maximal stretches of period d around s, where they have two periods."""
        n = len(self.w)
        right = self.reach(s, s + d, np.minimum(n - s - d, self.longest))
        left = self.reach(s, s + d, np.minimum(s, self.longest), left=True)
        start, end = s - left, s + d + right
        long = end - start >= 2 * d
        return start[long], end[long], d[long]


def selected(ids: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Places whose own hash, or that t places on, is the smallest of the t + 1 hashes from there on."""
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    ids = np.where(periodic, most, ids)
    low, width = ids, 1
    while width < t + 1:  # smallest of a growing window; the last step overlaps
        step = min(width, t + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    n = len(low)
    return np.flatnonzero((low != most) & ((low == ids[:n]) | (low == ids[t : t + n])))


def pairs_within(key: np.ndarray, at: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``place, distance`` of the pairs with one key whose places are ``least`` to ``most`` - 1 apart."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    places, gaps, k = [], [], 1
    open_ = np.flatnonzero(key[1:] == key[:-1]) if len(key) > 1 else np.zeros(0, np.int64)
    while len(open_):
        gap = at[open_ + k] - at[open_]
        open_, gap = open_[gap < most], gap[gap < most]
        places.append(at[open_[gap >= least]])
        gaps.append(gap[gap >= least])
        k += 1
        open_ = open_[open_ + k < len(key)]
        open_ = open_[key[open_ + k] == key[open_]]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *gaps])


def one_of_each(s: np.ndarray, d: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals without those that follow another of the same distance so closely that they are in the same stretch."""
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] - s[:-1] > 2 * t)
    return s[new], d[new]


def touching(text: Text, start: np.ndarray, end: np.ndarray, period: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from highly periodic regions that touch or overlap the next one of the same period."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    i = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]) & (end[1:] - end[:-1] >= period[1:]))
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    r, q = end[i], period[i]
    longest = np.minimum(np.minimum(r - start[i], end[i + 1] - start[i + 1]) + q, 6 * t - 1)
    row, shift = expand(q, q)  # shifts q .. 2q - 1
    fits = text.alike(r[row] - shift, r[row], q[row])
    row, shift = row[fits], shift[fits]
    k0 = np.maximum(0, -((shift - 3 * t) // q[row]))  # the first multiple that brings the distance to 3t
    count = np.maximum(0, (longest[row] - shift) // q[row] - k0 + 1)
    which, k = expand(k0, count)
    d = shift[which] + k * q[row[which]]
    s = r[row[which]] - d
    return s[s >= 0], d[s >= 0]


def runs_of(w: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs (two periods or more) in integers, if none is longer than ``longest``."""
    n = len(w)
    text = Text(w, longest)
    known = np.zeros((0, 3), np.int64)
    for d in range(1, min(6, n)):
        same = np.flatnonzero(np.diff(np.concatenate([[False], w[d:] == w[:-d], [False]]).astype(np.int8)))
        start, end = same[::2], same[1::2] + d
        long = end - start >= 2 * d
        known = smallest_periods(known, np.stack([start[long], end[long], np.full(int(long.sum()), d)], 1))
    ids = mixed(w.astype(np.uint64), np.full(n, 7, np.uint64))
    t = 1
    while 12 * t <= longest:
        ids = mixed(ids[:-t], ids[t:])  # of 2t words, from those of t
        t *= 2
        known = smallest_periods(known, proposed(text, ids, known, t))
    return known[:, 0], known[:, 1], known[:, 2]


def smallest_periods(known: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One row (start, end, period) for each stretch, with its smallest period."""
    every = np.concatenate([known, more])
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[new]


def proposed(text: Text, ids: np.ndarray, known: np.ndarray, t: int) -> np.ndarray:
    """Stretches with periods from 3t to 6t - 1, from the hashes of t words and all runs of periods under 3t."""
    small = known[known[:, 2] <= t // 3]
    size = small[:, 1] - small[:, 0]
    dense, region = small[size >= t], small[size >= 3 * t - 1]
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, dense[:, 0], 1)
    np.add.at(marks, dense[:, 1] - t + 1, -1)
    at = selected(ids, np.cumsum(marks[:-1]) > 0, t)
    s, d = one_of_each(*pairs_within(mixed(ids[at], ids[at + t]), at, 3 * t, 6 * t), t)
    last, gap = pairs_within(region[:, 2], region[:, 1] - 1, 3 * t, 6 * t)
    near, shift = touching(text, *region.T, t)
    s, d = np.concatenate([s, last, near]), np.concatenate([d, gap, shift])
    return checked(text.w, np.unique(np.stack(text.runs_at(s, d), 1), axis=0))


def checked(w: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The stretches as the words themselves have them, where hashes said more than the words do."""
    start, end, d = runs.T
    row, at = expand(start, end - start - d)
    differ = w[at] != w[at + d[row]]
    if not differ.any():
        return runs
    exact = [np.zeros((0, 3), np.int64)]
    for a, b, p in runs.tolist():  # two primes agreed on different words: cut at the differences
        edges = np.concatenate([[a - 1], a + np.flatnonzero(w[a : b - p] != w[a + p : b]), [b - p]])
        piece = np.flatnonzero(np.diff(edges) - 1 >= p)
        exact.append(np.stack([edges[piece] + 1, edges[piece + 1] + p, np.full(len(piece), p)], 1))
    return np.concatenate(exact)


def runs_in(texts: list[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """For each array of word ids (from 0 on), the rows (start, length, period) of its runs of ``shortest`` words or more."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    ends = np.cumsum(sizes)
    w = np.zeros(int(sizes.sum()), np.int64)
    for x, e in zip(texts, ends.tolist(), strict=True):
        w[e - 1 - len(x) : e - 1] = x
    w[ends - 1] = w.max(initial=0) + 1 + np.arange(len(ends))  # separators, each its own
    start, end, period = runs_of(w, int(sizes.max(initial=1)) - 1)
    size = end - start
    long = size >= np.maximum(shortest, 2 * period)
    start, size, period = start[long], size[long], period[long]
    doc = np.searchsorted(ends, start, side="right")
    order = np.lexsort((period, start))
    rows = np.stack([start - (ends - sizes)[doc], size, period], 1)[order]
    cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def found_in(texts: list[list[bytes]], shortest: int = SHORTEST, most: int = 1 << 18) -> list[np.ndarray]:
    """Runs of lists of words, see :func:`runs_in`; texts of like length are searched together, about ``most`` words at a time."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    group, size = [], 0
    for i in [*order, None]:
        if group and (i is None or size + len(texts[i]) > most):
            flat = pa.array([x for k in group for x in texts[k]], pa.large_binary())
            ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.cumsum([0, *[len(texts[k]) for k in group]])
            for k, r in zip(group, runs_in([ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], shortest), strict=True):
                out[k] = r
            group, size = [], 0
        if i is not None and len(texts[i]) >= shortest:
            group.append(i)
            size += len(texts[i])
    return out


def collapsed(ws: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(ws)
    marks = np.zeros(len(ws) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([ws[i] for i in np.flatnonzero(np.cumsum(marks[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` (``text`` and any other columns but the new ones) with ``starts``, ``lengths`` and ``periods`` (arrays, one
    entry a run, by start, then period) and ``collapsed``: the words outside what runs repeat, joined by one space.

    A null or empty text has no words and no runs; repeated rows are searched like any others; very long texts are searched
    whole, in memory in proportion to the one text. An empty table gives an empty one.
    """

    def make():
        def search(texts: list[str | None]) -> dict[str, list]:
            split = [words(t) for t in texts]
            runs = found_in(split, shortest)
            return {
                "starts": [r[:, 0].tolist() for r in runs], "lengths": [r[:, 1].tolist() for r in runs], "periods": [r[:, 2].tolist() for r in runs],
                "collapsed": [collapsed(ws, r).decode("utf-8", "surrogatepass") for ws, r in zip(split, runs, strict=True)],
            }

        return search

    return per_text(docs, make, "starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string")


def looped(ws: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words the digest searches: for about every tenth id, by its CRC-32, one stretch repeats up to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + i % p] for i in range(n - a)]


def summary(ws: list[bytes], runs: np.ndarray) -> tuple:
    """A row of the digest but for its id."""
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs.tolist())
    first = (None, None, None, None)
    if len(runs):
        s, m, q = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        first = (s, m, q, 1000 * m // q)
    return (len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(ws, runs)).hexdigest())


def digest(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: smallest start, then period) as ``start, length, period, exponent_milli``
    (null without one), ``runs_sha256`` and ``collapsed_sha256`` of every row. The words of some ids are looped first; never
    those of a null id."""
    schema = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in FIGURES] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, 4 << 20):
                ids = b.column("doc_id").to_pylist()
                split = [looped(words(t), d) for d, t in zip(ids, b.column("text").to_pylist(), strict=True)]
                rows = [(d, *summary(ws, r)) for d, ws, r in zip(ids, split, found_in(split, shortest), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    fields = ", ".join(["doc_id bigint", *[f"{n} bigint" for n in FIGURES], "runs_sha256 string", "collapsed_sha256 string"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, fields)
