"""Stupid-backoff language-model scores, computed as a join of n-gram counts.

Documents are dealt by hash to groups of about ``GROUP_BYTES`` of text, and each step is a Spark stage over groups or
hash partitions:

1. every group lists its distinct n-grams (orders 1 to ``ORDER``) with their counts in the group;
2. the lists meet, partitioned by n-gram hash: that is the count table. A frequent n-gram comes once from each group, so
   no partition holds more than its distinct n-grams times the groups. The corpus count of each n-gram goes back to the
   groups that listed it;
3. each group explodes its documents' n-grams again, looks up the corpus counts and sums log scores per document.

The score of a word after its context is ``count(context word) / count(context)`` if that n-gram was seen ``SEEN`` times
or more, else ``BACKOFF`` times the score after the context's shorter end; a single word scores its count over all words.
Counts are over all documents, the scored one included. N-grams are known by ``HASH_BITS`` bits of a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qualis.llm.common import ASCII_UPPER, stored
from qualis.llm.grouped import corpus_counts, packed, sums_of, text_bytes, unpacked

ORDER, BACKOFF, SEEN = 3, 0.4, 2
GROUP_BYTES, PART_NGRAMS, HASH_BITS = 10 << 20, 4_000_000, 64
MEMO = 500_000

#: Words are runs of letters a-z (capitals lowered), digits and bytes outside ASCII; the rest separates them.
TABLE = bytes(b + 32 if chr(b) in ASCII_UPPER else b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Words:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        """The hashes of a text's words, in order."""
        ws = text.translate(TABLE).split()
        if len(self.known) > MEMO:
            self.known.clear()
        get, known = self.known.get, self.known
        out = []
        for w in ws:
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def ngrams(words: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """For every order n, the hash of the n-gram that ends at each word (0 where its document has too few words before)."""
    drop, out = np.uint64(64 - HASH_BITS), []
    rolled, ok = words.copy(), np.ones(len(words), bool)
    for n in range(1, order + 1):
        if n > 1:
            earlier = np.concatenate([np.zeros(n - 1, np.uint64), words[: len(words) - n + 1]])[: len(words)]
            ok[: n - 1] = False
            ok[n - 1 :] &= doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)]
            rolled = (rolled ^ (earlier + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (rolled ^ rolled >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(29)) >> drop
        out.append(np.where(ok, np.maximum(mixed, np.uint64(1)), np.uint64(0)))
    return out


def group_lists(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct n-gram hashes of a group (ascending), their counts, the hashes by order, and each word's document."""
    read = Words()
    each = [read(t) for t in texts]
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    grams = ngrams(np.concatenate(each) if each else np.zeros(0, np.uint64), doc, order)
    flat = np.concatenate(grams)
    keys, counts = np.unique(flat[flat > 0], return_counts=True)
    return keys, counts.astype(np.uint32), grams, doc


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, seen: int = SEEN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, n_words, n_full`` (words scored at the highest order) and ``log_score`` (sum of natural logs) of each row.

    Null texts are empty; a text without words has score 0. Rows repeated or sharing an id are scored, and counted, each;
    an empty table gives an empty table; other columns are not read.
    """
    total = text_bytes(docs)
    rows = packed(docs, max(1, -(-total // group_bytes)))

    sums = corpus_counts(rows, lambda texts: group_lists(texts, order)[:2], max(1, -(-total * order // (6 * PART_NGRAMS))), HASH_BITS)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = unpacked(left.column("z"))
        keys, _, grams, doc = group_lists(texts, order)
        total = sums_of(right)
        logs, level = log_scores(grams, keys, total, backoff, seen)
        n = len(texts)
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(np.bincount(doc, minlength=n), pa.int64()),
            "n_full": pa.array(np.bincount(doc, level == order, n).astype(np.int64)),
            "n_one": pa.array(np.bincount(doc, level == 1, n).astype(np.int64)), "log_score": pa.array(np.bincount(doc, logs, n).astype(np.float64)),
        })

    out = rows.groupBy("g").cogroup(sums.groupBy("g")).applyInArrow(scored, "doc_id bigint, n_words bigint, n_full bigint, n_one bigint, log_score double")
    out = stored(out, "lm-scores")  # a row of numbers a document; the count of all words comes from it
    n_words = out.agg(F.sum("n_words").alias("n")).first().n or 1
    return out.select("doc_id", "n_words", "n_full", (F.col("log_score") - F.col("n_one") * F.log(F.lit(float(n_words)))).alias("log_score"))


def log_scores(grams: list[np.ndarray], keys: np.ndarray, total: np.ndarray, backoff: float, seen: int) -> tuple[np.ndarray, np.ndarray]:
    """The natural log of every word's score, at order 1 without the division by all words, and the order it was
    scored at."""
    n = len(grams[0])
    logs, open_ = np.zeros(n), np.ones(n, bool)
    counts = [np.where(g > 0, total[np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))], 0) if len(keys) else np.zeros(n) for g in grams]
    level = np.zeros(n, np.int64)
    longest = np.max([np.where(g > 0, k + 1, 0) for k, g in enumerate(grams)], axis=0) if n else np.zeros(0)
    for k in range(len(grams) - 1, -1, -1):
        here = open_ & (grams[k] > 0)
        if k:
            here &= counts[k] >= seen
            context = np.concatenate([[0], counts[k - 1][:-1]])
        else:
            context = np.ones(n)
        logs[here] = np.log(counts[k][here] / context[here]) + np.log(backoff) * (longest[here] - 1 - k)
        level[here] = k + 1
        open_ &= ~here
    return logs, level


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_full, log_score`` of every row, the score to six decimals."""
    return score(docs).withColumn("log_score", F.round("log_score", 6))


#: DuckDB SQL for the digest, at order 3.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT rid, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
      FROM (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM d)),
one AS (SELECT w, count(*) AS c FROM t GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY u, v, w),
n AS (SELECT sum(c) AS c FROM one),
s AS (
  SELECT t.rid, coalesce(three.c >= {SEEN}, false) AS full3,
    CASE WHEN three.c >= {SEEN} THEN ln(three.c / uv.c)
         WHEN two.c >= {SEEN} THEN ln(two.c / v1.c) + (CASE WHEN t.u IS NULL THEN 0 ELSE 1 END) * ln({BACKOFF})
         ELSE ln(one.c / n.c) + (CASE WHEN t.v IS NULL THEN 0 WHEN t.u IS NULL THEN 1 ELSE 2 END) * ln({BACKOFF}) END AS l
  FROM t CROSS JOIN n JOIN one ON t.w = one.w
  LEFT JOIN two ON t.v = two.v AND t.w = two.w LEFT JOIN one v1 ON t.v = v1.w
  LEFT JOIN three ON t.u = three.u AND t.v = three.v AND t.w = three.w LEFT JOIN two uv ON t.u = uv.v AND t.v = uv.w)
SELECT d.doc_id, CAST(any_value(len(d.ws)) AS BIGINT) AS n_words, CAST(count(*) FILTER (s.full3) AS BIGINT) AS n_full, round(coalesce(sum(s.l), 0), 6) AS log_score
FROM d LEFT JOIN s USING (rid) GROUP BY d.rid, d.doc_id
"""
