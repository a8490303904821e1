"""Phrase collocation mining: n-grams counted by burst tries, spilled as sorted runs and merged per prefix partition.

For every phrase length one pass over the texts. Each task counts n-grams of its own word ids in a trie
(:mod:`qualis.llm.hattrie`) of bounded size; whole subtrees leave it as runs sorted by phrase, and the runs are dealt to
partitions by their prefix and merged there. A prefix is the first word; a word that makes up one in ``HOT`` of the corpus
is split by the second word, and a pair that frequent by the whole phrase, so a frequent prefix fills no partition.

A phrase can only be frequent if its parts are: a pass skips n-grams with a word (or pair) that the previous pass found
under the threshold. What it found is handed on as a bitmap of hashes of at most ``FILTER_BITS`` bits; a shared hash keeps an
n-gram too many, which is then counted exactly like any other, so nothing depends on hashes but the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualis.llm.common import stored
from qualis.llm.hattrie import BURST, MOST, Node, packed, unpacked

#: Words of the longest phrase, occurrences of a candidate, percent of them inside a longer phrase, phrases a language.
LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2000
#: Bits of the bitmap between passes, and the share of all words (one in so many) from which on a prefix is split.
FILTER_BITS, HOT = 1 << 27, 1 << 12
#: Words a task numbers before it starts anew, bytes and words of text taken at once, and rows in a batch of a run.
NUMBERED, BYTES, CHUNK, ROWS = 400_000, 8 << 20, 1 << 18, 1 << 16
#: What ends a piece, and what separates words in it.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b"\t"
#: A byte that UTF-8 doesn't have stands for the end of a piece.
END = b"\xff"
TABLE = bytes.maketrans(ENDS + GAPS, END * len(ENDS) + b" ")
RUN = "lang string, prefix bigint, phrase string, n bigint"


def tokens(texts: list[bytes]) -> pa.Array:
    """Lower-cased (A-Z) words of UTF-8 texts, and ``END`` between pieces and texts."""
    joined = END.join(texts).lower().translate(TABLE).replace(END, b" " + END + b" ")
    parted = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten()
    return parted.filter(pc.greater(pc.binary_length(parted), 0))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b ^ b >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ x >> np.uint64(32)


def phrase_hash(lang: str, parts: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases by the hashes of their words."""
    out = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for p in parts:
        out = mixed(out, p)
    return out


class Task:
    """The word ids and tries of one task; ``hot[i]`` has hashes of the (i+1)-word prefixes that are split."""

    def __init__(self, size: int, bits: np.ndarray | None, hot: list[np.ndarray], most: int, burst: int):
        self.size, self.bits, self.hot, self.most, self.burst = size, bits, hot, most, burst
        self.total: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        self.ids: dict[bytes, int] = {END: 0}
        self.hashes = np.zeros(1, np.uint64)
        self.tries: dict[str, Node] = {}

    def frequent(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the last pass may have found these phrases frequent."""
        at = (hashes & np.uint64(8 * len(self.bits) - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def numbered(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        known, ids = len(self.ids), self.ids
        local = np.array([ids.setdefault(w, len(ids)) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)
        if len(ids) > known:
            new = list(ids)[known:]
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)])
        return local[coded.indices.to_numpy(zero_copy_only=False)]

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Counts the n-grams of texts that may be frequent, and the words; gives runs whenever the tries are too large."""
        words, k = tokens(texts), self.size
        for a in range(0, len(words), CHUNK):  # n-grams that start in the chunk
            w = self.numbered(words[a : a + CHUNK + k - 1])
            n, ok = len(w), w > 0
            self.total[lang] = self.total.get(lang, 0) + int(ok[:CHUNK].sum())
            if n < k:
                break
            good = np.ones(n - k + 1, bool)
            for i in range(k):
                good &= ok[i : n - k + 1 + i]
            if self.bits is not None:  # every part one word shorter has to be frequent
                h = self.hashes[w]
                parts = self.frequent(phrase_hash(lang, [h[i : n - k + 2 + i] for i in range(k - 1)]))
                good &= parts[:-1] & parts[1:]
            self.tries.setdefault(lang, Node(k, self.burst)).add(packed([w[i : n - k + 1 + i][good] for i in range(k)]))
            yield from self.spilled()

    def spilled(self, whole: bool = False) -> Iterator[pa.RecordBatch]:
        """Sorted runs, if the tries or the words have grown too large: of the largest subtrees, or of all."""
        whole = whole or len(self.ids) > NUMBERED
        if not whole and sum(map(len, self.tries.values())) <= self.most:
            return
        words = pa.array(list(self.ids), pa.large_binary())
        keep = 0 if whole else self.most // 2 // max(1, len(self.tries))
        for lang, trie in self.tries.items():
            for keys, counts in trie.spill(keep):
                yield from self.run(lang, words, keys, counts)
        if whole:
            self.restart()

    def run(self, lang: str, words: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = unpacked(keys, self.size)
        hashes = [self.hashes[p] for p in parts]
        depth = np.ones(len(keys), np.int64)  # words in the prefix
        for i, hot in enumerate(self.hot[: self.size - 1]):
            depth += (depth == i + 1) & np.isin(phrase_hash(lang, hashes[: i + 1]), hot)
        prefix = np.zeros(len(keys), np.uint64)
        for i in range(self.size):
            at = depth == i + 1
            prefix[at] = phrase_hash(lang, [h[at] for h in hashes[: i + 1]])
        columns = [words.take(pa.array(p)) for p in parts]
        phrases = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if self.size > 1 else columns[0]
        order = pc.sort_indices(phrases).to_numpy()
        for a in range(0, len(order), ROWS):
            o = order[a : a + ROWS]
            yield run_batch(lang, prefix[o].view(np.int64), phrases.take(pa.array(o)).cast(pa.binary()).cast(pa.string()), counts[o])


def run_batch(lang: str, prefix: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([lang] * len(counts), pa.string()), pa.array(prefix, pa.int64()), phrases, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "prefix", "phrase", "n"])


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, about ``BYTES`` at a time; a longer text alone."""
    out, size = {}, 0
    for b in source:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            x = text.as_py()
            out.setdefault(lang, []).append(x)
            size += len(x)
            if size > BYTES:
                yield out
                out, size = {}, 0
    if out:
        yield out


def counts(docs: DataFrame, size: int, bits: np.ndarray | None, hot: list[np.ndarray], least: int, most: int = MOST, burst: int = BURST) -> DataFrame:
    """``lang, phrase, n`` of the phrases of ``size`` words that occur ``least`` times or more; with ``size`` 1 also a row with an
    empty phrase and the number of all words for each language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(size, shared.value if shared else None, hot, most, burst)
        for texts in batches(source):
            for lang, group in texts.items():
                yield from task.add(lang, group)
        yield from task.spilled(whole=True)
        if size == 1:
            for lang, n in task.total.items():
                yield run_batch(lang, np.zeros(1, np.int64), pa.array([""], pa.string()), np.array([n]))

    runs = rows.mapInArrow(run, RUN).repartition("prefix")
    merged = runs.groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n"))
    return merged.where((F.col("n") >= least) | (F.col("phrase") == "")).select("lang", "phrase", "n")


def hashed(phrases: DataFrame) -> DataFrame:
    """``hash`` of the phrases, as tasks compute it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x: np.array([xxhash.xxh64_intdigest(x)], np.uint64)
        for b in source:
            rows = zip(b.column("lang").to_pylist(), b.column("phrase").cast(pa.binary()).to_pylist(), strict=True)
            h = [int(phrase_hash(lang, [one(w) for w in p.split(b" ")]).view(np.int64)[0]) for lang, p in rows]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash bigint")


def bitmap(phrases: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of the hashes of phrases: eight bits a phrase, at most ``most`` bits whatever their number."""
    bits = min(most, 1 << max(15, int(8 * phrases.count()).bit_length()))
    place = hashed(phrases).select(F.col("hash").bitwiseAND(bits - 1).alias("at")).distinct()

    def block(table: pa.Table) -> pa.Table:
        field = np.zeros(1 << 15, bool)
        field[table.column("at").to_numpy() & (1 << 15) - 1] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(field, bitorder="little").tobytes()], pa.binary())})

    blocks = place.select((F.col("at") / (1 << 15)).cast("bigint").alias("block"), "at").groupBy("block").applyInArrow(block, "block bigint, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r.block << 12 : r.block + 1 << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def word(phrase: Column, first: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """Stored ``lang, phrase, n`` of one word, two words, and so on up to ``longest`` (at most three), that occur ``least``
    times or more; the first also has the number of all words, under an empty phrase."""
    found: list[DataFrame] = []
    bits, hot, total = None, [], 0
    for size in range(1, longest + 1):
        found.append(stored(counts(docs, size, bits, hot, least), f"phrases-{size}"))
        real = found[-1].where(F.col("phrase") != "")
        if size == 1:
            total = found[0].where(F.col("phrase") == "").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        if size < longest:
            bits = bitmap(real)
            # prefixes with one in HOT of all words each: HOT rows at most
            rows = hashed(real.where(F.col("n") * HOT >= total)).collect()
            hot = [*hot, np.array([r.hash for r in rows], np.int64).view(np.uint64)]
    return found


def scored(found: list[DataFrame], inside: int = INSIDE) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two words or more that are not mostly inside a longer one."""
    every = found[0].where(F.col("phrase") != "").withColumn("size", F.lit(1))
    for size, f in enumerate(found[1:], start=2):
        every = every.union(f.withColumn("size", F.lit(size)))
    phrases = every.where("size > 1").withColumnRenamed("n", "a")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", word(F.col("phrase"), 1, F.col("k")).alias("left"), word(F.col("phrase"), F.col("k") + 1, F.col("size")).alias("right"))
    left = every.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = every.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    exact = {c: f"cast({c} as decimal(15,0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({exact['a']} * {exact['a']})) div ({exact['l']} * {exact['r']})").alias("score")
    tried = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "phrase", "a", "k", "l", "r", score)
    worst = tried.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    longer = phrases.where("size > 2").select("lang", "phrase", "size", F.col("a").alias("b"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    spans = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    around = spans.select("lang", word(F.col("phrase"), F.col("at"), F.col("m")).alias("phrase"), "b").groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    whole = worst.join(around, ["lang", "phrase"], "left").where(F.col("b").isNull() | (100 * F.col("b") < inside * F.col("a")))
    return whole.select("lang", "phrase", "a", "l", "r", "score")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language, with ``rank``. Each language is ranked in parts first, as many as make both steps
    alike in size."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(1, int((phrases.count() / top) ** 0.5))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    over = Window.partitionBy("lang").orderBy(*best)
    return first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language of ``docs`` (``lang``, ``text``; other columns
    are not read).

    A null language is ``und``, a null text is empty; repeated rows count each time; texts of any length are read whole, in pieces
    of several texts or one. An empty table, or one without phrases frequent enough, gives an empty one.
    """
    found = frequent_phrases(docs, longest, least)
    best = ranked(stored(scored(found, inside), "phrases-scored"), top)
    n = found[0].where(F.col("phrase") == "").select("lang", "n")
    return best.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def digest(docs: DataFrame) -> DataFrame:
    return collocations(docs)


#: DuckDB SQL for the digest.
ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS ph
      FROM (SELECT lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, ph, count(*) AS a FROM g GROUP BY lang, k, ph),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(ph, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, ph, a, cut, array_to_string(ws[1 : cut], ' ') AS lp, array_to_string(ws[cut + 1 : k], ' ') AS rp
         FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c)),
cut AS (SELECT cuts.lang, cuts.ph, cuts.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
        FROM cuts JOIN f x ON x.lang = cuts.lang AND x.ph = lp JOIN f y ON y.lang = cuts.lang AND y.ph = rp),
worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) AS o FROM cut) WHERE o = 1),
around AS (SELECT lang, ph, max(a) AS b
           FROM (SELECT lang, array_to_string(ws[i : i + 1], ' ') AS ph, a FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3)) GROUP BY lang, ph),
kept AS (SELECT worst.*, ph AS phrase FROM worst LEFT JOIN around USING (lang, ph) WHERE b IS NULL OR 100 * b < 50 * a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN n USING (lang) WHERE rank <= 2000
"""
