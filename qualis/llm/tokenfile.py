"""Token-ID files with bit-plane shuffling.

A token file is a folder of two Parquet tables, written by Spark and so safe against lost executors and readable from
any store that Spark reads:

* ``chunks``: one row a chunk. A chunk holds whole documents, about ``CHUNK`` ids; its ids are cut into blocks of
  ``BLOCK`` ids; each block's little-endian bytes are transposed into planes (all first bytes, then all second
  bytes, ...) and every plane is compressed by itself with zstandard. ``blocks`` has a block's planes one after
  another, ``planes`` their compressed lengths, ``doc_ids`` and ``lengths`` the chunk's documents in order.
* ``index``: a row a chunk without the blocks: file part, chunk number, first id's place in the part, counts.

Documents are dealt to parts by ranges of (id, hash of text) and sorted in each, so the parts in order hold the
documents in ascending order of id (null first; ties by the hash of the text). A document's place among all ids
is its part's base, plus its chunk's place in the part, plus its place in the chunk; bases are a running sum
over one row a part.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from string import ascii_letters
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qualis.llm.bpe import ODD_SPACE, byte_symbols
from qualis.llm.common import scratch_path, sliced

BLOCK, CHUNK, WIDTH, LEVEL, END = 1 << 14, 1 << 18, 4, 3, 2
MEMO = 500_000
SIGNS = ".,;:!?%&$#*)"
#: White space as Unicode has it.
SPACES = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

CHUNKS = "part int, chunk int, place bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, blocks array<binary>, planes array<binary>"
CHUNK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("place", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary())), ("planes", pa.list_(pa.binary())),
])


class Encoder:
    """The library's ids of whole texts, as little-endian 32-bit integers.

    White space separates pieces that this vocabulary encodes one by one, so each distinct piece is encoded once in a
    while. A piece that is one word of letters, or one with signs of punctuation after it, needs no splitting:
    its word goes to the library's BPE model, as symbols of their bytes. All other pieces take the library's whole way.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}

    def whole(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def word(self, word: str) -> bytes | None:
        """Ids of a word of letters; None if the library would do more to it than lower its case."""
        low = word.replace("Σ", "σ").lower()  # one letter at a time, as the library does
        ids = self.words.get(low)
        if ids is None:
            if not word.isascii() and not (low.isalpha() and is_normalized("NFC", word)):
                return None
            if len(self.words) >= MEMO:
                self.words.clear()
            text = low if low.isascii() else "".join([self.symbols[b] for b in low.encode()])
            ids = self.words[low] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def learn_words(self, words: list[str]) -> None:
        """Words of small ASCII letters."""
        for w in words:
            self.words[w] = array("I", [t.id for t in self.model.tokenize(w)]).tobytes()

    def learn_signs(self, signs: list[str]) -> None:
        self.signs.update(zip(signs, self.whole(signs), strict=True))

    def learn_others(self, pieces: list[str]) -> None:
        hard = []
        for p in pieces:
            word = p.rstrip(SIGNS)
            ids = self.word(word) if word.isalpha() else None
            if ids is None:
                hard.append(p)
                continue
            sign = p[len(word) :]
            if sign not in self.signs:
                if len(self.signs) >= MEMO:
                    self.signs.clear()
                self.learn_signs([sign])
            self.memo[p] = ids + self.signs[sign]
        for at in range(0, len(hard), 10_000):
            part = hard[at : at + 10_000]
            self.memo.update(zip(part, self.whole(part), strict=True))

    def ids(self, pieces: pa.Array) -> pa.Array:
        """Ids of pieces: of ASCII letters by word and signs, of all others by piece."""
        words = pc.ascii_rtrim(pieces, SIGNS)
        easy = pc.ascii_is_alpha(words)
        lows = looked_up(pc.if_else(easy, pc.ascii_lower(words), ""), self.words, self.learn_words)
        signs = looked_up(pc.if_else(easy, pc.ascii_ltrim(pieces, ascii_letters), ""), self.signs, self.learn_signs)
        others = looked_up(pc.if_else(easy, "", pieces), self.memo, self.learn_others)
        return pc.binary_join_element_wise(lows, signs, others, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: empty). Each distinct piece of the batch is looked up once."""
        texts = pc.fill_null(texts, "")
        odd = pc.any(pc.match_substring_regex(texts, ODD_SPACE.pattern)).as_py()  # Arrow parts words there, the library doesn't
        parted = pc.split_pattern_regex(texts, SPACES) if odd else pc.utf8_split_whitespace(texts)
        coded = parted.flatten().dictionary_encode()
        ids = self.ids(coded.dictionary).take(coded.indices)
        ends = np.cumsum([0, *pc.list_value_length(parted).to_pylist()])
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), ids), pa.scalar(b"", pa.large_binary())).to_pylist()


def looked_up(keys: pa.Array, known: dict[str, bytes], learn: Callable[[list[str]], None]) -> pa.Array:
    """The values of ``known`` for all keys, learned where missing; it starts anew when full."""
    coded = keys.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [k for k in distinct if k not in known]
    if len(known) + len(new) > MEMO:
        known.clear()
        new = distinct
    learn(new)
    return pa.array([known[k] for k in distinct], pa.large_binary()).take(coded.indices)


_CACHE: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _CACHE:
        _CACHE[vocabulary] = Encoder(vocabulary)
    return _CACHE[vocabulary]


def pack(ids: bytes) -> tuple[list[bytes], list[bytes]]:
    """Blocks of compressed byte planes, and each block's plane lengths (little-endian 32-bit)."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    blocks, planes = [], []
    for at in range(0, len(ids), BLOCK * WIDTH):
        rows = np.frombuffer(ids[at : at + BLOCK * WIDTH], np.uint8).reshape(-1, WIDTH)
        parts = [press.compress(plane.tobytes()) for plane in rows.T]
        blocks.append(b"".join(parts))
        planes.append(np.array([len(p) for p in parts], "<u4").tobytes())
    return blocks, planes


def unpack(block: bytes, planes: bytes) -> bytes:
    press, at, parts = zstandard.ZstdDecompressor(), 0, []
    for n in np.frombuffer(planes, "<u4").tolist():
        parts.append(np.frombuffer(press.decompress(block[at : at + n]), np.uint8))
        at += n
    return np.stack(parts, axis=1).tobytes()


def write(docs: DataFrame, vocabulary: str, path: str, end: int | None = END, parts: int | None = None) -> None:
    """Encode ``doc_id, text`` of every row (null: empty), append ``end`` to each, and write the token file ``path``.

    One shuffle, by ranges of (id, hash of text): rows that share an id are spread by their text. An empty
    table gives a file without chunks. Extra columns are not read.
    """
    spark, tail = docs.sparkSession, b"" if end is None else end.to_bytes(4, "little")
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    dealt = keyed.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.col("hash")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, chunk, place = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        ids, keys, lengths, size = [], [], [], 0
        for whole in batches:
            for b in sliced(whole):
                for key, got in zip(b.column(0).to_pylist(), tok.encode(b.column(1)), strict=True):
                    ids.append(got + tail)
                    keys.append(key)
                    lengths.append(len(ids[-1]) // 4)
                    size += lengths[-1]
                    if size >= CHUNK:
                        yield closed(part, chunk, place, size, keys, lengths, ids)
                        chunk, place = chunk + 1, place + size
                        ids, keys, lengths, size = [], [], [], 0
        if keys:
            yield closed(part, chunk, place, size, keys, lengths, ids)

    def closed(part, chunk, place, size, keys, lengths, ids) -> pa.RecordBatch:
        row = dict(zip(CHUNK_SCHEMA.names, (part, chunk, place, size, keys, lengths, *pack(b"".join(ids))), strict=True))
        return pa.RecordBatch.from_pylist([row], CHUNK_SCHEMA)

    dealt.select("doc_id", "text").mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    spark.read.parquet(f"{path}/chunks").select("part", "chunk", "place", "n_ids", F.size("doc_ids").alias("n_docs")).write.parquet(f"{path}/index")


def bases(spark: SparkSession, path: str) -> DataFrame:
    """``part, base``: the number of ids before each part. One row a part, so the running sum is small."""
    totals = spark.read.parquet(f"{path}/index").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a token file: ``doc_id, start`` (ids before it), ``n_tokens`` and ``token_ids`` (little-endian
    unsigned 32-bit integers), or with ``digest`` their crc32 as ``ids_crc32``."""
    what = "crc bigint" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                r = whole.slice(i, 1).to_pylist()[0]
                ids = memoryview(b"".join(unpack(b, p) for b, p in zip(r["blocks"], r["planes"], strict=True)))
                ends = np.cumsum([0, *r["lengths"]])
                docs = [ids[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                last = pa.array([zlib.crc32(d) for d in docs], pa.int64()) if digest else pa.array([d.tobytes() for d in docs], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(docs), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends[:-1] + r["place"], pa.int64()), pa.array(r["lengths"], pa.int64()), last],
                    names=["part", "doc_id", "place", "n_tokens", what.split(" ")[0]],
                )

    rows = spark.read.parquet(f"{path}/chunks").mapInArrow(run, f"part int, doc_id bigint, place bigint, n_tokens bigint, {what}")
    out = rows.join(F.broadcast(bases(spark, path)), "part")  # broadcast: 12 bytes a part
    last = F.col("crc").alias("ids_crc32") if digest else F.col("ids").alias("token_ids")
    return out.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", last)


def digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, from the files as written."""
    path = scratch_path(docs.sparkSession, "token-file")
    write(docs, vocabulary, path)
    return read(docs.sparkSession, path, digest=True)
