import hashlib
import random
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from qualis.llm import bpe, common, tokenfile
from qualis.llm.common import scratch_path

from . import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return bpe.automaton(PATH)


def test_automaton_agrees_with_the_library(library, automaton):
    rng = random.Random(3)
    signs = "aaabbbcdeé ñüßΣσςİIiıǺ̀̊ é '’s 'll it's 12½²Ⅷ٣ 😀👍🏽中文字 \x1c\x1f\x85  ​　\t\n<|endoftext|>!!!...---$$ the ing tionẛ̣ﬁǅ𝔘힣가"
    words = signs.split()
    texts = ["", "a" * 5000, "!" * 3000, "<|endoftext|><|startoftext|>x"]
    for _ in range(800):
        texts.append("".join(rng.choice(signs) for _ in range(rng.randint(0, 60))))
        texts.append(" ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randint(0, 12))))
        texts.append("".join(rng.choice("aest") for _ in range(rng.randint(0, 40))))
        texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 40))))
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decoded = automaton.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
        assert decoded == library.decode(want.ids, skip_special_tokens=False)


def test_gadgets_leave_one_path(automaton):
    """Of all ways to cut a word into tokens, exactly one follows arcs, and it is the encoding."""
    for word in ("aaaaaa", "thinking", "banana", "tttt"):
        ids = [automaton.ids.get(word[a:b] + ("</w>" if b == len(word) else "")) for a in range(len(word)) for b in range(a + 1, len(word) + 1)]
        assert ids
        n, found = len(word), []

        def walk(at, path):
            if at == n:
                found.append(tuple(path))
            for to in range(at + 1, n + 1):
                t = automaton.ids.get(word[at:to] + ("</w>" if to == n else ""))
                if t in automaton.live and (not path or automaton.arc(path[-1], t)):
                    walk(to, [*path, t])

        walk(0, [])
        assert found == [automaton._read(word)]


def test_memo_starts_afresh_when_full():
    memo = bpe.Memo(lambda k: k * 2, size=3)
    assert [memo[i] for i in range(8)] == [0, 2, 4, 6, 8, 10, 12, 14] and len(memo) <= 3


def test_rows_and_awkward_cases(spark, library):
    got = bpe.encode_decode(cases.docs(spark), PATH)
    assert set(cases.COLUMNS) <= set(got.columns)
    for r in got.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == np.array(want, "<u4").tobytes() and r.n_tokens == len(want)
    out = cases.bag(bpe.digests(cases.docs(spark), PATH).collect())
    want = [(d, len(e := library.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()) for d, t in cases.texts()]
    assert out == cases.bag(want)
    assert bpe.digests(cases.empty(spark), PATH).collect() == []


def test_token_file_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(tokenfile, "CHUNK", 500)
    monkeypatch.setattr(tokenfile, "BLOCK", 64)
    path = scratch_path(spark, "token-test")
    tokenfile.write(cases.docs(spark), PATH, path, parts=3)
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in cases.texts()), key=lambda d: (d is not None, d or 0))
    want = sorted([(repr(d), np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, t in cases.texts()])
    assert sorted((repr(r.doc_id), bytes(r.token_ids)) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at and len(r.token_ids) == 4 * r.n_tokens
        at += r.n_tokens
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r.n_ids for r in index) == at and len(index) > 3


def test_token_file_of_nothing(spark):
    path = scratch_path(spark, "token-test")
    tokenfile.write(cases.empty(spark), PATH, path)
    assert tokenfile.read(spark, path, digest=True).collect() == []


def test_blocks_are_planes():
    ids = np.arange(70_000, dtype="<u4").tobytes()
    blocks, planes = tokenfile.pack(ids)
    assert len(blocks) == -(-70_000 // tokenfile.BLOCK) and all(len(p) == 16 for p in planes)
    assert b"".join(tokenfile.unpack(b, p) for b, p in zip(blocks, planes, strict=True)) == ids
    assert sum(map(len, blocks)) < len(ids) / 4


def test_a_worker_lets_go_of_the_automaton_when_other_work_begins():
    common.begun(lambda: len)  # a fixture may hold the one made before
    common.begun(lambda: bpe.automaton(PATH))
    held = weakref.ref(bpe.automaton(PATH))
    assert common.begun(lambda: bpe.automaton(PATH)) is held()  # the next task of the same stage
    common.begun(lambda: len)
    assert held() is None


def test_token_file_encoder_by_column():
    """All kinds of white space and letters, nulls, slices, memos that fill up: the ids of the library."""
    rng, library = random.Random(3), Tokenizer.from_file(PATH)
    library.no_padding()
    library.no_truncation()
    signs = [*map(chr, range(0x80)), *"\x85\xa0\u1680\u200a\u2028\u3000\u200bΣσςİßéÅ中½\u0301\U0001f600"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(300)] + [None, "", "Hello, WORLD!! it's", "(end)."]
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for most in (3, 500_000):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tokenfile, "MEMO", most)
            encoder = tokenfile.Encoder(PATH)
            assert encoder.encode(pa.array(texts).slice(2)) == want[2:] == encoder.encode(pa.array(texts).slice(2))
            assert not encoder.memo.keys() & {"Hello,", "WORLD!!"} and encoder.encode(pa.array([], pa.string())) == []
