"""BPE encoding and decoding with a tokenization automaton.

Compilation starts from the automaton that accepts every sequence of base symbols (one state, "the
last symbol read", per symbol; an arc for every next symbol) and adds one *merge gadget* per merge
rule, in rank order. The gadget of rule ``(a, b) -> c``

* adds a state for ``c`` whose outgoing arcs are those ``b`` has just then, since ``c`` ends as ``b`` does;
* enters it by an arc labelled ``c`` from every state that has an arc labelled ``a``;
* removes the arc labelled ``b`` from the state of ``a``, as that pair is now always merged. For ``a = b`` the
  leftmost pair wins, so the arc labelled ``c`` out of the state of ``a`` goes too.

What is left after all gadgets is deterministic and accepts exactly the token sequences BPE produces. Its
states are the tokens; its arcs, written out, would be a 49k x 49k table, so an arc is evaluated on first use by
unwinding the gadgets that made its two ends (:meth:`Automaton.arc`) and kept in a bounded transition table.

Encoding reads a word once from left to right. For every prefix it keeps the state the automaton is in: the one
token that ends there and whose arc leaves the state of the prefix before it. Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import weakref
from itertools import chain

import regex
from pyspark.sql import DataFrame

from qualis.llm.common import in_worker, per_text

MEMO = 400_000  # entries kept of words already encoded, in each Python worker
PREFIX = 12  # up to this length, the state after a prefix is remembered across words
NO_RANK = -1

#: The pre-tokenizer pattern of the vocabulary file's kind, and white space as Unicode has it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character for each byte value: itself where it is printable in Latin-1, else the
    next free character from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Memo(dict):
    """A dict that computes missing values and starts afresh when full."""

    def __init__(self, fill, size: int = MEMO):
        super().__init__()
        self.fill, self.size = fill, size

    def __missing__(self, key):
        value = self.fill(key)
        if len(self) >= self.size:
            self.clear()
        self[key] = value
        return value


class Automaton:
    """The compiled automaton of a vocabulary file (a ``tokenizers`` JSON with a BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain BPE models are compiled")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_symbols()
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        n = max(self.label) + 1
        self.rank, self.left, self.right = [NO_RANK] * n, [NO_RANK] * n, [NO_RANK] * n
        self.pair: dict[tuple[int, int], int] = {}
        self.live = {i for t, i in self.ids.items() if len(t.removesuffix(self.end)) == 1}
        for k, rule in enumerate(model["merges"]):
            self._gadget(k, *(rule.split(" ") if isinstance(rule, str) else rule))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(WORDS).findall
        me = weakref.proxy(self)  # no cycle: what is remembered goes as soon as the automaton does
        self.arcs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[str, tuple[int, int]] = {}
        self.words: Memo = Memo(lambda word: me._word(word))
        self.pieces: Memo = Memo(lambda piece: me._piece(piece))

    def _gadget(self, k: int, a: str, b: str) -> None:
        i, j, c = self.ids[a], self.ids[b], self.ids[a + b]
        self.pair[i, j] = k
        self.rank[c], self.left[c], self.right[c] = k, i, j
        if i in self.live and j in self.live and self._open(i, j, k):
            self.live.add(c)  # else no path reads a then b any more, and c is never entered

    def _open(self, t: int, s: int, k: int) -> bool:
        """Whether the state of ``t`` has an arc labelled ``s`` when the gadgets up to ``k`` (exclusive) are in."""
        rank, pair = self.rank, self.pair
        while True:
            merged = pair.get((t, s))
            if merged is not None and merged < k:
                return False
            if rank[t] > rank[s]:
                t, k = self.right[t], rank[t]  # arcs copied from the right part when t was made
            elif rank[s] != NO_RANK:
                s, k = self.left[s], rank[s] + 1  # entered where the left part was; ties go to the left pair
            else:
                return True

    def arc(self, t: int, s: int) -> bool:
        """Whether ``s`` may follow ``t``: one cell of the transition table."""
        got = self.arcs.get((t, s))
        if got is None:
            if len(self.arcs) >= 4 * MEMO:
                self.arcs.clear()
            got = self.arcs[t, s] = self._open(t, s, len(self.pair))
        return got

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self._read(word)
        return b"".join([i.to_bytes(4, "little") for i in ids]), self.decode(ids)

    def _read(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word, by transitions from prefix to prefix."""
        text = "".join(map(self.bytes.__getitem__, word.encode("utf-8", "surrogatepass")))
        n, ids, live = len(text), self.ids, self.live
        whole = ids.get(text + self.end)
        if whole is not None and whole in live:
            return (whole,)
        state, came, arcs, pair_ok = [NO_RANK] * (n + 1), [0] * (n + 1), self.arcs, self.arc
        for i in range(1, n + 1):
            known = self.prefixes.get(text[:i]) if i < n and i <= PREFIX else None
            if known is None:
                tail = self.end if i == n else ""
                low = max(0, i - self.longest)
                for j in chain((came[i - 1], i - 1), range(low, i)):  # only one fits; the first two mostly do
                    s = ids.get(text[j:i] + tail)
                    if s is not None and s in live:
                        if j == 0:
                            break
                        ok = arcs.get((state[j], s))
                        if ok or ok is None and pair_ok(state[j], s):
                            break
                known = s, j
                if i < n and i <= PREFIX:
                    if len(self.prefixes) >= MEMO:
                        self.prefixes.clear()
                    self.prefixes[text[:i]] = known
            state[i], came[i] = known
        out, i = [], n
        while i:
            out.append(state[i])
            i = came[i]
        return tuple(reversed(out))

    def _piece(self, piece: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and labels, of a text without white space."""
        if not piece:
            return b"", ""
        if piece.isascii():
            if piece.isalpha():
                return self.words[piece.lower()]
            if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
                (x, y), (u, v) = self.words[piece[:-1].lower()], self.words[piece[-1]]
                return x + u, f"{y} {v}"
        got = []
        for part in self.split.split(piece) if self.split else [piece]:
            if part in self.special:
                got.append((self.special[part].to_bytes(4, "little"), part))
            elif part:
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ").lower()  # one letter at a time: no final form
                got += [self.words[w] for w in self.find(part)]
        return b"".join([x for x, _ in got]), " ".join([y for _, y in got])

    def decode(self, ids) -> str:
        return " ".join(map(self.label.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text. White space separates pieces
        and is itself dropped, so pieces are encoded one by one and remembered."""
        pieces = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        got = list(map(self.pieces.__getitem__, pieces))
        return b"".join([x for x, _ in got]), " ".join([y for x, y in got if x])


def automaton(path: str) -> Automaton:
    """The automaton of a file, compiled once in each Python worker and kept while its tasks use it."""
    return in_worker(f"automaton {path}", lambda: Automaton(path))


def encode_decode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None) -> DataFrame:
    """Each row's whole text encoded and decoded; columns of ``docs`` (or those of ``keep``) plus

    * ``token_ids`` binary: little-endian unsigned 32-bit integers;
    * ``n_tokens`` long;
    * ``decoded`` string: the arc labels joined by a space.

    ``vocabulary`` is the path of the vocabulary file, present on every machine. Null is as the empty text: no
    ids, decoded empty. Repeated rows and ties stay rows of their own; an empty table gives an empty table; columns
    of ``docs`` with one of the new names are replaced. A narrow operation: no shuffle, state bounded by the memo.
    """

    def make():
        tok = automaton(vocabulary)

        def run(texts):
            got = [tok.encode(t or "") for t in texts]
            return {"token_ids": [x for x, _ in got], "n_tokens": [len(x) // 4 for x, _ in got], "decoded": [y for _, y in got]}

        return run

    return per_text(docs, make, "token_ids binary, n_tokens bigint, decoded string", keep)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""

    def make():
        tok = automaton(vocabulary)

        def run(texts):
            got = [tok.encode(t or "") for t in texts]
            return {
                "n_tokens": [len(x) // 4 for x, _ in got],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x, _ in got],
                "decoded_sha256": [hashlib.sha256(y.encode("utf-8", "surrogatepass")).hexdigest() for _, y in got],
            }

        return run

    return per_text(docs, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])
