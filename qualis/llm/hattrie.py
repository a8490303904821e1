"""A burst trie over word ids with hash containers, for counting n-grams of up to three words in bounded memory."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Bits of a word id and of the part of it that a trie node tells children apart by.
ID_BITS, DIGIT_BITS = 21, 3
#: n-grams in a container before it bursts, and in a whole trie before subtrees are spilled.
BURST, MOST = 1 << 14, 400_000


def packed(words: list[np.ndarray]) -> np.ndarray:
    """One integer for each n-gram; ``words`` has the ids of its first words, its second words, and so on."""
    key = words[0].astype(np.int64)
    for w in words[1:]:
        key = key << ID_BITS | w
    return key


def unpacked(keys: np.ndarray, size: int) -> list[np.ndarray]:
    return [keys >> ID_BITS * (size - 1 - i) & (1 << ID_BITS) - 1 for i in range(size)]


class Node:
    """A container (hash table of n-grams), or after it burst a trie node.

    A node's children part its n-grams by the next digit of their first word's id, then of the second's, and so on: rare first
    words share containers, a frequent one gets a subtree of its own in which the second word decides.
    """

    def __init__(self, size: int, burst: int, depth: int = 0):
        self.words, self.burst, self.depth = size, burst, depth
        self.table: Counter[int] = Counter()
        self.children: list[Node] = []

    def __len__(self) -> int:
        return sum(map(len, self.children)) if self.children else len(self.table)

    def digit(self, keys: np.ndarray) -> np.ndarray:
        word, part = divmod(self.depth, ID_BITS // DIGIT_BITS)
        return (keys >> ID_BITS * (self.words - 1 - word) + DIGIT_BITS * part & (1 << DIGIT_BITS) - 1).astype(np.uint8)

    def add(self, keys: np.ndarray) -> None:
        """Counts packed n-grams."""
        if not self.children:
            self.table.update(keys.tolist())
            if len(self.table) > self.burst:
                self.split()
            return
        for child, part in self.parted(keys):
            child.add(keys[part])

    def parted(self, keys: np.ndarray) -> list[tuple[Node, np.ndarray]]:
        which = self.digit(keys)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(len(self.children) + 1))
        return [(c, order[a:b]) for c, a, b in zip(self.children, cuts[:-1], cuts[1:], strict=True) if b > a]

    def split(self) -> None:
        """The container bursts: its n-grams move to containers of the next depth."""
        keys, counts = self.items()
        self.children = [Node(self.words, self.burst, self.depth + 1) for _ in range(1 << DIGIT_BITS)]
        self.table = Counter()
        for child, part in self.parted(keys):
            child.table = Counter(dict(zip(keys[part].tolist(), counts[part].tolist(), strict=True)))
            if len(child.table) > self.burst:
                child.split()

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Packed n-grams of the subtree and their counts."""
        if self.children:
            parts = [c.items() for c in self.children]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return np.fromiter(self.table.keys(), np.int64, len(self.table)), np.fromiter(self.table.values(), np.int64, len(self.table))

    def spill(self, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Takes whole subtrees out, the largest first, until at most ``keep`` n-grams stay."""
        out, size = [], len(self)
        while size > keep and self.children:
            at = max(range(len(self.children)), key=lambda i: len(self.children[i]))
            out.append(self.children[at].items())
            size -= len(self.children[at])
            self.children[at] = Node(self.words, self.burst, self.depth + 1)
        if size > keep:
            out.append(self.items())
            self.table, self.children = Counter(), []
        return out
