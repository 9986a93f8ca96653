"""Counting of word sequences in a burst trie of hash containers.

A sequence of up to four word ids is two 64-bit numbers, ``hi`` (first and second word) and ``lo`` (third and fourth, 0 where there
is none). The root sends a sequence to a container by its first word. A container buffers sequences and folds them by hashing;
one that stays large bursts: a word that holds much of it gets a container of its own, by first word and below that by second,
so that the trie stays shallow and hot prefixes stand apart. Beyond ``memory`` entries whole subtrees leave as sorted runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

ROOTS = 64
BURST = 150_000
HEAVY = 16
"""A word with one in so many entries of a bursting container gets its own."""
MEMORY = 1_500_000
MIX = np.uint64(0x9E3779B97F4A7C15)

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def digits(hi: np.ndarray, n: int) -> np.ndarray:
    return ((hi * MIX) >> np.uint64(33)) % np.uint64(n)


def folded(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Entries:
    """Distinct sequences with their counts added up, by hash tables on both halves and on their pair."""
    a, first = pd.factorize(hi)
    b, second = pd.factorize(lo)
    c, pair = pd.factorize(a * len(second) + b)
    return first[pair // max(1, len(second))], second[pair % max(1, len(second))], np.bincount(c, n, len(pair)).astype(np.int64)


class Container:
    def __init__(self, depth: int = 0):
        self.depth = depth
        self.parts: list[Entries] = []
        self.buffered = 0
        self.children: dict[int, Container] = {}

    @property
    def size(self) -> int:
        return self.buffered + sum(c.size for c in self.children.values())

    def word(self, hi: np.ndarray) -> np.ndarray:
        return hi >> np.uint64(32) if self.depth == 0 else hi & np.uint64(0xFFFFFFFF)

    def add(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> None:
        if self.children:
            word = self.word(hi)
            own = np.ones(len(hi), bool)
            for w, child in self.children.items():
                at = word == np.uint64(w)
                if at.any():
                    child.add(hi[at], lo[at], n[at])
                    own &= ~at
            hi, lo, n = hi[own], lo[own], n[own]
        if len(hi):
            self.parts.append((hi, lo, n))
            self.buffered += len(hi)
        if self.buffered > BURST:
            self.fold()
            if self.buffered > BURST // 2:
                self.burst()

    def fold(self) -> None:
        if len(self.parts) > 0:
            self.parts = [folded(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.buffered = len(self.parts[0][0])

    def burst(self) -> None:
        if self.depth > 1:
            return
        hi, lo, n = self.parts[0]
        words, many = np.unique(self.word(hi), return_counts=True)
        for w in words[many * HEAVY > len(hi)]:
            self.children[int(w)] = Container(self.depth + 1)
        if self.children:
            self.parts, self.buffered = [], 0
            self.add(hi, lo, n)

    def entries(self) -> Iterator[Entries]:
        self.fold()
        yield from self.parts
        for c in self.children.values():
            yield from c.entries()


class HatTrie:
    """``spill`` gets sorted runs: distinct sequences of whole subtrees, ascending, with counts."""

    def __init__(self, spill: Callable[[np.ndarray, np.ndarray, np.ndarray], None], memory: int = MEMORY):
        self.spill, self.memory = spill, memory
        self.roots = [Container() for _ in range(ROOTS)]

    def add(self, hi: np.ndarray, lo: np.ndarray, n: np.ndarray | None = None) -> None:
        n = np.ones(len(hi), np.int64) if n is None else n
        digit = digits(hi >> np.uint64(32), ROOTS).astype(np.uint8)
        order = np.argsort(digit, kind="stable")
        ends = np.cumsum(np.bincount(digit, minlength=ROOTS))
        hi, lo, n = hi[order], lo[order], n[order]
        for root, s, e in zip(self.roots, np.r_[0, ends[:-1]], ends):
            if e > s:
                root.add(hi[s:e], lo[s:e], n[s:e])
        if sum(r.size for r in self.roots) > self.memory:
            self.shed(self.memory // 2)

    def shed(self, keep: int) -> None:
        """Largest subtrees go, in one run, until at most ``keep`` entries are left."""
        total, gone = sum(r.size for r in self.roots), []
        for k in sorted(range(ROOTS), key=lambda k: -self.roots[k].size):
            if total <= keep or not self.roots[k].size:
                break
            total -= self.roots[k].size
            gone.extend(self.roots[k].entries())
            self.roots[k] = Container()
        if gone:
            hi, lo, n = (np.concatenate(x) for x in zip(*gone))
            order = np.lexsort((lo, hi))
            self.spill(hi[order], lo[order], n[order])

    def close(self) -> None:
        self.shed(0)


def merged(runs: list[Entries]) -> Entries:
    """Runs put together: ascending, equal sequences added up. Sorting is stable and meets runs that ascend."""
    hi, lo, n = (np.concatenate(x) for x in zip(*runs))
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
    return hi[new], lo[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
