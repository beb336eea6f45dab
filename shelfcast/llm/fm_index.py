"""An FM-index over runs of word numbers, searched for many phrases at once.

The index holds the Burrows-Wheeler transform of all runs in a wavelet matrix
(rank of a symbol in O(bits) popcounts) and the places of sampled suffixes: those
at every ``SAMPLE``-th position and those that begin a run. Phrases are found by
backward search, occurrences by walking to the next sampled suffix. All steps
work on whole numpy arrays, one phrase or one occurrence per element.
"""

from __future__ import annotations

import numpy as np

# A suffix in so many keeps its place.
SAMPLE = 8


class BitRank:
    """A bit array with the number of set bits before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank and access on a sequence of small numbers."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            self.levels.append(BitRank(one))
            self.zeros.append(len(symbols) - int(one.sum()))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each of its ``ends``."""
        at = [np.zeros(len(symbol), np.int64), *ends]
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            ranks = [level.rank(a) for a in at]
            at = [np.where(one, zeros + r, a - r) for a, r in zip(at, ranks)]
        return [a - at[0] for a in at[1:]]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before."""
        symbol, first = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(at)
            here, start = level.rank(at), level.rank(first)
            at = np.where(one, zeros + here, at - here)
            first = np.where(one, zeros + start, first - start)
            symbol = symbol << 1 | one
        return symbol, at - first


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of the suffixes that begin there, by doubling sorted prefixes."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])] if n else order
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Index of runs of 64-bit word numbers: ``words`` one run after the other, ``begins`` where each begins."""

    def __init__(self, words: np.ndarray, begins: np.ndarray):
        n, runs = len(words), len(begins)
        self.alphabet, codes = np.unique(words, return_inverse=True)
        # Symbols from 1 on; a run's end has its own smaller symbol while suffixes are
        # sorted, so that no comparison runs into the next run, and 0 in the transform.
        ends = np.r_[begins[1:], n] if runs else begins
        text = np.empty(n + runs, np.int64)
        word_at = np.arange(n) + np.repeat(np.arange(runs), ends - begins)
        text[word_at] = codes + runs
        end_at = ends + np.arange(runs)
        text[end_at] = np.arange(runs)
        order = sort_suffixes(text)
        # The position of a suffix without the run ends; a run's end counts as the next run's begin.
        run_begin = begins + np.arange(runs)
        plain = np.where(text >= runs, text - runs + 1, 0)
        before = np.where(order > 0, plain[order - 1], 0)
        bits = max(1, len(self.alphabet).bit_length())
        self.transform = WaveletMatrix(before, bits)
        self.first = np.r_[0, np.cumsum(np.bincount(plain, minlength=len(self.alphabet) + 1))].astype(np.int64)
        sampled = np.zeros(n + runs, bool)
        sampled[::SAMPLE] = True
        sampled[run_begin] = True
        kept = sampled[order]
        self.sampled = BitRank(kept)
        number = np.full(n + runs, -1, np.int64)
        number[word_at] = np.arange(n)
        self.place = number[order[kept]]
        # Positions of run ends are never asked for; the walk stops at a run's begin before.
        self.size = n + runs

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase: rows of word numbers, of which the first ``lengths`` count."""
        count = len(phrases)
        low, high = np.zeros(count, np.int64), np.full(count, self.size, np.int64)
        if not len(self.alphabet):
            return low, low.copy()
        code = np.minimum(np.searchsorted(self.alphabet, phrases), len(self.alphabet) - 1)
        symbol = np.where(self.alphabet[code] == phrases, code + 1, 0)
        rows = np.flatnonzero(lengths > 0)
        high[lengths == 0] = 0
        for step in range(phrases.shape[1]):
            rows = rows[(lengths[rows] > step) & (high[rows] > low[rows])]
            if not len(rows):
                break
            s = symbol[rows, lengths[rows] - 1 - step]
            below, above = self.transform.rank(s, low[rows], high[rows])
            low[rows] = self.first[s] + below
            high[rows] = np.where(s > 0, self.first[s] + above, low[rows])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The position among all words at which each suffix begins."""
        out = np.empty(len(at), np.int64)
        open_, steps = np.arange(len(at)), 0
        while len(open_):
            here = at[open_]
            done = self.sampled.get(here)
            out[open_[done]] = self.place[self.sampled.rank(here[done])] + steps
            open_ = open_[~done]
            symbol, before = self.transform.access(at[open_])
            at = at.copy()
            at[open_] = self.first[symbol] + before
            steps += 1
        return out
