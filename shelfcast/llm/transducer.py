"""A minimal acyclic transducer from words to token ids, and exact merging of other words.

``compile_lexicon`` builds the smallest automaton of a sorted word list (equal
suffixes are shared) whose transitions carry numbers; their sum along a word is
the word's row in a table of id sequences. ``Lexicon`` reads the arrays from a
memory-mapped file and looks up many words at once, one byte per step.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

from .chunks import ragged

MAGIC = b"SCFST001"
FIELDS = (("keys", np.int64), ("target", np.int32), ("out", np.int32), ("final", np.int32), ("starts", np.int64), ("ids", np.uint32))
# Longer words are merged one at a time.
MATRIX_BYTES = 48
NONE = np.iinfo(np.int32).max


def compile_lexicon(words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file for ``words`` (distinct, sorted, not empty) with their ids, one after the other."""
    register: dict[tuple, int] = {}
    counts: list[int] = []
    nodes: list[tuple] = []

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(nodes)
            nodes.append(key)
            counts.append(int(final) + sum(counts[t] for _, t in edges))
        return register[key]

    # The path of the last word: [final, edges so far, byte that leads on].
    path: list[list] = [[False, [], 0]]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges, _ = path.pop()
            path[-1][1].append((path[-1][2], freeze(final, edges)))

    previous = b""
    for word in words:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        close(common)
        for byte in word[common:]:
            path[-1][2] = byte
            path.append([False, [], 0])
        path[-1][0] = True
        previous = word
    close(0)
    root = freeze(path[0][0], path[0][1])
    keys, target, out = [], [], []
    for state, (final, edges) in enumerate(nodes):
        before = int(final)
        for byte, to in edges:
            keys.append(state << 8 | byte)
            target.append(to)
            out.append(before)
            before += counts[to]
    order = np.argsort(np.array(keys, np.int64))
    arrays = {
        "keys": np.array(keys, np.int64)[order],
        "target": np.array(target, np.int32)[order],
        "out": np.array(out, np.int32)[order],
        "final": np.array([int(n[0]) for n in nodes], np.int32),
        "starts": np.r_[0, np.cumsum(lengths)].astype(np.int64),
        "ids": np.asarray(ids, np.uint32),
    }
    head = json.dumps({"root": root, "sizes": {k: len(arrays[k]) for k, _ in FIELDS}}).encode()
    head += b" " * (-len(head) % 8)
    body = b"".join(arrays[k].astype(t).tobytes() + b"\0" * (-arrays[k].astype(t).nbytes % 8) for k, t in FIELDS)
    return MAGIC + len(head).to_bytes(8, "little") + head + body


class Lexicon:
    """Looks words up in a compiled file, which stays memory-mapped."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        if whole[:8].tobytes() != MAGIC:
            raise ValueError(f"not a lexicon file: {path}")
        size = int.from_bytes(whole[8:16].tobytes(), "little")
        head = json.loads(whole[16 : 16 + size].tobytes())
        self.root = head["root"]
        at = 16 + size
        for name, kind in FIELDS:
            n = head["sizes"][name] * np.dtype(kind).itemsize
            setattr(self, name, whole[at : at + n].view(kind))
            at += n + (-n % 8)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Each word's row in the id table, or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.root, np.int64)
        total = np.zeros(len(words), np.int64)
        if not len(self.keys):
            return np.full(len(words), -1)
        alive = np.arange(len(words))
        step = 0
        while len(alive):
            alive = alive[lengths[alive] > step]
            key = state[alive] << 8 | data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            state[alive[~found]] = -1
            alive, at = alive[found], at[found]
            total[alive] += self.out[at]
            state[alive] = self.target[at]
            step += 1
        good = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(good, total, -1)

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.starts[rows + 1] - self.starts[rows]
        return self.ids[ragged(self.starts[rows], lengths)], lengths


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    table = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merger:
    """Byte-pair merges by rank, the leftmost first among equal ranks."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys = keys
        self.rank = np.array([pairs[int(k)][0] for k in keys], np.int32)
        self.merged = np.array([pairs[int(k)][1] for k in keys], np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (b >= 0)
        return np.where(found, self.rank[at], NONE), self.merged[at]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        out: list[np.ndarray | None] = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > MATRIX_BYTES):
            out[k] = self._merge_long(words[k])
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] <= MATRIX_BYTES]
        for part in np.array_split(order, max(1, len(order) // 20_000)):
            if len(part):
                for k, ids in zip(part, self._merge_matrix([words[k] for k in part], lengths[part])):
                    out[k] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0)).astype(np.uint32), sizes

    def _merge_matrix(self, words: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
        width = max(int(lengths.max()), 1)
        filled = np.arange(width) < lengths[:, None]
        s = np.full((len(words), width), -1, np.int64)
        s[filled] = self.inner[np.frombuffer(b"".join(words), np.uint8)]
        some = np.flatnonzero(lengths > 0)
        ends = np.frombuffer(bytes(words[k][-1] for k in some), np.uint8)
        s[some, lengths[some] - 1] = self.last[ends]
        result: list = [None] * len(words)
        live = np.arange(len(words))
        n = lengths.copy()
        rank = np.full((len(words), width), NONE, np.int32)
        into = np.zeros((len(words), width), np.int64)
        if width > 1:
            rank[:, :-1], into[:, :-1] = self._look(s[:, :-1], s[:, 1:])
        columns = np.arange(width - 1) if width > 1 else np.zeros(0, np.int64)
        while True:
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            go = rank[rows, at] < NONE
            for k in np.flatnonzero(~go):
                result[live[k]] = s[k, : n[k]]
            if not go.any():
                return result
            live, s, rank, into, n, at = live[go], s[go], rank[go], into[go], n[go], at[go]
            rows = np.arange(len(live))
            s[rows, at] = into[rows, at]
            # Close the gap behind the merged pair.
            later = columns[None, :] + (columns[None, :] > at[:, None])
            for x, fill in ((s, -1), (rank, NONE), (into, 0)):
                x[:, :-1] = np.take_along_axis(x, later, 1)
                x[:, -1] = fill
            n -= 1
            following = np.minimum(at + 1, width - 1)
            rank[rows, at], into[rows, at] = self._look(s[rows, at], np.where(at + 1 < n, s[rows, following], -1))
            left = np.maximum(at - 1, 0)
            r, m = self._look(s[rows, left], s[rows, at])
            has = at > 0
            rank[rows[has], left[has]], into[rows[has], left[has]] = r[has], m[has]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One word with a queue of its pairs: time grows as n log n."""
        s = [int(self.inner[b]) for b in word]
        s[-1] = int(self.last[word[-1]])
        before = list(range(-1, len(s) - 1))
        after = [*range(1, len(s)), -1]
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get(s[i] << 20 | s[j])):
                heapq.heappush(queue, (found[0], i, s[i], s[j]))

        for i in range(len(s) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i] = self.pairs[a << 20 | b][1]
            s[j] = -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in s if x >= 0], np.int64)
