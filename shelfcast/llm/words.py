"""Words of whole texts as numpy arrays, for the operators that run in Python tasks.

A word is a run of characters other than space and the five control characters
9 to 13. All functions work on the UTF-8 bytes of many texts at once; a word's
identity is a 64-bit hash of its bytes, so two different words are taken for one
with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The words of every contract of this package, as a pattern for Java, RE2 and Python.
WORD = r"[^\x20\x09-\x0D]+"

# Odd, so that it has an inverse modulo 2**64: the powers turn prefix sums into hashes.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
# Texts are handled in slices of about this many bytes, which bounds the memory of a task.
SLICE_BYTES = 1 << 20

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow_powers(n: int) -> None:
    global _powers, _inverses
    if len(_powers) >= n:
        return
    size = max(n, SLICE_BYTES + 1)
    with np.errstate(over="ignore"):
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE_INVERSE, np.uint64)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# Random values per byte keep the sums of the polynomial apart.
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64), 7)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text stands alone."""
    if len(texts) == 0:
        return
    ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 1))
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield begin, end
        begin = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and each text's begin and end (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if buffers[2] is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    data = np.frombuffer(buffers[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def binary_content(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after the other, and each value's begin and end."""
    values = values.cast(pa.large_binary())
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    content = values.buffers()[2]
    data = np.frombuffer(content, np.uint8)[bounds[0] : bounds[-1]] if content is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def fold_ascii(data: np.ndarray) -> np.ndarray:
    """Lower-case A to Z and nothing else."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in ``data``, and for each text the index of its first word.

    The last array has one element more than there are texts.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # A text that ends without a space must not run into the next one.
    starts_here = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[starts_here] = inside[starts_here]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_here = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[ends_here] = inside[ends_here]
    begin = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, bounds)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes with ``inside`` set, none across texts, and for each text its first run.

    The last array has one element more than there are texts.
    """
    edges = np.zeros(len(inside) + 1, bool)
    edges[1:-1] = inside[1:] != inside[:-1]
    edges[bounds] = True
    edges = np.flatnonzero(edges)
    kept = inside[edges[:-1]] if len(inside) else np.zeros(0, bool)
    begin = edges[:-1][kept]
    return begin, edges[1:][kept], np.searchsorted(begin, bounds)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    _grow_powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _powers[: len(data)], out=total[1:])
        raw = (total[end] - total[begin]) * _inverses[begin]
        return mix(raw + (end - begin).astype(np.uint64), seed + 1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (``len(words) - n + 1`` values)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n <= 8:
            out = mix(words[:count], 1)
            for k in range(1, n):
                out = mix(out * np.uint64(3) + words[k : k + count], k + 1)
            return out
        _grow_powers(len(words) + 1)
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _powers[: len(words)], out=total[1:])
        return mix((total[n:] - total[:-n]) * _inverses[:count], n)
