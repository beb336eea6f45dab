"""Numbers that describe a text's form, for the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import fold_ascii, gram_hashes, hash_spans, mix, slices, spans, text_bytes

_CLASSES = ("other", "space", "lower", "upper", "digit", "mark", "symbol", "pipe", "exclaim", "high")


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[9, 10, 11, 12, 13, 32]] = 1
    table[97:123] = 2
    table[65:91] = 3
    table[48:58] = 4
    table[[ord(c) for c in ".,;:?'\"-()"]] = 5
    table[[ord(c) for c in "#*$%&<>"]] = 6
    table[ord("|")] = 7
    table[ord("!")] = 8
    table[128:] = 9
    return table


_TABLE = _class_table()

NAMES = (
    "log_words",
    "word_bytes",
    "longest_word",
    "space",
    "lower",
    "upper",
    "digit",
    "mark",
    "symbol",
    "pipe",
    "exclaim",
    "high",
    "same_as_before",
    "distinct_words",
    "repeated_grams",
    "words_a_line",
)


def describe(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` per text; a null or empty text has zeros only."""
    out = np.zeros((len(texts), len(NAMES)))
    for begin, end in slices(texts):
        data, bounds = text_bytes(texts.slice(begin, end - begin))
        count = end - begin
        if not len(data):
            continue
        row = np.repeat(np.arange(count), np.diff(bounds))
        tally = np.bincount(_TABLE[data] + row * len(_CLASSES), minlength=count * len(_CLASSES))
        tally = tally.reshape(count, -1)[:, : len(_CLASSES)]
        share = tally / np.maximum(np.diff(bounds), 1)[:, None]
        line_ends = np.bincount(row[data == 10], minlength=count)
        first, last, index = spans(data, bounds)
        sizes = last - first
        words = hash_spans(fold_ascii(data), first, last)
        n = np.diff(index)
        some = np.maximum(n, 1)
        of = np.repeat(np.arange(count), n)
        total = np.bincount(of, sizes, count)
        longest = np.zeros(count)
        np.maximum.at(longest, of, sizes)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        grams = gram_hashes(words, 5)
        inside = of[: len(grams)] == of[4:] if len(grams) else np.zeros(0, bool)
        gram_of = of[: len(grams)][inside]

        def distinct(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
            _, at = np.unique(mix(values + mix(owner.astype(np.uint64), 21), 22), return_index=True)
            return np.bincount(owner[at], minlength=count)

        gram_count = np.bincount(gram_of, minlength=count)
        columns = (
            np.log1p(n),
            total / some,
            np.log1p(longest),
            *[share[:, k] for k in range(1, 10)],
            np.bincount(of, again, count) / some,
            distinct(words, of) / some,
            1 - distinct(grams[inside], gram_of) / np.maximum(gram_count, 1),
            np.log1p(n / (line_ends + 1)),
        )
        block = np.stack(columns, axis=1)
        block[:, NAMES.index("repeated_grams")] *= gram_count > 0
        block[np.diff(bounds) == 0] = 0
        out[begin:end] = block
    return out
