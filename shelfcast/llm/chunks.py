"""Texts as chunks between white space, each distinct chunk encoded once per task.

The word tokenizer never joins characters across white space, so a text's ids are
its chunks' ids one after the other. ``ChunkEncoder`` keeps the chunks it has met
(up to a bound, then it starts anew) with their ids and gathers whole texts with
numpy. Texts with characters whose normalization depends on more than the single
character go through the tokenizer's own normalizer instead.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np

# Characters that the tokenizer's normalizer only lower-cases one by one, and whose classes
# Python's own pattern engine knows: printable ASCII, the five controls 9 to 13 and Latin
# letters up to U+024F. U+0130 (lower-cases to two characters) is left out.
PLAIN = re.compile("[^\t-\r -~¡-¬®-įı-ɏ]")
# The pattern of the tokenizer's file for one chunk of such characters (fixed values).
_NUMBERS = "²³¹¼½¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{_NUMBERS}]+|[\d{_NUMBERS}]|(?:(?![{_NUMBERS}])[\W_])+")
# Distinct chunks that are kept at a time.
MOST_CHUNKS = 1_000_000


def is_plain(text: str, specials: Sequence[str]) -> bool:
    return PLAIN.search(text) is None and not any(s in text for s in specials)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class ChunkEncoder:
    """Encodes lists of texts; ``encode_chunks`` maps new chunks to (ids, lengths)."""

    def __init__(
        self,
        encode_chunks: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        encode_other: Callable[[str], np.ndarray],
        specials: Sequence[str],
    ):
        self.encode_chunks, self.encode_other, self.specials = encode_chunks, encode_other, specials
        self._reset()

    def _reset(self) -> None:
        self.index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self, known: int) -> None:
        new = list(itertools.islice(self.index, known, None))
        if not new:
            return
        ids, lengths = self.encode_chunks(new)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's begin and end in them."""
        if len(self.index) > MOST_CHUNKS:
            self._reset()
        known = len(self.index)
        codes: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        other: dict[int, np.ndarray] = {}
        look = self.index.__getitem__
        for k, text in enumerate(texts):
            if is_plain(text, self.specials):
                parts = text.lower().split()
                counts[k] = len(parts)
                codes.extend(map(look, parts))
            else:
                other[k] = self.encode_other(text)
        self._learn(known)
        code = np.array(codes, np.int64)
        lengths = self.lengths[code] if len(code) else np.zeros(0, np.int64)
        ids = self.ids[ragged(self.starts[code], lengths)] if len(code) else np.zeros(0, np.uint32)
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]
        sizes = np.diff(np.r_[0, ends])
        if other:
            pieces, at = [], 0
            for k in range(len(texts)):
                if k in other:
                    pieces.append(other[k])
                    sizes[k] = len(other[k])
                else:
                    pieces.append(ids[at : at + sizes[k]])
                    at += sizes[k]
            ids = np.concatenate(pieces) if pieces else ids
        return ids, np.r_[0, np.cumsum(sizes)]
