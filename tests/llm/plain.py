"""Brute-force versions of the operators, row by row."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, n: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


class Groups:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def near_components(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """(id, set size, component id) of rows (id, text)."""
    sets = [shingles(t, n) for _, t in rows]
    groups = Groups(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                groups.link(i, j)
    smallest: dict[int, int | None] = {}
    for k, (i, _) in enumerate(rows):
        g = groups.find(k)
        known = [x for x in (smallest.get(g), i) if x is not None]
        smallest[g] = min(known) if known else None
    return [(i, len(s), smallest[groups.find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def repeated_word_places(rows: list[tuple], least: int) -> dict:
    """Places of each distinct (id, text) covered by windows of ``least`` words that another one has."""
    texts = {(i, t): words(t) for i, t in rows}
    owners: dict[tuple, set] = {}
    for key, w in texts.items():
        for k in range(len(w) - least + 1):
            owners.setdefault(tuple(w[k : k + least]), set()).add(key)
    out = {}
    for key, w in texts.items():
        covered = set()
        for k in range(len(w) - least + 1):
            if len(owners[tuple(w[k : k + least])]) > 1:
                covered.update(range(k, k + least))
        if covered:
            out[key] = covered
    return out


def form_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )
