"""Phrases whose words keep together, counted as stripes and scored by their weakest cut.

A stripe belongs to a prefix and counts what follows it: for every next word the
occurrences of prefix and word, and one more entry, ``OTHER``, for occurrences
with nothing to count behind them. Its sum is therefore the frequency of the
prefix, its entries are the prefix's extensions, and its largest entry says
whether an extension subsumes the prefix. Tasks build stripes from a bounded
number of positions at a time, Spark brings the stripes of a prefix together, and
they are merged entry by entry.

Level by level: a phrase can only be frequent if both phrases of one word less
inside it are, so stripes of a level take prefixes and next words that the level
before left, tested by a fixed-size bitmap; everything else counts as ``OTHER``.

A phrase is known by a 64-bit number made of the numbers of its first and its
last words, so a next word is named by the number of the words it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import build_bitmap, passes
from .chunks import ragged
from .tables import Workspace
from .words import binary_content, fold_ascii, hash_spans, mix, runs, slices, text_bytes

# Bytes that end a piece of text, and bytes between the words of a piece.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
# Stands in a stripe for a next word that is rare or missing.
OTHER = -(1 << 63)
# Positions or distinct words a task counts before it hands on what it has.
BUFFER = 1 << 20
# Entries of a row of a stripe; a longer stripe is several rows, so a batch of rows stays small.
ROW_ENTRIES = 256
# Rows of a batch that leaves a task.
ROWS = 1 << 14
# A prefix with more occurrences than this and than one in HOT_SHARE of all words is
# cut into slices by next word; there are HOT_SHARE such prefixes at most.
HOT_LEAST, HOT_SHARE = 1 << 16, 1 << 16
# Slices in which a lang's phrases are ranked before they are ranked as a whole.
RANK_SLICES = 64

# An entry of a stripe on its way: a task's own count of at most BUFFER positions.
_ENTRY = np.dtype([("word", "<i8"), ("n", "<u4")])

_EDGE = np.zeros(256, bool)
_EDGE[list(PIECE_ENDS)] = True
_GAP = _EDGE.copy()
_GAP[list(SPACES)] = True


def _grow(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Numbers of phrases from those of their first words and of their last words."""
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(3) + rest, 11)


def _words(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, begin, end, text and number of each word, and whether the next word is in its piece."""
    data, bounds = text_bytes(texts)
    data = fold_ascii(data)
    begin, end, first = runs(~_GAP[data], bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    names, name_bounds = text_bytes(langs)
    seeds = hash_spans(names, name_bounds[:-1], name_bounds[1:], 5)
    number = mix(hash_spans(data, begin, end) ^ seeds[text])
    edges = np.concatenate([[0], np.cumsum(_EDGE[data])])
    joined = np.zeros(len(begin), bool)
    if len(begin):
        joined[:-1] = (text[1:] == text[:-1]) & (edges[begin[1:]] == edges[end[:-1]])
    return data, begin, end, text, number, joined


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        number = np.concatenate([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        kept, first, place = np.unique(number, return_index=True, return_inverse=True)
        sums = np.bincount(place, n, len(kept)).astype(np.int64)
        take = pa.array(first)
        words = pa.concat_arrays([h[2] for h in held]).take(take)
        langs = pa.concat_arrays([h[3] for h in held]).take(take)
        held.clear()
        return pa.record_batch([langs, words, pa.array(kept.view(np.int64)), pa.array(sums)], ["lang", "word", "id", "n"])

    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for a, b in slices(texts):
            data, begin, end, text, number, _ = _words(texts[a:b], langs[a:b])
            if not len(number):
                continue
            kept, first, n = np.unique(number, return_index=True, return_counts=True)
            sizes = (end - begin)[first]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            content = pa.py_buffer(data[ragged(begin[first], sizes)].tobytes())
            words = pa.LargeStringArray.from_buffers(len(kept), pa.py_buffer(ends.tobytes()), content)
            held.append((kept, n, words, langs[a:b].cast(pa.large_string()).take(pa.array(text[first]))))
            if sum(len(h[0]) for h in held) >= BUFFER:
                yield flush()
    if held:
        yield flush()


def _stripe_rows(prefix: np.ndarray, word: np.ndarray, n: np.ndarray, hot: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of stripes from entries in any order; equal entries are added up."""
    if not len(prefix):
        return
    part = np.zeros(len(prefix), np.int64)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, prefix), len(hot) - 1)
        shift = np.where(hot[place] == prefix, bits[place], 0)
        spread = mix(word.view(np.uint64), 3)
        part = np.where(shift > 0, spread >> np.uint64(32) & ((np.uint64(1) << shift.astype(np.uint64)) - np.uint64(1)), 0).astype(np.int64)
    order = np.lexsort((word, part, prefix))
    prefix, part, word, n = prefix[order], part[order], word[order], n[order]
    row = np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])]
    entry = np.flatnonzero(row | np.r_[True, word[1:] != word[:-1]])
    n = np.add.reduceat(n, entry)
    prefix, part, word, row = prefix[entry], part[entry], word[entry], row[entry]
    begins = np.flatnonzero(row)
    since = np.arange(len(row)) - np.repeat(begins, np.diff(np.r_[begins, len(row)]))
    begins = np.flatnonzero(since % ROW_ENTRIES == 0)
    for k in range(0, len(begins), ROWS):
        heads = begins[k : k + ROWS]
        stop = begins[k + ROWS] if k + ROWS < len(begins) else len(row)
        entries = np.empty(stop - heads[0], _ENTRY)
        entries["word"], entries["n"] = word[heads[0] : stop], n[heads[0] : stop]
        offsets = ((np.r_[heads, stop] - heads[0]) * _ENTRY.itemsize).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])
        columns = [pa.array(prefix[heads]), pa.array(part[heads]), pa.array(word[heads]), packed]
        yield pa.record_batch(columns, ["prefix", "part", "first", "entries"])


def _build_stripes(length: int, filters: Broadcast):
    """Stripes of prefixes of ``length`` words, a bounded number of positions at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot, bits = filters.value
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            prefix, word = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            yield from _stripe_rows(prefix, word, np.ones(len(prefix), np.int64), hot, bits)

        for batch in batches:
            texts, langs = batch.column("text"), batch.column("lang")
            for a, b in slices(texts):
                *_, number, joined = _words(texts[a:b], langs[a:b])
                whole = np.ones(len(number), bool)
                for _ in range(length - 1):
                    # Position k: the phrase one word longer that begins there, if its piece goes on.
                    longer = np.zeros_like(number)
                    longer[:-1] = _grow(number[:-1], number[1:])
                    whole = joined & np.r_[whole[1:], False]
                    number = longer
                whole &= passes(bitmap, number.view(np.int64))
                follows = joined & np.r_[whole[1:], False]
                rest = np.r_[number[1:], np.uint64(0)].view(np.int64)
                held.append((number[whole].view(np.int64), np.where(follows, rest, OTHER)[whole]))
                if sum(len(h[0]) for h in held) >= BUFFER:
                    yield from flush()
        if held:
            yield from flush()

    return build


def _merge_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up stripes entry by entry; rows come sorted by prefix, part and first word.

    A later row has no entry before its own first word, so what lies before it is
    final and leaves; no stripe need be held as a whole. A stripe may come out in
    several rows, each with the sum and the largest count of its entries.
    """
    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

    def merged(columns: list[np.ndarray]) -> list[np.ndarray]:
        prefix, part, word, n = columns
        if not len(prefix):
            return columns
        order = np.lexsort((word, part, prefix))
        prefix, part, word, n = prefix[order], part[order], word[order], n[order]
        new = np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]) | (word[1:] != word[:-1])]
        heads = np.flatnonzero(new)
        return [prefix[heads], part[heads], word[heads], np.add.reduceat(n, heads)]

    def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        prefix, part, word, n = columns
        if not len(prefix):
            return
        heads = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        best = np.maximum.reduceat(np.where(word == OTHER, 0, n), heads)
        named = np.flatnonzero(word != OTHER)
        offsets = pa.array(np.searchsorted(named, np.r_[heads, len(word)]), pa.int32())
        numbers = _grow(prefix[named].view(np.uint64), word[named].view(np.uint64)).view(np.int64)
        yield pa.record_batch(
            [
                pa.array(prefix[heads]),
                pa.array(np.add.reduceat(n, heads)),
                pa.array(best),
                pa.ListArray.from_arrays(offsets, pa.array(word[named])),
                pa.ListArray.from_arrays(offsets, pa.array(numbers)),
                pa.ListArray.from_arrays(offsets, pa.array(n[named])),
            ],
            ["prefix", "total", "best", "words", "ids", "counts"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = binary_content(batch.column("entries"))
        entries, lengths = data.view(_ENTRY), np.diff(bounds) // _ENTRY.itemsize
        keys = [batch.column(c).to_numpy() for c in ("prefix", "part", "first")]
        columns = [np.repeat(keys[0], lengths), np.repeat(keys[1], lengths), entries["word"].copy(), entries["n"].astype(np.int64)]
        columns = merged([np.concatenate(pair) for pair in zip(rest, columns)])
        last = [k[-1] for k in keys]
        keep = (columns[0] == last[0]) & (columns[1] == last[1]) & (columns[2] >= last[2])
        yield from out([c[~keep] for c in columns])
        rest = [c[keep] for c in columns]
    yield from out(rest)


_STRIPE_ROWS = "prefix long, part long, first long, entries binary"
_STRIPES = "prefix long, total long, best long, words array<long>, ids array<long>, counts array<long>"


def _filters(below: DataFrame, words: int) -> Broadcast:
    """What tasks of the next level need: the bitmap of phrases, and the hot ones with their slices."""
    most = max(HOT_LEAST, -(-words // HOT_SHARE))
    hot = below.where(F.col("a") > most).select("id", "a").toPandas().sort_values("id")
    bits = np.ceil(np.log2(hot["a"].to_numpy(np.float64) / most)).astype(np.int64) if len(hot) else np.zeros(0, np.int64)
    content = (build_bitmap(below, "id"), hot["id"].to_numpy(np.int64), bits)
    return below.sparkSession.sparkContext.broadcast(content)


def phrase_counts(
    docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of each number of words up to ``longest``, and all words of each lang.

    A table of phrases has lang, id, phrase, last (its last word), a (its
    occurrences, ``least`` at least), heads (occurrences of its first 1, 2, ...
    words, itself last), tails (of its last 1, 2, ... words) and longer (the most
    occurrences of a phrase with one word more on either side; 0 if none is frequent).
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "phrases")
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = texts.mapInArrow(_count_words, "lang string, word string, id long, n long")
    words = workspace.write(words.groupBy("lang", "id", "word").agg(F.sum("n").alias("n")), "words")
    langs = workspace.write(words.groupBy("lang").agg(F.sum("n").alias("n")), "langs")
    total = langs.agg(F.sum("n")).head()[0] or 0
    below = words.where(F.col("n") >= least).select(
        "lang", "id", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"),
        F.array("n").alias("heads"), F.array("n").alias("tails"),
    )
    levels = []
    for length in range(1, longest):
        filters = _filters(below, total)
        stripes = texts.mapInArrow(_build_stripes(length, filters), _STRIPE_ROWS)
        stripes = stripes.repartition("prefix", "part").sortWithinPartitions("prefix", "part", "first")
        stripes = workspace.write(stripes.mapInArrow(_merge_stripes, _STRIPES), "stripes")
        filters.unpersist()
        # The stripe of a prefix gives its frequency and its most frequent extension.
        of_prefix = stripes.groupBy(F.col("prefix").alias("id")).agg(F.sum("total").alias("a"), F.max("best").alias("after"))
        frequent = stripes.where(F.col("best") >= least).select("prefix", F.explode(F.arrays_zip("words", "ids", "counts")).alias("e"))
        frequent = frequent.select("prefix", F.col("e.words").alias("suffix"), F.col("e.ids").alias("id"), F.col("e.counts").alias("a"))
        frequent = workspace.write(frequent.where(F.col("a") >= least), "extensions")
        before = frequent.groupBy(F.col("suffix").alias("id")).agg(F.max("a").alias("before"))
        around = of_prefix.select("id", "after").join(before, "id", "full")
        around = around.select("id", F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0))).alias("longer"))
        levels.append(below.join(around, "id", "left").withColumn("longer", F.when(F.col("longer") >= least, F.col("longer")).otherwise(0)))
        # Frequencies of the first words: those of the prefix's own first words, and its stripe's sum.
        heads = below.join(of_prefix.select("id", F.col("a").alias("total")), "id")
        heads = heads.select(
            F.col("id").alias("prefix"), "lang", F.col("phrase").alias("begin"),
            F.concat(F.slice("heads", 1, length - 1) if length > 1 else F.array().cast("array<long>"), F.array("total")).alias("heads"),
        )
        tails = below.select(F.col("id").alias("suffix"), "last", "tails")
        grown = frequent.join(heads, "prefix").join(tails, "suffix")
        below = workspace.write(
            grown.select(
                "lang", "id", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "a",
                F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"),
            ),
            f"phrases-{length + 1}",
        )
    levels.append(below.withColumn("longer", F.lit(0).cast("long")))
    return levels, langs


def mine_phrases(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    subsumed_percent: int = 50,
    top: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each lang, those that keep together best first.

    A phrase with a occurrences, cut after its first k words into parts with l and
    r occurrences, scores floor(1000000 * a * a / (l * r)); its lowest cut counts,
    the first one of equal. Integers are exact (decimals of 38 digits, enough for
    10**15 words). A phrase is left out if a longer frequent one around it has
    ``subsumed_percent`` of its occurrences or more. Columns: lang, rank, phrase,
    a, l, r, n (words of the lang) and score.

    Null and empty texts have no words, a null lang is ``und``. Repeated rows
    count as often as they occur; equal scores are ordered by a and then by the
    phrase's bytes. An empty table gives no rows. A text of any length is read
    whole. Other columns are not read, so their names do not matter. Words are
    told apart by 64-bit hashes of lang and word.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    levels, langs = phrase_counts(docs, longest, least, text_col, lang_col)
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)
    found = found.where(F.col("longer") * 100 < F.col("a") * subsumed_percent)
    # Each cut: occurrences of the first k words and of the others; structs compare by score, then by cut.
    cuts = F.expr(
        """array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
             'score', cast((cast(1000000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0)))
                           div (cast(heads[k - 1] as decimal(19,0)) * cast(tails[size(heads) - k - 1] as decimal(19,0))) as bigint),
             'cut', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1])))"""
    )
    found = found.withColumn("lowest", cuts).select("lang", "phrase", "a", "lowest.l", "lowest.r", "lowest.score")
    # The best of each slice first, so that a lang's last ranking sees RANK_SLICES * top rows at most.
    best_first = (F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES)))
    for keys in (("lang", "slice"), ("lang",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first))
        found = found.withColumn("rank", place).where(F.col("rank") <= top)
    return found.join(langs, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
