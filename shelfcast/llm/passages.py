"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept only where content selects them: at the smallest hash among
``least_words - GRAM + 1`` neighbouring grams of ``GRAM`` words, so every passage
of ``least_words`` words holds a selected position, the same in all its copies.
Suffixes whose gram occurs in one document only are left out. The others are
sorted twice, by the gram with the words that follow and by the gram with those
that precede, and each is compared with its nearest neighbours of other
documents. The match is extended to both sides: it is a passage if it has
``least_words`` words. The neighbours also tell how far any other document goes
along on either side, so with how many words before the gram a passage can
begin. Where the neighbours show none for such a number, suffixes are grouped by
the gram, so many words before it and the remaining ones after it, which finds
passages that other documents hide in both orders. Matches of neighbouring
positions overlap, so merged they give whole passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import build_bitmap, passes
from .tables import Workspace
from .words import binary_content, fold_ascii, gram_hashes, hash_spans, mix, slices, spans, text_bytes

GRAM = 32
LEAST_WORDS = 50


def _windows(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` over values[i : i + width] for every i that has so many."""
    out, have = values, 1
    while 2 * have <= width:
        out = reduce(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = reduce(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])
    return out


def selected(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions whose gram is the smallest of some window of ``width`` valid grams."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = _windows(grams, width, np.minimum)
    whole = _windows(valid, width, np.logical_and)
    low = np.where(whole, low, 0)
    # Windows that contain a position: their minima are at most its gram, equal if it is selected.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((_windows(padded, width, np.maximum) == grams) & valid & (grams > 0))


def suffixes(texts: pa.Array, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, position in the text, gram, word index, words, first and end word of the text) by slice."""
    for begin, end in slices(texts):
        data, bounds = text_bytes(texts.slice(begin, end - begin))
        first, last, index = spans(data, bounds)
        words = hash_spans(fold_ascii(data), first, last)
        grams = gram_hashes(words, GRAM)
        if not len(grams):
            continue
        of = np.repeat(np.arange(end - begin), np.diff(index))
        valid = of[: len(grams)] == of[GRAM - 1 :]
        at = selected(grams, valid, least - GRAM + 1)
        yield begin + of[at], at - index[of[at]], grams[at], at, words, index[of[at]], index[of[at] + 1]


def _contexts(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """32 bits of each of the ``reach`` words before (nearest first) and after the grams; 0 outside the text."""
    short = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)
    steps = np.arange(reach)
    left = at[:, None] - 1 - steps
    right = at[:, None] + GRAM + steps
    before = np.where(left >= low[:, None], short[np.maximum(left, 0)], 0)
    after = np.where(right < high[:, None], short[np.minimum(right, len(short) - 1)], 0)
    return before.astype(">u4"), after.astype(">u4")


def _binary(rows: np.ndarray, size: int) -> pa.Array:
    """Equal-sized binary values from the rows of a matrix, without a copy per row."""
    offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def _context_ids(gram: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each gram with its surroundings."""
    out = gram
    for k in range(before.shape[1]):
        out = mix(out ^ (before[:, k].astype(np.uint64) << np.uint64(32) | after[:, k].astype(np.uint64)), 5)
    return out.view(np.int64)


def _extent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words at the start of each row of two matrices; 0 is no word."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _neighbours(contexts: DataFrame, reach: int, side: str, workspace: Workspace) -> DataFrame:
    """(context, gram, far, least, most, twin) from the order by the gram and the words on one side.

    far: words on this side that at most another document shares; at the ends
    of a batch of sorted rows, where a neighbour is out of sight, all there are.
    least, most: words before the gram with which passages shared with a
    neighbour begin, null without one; twin: a document of it.
    """
    schema = "context long, gram long, far int, least int, most int, twin long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            gram, low, high = (batch.column(c).to_numpy() for c in ("gram", "low", "high"))
            words = {}
            for c in ("left", "right"):
                content, bounds = binary_content(batch.column(c))
                words[c] = np.frombuffer(content[bounds[0] : bounds[-1]].tobytes(), ">u4").reshape(n, reach)
            # Rows of one document only, one behind the other, look for their neighbours around all of them.
            new = np.ones(n, bool)
            new[1:] = (gram[1:] != gram[:-1]) | (low[1:] != low[:-1]) | (high[1:] != low[:-1]) | (low[1:] != high[:-1])
            starts = np.flatnonzero(new)
            number = np.cumsum(new) - 1
            far = np.zeros(n, np.int64)
            least, most, twin = np.full(n, reach + 1), np.full(n, -1), np.zeros(n, np.int64)
            for partner in (starts[number] - 1, np.r_[starts[1:], n][number]):
                seen = (partner >= 0) & (partner < n)
                far[~seen] = reach
                me = np.flatnonzero(seen)
                me = me[gram[partner[me]] == gram[me]]
                other = partner[me]
                shared = {c: _extent(w[me], w[other]) for c, w in words.items()}
                far[me] = np.maximum(far[me], shared[side])
                found = shared["left"] + shared["right"] >= reach
                me, other = me[found], other[found]
                twin[me] = np.where(low[other] != low[me], low[other], high[other])
                least[me] = np.minimum(least[me], reach - shared["right"][found])
                most[me] = np.maximum(most[me], shared["left"][found])
            far = np.minimum(far, (words[side] > 0).sum(axis=1))
            none = most < 0
            yield pa.record_batch(
                [
                    batch.column("context"),
                    batch.column("gram"),
                    pa.array(far.astype(np.int32)),
                    pa.array(least.astype(np.int32), mask=none),
                    pa.array(most.astype(np.int32), mask=none),
                    pa.array(twin, mask=none),
                ],
                ["context", "gram", "far", "least", "most", "twin"],
            )

    order = ["gram", side, "right" if side == "left" else "left"]
    rows = contexts.select("context", "gram", "left", "right", "low", "high")
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order, "context").mapInArrow(run, schema)
    out = workspace.write(found, f"by-{side}")
    workspace.release()
    return out


def _extents(contexts: DataFrame, reach: int, workspace: Workspace) -> DataFrame:
    """(context, low, high, least, most): of suffixes with equal surroundings, the words before the gram
    with which a passage may begin, and one or two documents of which one at least is another one.

    ``contexts`` is deleted as soon as its rows have been taken.
    """
    n_left, n_right = (f"(length({c}) - 4 * size(filter(sequence(0, {reach - 1}), k -> substring({c}, 4 * k + 1, 4) = x'00000000'))) div 4" for c in ("left", "right"))
    whole = contexts.where("low <> high").select(
        "context", "low", "high", F.expr(f"int(greatest({reach} - {n_right}, 0))").alias("least"), F.expr(f"int({n_left})").alias("most")
    )
    whole = workspace.write(whole, "whole")

    # Surroundings of one document can meet others of the same gram only.
    edge = contexts.groupBy("gram").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max(F.col("low") == F.col("high")).alias("single")
    )
    grams = workspace.write(edge.where("low <> high and single").select("gram"), "grams")
    workspace.release()
    some = workspace.write(contexts.join(grams, "gram", "left_semi"), "sorted")
    workspace.release()
    workspace.drop(contexts)
    after, before = (_neighbours(some, reach, side, workspace) for side in ("right", "left"))
    seen = after.select("context", "gram", (reach - F.col("far")).alias("lo"), F.lit(None).cast("int").alias("hi"), "least", "most", "twin")
    seen = seen.unionByName(
        before.select("context", "gram", F.lit(None).cast("int").alias("lo"), F.col("far").alias("hi"), "least", "most", "twin")
    )
    seen = seen.groupBy("context").agg(
        F.max("gram").alias("gram"),
        F.max("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.min("twin").alias("low"),
        F.max("twin").alias("high"),
    )
    seen = workspace.write(seen, "seen")
    workspace.release()
    workspace.drop(after)
    workspace.drop(before)
    shown = seen.where("least is not null").select("context", "low", "high", "least", "most")

    # Beginnings that are possible but not shown, and all suffixes that may share them.
    possible = seen.where("lo <= hi").withColumn("l", F.explode(F.sequence("lo", "hi")))
    hidden = possible.where("least is null or l < least or l > most").join(
        some.where("low = high").select("context"), "context", "left_semi"
    )
    hidden = workspace.write(hidden.select("gram", "l").distinct(), "hidden")
    keys = possible.select("context", "gram", "l").join(hidden, ["gram", "l"], "left_semi").select("context", "l")
    keys = keys.join(some.select("context", "gram", "left", "right", "low", "high"), "context").select(
        "context",
        "low",
        "high",
        "l",
        F.expr(f"xxhash64(gram, l, substring(left, 1, 4 * l), substring(right, 1, 4 * ({reach} - l)))").alias("key"),
    )
    keys = workspace.write(keys, "keys")
    workspace.release()
    ends = keys.groupBy("key").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first <> last")
    found = keys.where("low = high").join(workspace.write(ends, "ends"), "key")
    found = found.select("context", F.col("first").alias("low"), F.col("last").alias("high"), F.col("l").alias("least"), F.col("l").alias("most"))
    every = whole.unionByName(shown).unionByName(found).groupBy("context")
    out = every.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))
    out = workspace.write(out, "extents")
    workspace.release()
    for table in (whole, some, seen, keys):
        workspace.drop(table)
    return out


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Passages of ``least_words`` words or more that another document also has.

    Columns: the id, start_word, n_words (a maximal stretch of repeated words) and
    twin_id, a document that has a part of it. Words are compared with A to Z in
    lower case, by hashes. Null or short texts: no row. Rows with equal id and
    text count as one document; null ids are documents of their own by their
    text. Repeats inside one document only do not count. Which of several twins
    is named may differ between runs; the passages do not.
    """
    if least_words <= GRAM:
        raise ValueError(f"least_words must be above {GRAM}")
    spark = docs.sparkSession
    workspace = Workspace(spark, "passages")
    reach = least_words - GRAM
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("doc"),
        F.col(text_col).cast("string").alias("text"),
    )

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, gram, *_ in suffixes(batch.column(1), least_words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), batch.column(0).take(pa.array(row))], ["gram", "doc"]
                )

    counted = keyed.select("doc", "text").mapInArrow(grams, "gram long, doc long").groupBy("gram")
    repeated = counted.agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("gram")
    bitmap = spark.sparkContext.broadcast(build_bitmap(workspace.write(repeated, "repeated"), "gram"))
    workspace.release()

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for row, _, gram, at, words, low, high in suffixes(batch.column(1), least_words):
                # A gram that passes by chance is sorted in vain, nothing else. Nor can a passage be in a shorter text.
                keep = np.flatnonzero(passes(bits, gram) & (high - low >= least_words))
                before, after = _contexts(words, at[keep], low[keep], high[keep], reach)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_context_ids(gram[keep], before, after)),
                        pa.array(gram[keep].view(np.int64)),
                        _binary(before, 4 * reach),
                        _binary(after, 4 * reach),
                        batch.column(0).take(pa.array(row[keep])),
                    ],
                    ["context", "gram", "left", "right", "doc"],
                )

    around = keyed.select("doc", "text").mapInArrow(surroundings, "context long, gram long, left binary, right binary, doc long")
    contexts = around.groupBy("context", "gram", "left", "right").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    contexts = workspace.write(contexts, "contexts")
    workspace.release()
    extents = _extents(contexts, reach, workspace)
    wanted = spark.sparkContext.broadcast(build_bitmap(extents, "context"))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hits = bitmap.value, wanted.value
        for batch in batches:
            for row, pos, gram, at, words, low, high in suffixes(batch.column(2), least_words):
                keep = np.flatnonzero(passes(bits, gram))
                context = _context_ids(gram[keep], *_contexts(words, at[keep], low[keep], high[keep], reach))
                hit = np.flatnonzero(passes(hits, context))
                taken = pa.array(row[keep[hit]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(pos[keep[hit]]), pa.array(context[hit])],
                    ["id", "doc", "pos", "context"],
                )

    schema = keyed.select("id", "doc").schema.add("pos", "long").add("context", "long")
    places = keyed.mapInArrow(positions, schema)
    # A passage with l words before the gram ends least_words later; all of one gram overlap.
    matches = places.join(extents, "context").select(
        "id",
        "doc",
        (F.col("pos") - F.col("most")).alias("start"),
        (F.col("pos") + least_words - F.col("least")).alias("end"),
        F.when(F.col("low") == F.col("doc"), F.col("high")).otherwise(F.col("low")).alias("twin"),
    )

    # Merge overlapping matches of a document; a document has no more of them than words.
    own = Window.partitionBy("id", "doc").orderBy("start", "end", "twin")
    merged = (
        matches.groupBy("id", "doc", "start", "end")
        .agg(F.min("twin").alias("twin"))
        .withColumn("reached", F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("fresh", (F.col("reached").isNull() | (F.col("start") > F.col("reached"))).cast("int"))
        .withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("id", "doc", "island")
        .agg(
            F.min("start").alias("start_word"),
            (F.max("end") - F.min("start")).alias("n_words"),
            F.max_by("twin", F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("twin"),
        )
    )
    merged = workspace.write(merged, "merged")
    twins = keyed.select(F.col("doc").alias("twin"), F.col("id").alias("twin_id"))
    twins = twins.join(merged.select("twin").distinct(), "twin", "left_semi").dropDuplicates(["twin"])
    merged = merged.join(twins, "twin", "left")
    return merged.select(F.col("id").alias(id_col), "start_word", "n_words", "twin_id")
