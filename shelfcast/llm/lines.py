"""Keep one occurrence of each group of equal or nearly equal lines.

A line is normalized to its words with A to Z in lower case. Two lines are near
if the edit similarity of their words reaches the threshold, 0.8 by default.
Candidates come from SimHashes of blocks: a line is cut where a word's hash is
the smallest of those around it, so an edit moves only the cuts next to it, and
by the pigeonhole principle lines with fewer edits than blocks have a whole
block in common. Each block's SimHash adds up the bits of its words' hashes, and
lines are joined on equal ones. Lines of nine words or less, which one edit at
most may part, are joined on the SimHashes of the line with each word left out;
these find all of them. Blocks do not: where edits are so many that they reach
every block, a near line is missed. Of the near pairs that brute force finds in
the given documents 0.97 or more share a key (README, and a test).

Near lines are linked into groups; of each group the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import build_bitmap, passes
from .buckets import differing_bits, link_buckets, parity_marks
from .tables import Workspace, plain_names
from .words import binary_content, fold_ascii, hash_spans, mix, slices, spans, text_bytes

# A cut is the smallest word hash among so many words on either side.
RADIUS = 3
# Lines of so many words or less may be one edit apart at most, for PERCENT.
ONE_EDIT = 9
# The shortest line cut into blocks; a line of 10 words may be near one of 8.
LEAST_CUT = 8
# The shortest line that may be near another one, of five words.
LEAST_WORDS = 4
# Blocks at the ends of a line have so many words: a sixth of the line between these bounds.
LEAST_END, MOST_END, END_SHARE = 2, 4, 6
# Buckets of so many lines or less are not divided by length, but compared to see who has a near line.
SMALL = 8
# Edit similarity of word sequences, in percent; the keys are made for this or more.
PERCENT = 80
# Cells of a band of the edit table that are worked on at once.
CELLS = 1 << 17
# 64-bit numbers of word parities.
PARITIES = 4
MARKS = [f"parity{k}" for k in range(PARITIES)]
# As many more for the last round, which compares the most pairs.
LAST_PARITIES = 8


def line_table(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line number, word hashes, first word, word count) of lines with a word, by slice."""
    for begin, end in slices(texts):
        data, bounds = text_bytes(texts.slice(begin, end - begin))
        if not len(data):
            continue
        data = fold_ascii(data)
        breaks = np.flatnonzero(data == 10)
        first, last, _ = spans(data, bounds)
        words = hash_spans(data, first, last)
        # Words of one text with the same number of line breaks before them make a line.
        row = np.searchsorted(bounds, first, "right") - 1
        number = np.searchsorted(breaks, first) - np.searchsorted(breaks, bounds[:-1])[row]
        new = np.ones(len(first), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        starts = np.flatnonzero(new)
        yield begin + row[starts], number[starts], words, starts, np.diff(np.r_[starts, len(first)])


def line_ids(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line's word sequence."""
    if not len(starts):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        place = (np.arange(len(words)) - np.repeat(starts, sizes)).astype(np.uint64)
        total = np.add.reduceat(mix(words + place * np.uint64(0x9E3779B97F4A7C15), 3), starts)
        return mix(total + sizes.astype(np.uint64), 4).view(np.int64)


# Four bits of a hash as four counters of 16 bits.
_SPREAD = np.array([sum((k >> b & 1) << 16 * b for b in range(4)) for k in range(16)], np.uint64)


def simhashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit k is set if more than half of the counted words of a block have it set in their hash.

    A word that equals one of the two before it in its block does not count: the
    separator that fills half of a table row must not decide alone.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(starts)), sizes)
    again = np.zeros(len(words), bool)
    for by in (1, 2):
        again[by:] |= (words[by:] == words[:-by]) & (line[by:] == line[:-by])
    kept = words[~again]
    count = np.bincount(line[~again], minlength=len(starts))
    begin = np.cumsum(count) - count
    out = np.zeros(len(starts), np.uint64)
    if count.max() < 1 << 16:
        for part in range(16):
            sums = np.add.reduceat(_SPREAD[(kept >> np.uint64(4 * part) & np.uint64(15)).astype(np.int64)], begin)
            for b in range(4):
                ones = (sums >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)
                out |= (2 * ones > count).astype(np.uint64) << np.uint64(4 * part + b)
    else:
        for b in range(64):
            ones = np.add.reduceat((kept >> np.uint64(b) & np.uint64(1)).astype(np.int64), begin)
            out |= (2 * ones > count).astype(np.uint64) << np.uint64(b)
    return out.view(np.int64)


def parities(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``PARITIES`` numbers for each line: whether the words that hash to a bit are odd in number."""
    out = np.zeros((PARITIES, len(starts)), np.uint64)
    if len(starts):
        own = mix(words, 6)
        bit = np.uint64(1) << (own & np.uint64(63))
        place = (own >> np.uint64(6)) % np.uint64(PARITIES)
        for k in range(PARITIES):
            out[k] = np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), starts)
    return out.view(np.int64)


def cut_blocks(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, first word, word count) of the blocks of lines."""
    line = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(words)) - np.repeat(starts, sizes)
    rest = np.repeat(sizes, sizes) - place
    end = np.clip(np.repeat(sizes, sizes) // END_SHARE, LEAST_END, MOST_END)
    own = mix(words, 11)
    cut = (place >= end) & (rest >= end)
    for by in range(1, RADIUS + 1):
        inside = place[by:] >= by
        cut[by:] &= ~(inside & (own[:-by] <= own[by:]))
        cut[:-by] &= ~(inside & (own[by:] < own[:-by]))
    begin = np.flatnonzero(cut | (place == 0))
    return line[begin], begin, np.diff(np.r_[begin, len(words)])


def left_out(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, words, first word, word count) of lines as they are and with each of their words left out."""
    gone = np.arange(int((sizes + 1).sum())) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    line = np.repeat(np.arange(len(starts)), sizes + 1)
    whole = sizes[line]
    copy = np.repeat(np.arange(len(line)), whole)
    place = np.arange(len(copy)) - np.repeat(np.cumsum(whole) - whole, whole)
    # The last copy of a line leaves nothing out.
    keep = place != gone[copy]
    size = whole - (gone < whole)
    taken = words[(starts[line][copy] + place)[keep]]
    kept = size > 0
    first = np.cumsum(size) - size
    return line[kept], taken, first[kept], size[kept]


def near_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): near lines have one in common, but for some whose edits reach all blocks."""
    pieces = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    short = np.flatnonzero((sizes >= LEAST_WORDS) & (sizes <= ONE_EDIT))
    if len(short):
        line, own, begin, count = left_out(words, starts[short], sizes[short])
        pieces.append((short[line], mix(simhashes(own, begin, count).view(np.uint64), 1).view(np.int64)))
    long = np.flatnonzero(sizes >= LEAST_CUT)
    if len(long):
        size = sizes[long]
        first = np.cumsum(size) - size
        own = words[np.repeat(starts[long] - first, size) + np.arange(int(size.sum()))]
        line, begin, count = cut_blocks(own, first, size)
        pieces.append((long[line], mix(simhashes(own, begin, count).view(np.uint64), 2).view(np.int64)))
    return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])


def _within(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether row k of ``x`` (n[k] words) and of ``y`` (m[k] words) are at most most[k] edits apart.

    All pairs go through the band around the diagonal of their edit tables
    together, one word of ``x`` at a time; a pair leaves when its row of the
    table has no cell in reach, or with its last word.
    """
    band = int(most.max())
    offset = np.arange(-band, band + 1)
    far = np.int32(x.shape[1] + y.shape[1] + 2 * band + 2)
    padded = np.zeros((len(x), x.shape[1] + 2 * band + 1), np.uint32)
    padded[:, band : band + y.shape[1]] = y[:, : padded.shape[1] - band]
    row = np.repeat(np.where(offset >= 0, offset, far)[None].astype(np.int32), len(x), 0)
    out = np.zeros(len(x), bool)
    open_ = np.arange(len(x))
    slope = np.arange(2 * band + 1, dtype=np.int32)
    for i in range(x.shape[1] + 1):
        if i:
            new = row + (padded[:, i - 1 : i + 2 * band] != x[:, i - 1 : i])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - slope, axis=1) + slope
        done = n[open_] == i
        if done.any():
            ended = open_[done]
            place = m[ended] - n[ended] + band
            out[ended] = row[done, place] <= most[ended]
        alive = ~done & (row.min(axis=1) <= most[open_])
        if done.any() or 4 * int(alive.sum()) < 3 * len(alive):
            open_, row, x, padded = open_[alive], row[alive], x[alive], padded[alive]
            if not len(open_):
                break
    return out


def near_sequences(a: pa.Array, b: pa.Array, percent: int) -> np.ndarray:
    """Whether the words of each pair (32-bit hashes, as binary) have an edit similarity of ``percent`` or more."""
    sides = []
    for values in (a, b):
        content, bounds = binary_content(values)
        sides.append((np.frombuffer(content.tobytes(), np.uint32), (bounds - bounds[0]) // 4))
    (x, at_x), (y, at_y) = sides
    n, m = np.diff(at_x), np.diff(at_y)
    swap = n > m
    words = np.concatenate([x, y])
    at_x, at_y = at_x[:-1], at_y[:-1] + len(x)
    at_x, at_y = np.where(swap, at_y, at_x), np.where(swap, at_x, at_y)
    n, m = np.minimum(n, m), np.maximum(n, m)
    most = m * (100 - percent) // 100
    out = np.zeros(len(n), bool)
    order = np.lexsort((m, n))
    order = order[(m - n <= most)[order]]

    def padded(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(at), int(size.max())), np.uint32)
        inside = np.arange(wide.shape[1]) < size[:, None]
        wide[inside] = words[(at[:, None] + np.arange(wide.shape[1]))[inside]]
        return wide

    begin = 0
    while begin < len(order):
        # Pairs of about the same length, as many as the cells allow.
        size = m[order[begin]]
        width = max(2 * int(size), 1)
        end = min(begin + max(1, CELLS // width), int(np.searchsorted(n[order], max(size, 8) * 5 // 4, "right")))
        some = order[begin : max(end, begin + 1)]
        out[some] = _within(padded(at_x[some], n[some]), padded(at_y[some], m[some]), n[some], m[some], most[some])
        begin += len(some)
    return out


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(_id, _doc, line, node) of all lines with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, words, starts, sizes in line_table(batch.column(2)):
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                        pa.array(number, pa.int64()),
                        pa.array(line_ids(words, starts, sizes)),
                    ],
                    ["_id", "_doc", "line", "node"],
                )

    schema = docs.select("_id", "_doc").schema.add("line", "long").add("node", "long")
    return docs.select("_id", "_doc", F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def _keyed_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, *MARKS, n, keys): each distinct line that may have a near one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, starts, sizes in line_table(batch.column(0)):
                ids = line_ids(words, starts, sizes)
                once = np.unique(ids, return_index=True)[1]
                once = once[sizes[once] >= LEAST_WORDS]
                size = sizes[once]
                first = np.cumsum(size) - size
                own = words[np.repeat(starts[once] - first, size) + np.arange(int(size.sum()))]
                line, keys = near_keys(own, first, size)
                order = np.lexsort((keys, line))
                line, keys = line[order], keys[order]
                new = np.ones(len(line), bool)
                new[1:] = (line[1:] != line[:-1]) | (keys[1:] != keys[:-1])
                line, keys = line[new], keys[new]
                bounds = np.searchsorted(line, np.arange(len(once) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[once]),
                        *[pa.array(v) for v in parities(own, first, size)],
                        pa.array(size, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys)),
                    ],
                    ["node", *MARKS, "n", "keys"],
                )

    schema = f"node long, {', '.join(f'{c} long' for c in MARKS)}, n long, keys array<long>"
    out = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
    return out.groupBy("node").agg(*[F.min(c).alias(c) for c in (*MARKS, "n")], F.min("keys").alias("keys"))


def _sequences(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, words): 32 bits of the word hashes of the wanted lines."""
    bitmap = docs.sparkSession.sparkContext.broadcast(build_bitmap(wanted, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, starts, sizes in line_table(batch.column(0)):
                ids = line_ids(words, starts, sizes)
                maybe = np.flatnonzero(passes(bitmap.value, ids))
                # Zero stands for no word.
                short = np.maximum(words.astype(np.uint32), np.uint32(1))
                nodes, where = np.unique(ids[maybe], return_index=True)
                where = maybe[where]
                yield pa.record_batch(
                    [
                        pa.array(nodes),
                        pa.array([short[starts[k] : starts[k] + sizes[k]].tobytes() for k in where], pa.binary()),
                    ],
                    ["node", "words"],
                )

    lines = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "node long, words binary")
    return lines.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _postings(keyed: DataFrame, percent: int, fits: Column, workspace: Workspace) -> DataFrame:
    """(token, node, *MARKS, n) of the keys that two lines have.

    Large buckets are divided by length: lines whose lengths differ by less than
    the threshold allows have a class of lengths, or the next, in common.
    """
    slim = keyed.select("node", F.explode("keys").alias("token"))
    # Lines are distinct, so a key with a second row has a second line.
    sizes = slim.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = workspace.write(sizes, "sizes")
    workspace.release()
    found = workspace.write(slim.join(sizes, "token"), "found")
    workspace.release()
    workspace.drop(sizes)
    rows = workspace.write(found.join(keyed.select("node", *MARKS, "n"), "node"), "rows")
    workspace.release()
    workspace.drop(found)
    small = _without_chance(rows.where(F.col("size") <= SMALL).drop("size"), fits)
    level = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)) if percent < 100 else F.col("n")
    large = rows.where(F.col("size") > SMALL).withColumn("level", F.explode(F.array(level, level + 1)))
    large = large.withColumn("token", F.xxhash64("token", "level")).select("token", "node", *MARKS, "n")
    out = workspace.write(small.unionByName(large), "postings")
    workspace.release()
    workspace.drop(rows)
    return out


def _without_chance(small: DataFrame, fits: Column) -> DataFrame:
    """The rows of small buckets that have another row in theirs which fits."""
    sides = ("node", *MARKS, "n")
    a = small.select("token", *[F.col(c).alias(f"{c}_a") for c in sides])
    b = small.select("token", *[F.col(c).alias(f"{c}_b") for c in sides])
    near = a.join(b, "token").where("node_a <> node_b").where(fits).select("token", F.col("node_a").alias("node"))
    kept = small.join(near.distinct(), ["token", "node"], "left_semi")
    return kept.select("token", *sides)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus n_lines and n_dropped.

    Lines are cut at \\n; lines without a word stay as they are. The first
    occurrence of a group is the one with the smallest (id, hash of the text,
    line); null ids come first. Rows with equal id and text count as one
    occurrence and keep the same lines. Null text: no lines, the text stays
    null. A text that loses all its lines becomes what is left, maybe empty.
    An empty table gives an empty one. Earlier columns named n_lines or
    n_dropped go. ``percent`` is the edit similarity of near lines, 80 or more.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {PERCENT} to 100")
    workspace = Workspace(docs.sparkSession, "lines")
    docs, names = plain_names(docs, ("n_lines", "n_dropped"))
    id_col, text_col = names[id_col], names[text_col]
    keyed = docs.withColumns({"_id": F.col(id_col), "_doc": F.xxhash64(F.col(text_col).cast("string"))})

    # A replaced word changes two parities at most, one that is added or left out one; of these
    # there are as many at least as the lengths differ by.
    differ = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in MARKS)
    most = f"2 * (greatest(n_a, n_b) * {100 - percent} div 100) - abs(n_a - n_b)"
    fits = F.expr(f"{differ} <= {most} and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    distinct = workspace.write(_keyed_lines(docs, text_col), "distinct")
    workspace.release()
    postings = _postings(distinct, percent, fits, workspace)
    workspace.drop(distinct)
    sequences = workspace.write(_sequences(docs, text_col, postings.select("node").distinct()), "sequences")
    workspace.release()

    def verify(pairs: DataFrame) -> DataFrame:
        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = near_sequences(batch.column(2), batch.column(3), percent)
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

        with_a = pairs.join(sequences.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
        with_b = with_a.join(sequences.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
        return with_b.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")

    # Lines with a passage in common share many keys: the last round meets a pair at the smallest only.
    tokens = postings.groupBy("node").agg(F.collect_set("token").alias("tokens"))
    marks = workspace.write(parity_marks(sequences, np.uint32, LAST_PARITIES).join(tokens, "node"), "marks")
    alike = F.expr(f"{differing_bits(marks)} <= {most} and array_min(array_intersect(tokens_a, tokens_b)) = token")
    roots = link_buckets(workspace, postings, [*MARKS, "n"], F.xxhash64("node"), fits, verify, marks, alike)
    roots = workspace.write(roots, "roots")
    workspace.release()
    workspace.drop(sequences)
    workspace.drop(marks)
    workspace.drop(postings)

    # The place that stays, for every line that occurs in more than one place or has near ones.
    lines = workspace.write(_lines(keyed, text_col), "lines")
    place = F.struct(F.col("_id"), F.col("_doc"), F.col("line"))
    nodes = lines.groupBy("node").agg(F.min(place).alias("first"), F.max(place).alias("final"))
    grouped = nodes.join(roots.withColumn("near", F.lit(True)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Of lines that occur once and have no near ones nothing goes.
    grouped = workspace.write(grouped.where("root <> node or not (first <=> final) or near").drop("near"), "grouped")
    stays = grouped.groupBy("root").agg(F.min("first").alias("stays"), F.max("final").alias("_final"))
    stays = stays.where("not (stays <=> _final)").select("root", "stays")
    stays = workspace.write(grouped.select("node", "root").join(stays, "root").select("node", "stays"), "stays")
    workspace.release()
    gone = lines.join(stays, "node").where(~place.eqNullSafe(F.col("stays")))
    gone = gone.groupBy("_id", "_doc").agg(F.collect_set("line").alias("_gone"))
    gone = workspace.write(gone, "gone").select(F.col("_id").alias("_id2"), F.col("_doc").alias("_doc2"), "_gone")

    marked = keyed.join(
        gone, keyed["_id"].eqNullSafe(gone["_id2"]) & keyed["_doc"].eqNullSafe(gone["_doc2"]), "left"
    )
    text = F.col(text_col).cast("string")
    parts = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(parts).cast("long") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(parts, i.cast("int"))), "\n")
    )
    with_word = F.size(F.filter(parts, lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    return marked.select(
        *[kept.alias(c) if n == text_col else F.col(n).alias(c) for c, n in names.items()],
        F.when(text.isNull(), 0).otherwise(with_word).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
