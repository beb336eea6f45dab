"""Words of documents that benchmark items have too, found through an FM-index per shard of documents.

A word is a run of letters a to z (A to Z lower-cased), digits and characters
outside ASCII. The windows of an item are all its stretches of ``window`` words; an item
with fewer words is one window. A document word inside any occurrence of a window
is hit.

A shard is a bounded number of documents of a task. Only words that some item has
(by a fixed-size bitmap) and that stand in runs as long as the shortest window can
be part of an occurrence; these runs are indexed, backward search finds all
windows in them, and sampled suffixes tell where. Windows come to the tasks in
blocks of a bounded size, each with one pass over the documents; benchmarks of up
to a quarter of a million windows are one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import build_bitmap, passes
from .chunks import ragged
from .fm_index import FmIndex
from .tables import Workspace, plain_names
from .words import fold_ascii, hash_spans, runs, slices, text_bytes

# About so many windows, and bytes of item names, travel to the tasks at a time.
BLOCK_WINDOWS, BLOCK_BYTES = 1 << 18, 1 << 25
# Words that an index holds; a document with more has one of its own.
SHARD_WORDS = 1 << 20
# Bytes of texts of a batch that leaves a task.
BATCH_BYTES = 8 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

SPANS = "array<struct<begin_word:long,end_word:long,begin_char:long,end_char:long>>"


def _words(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, bounds of texts, begin, end and number of each word, and the first word of each text."""
    data, bounds = text_bytes(texts)
    data = fold_ascii(data)
    begin, end, first = runs(_IN_WORD[data], bounds)
    return data, bounds, begin, end, hash_spans(data, begin, end), first


def item_windows(items: DataFrame, window: int = 10, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """Every window of every item: item (its id as a string, or null) and words (64-bit numbers)."""
    if window < 1:
        raise ValueError("a window has one word at least")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column("text"), batch.column("item")
            for a, b in slices(texts):
                *_, number, first = _words(texts[a:b])
                sizes = np.diff(first)
                counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
                starts = ragged(first[:-1], counts)
                lengths = np.repeat(np.minimum(sizes, window), counts)
                words = pa.array(number[ragged(starts, lengths)].view(np.int64))
                offsets = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
                item = names[a:b].take(pa.array(np.repeat(np.arange(b - a), counts)))
                yield pa.record_batch([item, pa.ListArray.from_arrays(offsets, words)], ["item", "words"])

    texts = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(cut, "item string, words array<long>")


class Windows:
    """The distinct windows of a block and the items of each, smallest item first."""

    def __init__(self, rows: pa.Table, window: int):
        words, names = rows.column("words").combine_chunks(), rows.column("item").combine_chunks()
        bounds = words.offsets.to_numpy().astype(np.int64)
        lengths = np.diff(bounds)
        table = np.zeros((len(lengths), window + 1), np.uint64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = words.flatten().to_numpy().view(np.uint64)
        table[:, window] = lengths
        kept, of = np.unique(table, axis=0, return_inverse=True)
        self.words, self.lengths = kept[:, :window], kept[:, window].astype(np.int64)
        known = sorted({n for n in names.to_pylist() if n is not None})
        number = {n: k for k, n in enumerate(known)}
        self.names = known
        pairs = np.unique([(w, number[n]) for w, n in zip(of.reshape(-1).tolist(), names.to_pylist()) if n is not None] or np.zeros((0, 2), np.int64), axis=0)
        self.items = pairs[:, 1]
        self.begins = np.searchsorted(pairs[:, 0], np.arange(len(kept) + 1))


def _covered(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans that are sorted by begin, as spans that neither overlap nor touch."""
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]]) if len(begin) else np.zeros(0, np.int64)
    return begin[new], reach[np.r_[new[1:] - 1, len(reach) - 1]] if len(new) else new


def _find(numbers: np.ndarray, first: np.ndarray, possible: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows in texts whose words begin at ``first``: position of the first word, and the window."""
    shortest = int(windows.lengths.min()) if len(windows.lengths) else 0
    begin, end, _ = runs(possible, first)
    long = end - begin >= max(1, shortest)
    begin, end = begin[long], end[long]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Shards end between runs, which no occurrence crosses.
    total = np.r_[0, np.cumsum(end - begin)]
    k = 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(total, total[k] + SHARD_WORDS, "right")) - 1)
        places = ragged(begin[k:stop], (end - begin)[k:stop])
        index = FmIndex(numbers[places], total[k:stop] - total[k])
        low, high = index.search(windows.words, windows.lengths)
        which = np.repeat(np.arange(len(low)), high - low)
        found.append((places[index.locate(ragged(low, high - low))], which))
        k = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def mark_contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    keep_text: bool = True,
) -> DataFrame:
    """The rows of ``docs`` with what the benchmark items have of each text.

    Added columns: n_words; hit_spans, the hit stretches as word positions and as
    character positions in the text (from the first word's begin to the last
    word's end), none touching another; hit_items, the ids of items with a window
    in the text, as strings in string order.

    Null texts, texts without words and items without words have no hits; a null
    item id is never listed, but its windows hit. Items that share an id are one
    item. Repeated documents are each marked. With no documents or no items
    nothing is hit. A text of any length is read whole. A column of ``docs`` with
    the name of an added one is replaced. Without ``keep_text`` the text is left out.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "windows")
    found = workspace.write(item_windows(items, window, item_text_col, item_id_col), "windows")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("bytes")).head()
    blocks = max(1, -(-size.n // BLOCK_WINDOWS), -(-size.bytes // BLOCK_BYTES))
    vocabulary = spark.sparkContext.broadcast(build_bitmap(found.select(F.explode("words").alias("word")), "word"))
    added = ("n_words", "hit_spans", "hit_items")
    inner, names = plain_names(docs, (*added, text_col))
    texts = docs.select(F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = texts.select(
        *inner.columns, "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    if blocks > 1:
        found = found.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
        found = workspace.write(found, "blocks", partition_by=("block",))
    for block in range(blocks):
        rows = found.where(F.col("block") == block).select("item", "words") if blocks > 1 else found
        content = spark.sparkContext.broadcast(Windows(rows.toArrow(), window))
        last = block + 1 == blocks
        schema = out.schema if keep_text or not last else out.drop("text").schema
        before, out = out, out.mapInArrow(_marker(content, vocabulary, schema.names), schema)
        if not last:
            out = workspace.write(out, "marked")
            workspace.drop(before)
    shown = {**names, text_col: "text"} if keep_text else names
    order = [c for c in docs.columns if c in shown]
    return out.select(
        *[F.col(shown[c]).alias(c) for c in order], "n_words", F.col("spans").alias("hit_spans"), F.col("items").alias("hit_items")
    )


def _marker(content: Broadcast, vocabulary: Broadcast, columns: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = content.value
        for batch in batches:
            for a, b in slices(batch.column("text"), BATCH_BYTES):
                yield _mark_rows(batch.slice(a, b - a), windows, vocabulary.value).select(columns)

    return mark


def _mark_rows(batch: pa.RecordBatch, windows: Windows, vocabulary: np.ndarray) -> pa.RecordBatch:
    texts = batch.column("text")
    numbers, firsts, begins, ends, starts, possible = [], [0], [], [], [], []
    for a, b in slices(texts):
        _, bounds, begin, end, number, first = _words(texts[a:b])
        numbers.append(number)
        possible.append(passes(vocabulary, number.view(np.int64)))
        firsts.extend((first[1:] + firsts[-1]).tolist())
        text = np.repeat(bounds[:-1], np.diff(first))
        begins.append(begin - text)
        ends.append(end - text)
    number, begin, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (numbers, begins, ends))
    first = np.array(firsts, np.int64)
    mask = np.concatenate(possible) if possible else np.zeros(0, bool)
    place, which = _find(number.view(np.uint64), first, mask, windows)
    columns = {n: batch.column(n) for n in batch.schema.names}
    columns["n_words"] = pa.array(np.diff(first))
    if len(place):
        order = np.argsort(place, kind="stable")
        place, which = place[order], which[order]
        row = np.searchsorted(first, place, "right") - 1
        spans, listed = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for h, stop in zip(heads, np.r_[heads[1:], len(row)]):
            r = int(row[h])
            base = first[r]
            old = [(s["begin_word"], s["end_word"]) for s in spans[r]]
            here = np.array([*old, *zip(place[h:stop] - base, place[h:stop] - base + windows.lengths[which[h:stop]])], np.int64)
            here = here[np.argsort(here[:, 0], kind="stable")]
            left, right = _covered(here[:, 0], here[:, 1])
            content = (texts[r].as_py() or "").encode()
            chars = np.r_[0, np.cumsum(np.frombuffer(content, np.uint8) & 0xC0 != 0x80)]
            spans[r] = [
                {"begin_word": x, "end_word": y, "begin_char": p, "end_char": q}
                for x, y, p, q in zip(left.tolist(), right.tolist(), chars[begin[base + left]].tolist(), chars[end[base + right - 1]].tolist())
            ]
            distinct = np.unique(which[h:stop])
            items = np.unique(windows.items[ragged(windows.begins[distinct], windows.begins[distinct + 1] - windows.begins[distinct])])
            listed[r] = sorted({*listed[r], *(windows.names[k] for k in items.tolist())})
        columns["spans"] = pa.array(spans, batch.schema.field("spans").type)
        columns["items"] = pa.array(listed, batch.schema.field("items").type)
    return pa.record_batch([columns[n] for n in batch.schema.names], batch.schema.names)


def remove_spans(marked: DataFrame, text_col: str = "text") -> DataFrame:
    """Marked rows with the hit stretches cut out of their texts; a text without a hit stays as it is."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("hit_spans.end_char"))
    begins = F.concat(F.col("hit_spans.begin_char"), F.array(F.char_length(text_col).cast("long")))
    parts = F.transform(
        F.arrays_zip(ends.alias("from"), begins.alias("to")),
        lambda p: F.substring(F.col(text_col), (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")),
    )
    return marked.withColumn(text_col, F.when(F.size("hit_spans") > 0, F.array_join(parts, "")).otherwise(F.col(text_col)))
