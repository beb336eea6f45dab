"""Join near-duplicate documents on the Jaccard similarity of their word shingles.

The candidates come from prefix filters under several global token orders. Each
order sorts a document's shingles by their (approximate) number of occurrences in
the corpus, rarest first, and breaks ties by a different hash. If two documents
reach the threshold, a prefix of each must share a shingle under every one of the
orders: the first order is joined on, the others are tested on what it finds, and
only pairs that pass all of them are verified on the whole sets.

Equal sets are one node from the start. Inside a bucket (documents whose prefixes
share a shingle) a few rounds link every document to one centre; after that only
pairs from different components are left, all of them, so no link between
components is lost and no group is expanded into all its pairs. What these pairs
may differ by is bounded from the parities of their shingles' hashes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import build_bitmap, passes
from .buckets import differing_bits, link_buckets, parity_marks, shared_only
from .tables import Workspace, own_names, plain_names
from .words import fold_ascii, gram_hashes, hash_spans, mix, slices, spans, text_bytes

# Counters of the frequency sketch, and the largest rank kept of a counter: a fixed
# 4 MB, whatever the corpus. Two shingles in one counter only share a place in the order.
SKETCH_BITS = 22
# Counters travel in blocks of this many.
BLOCK_BITS = 14
SKETCH_GROUPS = 256
ORDERS = 3
# Shingles two linked documents share within prefixes that are this much less one longer: a
# document whose prefix shares fewer with all others together has no link.
SHARED = 5
# 64-bit numbers of shingle parities that the last round compares.
PARITIES = 16


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each text that has a word."""
    for begin, end in slices(texts):
        data, bounds = text_bytes(texts.slice(begin, end - begin))
        data = fold_ascii(data)
        first, last, index = spans(data, bounds)
        words = hash_spans(data, first, last)
        grams = gram_hashes(words, n)
        for k in range(end - begin):
            i, j = index[k], index[k + 1]
            if j - i >= n:
                yield begin + k, np.unique(grams[i : j - n + 1])
            elif j > i:
                # Fewer words than a shingle: the whole sequence is the one shingle.
                value = np.zeros(1, np.uint64)
                for w in words[i:j]:
                    value = mix(value + w, 99 + int(j - i))
                yield begin + k, value


def set_id(grams: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers (as signed 64 bits)."""
    with np.errstate(over="ignore"):
        total = mix(grams, 12345).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix(np.array([total]), 5).view(np.int64)[0])


def _counters(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Occurrences per counter over all documents, as ranks of one byte (16 steps per doubling at most)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            parts = [grams for _, grams in shingle_sets(batch.column(0), n)]
            if parts:
                np.add.at(total, _counters(np.concatenate(parts)), 1)
        blocks = total.reshape(-1, 1 << BLOCK_BITS)
        kept = np.flatnonzero(blocks.any(axis=1))
        yield pa.record_batch(
            [pa.array(kept, pa.int32()), pa.array([blocks[k].tobytes() for k in kept], pa.binary())],
            ["block", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
        return pa.table(
            [table.column("block").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["block", "counts"]
        )

    # In two steps, so that one sum never meets more than a share of the tasks.
    blocks = (
        docs.select(F.col(text_col).cast("string").alias("text"))
        .mapInArrow(count, "block int, counts binary")
        .groupBy("block", (F.spark_partition_id() % SKETCH_GROUPS).alias("share"))
        .applyInArrow(add, "block int, counts binary")
        .groupBy("block")
        .applyInArrow(add, "block int, counts binary")
    )
    ranks = np.zeros((1 << SKETCH_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for row in blocks.toLocalIterator():
        total = np.frombuffer(row.counts, np.int64)
        ranks[row.block] = np.minimum(np.floor(8 * np.log2(1 + total)), 255)
    return ranks.reshape(-1)


def _prefix_length(size: int, percent: int) -> int:
    """Shingles of a probing document of which one must be shared with any partner."""
    return size - -(-percent * size // 100) + 1


def _least_overlap(a: str, b: str, percent: int) -> str:
    """SQL: the smallest intersection of sets of these sizes that reaches the threshold."""
    return f"((({a} + {b}) * {percent} + {100 + percent - 1}) div {100 + percent})"


def _prefix(grams: np.ndarray, order: int, length: int, table: np.ndarray) -> np.ndarray:
    """The first ``length`` shingles of a set under an order (as signed 64 bits)."""
    rank = table[_counters(grams)].astype(np.uint64) << np.uint64(56)
    key = rank | (mix(grams, 1000 + order) >> np.uint64(8))
    part = np.argpartition(key, length - 1)[:length] if length < len(grams) else np.arange(len(grams))
    return grams[part[np.argsort(key[part])]].view(np.int64)


def _index(docs: DataFrame, text_col: str, n: int, percent: int, ranks) -> DataFrame:
    """A row per distinct set of a task: node, n, and its prefix under the first order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for _, grams in shingle_sets(batch.column(0), n):
                node = set_id(grams)
                if node in seen:
                    continue
                seen.add(node)
                size = len(grams)
                # The first order's prefix is longer: see SHARED.
                length = min(size, _prefix_length(size, percent) + SHARED - 1)
                rows.append((node, size, _prefix(grams, 0, length, ranks.value)))
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                ],
                ["node", "n", "p0"],
            )

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(build, "node long, n int, p0 array<long>")


def _prefixes(sets: DataFrame, percent: int, ranks) -> DataFrame:
    """(node, p1, ...): the prefixes of sets under the orders after the first."""
    names = [f"p{k}" for k in range(1, ORDERS)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for value in batch.column(1):
                grams = np.frombuffer(value.as_buffer(), np.uint64)
                length = _prefix_length(len(grams), percent)
                for k, column in enumerate(columns):
                    column.append(_prefix(grams, k + 1, length, ranks.value))
            yield pa.record_batch(
                [batch.column(0), *[pa.array(c, pa.list_(pa.int64())) for c in columns]], ["node", *names]
            )

    schema = "node long, " + ", ".join(f"{name} array<long>" for name in names)
    return sets.select("node", "grams").mapInArrow(build, schema)


def _summary(docs: DataFrame, text_col: str, n: int) -> DataFrame:
    """``docs`` without its text, with _n_shingles and _node (null without words)."""
    kept = [c for c in docs.columns if c != text_col]
    fields = docs.select(*kept).schema.add("_n_shingles", "long").add("_node", "long")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            nodes = np.zeros(batch.num_rows, np.int64)
            for row, grams in shingle_sets(batch.column(len(kept)), n):
                sizes[row] = len(grams)
                nodes[row] = set_id(grams)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(kept))], pa.array(sizes), pa.array(nodes, mask=sizes == 0)],
                [*kept, "_n_shingles", "_node"],
            )

    return docs.select(*kept, F.col(text_col).cast("string").alias("_text")).mapInArrow(summarize, fields)


def _sets(docs: DataFrame, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """(node, grams): the wanted documents' sets as packed hashes."""
    bitmap = docs.sparkSession.sparkContext.broadcast(build_bitmap(wanted, "node"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, packed = [], []
            for _, grams in shingle_sets(batch.column(0), n):
                node = set_id(grams)
                if node not in seen and passes(bitmap.value, np.array([node]))[0]:
                    seen.add(node)
                    nodes.append(node)
                    packed.append(grams.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "grams"])

    sets = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(emit, "node long, grams binary")
    return sets.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64)
                y = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                keep[k] = 100 * shared >= percent * (len(x) + len(y) - shared)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def near_duplicate_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """``docs`` without the text, plus n_shingles and component_id (earlier columns of these names go).

    Texts are lower-cased in A to Z and cut into words; a set holds the distinct
    shingles of ``shingle`` words, or the whole sequence if it has fewer. Two rows
    link when 100 * intersection >= percent * union. component_id is the smallest
    id reachable by links. Null or wordless text: an empty set, linked with
    nothing. Repeated rows and equal sets: one component, each row returned.
    Null ids: such rows take part, the component's smallest non-null id counts
    (null if it has none). Words and shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "ngram")
    docs, names = plain_names(docs, ("n_shingles", "component_id"))
    id_col, text_col = names[id_col], names[text_col]
    ranks = spark.sparkContext.broadcast(_sketch(docs, text_col, shingle))
    summary = workspace.write(_summary(docs, text_col, shingle), "summary")
    nodes = workspace.write(_index(docs, text_col, shingle, percent, ranks), "nodes")
    workspace.release()

    # A pair must share, under the first order, a token in the index prefix of the smaller set
    # and the probing prefix of the larger. Partners are close in size, so a bucket is a token
    # and a size band; a row of an index prefix also stands in the band its larger partners reach.
    base = f"cast(floor(ln({{}}) / {max(math.log(100 / percent), 1e-3)!r}) as int)"
    index_length = f"n - ((2 * {percent} * n + {100 + percent - 1}) div {100 + percent}) + 1"
    postings = (
        nodes.select("node", "n", F.posexplode("p0").alias("pos", "shared"))
        .withColumn("indexed", F.expr(f"pos < {index_length} + {SHARED - 1}"))
        .withColumn("low", F.expr(base.format("n")))
        .withColumn("high", F.when(F.col("indexed"), F.expr(base.format(f"(n * 100 div {percent})"))).otherwise(F.col("low")))
        .select(
            "node",
            # One number for size, place and side keeps the rows of the largest shuffle short.
            F.expr("shiftleft(cast(n as long), 32) | shiftleft(cast(pos as long), 1) | cast(indexed as long)").alias("info"),
            F.explode(F.transform(F.sequence("low", "high"), lambda band: F.xxhash64("shared", band))).alias("token"),
        )
    )
    postings = shared_only(postings).distinct().select(
        "token",
        "node",
        F.expr("cast(info >> 32 as int)").alias("n"),
        F.expr("cast((info & 4294967295L) >> 1 as int)").alias("pos"),
        F.expr("(info & 1L) = 1L").alias("indexed"),
    )
    postings = workspace.write(postings, "longer")
    workspace.release()
    # An overlap of m leaves SHARED of m shingles within prefixes that are SHARED - 1 longer.
    enough = F.count_distinct("token") >= F.expr(f"least({SHARED}, ({percent} * first(n) + 99) div 100)")
    linked = postings.groupBy("node").agg(enough.alias("enough")).where("enough").select("node")
    postings = postings.join(linked, "node", "left_semi").withColumn("indexed", F.expr(f"pos < {index_length}"))
    postings = postings.where(f"pos < n - (({percent} * n + 99) div 100) + 1")
    postings = workspace.write(shared_only(postings), "postings")
    workspace.release()

    prefix_tests = [f"p{k}" for k in range(1, ORDERS)]
    touched = workspace.write(postings.select("node").distinct(), "touched")
    workspace.drop(nodes)
    sets = workspace.write(_sets(docs, text_col, shingle, touched), "sets")
    prefixes = workspace.write(_prefixes(sets, percent, ranks), "prefixes")
    parities = workspace.write(parity_marks(sets, np.uint64, PARITIES), "parities")
    workspace.release()

    def verify(pairs: DataFrame) -> DataFrame:
        """The other orders' filters, intersected, and then the whole sets."""
        for side in ("a", "b"):
            own = prefixes.select(F.col("node").alias(side), *[F.col(p).alias(f"{p}{side}") for p in prefix_tests])
            pairs = pairs.join(own, side)
        for p in prefix_tests:
            pairs = pairs.where(F.arrays_overlap(f"{p}a", f"{p}b"))
        return _verify(pairs.select("a", "b"), sets, percent)

    # Sizes and places bound the overlap.
    fits = F.expr(
        f"""100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)
        and case when n_a < n_b then indexed_a when n_a > n_b then indexed_b else indexed_a and indexed_b end
        and least(pos_a, pos_b) + least(n_a - pos_a, n_b - pos_b) >= {_least_overlap("n_a", "n_b", percent)}"""
    )
    # A shingle that only one of two sets has changes one parity.
    alike = F.expr(f"{differing_bits(parities)} <= n_a + n_b - 2 * {_least_overlap('n_a', 'n_b', percent)}")
    roots = link_buckets(workspace, postings, ["n", "pos", "indexed"], F.col("pos"), fits, verify, parities, alike)

    # Nodes carry several rows; the component's id is the smallest of all of them.
    labelled = summary.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn(
        "_root", F.coalesce("root", "_node")
    )
    smallest = labelled.where("_root is not null").groupBy("_root").agg(F.min(F.col(id_col)).alias("_smallest"))
    smallest = workspace.write(smallest, "smallest")
    del names[next(c for c, n in names.items() if n == text_col)]
    return labelled.join(smallest, "_root", "left").select(
        *own_names(names),
        F.col("_n_shingles").alias("n_shingles"),
        F.when(F.col("_root").isNull(), F.col(id_col)).otherwise(F.col("_smallest")).alias("component_id"),
    )
