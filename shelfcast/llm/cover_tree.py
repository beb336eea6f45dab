"""Exact top-k inner products of a query set, by cover trees of queries and data together.

Vectors become integers (floor of ``SCALE`` times each component). Rows are dealt
to blocks by their nearest pivot, query groups likewise; blocks are of bounded
size, so a hot pivot has several. A task gets one block and one query group,
builds a cover tree of each, and walks both at once: a pair of nodes is left out
if no vector of the one can reach the worst k-th score of the queries in the
other. A sample's scores give every query a first bound, by which whole blocks
are left out before they are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace

SCALE = 1024
# Rows of a block, queries of a group, rows of the sample (fixed bounds).
BLOCK_ROWS = 4096
GROUP_QUERIES = 2048
SAMPLE_ROWS = 1024
PIVOTS = 32
# Points below which a node is not divided, and the ratio of a node's reach to its children's.
LEAF = 48
BASE = 1.3


def integer_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector without null or non-finite components."""
    value = F.col(vector_col).cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & value.isNotNull() & finite).select(
        F.col(id_col).alias("id"), F.transform(value, lambda x: F.floor(x * SCALE).cast("long")).alias("v")
    )


class Node:
    """Points within ``radius`` of ``center``: some in children, the rest its own."""

    __slots__ = ("center", "norm", "radius", "points", "own", "children")

    def __init__(self, center, points, radius, own, children):
        self.center, self.points, self.radius = center, points, radius
        self.norm = float(np.linalg.norm(center))
        self.own, self.children = own, children


def build(x: np.ndarray, points: np.ndarray, center: int | None = None) -> Node:
    """A cover tree of some rows of ``x``: every child's points are near its centre, centres are apart."""
    c = x[points[0] if center is None else center]
    far = np.sqrt(((x[points] - c) ** 2).sum(axis=1))
    radius = float(far.max())
    if len(points) <= LEAF or radius == 0:
        return Node(c, points, radius, points, [])
    reach = radius / BASE
    rest, own, children = points, [], []
    while len(rest):
        lead = rest[0]
        near = np.sqrt(((x[rest] - x[lead]) ** 2).sum(axis=1)) <= reach
        group = rest[near]
        rest = rest[~near]
        if len(group) > LEAF and len(group) < len(points):
            children.append(build(x, group, lead))
        else:
            own.append(group)
    return Node(c, points, radius, np.concatenate(own) if own else points[:0], children)


class TopK:
    """The best k (score, id) of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.worst = floor.astype(float)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = (score >= self.worst[rows][:, None]).any(axis=1)
        rows, score = rows[some], score[some]
        if not len(rows):
            return
        both = np.concatenate([self.score[rows], score], axis=1)
        names = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        best = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(both, best, 1)
        self.id[rows] = np.take_along_axis(names, best, 1)
        self.worst[rows] = np.maximum(self.worst[rows], self.score[rows, -1])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> TopK:
    """The best k data rows of each query with a score of at least ``floor``, without rows of the query's id."""
    top = TopK(len(queries), k, floor)
    whole = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1])
    # Beyond 2**53 doubles are no longer exact; integers are.
    q, d = (queries.astype(float), data.astype(float)) if whole < 2.0**53 else (queries, data)
    qx, dx = queries.astype(float), data.astype(float)

    def base(rows: np.ndarray, points: np.ndarray) -> None:
        if len(rows) and len(points):
            score = (q[rows] @ d[points].T).astype(float)
            score[query_ids[rows][:, None] == ids[points][None, :]] = -np.inf
            top.offer(rows, score, ids[points])

    def bound(a: Node, b: Node) -> float:
        return float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius

    pending = [(build(qx, np.arange(len(qx))), build(dx, np.arange(len(dx))))]
    while pending:
        a, b = pending.pop()
        limit = bound(a, b)
        if limit + abs(limit) * 1e-9 + 1e-3 < top.worst[a.points].min():
            continue
        if not a.children and not b.children:
            base(a.own, b.own)
        elif b.children and (not a.children or b.radius >= a.radius):
            # The likeliest child comes last, so that it is taken first and tightens the bounds.
            pending += sorted(((a, c) for c in b.children), key=lambda p: bound(*p))
            if len(b.own):
                base(a.points, b.own)
        else:
            if len(a.own):
                base(a.own, b.points)
            pending += [(c, b) for c in a.children]
    return top


def _sample(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a fixed number of rows, the commonest length only."""
    rows = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE_ROWS).toArrow()
    ids = rows.column("id").to_numpy()
    values = rows.column("v").to_pylist()
    sizes = [len(v) for v in values]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    keep = [k for k, s in enumerate(sizes) if s == size]
    return ids[keep], np.array([values[k] for k in keep], np.int64).reshape(len(keep), size)


def _spread(x: np.ndarray, count: int) -> np.ndarray:
    """Rows that lie far from each other: the top of a cover tree of the sample."""
    if not len(x):
        return x
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id column, score): each query's k best integer inner products, all if fewer.

    Queries are the rows where ``is_query`` holds; candidates are all rows with
    another id. Ties: the smaller id. Rows with a null id, a null vector, or null
    or non-finite components take no part; vectors of other lengths than the
    query's are no candidates. Repeated rows are candidates each; a repeated
    query is answered once.
    """
    spark = vectors.sparkSession
    workspace = Workspace(spark, "topk")
    data = integer_vectors(vectors, id_col, vector_col)
    queries = workspace.write(integer_vectors(vectors.where(is_query), id_col, vector_col).distinct(), "queries")
    sample_ids, sample = _sample(data)
    pivots = _spread(sample.astype(float), PIVOTS)
    shared = spark.sparkContext.broadcast((sample_ids, sample, pivots))

    def cells(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row (-1: other length) and the distance to it."""
        near = shared.value[2]
        if not len(near) or values.shape[1] != near.shape[1]:
            return np.full(len(values), -1), np.zeros(len(values))
        x = values.astype(float)
        far = (x**2).sum(axis=1)[:, None] - 2 * x @ near.T + (near**2).sum(axis=1)
        cell = far.argmin(axis=1)
        return cell, np.sqrt(((x - near[cell]) ** 2).sum(axis=1))

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        column = batch.column("v")
        sizes = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        starts = column.offsets.to_numpy() - column.offsets[0].as_py()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            yield rows, flat[starts[rows][:, None] + np.arange(size)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for rows, values in by_length(batch):
                cell[rows], far[rows] = cells(values)
                size[rows] = values.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell), pa.array(far)], ["id", "v", "size", "cell", "far"])

    placed = workspace.write(data.mapInArrow(place, "id long, v array<long>, size long, cell long, far double"), "placed")
    # Cells are few (pivots and lengths); a cell is cut into blocks of bounded size.
    counts = placed.groupBy("size", "cell").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("parts", F.ceil(F.col("rows") / BLOCK_ROWS)).drop("rows")
    blocks = placed.join(F.broadcast(counts), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")))
    blocks = blocks.drop("parts")
    reach = blocks.groupBy("size", "cell", "part").agg(F.max("far").alias("reach"))
    reach = workspace.write(reach, "reach")

    def first_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's cell, and a score that k sample rows reach (null if there are not so many)."""
        ids, rows_of_sample, _ = shared.value
        for batch in batches:
            cell, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            floor = np.full(batch.num_rows, -np.inf)
            own = batch.column("id").to_numpy()
            for rows, values in by_length(batch):
                cell[rows], _ = cells(values)
                size[rows] = values.shape[1]
                if len(ids) > k and values.shape[1] == rows_of_sample.shape[1]:
                    score = values.astype(float) @ rows_of_sample.T.astype(float)
                    score[own[rows][:, None] == ids[None, :]] = -np.inf
                    floor[rows] = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            # A hair lower, so that rounding never hides a tie.
            floor = floor - np.abs(np.where(np.isfinite(floor), floor, 0)) * 1e-9 - 1e-3
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(cell), pa.array(floor)], ["id", "v", "size", "qcell", "floor"])

    asked = queries.mapInArrow(first_bound, "id long, v array<long>, size long, qcell long, floor double")
    # Small cells share a group, as each group is sent the blocks it may need; large ones are cut.
    before = Window.partitionBy("size").orderBy("qcell").rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("n") > GROUP_QUERIES
    small_before = F.coalesce(F.sum(F.when(~large, F.col("n"))).over(before), F.lit(0))
    groups = asked.groupBy("size", "qcell").agg(F.count(F.lit(1)).alias("n")).select(
        "size",
        "qcell",
        F.when(large, -1 - F.col("qcell")).otherwise(F.floor(small_before / GROUP_QUERIES)).alias("qgroup"),
        F.ceil(F.col("n") / GROUP_QUERIES).alias("groups"),
    )
    asked = asked.join(F.broadcast(groups), ["size", "qcell"])
    asked = asked.withColumn("qpart", F.pmod(F.xxhash64("id", F.lit("group")), F.col("groups"))).drop("groups", "qcell")

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (query, block) whose block can hold a score of the query's first bound."""
        near = shared.value[2]
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            keep = np.ones(batch.num_rows, bool)
            for rows, values in by_length(batch):
                if not len(near) or values.shape[1] != near.shape[1]:
                    continue
                x = values.astype(float)
                limit = (x * near[cell[rows]]).sum(axis=1) + np.linalg.norm(x, axis=1) * batch.column("reach").to_numpy()[rows]
                keep[rows] = limit + np.abs(limit) * 1e-9 + 1e-3 >= batch.column("floor").to_numpy()[rows]
            yield batch.filter(pa.array(keep))

    # A stated query set against all rows in blocks: one row per query and block that may matter.
    pairs = asked.join(reach, "size").select("id", "v", "floor", "size", "cell", "part", "qgroup", "qpart", "reach")
    pairs = workspace.write(pairs.mapInArrow(reachable, pairs.schema), "pairs")
    keys = ["size", "cell", "part", "qgroup", "qpart"]
    wanted = workspace.write(pairs.select(*keys).distinct(), "wanted")
    sent = blocks.join(wanted, ["size", "cell", "part"]).select(*keys, "id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(table: pa.Table) -> np.ndarray:
            column = table.column("v").combine_chunks()
            return column.flatten().to_numpy().reshape(table.num_rows, -1)

        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        # Sorted, so that a rerun builds the same trees.
        left, right = left.sort_by("id"), right.sort_by("id")
        q, d = matrix(left), matrix(right)
        own, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        top = dual_search(q, own, d, ids, k, left.column("floor").to_numpy())
        row, column = np.nonzero(np.isfinite(top.score))
        return pa.table({"query_id": own[row], "vec": top.id[row, column], "score": top.score[row, column].astype(np.int64)})

    found = (
        pairs.select(*keys, "id", "v", "floor")
        .groupBy(*keys)
        .cogroup(sent.groupBy(*keys))
        .applyInArrow(search, "query_id long, vec long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec").alias(id_col), "score")
