"""Link the rows of shared buckets into components without expanding groups into pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Workspace, components
from .words import mix

# Rounds that compare a bucket's rows with one centre each.
CENTRE_ROUNDS = 2
# Rows outside the largest component of a bucket that one task of the last round compares with the bucket's rows.
OUTSIDERS = 1024


def shared_only(postings: DataFrame) -> DataFrame:
    """Rows of buckets with two nodes at least. The rows are moved once: most tokens are met
    once by a task, so minima and maxima would be as many as the rows they are joined to."""
    bucket = Window.partitionBy("token")
    edges = {"_low": F.min("node").over(bucket), "_high": F.max("node").over(bucket)}
    return postings.withColumns(edges).where("_low <> _high").drop("_low", "_high")


def parity_marks(values: DataFrame, kind: type, longs: int) -> DataFrame:
    """(node, mark0, ...): whether the hashes that fall on a bit are odd in number, from rows (node, packed hashes).

    A hash that one side has once more than the other changes one bit, so no more bits differ than hashes do.
    """
    names = [f"mark{k}" for k in range(longs)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = np.zeros((batch.num_rows, 64 * longs), np.uint8)
            for k, value in enumerate(batch.column(1)):
                bits = mix(np.frombuffer(value.as_buffer(), kind).astype(np.uint64), 77) % np.uint64(64 * longs)
                odd[k] = np.bincount(bits.astype(np.int64), minlength=64 * longs) & 1
            packed = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(packed[:, k]) for k in range(longs)]], ["node", *names])

    return values.mapInArrow(build, "node long, " + ", ".join(f"{c} long" for c in names))


def differing_bits(marks: DataFrame) -> str:
    """SQL: the number of bits in which the marks of a pair differ."""
    return " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in marks.columns if c.startswith("mark"))


def _across(rows: DataFrame, sides: Sequence[str]) -> DataFrame:
    """Pairs of rows (suffixes _a and _b) of a bucket and of different components, from rows with a root.

    Only rows outside the largest component of their bucket look for partners, among all of its
    rows: no more than twice the comparisons that pairs across components need. Filters behind it
    become part of the join, so that pairs which fail them are never made into rows. Buckets with
    many such rows are shared out among tasks.
    """
    parts = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("size"))
    parts = parts.groupBy("token").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("out")
    )
    parts = parts.where("out > 0")
    shares = F.ceil(F.col("out") / OUTSIDERS).cast("int")
    placed = rows.join(parts, "token").withColumn("shares", shares)
    a = placed.where("root <> main").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    b = placed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    a = a.select("token", "share", *[F.col(c).alias(f"{c}_a") for c in sides])
    b = b.select("token", "share", (F.col("root") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"{c}_b") for c in sides])
    return a.join(b, ["token", "share"]).where("root_a <> root_b and (in_main or root_a < root_b)")


def link_buckets(
    workspace: Workspace,
    postings: DataFrame,
    attributes: Sequence[str],
    first_key: Column,
    fits: Column,
    verify: Callable[[DataFrame], DataFrame],
    marks: DataFrame | None = None,
    alike: Column | None = None,
) -> DataFrame:
    """(node, root) for every linked node, from rows (token, node, *attributes).

    Two nodes may link if they share a token and ``fits`` holds, an expression
    over each attribute (and node) with the suffixes _a and _b that must not
    depend on the sides' order; ``verify`` keeps the pairs (a, b) that do link.
    ``marks`` holds further attributes of the nodes, too wide for all rounds, for
    ``alike``, an expression like ``fits`` that the last round tests as well and that
    may ask for the bucket's token.
    A few rounds compare each bucket's rows with one centre: first the row with
    the smallest ``first_key``, then others. Rows that are connected by then are
    never compared again. A last round compares all pairs of different components
    that still share a bucket, so every link between components is found; only
    pairs that pass ``fits`` and ``alike`` become rows. A group of n rows around a
    centre costs n comparisons.
    """
    spark = postings.sparkSession
    sides = ("node", *attributes, "root")
    links = None
    roots = spark.createDataFrame([], "node long, root long")
    for step in range(CENTRE_ROUNDS + 1):
        placed = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
        mixed = mixed.where("_low <> _high").select("token")
        rows = workspace.write(placed.join(mixed, "token", "left_semi"), "open")
        if rows.isEmpty():
            break
        if step < CENTRE_ROUNDS:
            first = first_key if step == 0 else F.xxhash64("node", F.lit(step))
            own = F.struct(first.alias("key"), *[F.col(c) for c in sides])
            centres = rows.groupBy("token").agg(F.min(own).alias("c"))
            pairs = rows.join(centres, "token").where("root <> c.root")
            pairs = pairs.select(
                *[F.col(c).alias(f"{c}_a") for c in sides], *[F.col(f"c.{c}").alias(f"{c}_b") for c in sides]
            )
        else:
            wide = [] if marks is None else [c for c in marks.columns if c != "node"]
            marked = rows if marks is None else rows.join(marks, "node")
            pairs = _across(marked, [*sides, *wide])
            if alike is not None:
                pairs = pairs.where(fits).where(alike)
        pairs = pairs.where(fits).select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
        )
        found = workspace.write(verify(pairs.distinct()), "links")
        workspace.drop(rows)
        workspace.release()
        if found.isEmpty():
            continue
        links = found if links is None else links.unionAll(found)
        roots = components(workspace, links)
    return roots
