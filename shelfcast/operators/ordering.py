"""Global row order without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .joins import split_join

# monotonically_increasing_id() keeps the partition above this bit.
PARTITION_SHIFT = 33


def with_global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Number all rows 0, 1, 2, ... by ``order``, which must be a unique key.

    Rows are range-partitioned and sorted, so a hot key spreads over several
    partitions; each row's number is its place in its partition plus the sizes
    of those before. The sorted rows are checkpointed first: sizes and places
    must come from the same partitions, even after an executor loss.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = durable(placed).select(
        "*",
        F.shiftright("_id", PARTITION_SHIFT).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << PARTITION_SHIFT) - 1)).alias("_place"),
    )
    # One row per partition: small enough for one task and for a broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg((F.max("_place") + 1).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.col("_place")).cast("long"))
        .drop("_id", "_part", "_place", "_before")
    )


def segments(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], lookback: int, rows: int
) -> DataFrame:
    """Cut each series into segments of ``rows`` rows for windows that look back.

    Adds ``_segment``, ``_place`` (row number within the series) and ``_halo``.
    The last ``lookback`` rows of a segment also appear, marked as halo, at the
    head of the next, so a window of up to ``lookback`` preceding rows is exact
    inside a segment; drop the halo rows afterwards. No group is larger than
    ``rows + lookback``, whatever the length of a series.
    """
    if rows < lookback:
        raise ValueError("a segment must hold at least the rows its successor looks back on")
    ranked = with_global_rank(df, [*keys, *order], "_rank")
    starts = ranked.groupBy(*keys).agg(F.min("_rank").alias("_start"))
    placed = (
        split_join(ranked, starts, keys)
        .withColumn("_place", F.col("_rank") - F.col("_start"))
        .drop("_rank", "_start")
        .withColumn("_segment", F.expr(f"_place div {rows}"))
    )
    own = F.struct(F.col("_segment").alias("segment"), F.lit(False).alias("halo"))
    following = F.struct((F.col("_segment") + 1).alias("segment"), F.lit(True).alias("halo"))
    in_tail = F.col("_place") % rows >= rows - lookback
    copies = F.when(in_tail, F.array(own, following)).otherwise(F.array(own))
    return (
        placed.withColumn("_copy", F.explode(copies))
        .withColumn("_segment", F.col("_copy.segment"))
        .withColumn("_halo", F.col("_copy.halo"))
        .drop("_copy")
    )


def adjacent_gaps(
    df: DataFrame, order: Sequence[str], first: str, last: str, by: Sequence[str] = ()
) -> DataFrame:
    """Sum and count of |first(next row) - last(this row)| over all neighbours.

    Neighbours are taken in the order of ``order`` within each ``by`` group. Rows
    are numbered over all groups, and each meets its predecessor in a join on the
    numbers, which spreads over all tasks however many rows a group has.
    """
    keys = list(dict.fromkeys([*by, *order]))
    rows = df.select(*keys, F.col(first).cast("double").alias("_f"), F.col(last).cast("double").alias("_l"))
    ranked = with_global_rank(rows, keys, "_rank")
    before = ranked.select(
        (F.col("_rank") + 1).alias("_rank"), F.struct(F.lit(0), *by).alias("_group_before"), F.col("_l").alias("_before")
    )
    same = F.col("_group_before").eqNullSafe(F.struct(F.lit(0), *by))
    step = F.when(same, F.abs(F.col("_f") - F.col("_before")))
    joined = ranked.join(before, "_rank", "left").withColumn("_step", step)
    return joined.groupBy(*by).agg(
        F.sum(F.coalesce("_step", F.lit(0.0))).alias("gap_sum"), F.count("_step").alias("gap_count")
    )
