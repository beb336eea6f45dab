"""Exact percentiles over groups of any size.

Spark's ``percentile`` holds all distinct values of a group in one buffer. That
is fine for dates, not for errors. Here each wanted rank is narrowed down with
two histograms of bounded size, and only values of the bins that hold a wanted
rank are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 64
FINE_BINS = 4096
# Larger than any |log2| of a double times the bins per octave.
BIN_OFFSET = 100_000


def _coarse_bin(value: Column) -> Column:
    """A bin number that never falls as ``value`` rises: equal steps of its log."""
    size = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE) + BIN_OFFSET
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def _fine_bin(value: Column, low: Column, high: Column) -> Column:
    step = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * FINE_BINS)
    return F.coalesce(step, F.lit(0)).cast("long")


def _locate(hist: DataFrame, by: Sequence[str], bin_name: str, wanted: Column) -> DataFrame:
    """Join each wanted rank to the one bin of its group that holds it."""
    upto = Window.partitionBy(*by).orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0)
    located = hist.withColumn("_upto", F.sum("_rows").over(upto)).withColumn(
        "_want", F.explode(wanted)
    )
    inside = (F.col("_want.rank") >= F.col("_upto") - F.col("_rows")) & (
        F.col("_want.rank") < F.col("_upto")
    )
    return located.filter(inside).withColumn(
        "_want",
        F.struct(
            F.col("_want.slot").alias("slot"),
            (F.col("_want.rank") - (F.col("_upto") - F.col("_rows"))).alias("rank"),
        ),
    )


def exact_percentiles(
    df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles as columns named by the keys of ``shares``.

    Null and NaN values do not count. Groups without values give no row.
    """
    by = list(by)
    column = F.col(value).cast("double")
    # Copies of a value collapse to one line before the shuffle.
    counted = (
        df.select(*by, column.alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", _coarse_bin(F.col("_v")))
    )

    hist = counted.groupBy(*by, "_bin").agg(
        F.sum("_n").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    hist = hist.withColumn("_total", F.sum("_rows").over(Window.partitionBy(*by)))
    slots = []
    for name, share in shares.items():
        spot = F.floor((F.col("_total") - 1) * F.lit(float(share))).cast("long")
        slots.append(F.struct(F.lit(f"{name}/low").alias("slot"), spot.alias("rank")))
        upper = F.least(spot + 1, F.col("_total") - 1)
        slots.append(F.struct(F.lit(f"{name}/high").alias("slot"), upper.alias("rank")))
    coarse = _locate(hist, by, "_bin", F.array(*slots))

    # Two lines at most per group and share from here on.
    picked = coarse.groupBy(*by, "_bin", "_low", "_high", "_total").agg(
        F.collect_list("_want").alias("_wants")
    )
    fine_values = _join(counted, picked, [*by, "_bin"]).withColumn(
        "_fine", _fine_bin(F.col("_v"), F.col("_low"), F.col("_high"))
    )
    fine_hist = fine_values.groupBy(*by, "_bin", "_fine").agg(
        F.sum("_n").alias("_rows"),
        F.first("_wants").alias("_wants"),
        F.first("_total").alias("_total"),
    )
    fine = _locate(fine_hist, [*by, "_bin"], "_fine", F.col("_wants"))
    targets = fine.groupBy(*by, "_bin", "_fine").agg(
        F.collect_list("_want").alias("_targets"), F.first("_total").alias("_count")
    )

    last = _join(
        fine_values.select(*by, "_bin", "_fine", "_v", F.col("_n").alias("_rows")),
        targets,
        [*by, "_bin", "_fine"],
    )
    found = _locate(last, [*by, "_bin", "_fine"], "_v", F.col("_targets"))

    values = found.groupBy(*by).agg(
        F.first("_count").alias("_count"),
        *[
            F.max(F.when(F.col("_want.slot") == f"{name}/{end}", F.col("_v"))).alias(
                f"_{name}_{end}"
            )
            for name in shares
            for end in ("low", "high")
        ],
    )
    results = []
    for name, share in shares.items():
        spot = (F.col("_count") - 1) * F.lit(float(share))
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        results.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return values.select(*by, *results)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` that also matches null keys."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    match = [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys]
    return left.join(renamed, match).drop(*[f"_r_{key}" for key in keys])
