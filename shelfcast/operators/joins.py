"""A join whose hot keys adaptive execution can split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on ``keys``, where ``right`` has one row per key and ``left`` any number.

    Adaptive execution splits a hot key's rows only if both inputs of a sort
    merge join come straight from a shuffle made for it. An aggregated ``right``
    already lies by its keys and would get none, leaving all of a hot key's left
    rows in one task. Joining on a struct of the keys asks for that shuffle; it
    moves ``right`` once more, which is one row per key. Null keys do not match.
    """
    names = list(keys)
    known = F.col(names[0]).isNotNull()
    for name in names[1:]:
        known = known & F.col(name).isNotNull()
    lookup = right.filter(known).select(
        F.struct(*names).alias("_join_key"), *[c for c in right.columns if c not in names]
    )
    return left.withColumn("_join_key", F.struct(*names)).join(lookup, "_join_key", how).drop("_join_key")
