"""A fixed-size filter of 64-bit hashes that tasks test rows against before a shuffle.

The bitmap has 2**27 bits, 16 MB, whatever the number of hashes, so it may be
broadcast. It never says no to a hash it was built from; others pass when they
share a bit, which the join after it sorts out. At a size where most bits are
set it saves nothing, and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27
BLOCK_BITS = 17


def build_bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """The bitmap of the top ``BITS`` bits of a long column."""

    def block(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, np.uint8)
        bits[table.column("bit").to_numpy() & ((1 << BLOCK_BITS) - 1)] = 1
        packed = pa.array([np.packbits(bits).tobytes()], pa.binary())
        return pa.table([table.column("block").slice(0, 1), packed], ["block", "bits"])

    # Distinct bits first: a block's group never exceeds its bits.
    bits = hashes.select(F.expr(f"shiftrightunsigned({column}, {64 - BITS})").alias("bit")).distinct()
    blocks = bits.withColumn("block", F.expr(f"bit >> {BLOCK_BITS}"))
    blocks = blocks.groupBy("block").applyInArrow(block, "block long, bits binary")
    out = np.zeros((1 << BITS - BLOCK_BITS, (1 << BLOCK_BITS) // 8), np.uint8)
    for row in blocks.toLocalIterator():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those the bitmap was built from."""
    bit = (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
