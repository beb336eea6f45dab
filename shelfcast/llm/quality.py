"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into quantile bins. Boosting goes round the features one by one;
each turn fits a shallow tree on the bins of one feature and adds its leaves to
that feature's lookup table. Then the pairs of features that explain most of
what is left get tables of two coarse bins each, boosted in the same way. A
score is the sum of the table entries of a text's bins, so scoring is vectorised
additions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import NAMES, describe
from .tables import Workspace, own_names, plain_names

# Labelled rows the model is fitted on at most: the driver holds this many rows of numbers.
TRAIN_ROWS = 20_000
BINS = 48
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 4
# Added to a leaf's weight, so that a few rows decide little.
RIDGE = 5.0
THRESHOLD = 0.7
# Rows of this remainder of crc32(id) modulo 4 are never learned from.
HELD_OUT = 2


def held_out(identity: Column) -> Column:
    """Whether a row is kept out of learning (null id: no, but such rows have no label either)."""
    return F.coalesce(F.crc32(identity.cast("string")) % 4 == HELD_OUT, F.lit(False))


@dataclass
class AdditiveModel:
    """Cuts and tables; ``score`` gives the probability of label 1."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k])]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i]), np.searchsorted(self.pair_cuts[j], x[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value per bin of a tree with ``LEAVES`` leaves at most, grown by the best gain."""
    edges = [0, len(g)]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        at = np.arange(a + 1, b)
        lg, lh, rg, rh = cg[at] - cg[a], ch[at] - ch[a], cg[b] - cg[at], ch[b] - ch[at]
        gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    while len(edges) <= LEAVES:
        gain, at = max(best(a, b) for a, b in zip(edges, edges[1:]))
        if gain <= 1e-9:
            break
        edges = sorted([*edges, at])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a two-way table: its gain, and the leaf value per cell."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    found = (0.0, np.zeros_like(g))
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [
                (cg[i, j], ch[i, j], slice(0, i), slice(0, j)),
                (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j], slice(0, i), slice(j, None)),
                (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j], slice(i, None), slice(0, j)),
                (
                    cg[-1, -1] - cg[i, -1] - cg[-1, j] + cg[i, j],
                    ch[-1, -1] - ch[i, -1] - ch[-1, j] + ch[i, j],
                    slice(i, None),
                    slice(j, None),
                ),
            ]
            gain = sum(p[0] ** 2 / (p[1] + RIDGE) for p in parts) - whole
            if gain > found[0]:
                table = np.zeros_like(g)
                for pg, ph, a, b in parts:
                    table[a, b] = _leaf(pg, ph)
                found = (gain, table)
    return found


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on a matrix of features and labels 0 and 1. No rows: every score is 0.5."""
    width = x.shape[1]
    if not len(y):
        empty = [np.zeros(0)] * width
        return AdditiveModel(0.0, empty, [np.zeros(1)] * width, empty, [], [])
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, k], BINS) for k in range(width)]
    bins = [np.searchsorted(cuts[k], x[:, k]) for k in range(width)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            size = len(tables[k])
            step = RATE * _shallow_tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            tables[k] += step
            total += step[bins[k]]

    pair_cuts = [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(pair_cuts[k], x[:, k]) for k in range(width)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(combinations(range(width), 2), key=lambda p: (-_quadrants(grid(*p, g), grid(*p, h))[0], p))
    pairs = ranked[:PAIRS]
    pair_tables = [np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)) for i, j in pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(pairs, pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return AdditiveModel(base, cuts, tables, pair_cuts, pairs, pair_tables)


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> AdditiveModel:
    """Fit on ``train_rows`` labelled rows at most, chosen by a hash of their id.

    Rows whose crc32 of the id has the held-out remainder, and null ids or labels,
    are never used. A row labelled or present several times counts several times.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "quality")
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    order = F.xxhash64(F.col("_id"), F.lit("quality"))
    chosen = workspace.write(chosen.orderBy(order, "_id", "_label").limit(train_rows), "chosen")
    names = [f"f{k}" for k in range(len(NAMES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = describe(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x[:, k]) for k in range(x.shape[1])]],
                ["_id", "_label", *names],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(chosen, "_id")
    schema = rows.select("_id", "_label").schema
    for name in names:
        schema = schema.add(name, "double")
    # Ids may repeat in docs: the bound holds for what reaches the driver, too.
    found = rows.select("_id", "_label", "_text").mapInArrow(run, schema).orderBy(order, "_id", "_label", *names)
    table = found.limit(train_rows).drop("_id").toArrow()
    x = np.stack([table.column(n).to_numpy() for n in names], axis=1) if table.num_rows else np.zeros((0, len(names)))
    return fit(x, table.column("_label").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1), an earlier column of this name goes.

    Only the text decides. Null text: as the empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs, own = plain_names(docs, ("quality_score",))
    schema = docs.schema.add("score", "double")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(describe(batch.column(len(names) - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(score)], names)

    rows = docs.select("*", F.col(own[text_col]).cast("string").alias("text")).mapInArrow(run, schema)
    return rows.select(*own_names(own), F.col("score").alias("quality_score"))
