"""Mix sources to target weights by repeating documents.

A source's rate is its target divided by its size in words. Every document of
the source is emitted floor(rate) times, and once more if a hash of its id falls
below the fraction, so a source's expected words equal its target and a rerun,
also of a single lost task, draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import with_global_rank
from .tables import Workspace, own_names, plain_names
from .words import WORD

# Hex digits of the md5 that make a draw: 52 bits, which a double holds exactly.
DRAW_DIGITS = 13


def word_count(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(identity: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the row's id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / float(16**DRAW_DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, workspace: Workspace) -> DataFrame:
    """(source, source_size, target) from rows of (_source, _size).

    Sources in code-point order, null last, take ``weights`` in turn and share
    all words by them. A target stops at ``most`` times the source's size; what
    is over goes to the others by weight until none is above. That end state is
    min(most * size, level * weight): sources ordered by size / weight reach
    their stop first, so one running sum finds the level. Number and running sum
    come from range partitions plus offsets, so any number of sources works.
    """
    totals = workspace.write(
        sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")), "sources"
    )
    named = totals.select(
        F.col("_source").isNull().alias("_null"),
        F.coalesce("_source", F.lit("")).alias("_name"),
        "source_size",
    )
    ranked = with_global_rank(named, ["_null", "_name"], "_rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = workspace.write(
        ranked.withColumn("_weight", F.get(turn, (F.col("_rank") % len(weights)).cast("int")))
        .withColumn("_stop", most * F.col("source_size"))
        .withColumn("_order", F.col("_stop") / F.col("_weight")),
        "ranked",
    )
    whole = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    words, weight = float(whole[0] or 0), float(whole[1] or 0)
    # Raise the level until no further source is above its stop; a pass is one small aggregate.
    level = words / weight if weight else 0.0
    while True:
        full = F.col("_order") <= level
        held = ranked.agg(
            F.sum(F.when(full, F.col("_stop")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))),
        ).first()
        if not held[1]:
            break
        higher = (words - held[0]) / held[1]
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    target = F.when(F.col("_order") <= level, F.col("_stop")).otherwise(level * F.col("_weight"))
    return workspace.write(
        ranked.select(
            F.when(~F.col("_null"), F.col("_name")).alias("_source"), "source_size", target.alias("target")
        ),
        "targets",
    )


def plan_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: str = "mixture",
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies; earlier columns of these names go.

    Null text: size 0. Null source: a source of its own, last. Null id: all such
    rows draw alike. Repeated rows draw alike. A source without words has target
    0 and no copies. No table row is gathered: sources meet documents in a join
    whose small side Spark broadcasts after its written size is known, and
    otherwise splits where one source is hot.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "mixture")
    docs, names = plain_names(docs, ("mix_size", "mix_source_size", "mix_target", "mix_copies"))
    source = F.col(names[source_col]).cast("string")
    size = word_count(F.col(names[text_col]))
    targets = source_targets(docs.select(source.alias("_source"), size.alias("_size")), weights, most, workspace)
    joined = docs.join(targets, source.eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(F.col(names[id_col]), seed) < rate - F.floor(rate)
    return joined.select(
        *own_names(names),
        size.alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        (F.floor(rate) + extra.cast("long")).cast("int").alias("mix_copies"),
    )


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as ``plan_mixture`` says, copies side by side."""
    names = docs.columns
    planned = plan_mixture(docs.toDF(*[f"d{k}" for k in range(len(names))]), **{
        key: f"d{names.index(options.pop(key, default))}"
        for key, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))
    }, **options)
    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies")))
    rows = planned.withColumn("mix_copy", F.explode(copies))
    return rows.select(*[F.col(f"d{k}").alias(c) for k, c in enumerate(names)])
