"""Intermediate tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, release_shuffles

# Rounds after which the component search stops with an error instead of running on.
MAX_ROUNDS = 60


def plain_names(df: DataFrame, dropped: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` without the columns ``dropped``, with its columns named c0, c1, ..., and the new name of each.

    An operator's own columns then never clash with those of its input.
    """
    kept = [c for c in df.columns if c not in dropped]
    names = {c: f"c{k}" for k, c in enumerate(kept)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def own_names(names: dict[str, str]) -> list[Column]:
    """The input's columns under their own names again."""
    return [F.col(n).alias(c) for c, n in names.items()]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """A folder below the shared checkpoint folder for the tables of one call.

    A written table cuts lineage, survives the loss of any executor, and gives
    Catalyst its true size, so joins with it are broadcast only when that size is
    below ``spark.sql.autoBroadcastJoinThreshold``. Tables that a returned
    DataFrame reads stay until the folder's own retention removes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/shelfcast-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = (), file_rows: int = 0) -> DataFrame:
        """``df`` as a table; ``file_rows`` is for rows of megabytes, of which a writer or a reader holds a file's first hundred at once."""
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if file_rows:
            writer = writer.option("maxRecordsPerFile", file_rows)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelfcast_path = path
        return out

    def release(self) -> None:
        """See :func:`~shelfcast.session.release_shuffles`."""
        release_shuffles(self.spark)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_shelfcast_path", None)
        if path:
            _delete(self.spark, path)


def _all_stars(links: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: links (u, v) with v < u."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(workspace: Workspace, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the smallest node it is connected to: (node, root).

    Alternates two steps until the links are stars around the smallest nodes: every node hands the smallest of
    its neighbours to its larger neighbours, then to its smaller ones. Each is
    one grouping with map-side minima, so a node with very many links costs no
    more than its rows; the number of rounds grows with the logarithm of the
    number of nodes. Nothing is gathered per group or on the driver.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = workspace.write(
        both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        if _all_stars(links):
            break
        # Large step: neighbours above u get u's smallest neighbour (or u).
        around = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            around.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        large = workspace.write(large.where("u <> v").distinct(), "large")
        # Small step: u and its smaller neighbours get the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
        )
        small = workspace.write(small.where("u <> v").distinct(), "small")
        workspace.drop(links)
        workspace.drop(large)
        # The plans of a round leave the driver's heap before the next one makes its own.
        workspace.release()
        links = small
    else:
        raise RuntimeError("the component search did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionAll(tops)

