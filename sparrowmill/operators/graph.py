"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, with_group


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Each round hangs larger neighbours on the least neighbour (large star), then smaller
    neighbours and the node itself (small star). Both are an aggregate with partial results and a
    join that meets nodes of very many neighbours by a broadcast, so none is collected, paired with
    itself or a task of its own. Rounds end when every node hangs on a root, as one aggregate tells;
    their number grows with the logarithm of the longest path. No edges: no rows.
    """
    tree = materialize(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    while not _flat(tree):
        total = 2 * tree.count()
        both = tree.select("u", "v").unionAll(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = with_group(both.where("v > u"), least, "u", "n", total, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_group(large, least, "u", "n", total, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = materialize(small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _flat(tree: DataFrame) -> bool:
    """Whether every u hangs on one v, and no v hangs on anything."""
    ends = tree.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionAll(tree.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs + holds > 1").isEmpty()
