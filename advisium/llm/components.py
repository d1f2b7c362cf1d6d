"""Connected components of an edge table by alternating large and small stars.

Each round joins edges with the least neighbour of a node. The least neighbours come from a partial
aggregate and are cut by a checkpoint, so that the join is one of two plain shuffles: adaptive
execution splits those, but not a join with an aggregate by the same key. A node that holds a third of
all edges is then no single task's work. Rounds end when the edges no longer change.

The edges of a round are a written table, not a checkpoint: a checkpoint keeps the size that the
optimizer guessed, which is the product of both sides of each join, and whose digits would double in
every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisium.llm.common import remove, scratch


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free sum of row hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least")).checkpoint()
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lower neighbours are tied to the least of them. Rows have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).checkpoint()
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the least node of its component.

    Loops, repeated edges and either direction are allowed; nulls are not edges. No edges: no rows.
    """
    spark = edges.sparkSession
    top, n = scratch(spark, "components"), 0

    def written(rows: DataFrame) -> DataFrame:
        rows.distinct().write.parquet(f"{top}/{n}")
        if n > 1:
            remove(f"{top}/{n - 2}")
        return spark.read.parquet(f"{top}/{n}")

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    was = _state(edges)
    while was[0]:
        n += 1
        large = _large_star(edges).checkpoint()
        edges = written(_small_star(large))
        now = _state(edges)
        if now == was:
            break
        was = now
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = pairs.union(pairs.select(F.col("root").alias("node"), "root").distinct()).checkpoint()
    remove(top)
    return out
