"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from shelfwatch.llm.common import staged

ROUNDS = 60  # far more than the logarithm of any table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest one around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; edges point down."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a")
    down = moved.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return down.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) but the smallest of each component.

    ``component`` is that smallest node. Tables are written after each round, so lost
    executors cost one round; the driver sees a count and a checksum only.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(edges, "edges"), None
    for _ in range(ROUNDS):
        edges = staged(_small_star(staged(_large_star(edges), "large-star")), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
