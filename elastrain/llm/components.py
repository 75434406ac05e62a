"""Connected components by alternating large-star and small-star steps over a written edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import write_table
from elastrain.session import shuffle_width

#: A task of a step takes so many edges, so a step over few of them has few tasks, files and shuffle blocks.
EDGES_A_TASK = 50_000


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b) that are not the smallest of their component, which is root.

    Each step is a partial aggregate and a join on the node, so a node with very many links is split by
    the join; nothing is gathered by component. The edges of a step are written to the shared folder.
    The end is reached when a step leaves the edge set as it was (count and two hash sums). ``edges`` are
    counted first, so they should be a table that was written. Steps are many and mostly small: their tasks
    follow the number of edges, not the number of shuffle partitions.
    """
    ends = edges.where("a != b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    now = write_table(_few(ends.distinct(), edges.count()), "cc")
    seen = _summary(now)
    while seen[0]:
        now = write_table(_small_star(_large_star(now, seen[0]), seen[0]), "cc")
        last, seen = seen, _summary(now)
        if seen == last:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _summary(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.sum(F.pmod(F.hash("b", "a"), F.lit(1 << 30)))).first())


def _few(df: DataFrame, edges: int) -> DataFrame:
    """``df``, made by as many tasks as so many edges and the cores ask for, if these are fewer than the shuffle's."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-edges // EDGES_A_TASK))
    return df.coalesce(tasks) if tasks < shuffle_width(df.sparkSession) else df


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    low = _few(both.groupBy("u").agg(F.min("v").alias("low")), n).select("u", F.least("u", "low").alias("low"))
    tied = _few(both.where("v > u").join(low, "u"), n)
    return _few(tied.select(F.col("low").alias("a"), F.col("v").alias("b")).distinct(), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = _few(edges.groupBy("b").agg(F.min("a").alias("low")), n)
    tied = _few(edges.join(low, "b"), n)
    down = tied.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return _few(down.union(low.select(F.col("low").alias("a"), "b")).distinct(), n)
