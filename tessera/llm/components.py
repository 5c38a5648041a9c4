"""Connected components of links that stay in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, released

#: Links for each task of what a round writes: most rounds have few, and every task leaves records in the driver.
LINKS, TASKS = 100_000, 8


def _both(edges: DataFrame) -> DataFrame:
    """Every link from each of its ends."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.select(F.explode(ends).alias("end")).select("end.*")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The larger neighbours of every node go to the least of the node and its neighbours.

    A star's centre may have a large part of all links. The least neighbours are found with partial aggregates and
    written first, so that both sides of the join are exchanges, which adaptive execution splits at the centre.
    """
    return _both(edges).join(least.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (the least node reachable) of every node that has a link to another.

    Links of a node to itself, null ends and repeated links say nothing and are left out; no links give no rows. What
    is returned is a checkpoint. The links are done when they are stars: each node has either no smaller neighbour, or
    one and no larger ones. Each step of a round is written by itself, as a short plan.
    """
    edges = edges.select(F.least(a, b).alias("b"), F.greatest(a, b).alias("a")).where("a != b").select("a", "b").distinct()
    edges, tasks = cut(edges), None

    def written(df: DataFrame) -> DataFrame:
        return cut(df.coalesce(tasks) if tasks else df)

    while True:
        lower, higher = F.count_if(F.col("b") < F.col("a")).alias("lower"), F.count_if(F.col("b") > F.col("a")).alias("higher")
        least = written(_both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), lower, higher))
        links, unsettled = least.agg(F.sum("lower"), F.count_if(F.expr("lower > 1 OR (lower = 1 AND higher > 0)"))).first()
        if not unsettled:
            return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
        tasks = TASKS + links // LINKS
        edges = written(_large_star(edges, least))
        edges = written(_small_star(edges))
        released(edges.sparkSession)
