"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every vertex of ``edges`` (``a, b``); the root is the least id.

    Large-star and small-star steps in turn, until every edge leads to a root:
    every vertex hands its larger neighbours, then its smaller ones, to the least
    vertex it knows.  The edges get no more, and the rounds grow with the
    logarithm of the longest path.  A hub's edges are reduced to a minimum before
    they are shuffled.  Each step is a stored table, so no plan holds two of them,
    and edges that are stars when they come take no step.
    """
    now = stored(_clean(edges), "edges")
    while not _settled(now):
        now = stored(_large_star(now), "edges")
        now = stored(_small_star(now), "edges")
    # Now every edge leads from a vertex to its root.
    roots = now.select(F.col("b").alias("root")).distinct().select(F.col("root").alias("id"), "root")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)


def _clean(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller vertex, each once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether no vertex has two smaller neighbours, or a smaller one and a larger one."""
    seen = lambda end, smaller: edges.select(F.col(end).alias("v"), F.lit(smaller).alias("smaller"), F.lit(1 - smaller).alias("larger"))
    ends = seen("a", 1).unionByName(seen("b", 0))
    met = ends.groupBy("v").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return not met.agg(F.bool_or(F.expr("smaller > 1 or (smaller = 1 and larger = 1)"))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a").where("b > a")
    return _clean(linked.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a")
    return _clean(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))
