"""Retrieval metrics from flat result tables ``(query_id, rank, id)``.

The same scores as the array form, for result sets too large to keep as lists:
one grouping by ``(query_id, id)`` and one by ``query_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Euler's constant (fixed value).
EULER = 0.5772156649015329


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n of whole numbers, without a loop.

    From 20 on the asymptotic series is exact to the last digits of a double.
    """
    first = [0.0]
    for i in range(1, 20):
        first.append(first[-1] + 1 / i)
    x = n.cast("double")
    series = F.log(x) + F.lit(EULER) + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n < 20, F.element_at(F.array(*map(F.lit, first)), n.cast("int") + 1)).otherwise(series)


def score_flat(actual: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, recall, average_precision, reciprocal_rank``.

    ``expected`` may be longer than ``top_k``; ``queries`` gives ``query_id,
    top_k`` and keeps queries without any rows in either table.
    """
    wanted = expected.join(queries.select("query_id", "top_k"), "query_id").where(
        F.col("rank") <= F.col("top_k")
    )
    nothing = F.lit(None).cast("int")
    both = actual.select("query_id", "id", F.col("rank").cast("int").alias("a"), nothing.alias("e")).unionByName(
        wanted.select("query_id", "id", nothing.alias("a"), F.col("rank").cast("int").alias("e"))
    )
    per_id = both.groupBy("query_id", "id").agg(
        F.min("a").alias("a"), F.min("e").alias("e"), F.count("a").alias("n_a"), F.count("e").alias("n_e")
    )
    later = F.when(F.col("a").isNotNull() & F.col("e").isNotNull(), F.greatest("a", "e"))
    # A hit at rank m adds 1/m + ... + 1/n for a result of n rows.
    n = F.sum("n_a").over(Window.partitionBy("query_id"))
    gain = F.when(later <= n, harmonic(n) - harmonic(later - 1))
    per_query = per_id.withColumn("later", later).withColumn("gain", gain).groupBy("query_id").agg(
        F.sum("n_a").alias("n_a"),
        F.sum("n_e").alias("n_e"),
        F.min(F.when(F.col("e").isNotNull(), F.col("a"))).alias("best"),
        F.count("later").alias("hits"),
        F.coalesce(F.sum("gain"), F.lit(0.0)).alias("gain"),
    )
    joined = queries.select("query_id").join(per_query, "query_id", "left")
    got, want = F.coalesce("n_a", F.lit(0)), F.coalesce("n_e", F.lit(0))

    def rule(value):
        return (
            F.when((want == 0) & (got == 0), F.lit(1.0))
            .when((want == 0) | (got == 0), F.lit(0.0))
            .otherwise(F.coalesce(value, F.lit(0.0)))
        )

    return joined.select(
        "query_id",
        rule(F.try_divide(F.col("hits").cast("double"), want)).alias("recall"),
        rule(F.try_divide("gain", got)).alias("average_precision"),
        rule(F.try_divide(F.lit(1.0), F.col("best"))).alias("reciprocal_rank"),
    )
