"""Splits of a corpus by its own ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevant_ids(queries: DataFrame, neighbors: str = "neighbors") -> DataFrame:
    """Distinct ids in any query's ground truth."""
    return queries.select(F.explode(neighbors).alias("id")).distinct()


def holes(records: DataFrame, relevant: DataFrame) -> DataFrame:
    """Records that some query's ground truth names."""
    return records.join(relevant.select("id"), "id", "left_semi")


def cheese(records: DataFrame, relevant: DataFrame) -> DataFrame:
    """Records that no query's ground truth names."""
    return records.join(relevant.select("id"), "id", "left_anti")


def drift_records(records: DataFrame, relevant: DataFrame) -> DataFrame:
    """Step 0 holds the cheese, step 1 the holes; one pass over the records."""
    marked = relevant.select("id").distinct().withColumn("_hit", F.lit(1))
    return (
        records.join(marked, "id", "left")
        .withColumn("step", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def drift_queries(queries: DataFrame) -> DataFrame:
    """All queries run in step 1, after the holes are filled."""
    return queries.withColumn("step", F.lit(1))
