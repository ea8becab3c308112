"""A whole evaluation as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.functions.scoring import score, score_long
from nearmark.operators.knn import attach_neighbours, knn, neighbour_lists
from nearmark.operators.report import histogram, summarise
from nearmark.schema import VectorDataset


def ground_truth(dataset: VectorDataset, **options) -> DataFrame:
    """The dataset's queries with exact neighbours for its records."""
    found = knn(dataset.records, dataset.queries, dataset.metric, **options)
    return attach_neighbours(dataset.queries, found)


def score_results(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of flat results (``query_id, rank, id``) against ``neighbors``.

    A query without results is scored too; one without ground truth gets null.
    """
    id_type = results.schema["id"].dataType.simpleString()
    joined = queries.select("query_id", "top_k", "neighbors").join(
        neighbour_lists(results, "actual"), "query_id", "left"
    )
    empty = F.array().cast(f"array<{id_type}>")
    return score(joined.withColumn("actual", F.coalesce("actual", empty)))


def summary(scored: DataFrame, request_type: str = "Search") -> DataFrame:
    """Distribution of every metric over the queries."""
    long = score_long(scored, ["query_id"]).withColumn("request_type", F.lit(request_type))
    return summarise(histogram(long))
