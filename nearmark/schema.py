"""Table layouts shared by the readers and the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

COSINE = "cosine"
EUCLIDEAN = "euclidean"
DOTPRODUCT = "dotproduct"
METRICS = (COSINE, EUCLIDEAN, DOTPRODUCT)

# Column sets of the on-disk tables (fixed values).
RECORD_REQUIRED = ("id", "values")
RECORD_OPTIONAL = ("sparse_values", "metadata")
QUERY_REQUIRED = ("top_k", "blob")
QUERY_VECTOR = ("values", "vector")
QUERY_OPTIONAL = ("id", "sparse_vector", "filter")
DOCUMENT_COLUMNS = ("id", "values", "sparse_values", "metadata")

NEIGHBOUR_COLUMNS = ("query_id", "rank", "id", "distance")


def check_metric(metric: str) -> str:
    """Return ``metric`` if it is known, raise otherwise."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    return metric


@dataclass(frozen=True)
class VectorDataset:
    """A corpus and its query set, read lazily.

    ``records`` holds ``id, values[, metadata, namespace, step]``; ``queries``
    holds ``query_id, values, top_k[, filter, neighbors, namespace, step]``.
    A stepped workload is one dataset whose two tables carry ``step``.
    """

    name: str
    records: DataFrame
    queries: DataFrame
    dims: int
    metric: str

    def __post_init__(self) -> None:
        check_metric(self.metric)
