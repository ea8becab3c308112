"""Filtered neighbour joins through an inverted tag index.

Each filtered query is anchored at its rarest required tag.  Records meet
queries by an equi-join on that tag, so a query is scored only against the
records that carry it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.operators.knn import Match, knn
from nearmark.session import stored


def posting_table(records: DataFrame) -> DataFrame:
    """``tag, id``: one row per tag of each record."""
    return records.select(F.explode(F.array_distinct("tags")).alias("tag"), "id")


def tag_counts(records: DataFrame) -> DataFrame:
    return (
        records.select(F.explode(F.array_distinct("tags")).alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def anchor_queries(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """Filtered queries with their rarest required tag as ``anchor``.

    A query that asks for a tag no record has finds nothing and is left out.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("required")).alias("tag"))
    known = asked.join(counts, "tag", "left")
    chosen = (
        known.groupBy("query_id")
        .agg(
            F.min_by("tag", F.struct("records", "tag")).alias("anchor"),
            F.bool_or(F.col("records").isNull()).alias("_unknown"),
        )
        .where(~F.col("_unknown"))
        .drop("_unknown")
    )
    return queries.join(chosen, "query_id")


def knn_by_postings(
    records: DataFrame, queries: DataFrame, metric: str, by: tuple[str, ...] = (), **options
) -> DataFrame:
    """Same rows as a filtered :func:`knn`; reads only matching records."""
    free = queries.where(F.col("required").isNull() | (F.size("required") == 0))
    bound = queries.where(F.size("required") > 0)
    anchored = stored(anchor_queries(bound, tag_counts(records)), "anchors")
    used = anchored.select("anchor").distinct()
    posted = records.withColumn("anchor", F.explode(F.array_distinct("tags"))).join(
        used, "anchor", "left_semi"
    )
    filtered = knn(posted, anchored, metric, Match(by=("anchor", *by), tags=True), **options)
    return filtered.unionByName(knn(records, free, metric, Match(by=by), **options))
