"""Approximate neighbour joins over a partitioned corpus.

The corpus is cut into lists around centroids.  A query probes the lists of
its nearest centroids and is compared exactly with their records.  Probing
every list gives the exact answer.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmark.functions.distance import norm
from nearmark.functions.scalars import default_lists, default_probes
from nearmark.operators import blocks
from nearmark.operators.knn import BROADCAST_BYTES, Match, _collect_within, knn, neighbour_lists
from nearmark.schema import COSINE, NEIGHBOUR_COLUMNS, check_metric
from nearmark.session import stored

# Most list ids written into a scan as literals.
NAMED_LISTS = 4096

__all__ = [
    "assign_lists", "default_lists", "default_probes", "fit_centroids", "ivf_search",
    "mean_centroids", "probe_sweep", "write_lists",
]


def _unit(values: str):
    length = norm(values)
    scaled = F.transform(F.col(values).cast("array<double>"), lambda x: x / length)
    return F.when(length > 0, scaled).otherwise(F.col(values).cast("array<double>"))


def fit_centroids(
    records: DataFrame, lists: int, metric: str, seed: int = 0, iterations: int = 10
) -> DataFrame:
    """``list_id, values``: k-means centres of the corpus.

    Cosine clusters directions.  The features are stored once, as training reads
    them in every iteration.
    """
    check_metric(metric)
    values = _unit("values") if metric == COSINE else F.col("values").cast("array<double>")
    points = records.select(values.alias("values"))
    points = stored(points, "features").select(array_to_vector("values").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(points)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return records.sparkSession.createDataFrame(centres, "list_id int, values array<double>")


def mean_centroids(records: DataFrame, group: str) -> DataFrame:
    """``list_id, values``: the mean vector of each group, as ready centroids."""
    means = records.groupBy(F.col(group).alias("list_id")).agg(
        Summarizer.mean(array_to_vector(F.col("values").cast("array<double>"))).alias("_m")
    )
    return means.select("list_id", vector_to_array("_m").alias("values"))


def assign_lists(
    records: DataFrame, centroids: DataFrame, metric: str, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Records with the ``list_id`` of their nearest centroid; ties by list id.

    Centroids within the budget are broadcast and the records labelled in one
    pass without a shuffle; more centroids than that meet the records in a grid.
    """
    centres = centroids.select(F.col("list_id").alias("id"), "values")
    side = _collect_within(centres, budget, forced=False)
    if side is None:
        asked = records.select(F.col("id").alias("query_id"), "values", F.lit(1).alias("top_k"))
        near = knn(centres, asked, metric, strategy="grid")
        return records.join(
            near.select(F.col("query_id").alias("id"), F.col("id").alias("list_id")), "id"
        )
    shared = records.sparkSession.sparkContext.broadcast(side)
    kind, list_type = centroids.schema["list_id"].dataType, side.schema.field("id").type

    @F.pandas_udf(kind)
    def nearest_list(values: pd.Series) -> pd.Series:
        n = len(values)
        table = pa.table(
            {
                "query_id": pa.array(np.arange(n)),
                "values": pa.array(list(values), pa.list_(pa.float64())),
                "top_k": pa.array(np.ones(n, np.int32)),
            }
        )
        centres = blocks.Records(shared.value, metric)
        # The top 1 of every row, in row order.
        found = blocks.nearest([centres], blocks.Queries(table, metric), list_type, pa.int64())
        return found.column("id").to_pandas()

    # Marked as if not deterministic, so that a filter on the list does not make
    # Catalyst compute it twice.
    labelled = nearest_list.asNondeterministic()
    return records.withColumn("list_id", labelled(F.col("values").cast("array<double>")))


def write_lists(assigned: DataFrame, path: str) -> None:
    """Store the corpus by list, so that probing reads only the lists probed."""
    assigned.write.partitionBy("list_id").parquet(path)


def ivf_search(
    assigned: DataFrame,
    centroids: DataFrame,
    queries: DataFrame,
    metric: str,
    probes: int,
    match: Match = Match(),
    **options,
) -> DataFrame:
    """Nearest records among each query's ``probes`` nearest lists."""
    asked = with_lists(queries, centroids, metric, probes)
    within = replace(match, lists=True)
    return knn(lists_named(assigned, asked), asked, metric, within, **options)


def with_lists(queries: DataFrame, centroids: DataFrame, metric: str, probes: int) -> DataFrame:
    """Queries with the ``lists`` of their nearest centroids, nearest first; a vector is held once."""
    near = neighbour_lists(_probe_lists(centroids, queries, metric, probes), "lists")
    return stored(queries.join(near, "query_id"), "probes")


def lists_named(assigned: DataFrame, asked: DataFrame) -> DataFrame:
    """The corpus without lists that no query names."""
    return _lists_probed(assigned, asked.select(F.explode("lists").alias("list_id")))


def _lists_probed(assigned: DataFrame, probed: DataFrame) -> DataFrame:
    """The corpus without lists nobody probes.

    A moderate number of lists is named in the scan, so that a corpus stored by
    list reads only their folders; more are matched by a join.
    """
    lists = probed.select("list_id").distinct()
    named = [row["list_id"] for row in lists.limit(NAMED_LISTS + 1).collect()]
    if len(named) <= NAMED_LISTS:
        return assigned.where(F.col("list_id").isin(named))
    return assigned.join(lists, "list_id", "left_semi")


def _probe_lists(centroids: DataFrame, queries: DataFrame, metric: str, probes: int) -> DataFrame:
    centres = centroids.select(F.col("list_id").alias("id"), "values")
    return knn(centres, queries.select("query_id", "values", F.lit(probes).alias("top_k")), metric)


def probe_sweep(
    assigned: DataFrame, centroids: DataFrame, queries: DataFrame, metric: str, settings: list[int], **options
) -> DataFrame:
    """Answers at several probe counts, with the setting as ``probes``.

    Each query and list is compared once, at the widest setting; every setting
    then merges the lists it probes.
    """
    bands = sorted(set(settings))
    starts = [0, *bands[:-1]]
    # Queries are known by numbers in here; a query comes once for the lists of each band of settings.
    asked = stored(with_lists(queries, centroids, metric, bands[-1]).withColumn("_no", F.monotonically_increasing_id()), "sweep")
    cut = [F.struct(F.lit(i).alias("band"), F.slice("lists", a + 1, b - a).alias("lists")) for i, (a, b) in enumerate(zip(starts, bands, strict=True))]
    number = F.col("_no") * len(bands) + F.col("_cut.band")
    split = asked.withColumn("_cut", F.explode(F.array(*cut))).where(F.size("_cut.lists") > 0)
    split = split.select(number.alias("query_id"), "values", "top_k", F.col("_cut.lists").alias("lists"))
    found = knn(lists_named(assigned, asked), split, metric, Match(lists=True), **options)
    found = found.withColumn("_no", F.expr(f"query_id div {len(bands)}L")).withColumn("band", F.col("query_id") % len(bands))
    reached = F.explode(F.slice(F.array(*map(F.lit, bands)), F.col("band").cast("int") + 1, len(bands)))
    order = Window.partitionBy("probes", "_no").orderBy("distance", "id")
    return (
        found.drop("query_id")
        .join(asked.select("_no", "query_id", "top_k"), "_no")
        .withColumn("probes", reached)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("top_k"))
        .select("probes", *NEIGHBOUR_COLUMNS)
    )
