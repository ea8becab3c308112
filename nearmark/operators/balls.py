"""Exact neighbour joins that skip parts of a stored corpus.

The corpus is stored by list, and of each list a ball is known that holds all
its records: a centre and a radius.  No record of a list is nearer to a query
than the distance to the ball, so a list whose ball lies beyond the query's
k-th neighbour cannot change the answer and is not read.

A search takes two waves.  The first reads, for every query, the lists of the
nearest balls that hold ``top_k`` records together; the k-th distance found
there is a limit.  The second reads the other lists whose ball is not beyond
it.  The rows are those of :func:`nearmark.operators.knn.knn`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmark.functions.distance import norm
from nearmark.operators import blocks
from nearmark.operators.ivf import assign_lists, lists_named
from nearmark.operators.knn import BROADCAST_BYTES, Match, _merge, knn, portions
from nearmark.schema import COSINE, EUCLIDEAN, check_metric
from nearmark.session import stored

# Share of the sizes involved by which a bound is lowered for rounding.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Balls:
    """``lists``: the records with their ``list_id``, stored by it.

    ``about``: ``list_id, values`` (the centre), ``radius, records`` of each.
    Under cosine the ball is that of the records' directions.
    """

    lists: DataFrame
    about: DataFrame
    metric: str


def build(records: DataFrame, centroids: DataFrame, metric: str, path: str) -> Balls:
    """Store ``records`` around ``centroids`` below ``path``, and measure the balls.

    Files hold one list each and are of even size: a long list gets several, and
    no task holds a whole list.  Vectors that are zero under cosine or not
    finite make a ball without end, which is always read.
    """
    check_metric(metric)
    assigned = assign_lists(records, centroids, metric).hint("rebalance", "list_id")
    assigned.write.partitionBy("list_id").parquet(f"{path}/lists")
    spark = records.sparkSession
    # The folder's names are read with the type that the lists have.
    lists = spark.read.schema(assigned.schema).parquet(f"{path}/lists").select(*assigned.columns)
    centres = centroids.select("list_id", F.col("values").cast("array<double>").alias("_centre"))
    values = F.col("values").cast("array<double>")
    if metric == COSINE:
        length = norm("values")
        values = F.transform(values, lambda x: x / F.nullif(length, F.lit(0.0)))
    apart = F.sqrt(F.aggregate(F.zip_with(values, "_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    far = F.lit(float("inf"))
    measured = lists.join(centres, "list_id").withColumn("_apart", F.nanvl(F.coalesce(apart, far), far))
    about = measured.groupBy("list_id").agg(F.max("_apart").alias("radius"), F.count(F.lit(1)).alias("records"))
    about.join(centres.withColumnRenamed("_centre", "values"), "list_id").write.parquet(f"{path}/about")
    return read(spark, path, metric, lists.schema)


def read(spark: SparkSession, path: str, metric: str, schema: T.StructType) -> Balls:
    """Balls stored earlier; ``schema`` is that of the records with ``list_id``."""
    lists = spark.read.schema(schema).parquet(f"{path}/lists").select(*schema.fieldNames())
    return Balls(lists, spark.read.parquet(f"{path}/about"), metric)


class Bounds:
    """Lower bounds of the distances from queries to the records of each list."""

    def __init__(self, about: pa.Table, metric: str):
        # Ordered by list, so that ties are the same wherever this is asked.
        about = about.sort_by("list_id")
        self.metric = metric
        self.ids = about.column("list_id").to_numpy()
        self.centres = blocks.matrix(about.column("values"))
        self.radius = about.column("radius").to_numpy()
        self.records = about.column("records").to_numpy()
        self.norms = blocks.lengths(self.centres) if len(self.ids) else np.empty(0)

    def lower(self, queries: np.ndarray) -> np.ndarray:
        """One row per query; minus infinity where nothing is known."""
        length = blocks.lengths(queries)
        with np.errstate(all="ignore"):
            if self.metric == COSINE:
                queries, length = queries / length[:, None], np.ones(len(queries))
            inner = queries @ self.centres.T
            size = length[:, None] + self.norms + self.radius
            if self.metric in (COSINE, EUCLIDEAN):
                squared = length[:, None] ** 2 + self.norms**2 - 2 * inner
                # The square of a difference loses half the digits.
                gap = np.sqrt(np.maximum(squared - ROUNDING * size**2, 0)) - self.radius
                out = np.maximum(gap - ROUNDING * size, 0)
                out = out**2 / 2 - ROUNDING if self.metric == COSINE else out
            else:
                out = -inner - length[:, None] * self.radius - ROUNDING * length[:, None] * size
        return np.where(np.isfinite(out), out, -np.inf)

    def nearest(self, lower: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which lists each query reads first: the nearest balls with ``k`` records in all."""
        order = np.argsort(lower, axis=1, kind="stable")
        before = np.cumsum(self.records[order], axis=1) - self.records[order]
        out = np.zeros(lower.shape, bool)
        np.put_along_axis(out, order, before < k[:, None], axis=1)
        return out


def _name(queries: DataFrame, about: DataFrame, metric: str, first: bool, budget: int) -> DataFrame:
    """Queries with the ``lists`` of one wave; without a shuffle."""
    kind = about.schema["list_id"].dataType
    empty = F.array().cast(T.ArrayType(kind))
    out = queries.withColumn("lists", empty)
    names = out.columns
    for part in portions(about, "list_id", budget):
        shared = out.sparkSession.sparkContext.broadcast(part)

        def add(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(shared.value, metric)
            for batch in batches:
                # Blocks of the score matrix stay small.
                step = max(1, blocks.SCORE_CELLS // max(1, len(bounds.ids)))
                for s in range(0, batch.num_rows, step):
                    rows = batch.slice(s, step)
                    at = {c: i for i, c in enumerate(rows.schema.names)}
                    lower = bounds.lower(blocks.matrix(rows.column(at["values"])))
                    chosen = bounds.nearest(lower, rows.column(at["top_k"]).to_numpy())
                    if not first:
                        limit = rows.column(at["bound"]).to_numpy(zero_copy_only=False).astype(np.float64)
                        limit = np.where(np.isnan(limit), np.inf, limit)
                        chosen = (lower <= limit[:, None]) & ~chosen
                    q, i = np.nonzero(chosen)
                    old = rows.column(at["lists"])
                    own = [o + bounds.ids[i[a:b]].tolist() for o, a, b in zip(old.to_pylist(), *_ranges(q, rows.num_rows), strict=True)]
                    values = [pa.array(own, old.type) if c == "lists" else rows.column(at[c]) for c in names]
                    yield pa.record_batch(values, names)

        out = out.mapInArrow(add, out.schema)
    return out


def _ranges(q: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    at = np.searchsorted(q, np.arange(n + 1)).tolist()
    return at[:-1], at[1:]


def ball_search(balls: Balls, queries: DataFrame, match: Match = Match(), budget: int = BROADCAST_BYTES, **options) -> DataFrame:
    """Same rows as ``knn(records, queries, metric, match)``.

    Query vectors and balls are broadcast in portions within the budget, records
    are read in place, list by list; only pairs are shuffled.  A query that
    finds fewer than ``top_k`` records at first (a filter, a NaN) reads all lists.
    """
    within = replace(match, lists=True)
    columns = match.query_columns(queries)
    asked = queries.select(*columns).where(F.col("top_k") > 0)
    first = stored(_name(asked, balls.about, balls.metric, True, budget), "balls-first")
    found = stored(knn(lists_named(balls.lists, first), first, balls.metric, within, budget=budget, **options), "balls-found")
    wanted = asked.select("query_id", "top_k")
    limit = found.join(wanted, "query_id").where(F.col("rank") == F.col("top_k")).select("query_id", F.col("distance").alias("bound"))
    limited = asked.drop("bound").join(limit, "query_id", "left")
    second = stored(_name(limited, balls.about, balls.metric, False, budget).where(F.size("lists") > 0), "balls-second")
    more = knn(lists_named(balls.lists, second), second, balls.metric, within, budget=budget, **options)
    return _merge(found.unionByName(more).join(wanted, "query_id"))
