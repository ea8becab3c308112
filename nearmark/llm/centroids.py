"""Centroid clustering of integer vectors by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value there.  A
vector's own value is looked up in each list, and all lists are walked outward
from it, the nearer side first.  A centroid met in any list is measured
exactly.  One met in no list yet differs in every dimension by at least that
list's frontier, so the walk stops when the sum of the squared frontiers is
strictly above the least distance measured: at an equal sum an unmet centroid
could still tie and have the smaller number.

Components, distances and sums are whole numbers of 64 bits, so results do not
depend on how rows are dealt to tasks.  A round moves one row of sums per task,
centroid and dimension; vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from nearmark.llm.common import column, fresh
from nearmark.session import stored

CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
# Vectors walked at once.
CHUNK = 1024
FAR = np.iinfo(np.int64).max


class Walk:
    """Nearest centroids of whole-number vectors."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of a tie) and the squared distance."""
        home, best = np.zeros(len(x), np.int64), np.full(len(x), FAR)
        for s in range(0, len(x), CHUNK):
            home[s : s + CHUNK], best[s : s + CHUNK] = self._walk(x[s : s + CHUNK])
        return home, best

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        home, best = np.full(len(x), k), np.full(len(x), FAR)
        met = np.zeros((len(x), k), bool)
        high = np.stack([np.searchsorted(self.values[:, j], x[:, j]) for j in range(dims)], axis=1)
        low = high - 1
        lists = np.arange(dims)
        left = np.arange(len(x))
        while len(left):
            down = np.where(low >= 0, x[left] - self.values[np.maximum(low, 0), lists], FAR)
            up = np.where(high < k, self.values[np.minimum(high, k - 1), lists] - x[left], FAR)
            below = down <= up
            frontier = np.where(below, down, up)
            number = self.order[np.where(below, low, high), lists]
            low, high = low - below, high + ~below
            new = np.zeros((len(left), k), bool)
            np.put_along_axis(new, number, True, axis=1)
            new &= ~met[left]
            met[left] |= new
            row, c = np.nonzero(new)
            distance = ((x[left[row]] - self.centroids[c]) ** 2).sum(axis=1)
            before = best[left]
            np.minimum.at(best, left[row], distance)
            # A number found for a larger distance no longer counts.
            home[left[best[left] < before]] = k
            least = distance == best[left[row]]
            np.minimum.at(home, left[row[least]], c[least])
            on = ((frontier**2).sum(axis=1) <= best[left]) & ~met[left].all(axis=1)
            left, low, high = left[on], low[on], high[on]
        return home, best


def whole(vector: Column, dims: int) -> Column:
    """The vector has ``dims`` components, and all are finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def scaled(array: pa.Array, dims: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of a list column; an error if distances could leave 64 bits."""
    flat = array.flatten().to_numpy(zero_copy_only=False)
    x = np.floor(flat * scale).reshape(len(array), dims)
    if x.size and 4 * dims * float(np.abs(x).max()) ** 2 >= 2.0**63:
        raise ValueError("components are too large for distances of 64 bits")
    return x.astype(np.int64)


def _moved(rows: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; empty ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        count, total = np.zeros(len(shared.value), np.int64), np.zeros_like(shared.value)
        for batch in batches:
            x = scaled(batch.column(0), dims, scale)
            home, _ = walk.nearest(x)
            count += np.bincount(home, minlength=len(count))
            np.add.at(total, home, x)
        used = np.flatnonzero(count)
        yield pa.record_batch(
            {
                "cluster": pa.array(np.repeat(used, dims), pa.int32()),
                "dim": pa.array(np.tile(np.arange(dims), len(used)), pa.int32()),
                "total": pa.array(total[used].ravel()),
                "n": pa.array(np.repeat(count[used], dims)),
            }
        )

    part = rows.select("vector").mapInArrow(sums, "cluster int, dim int, total bigint, n bigint")
    moved = centroids.copy()
    for r in part.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return moved


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept row.

    Kept are rows whose vector has exactly ``dims`` components, none null or not
    finite; a component x counts as ``floor(scale * x)``.  Centroids begin as the
    ``k`` rows of the smallest SHA-256 of ``1:<key>`` (rows of one key by their
    vectors), and are moved ``rounds`` times; the result is of a last assignment
    to the moved centroids.  Distances are squared, a tie goes to the smaller
    number, and a centroid without vectors stays where it is.

    A null key hashes as ``1:`` and comes out null.  Repeated rows count and come
    out each.  With fewer kept rows than ``k`` there are as many centroids as
    rows; none gives an empty table.  Other columns are ignored, whatever their
    names.  Components too large for 64-bit distances are an error.
    """
    rows = vectors.select(column(vectors, key).alias("key"), column(vectors, vector).cast("array<double>").alias("vector"))
    rows = rows.where(whole(F.col("vector"), dims))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    first = rows.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).select("vector").collect()
    start = pa.array([r["vector"] for r in first], pa.list_(pa.float64()))
    centroids = scaled(start, dims, scale)
    for _ in range(rounds if first else 0):
        centroids = _moved(rows, centroids, dims, scale)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        for batch in batches:
            home, distance = walk.nearest(scaled(batch.column(1), dims, scale))
            yield pa.record_batch([batch.column(0), pa.array(home, pa.int32()), pa.array(distance)], ["key", "cluster", "distance"])

    schema = rows.select("key").schema.add("cluster", IntegerType()).add("distance", LongType())
    placed = stored(rows.mapInArrow(assign, schema), "clusters")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    # As many rows as centroids.
    facts = [
        (c, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, own in inertia.items()
    ]
    about = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = placed.join(F.broadcast(about), "cluster")
    (name,) = fresh(about.withColumn("distance", F.lit(0)), key)
    return out.select(F.col("key").alias(name), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_report(spark, folder: str) -> DataFrame:
    """``op13``: cluster of each embedding after three rounds of sixteen centroids."""
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _cluster_sql() -> str:
    steps = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16
)"""
    for i in range(ROUNDS + 1):
        steps += f""", a{i} AS MATERIALIZED (
  SELECT k.rid, min(16 * list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) + c.c) AS best
  FROM kept k CROSS JOIN c{i} c GROUP BY k.rid
)"""
        if i < ROUNDS:
            # The division rounds to zero, so the rest is made positive first.
            steps += f""", c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT a.best % 16 AS c, t.i, sum(k.v[t.i]) AS s, count(*) AS n
      FROM a{i} a JOIN kept k USING (rid) CROSS JOIN range(1, 65) t(i) GROUP BY 1, 2
    ) GROUP BY c
  ) m ON m.c = c.c
)"""
    return steps + f"""
SELECT k.vec_id, CAST(a.best % 16 AS INTEGER) AS cluster, CAST(a.best // 16 AS BIGINT) AS distance,
       CAST(sum(a.best // 16) OVER (PARTITION BY a.best % 16) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best // 16) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k USING (rid) JOIN c{ROUNDS} c ON c.c = a.best % 16
"""


CLUSTER_SQL = _cluster_sql()
