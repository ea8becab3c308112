"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Vectors are unit length from here on, so a cosine of t is a distance of
sqrt(2 - 2 t).  If the home cell of y is c, y lies on c's side of the plane
between c and any other centroid h.  A vector x at home in h can link with y only
if it is no farther than that distance from the plane, which is
(x.h - x.c) / |h - c|.  So each vector is also sent, as a guest, to the cells for
which this holds, and no link is lost to the cells' borders.  A pair is counted
in the lower of its two home cells.

Equal vectors are one class.  Large cells are cut into parts, and pairs of
parts are dealt to tasks, which emit counts and spanning links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.llm.common import column, runs
from nearmark.llm.graph import components
from nearmark.llm.neardup import join_all
from nearmark.session import stored

THRESHOLD = 0.9
# The sample that centroids are trained on, in expected rows and in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
MOST_CELLS, MOST_GUESTS = 1024, 4.0
ROUNDS = 12
# Bytes of vectors in a part of a cell, and rows of one product.
PART_BYTES, TILE = 16 << 20, 1024
# Products this close to the threshold are measured again.
NEAR = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, scaled first so that no square leaves the range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """``k`` unit centroids at most: each the mean direction of the vectors nearest to it."""
    rng = np.random.default_rng(seed)
    # Far apart beginnings: each the farthest of a few random vectors.
    chosen = [x[rng.integers(len(x))]]
    nearest = x @ chosen[0]
    while len(chosen) < k:
        some = rng.integers(len(x), size=16)
        one = some[nearest[some].argmin()]
        chosen.append(x[one])
        nearest = np.maximum(nearest, x @ x[one])
    centroids = np.array(chosen)
    for _ in range(ROUNDS):
        home = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        length = np.sqrt((sums**2).sum(axis=1))
        sums[length < 1e-9] = centroids[length < 1e-9]
        centroids = sums / np.maximum(np.sqrt((sums**2).sum(axis=1, keepdims=True)), 1e-12)
    return np.unique(centroids, axis=0)


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and which lower cells it must also visit."""
    near = x @ centroids.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    reach = np.sqrt(2 - 2 * threshold) + 1e-6
    own = near[np.arange(len(x)), home]
    visits = own[:, None] - near <= reach * apart[home]
    visits &= np.arange(len(centroids))[None, :] < home[:, None]
    return home, visits


def choose(x: np.ndarray, threshold: float) -> np.ndarray:
    """Centroids of as many cells, by doubling, as keep guests few."""
    best = spherical(x, 1)
    k = 4
    while k <= min(MOST_CELLS, len(x) // 20):
        more = spherical(x, k)
        if cells_of(x, more, threshold)[1].sum(axis=1).mean() > MOST_GUESTS:
            break
        best, k = more, 2 * k
    return best


def valid(vector: Column) -> Column:
    """The vector has a direction: numbers throughout, and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _matrix(array: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(array.to_pylist()), np.float64).reshape(len(array), -1)


def _centroids(classes: DataFrame, threshold: float) -> np.ndarray:
    """Centroids for the most frequent number of dimensions, from a sample by hash."""
    sizes = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return np.zeros((0, 0))
    dims, n = sizes["dims"], sizes["n"]
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    place = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = classes.where((F.col("dims") == dims) & (place < min(1.0, rows / n))).select("h1", "h2", "vector").toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    sample = sample.sort_by([("h1", "ascending"), ("h2", "ascending")])
    flat = sample.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return choose(unit(flat.astype(np.float64).reshape(sample.num_rows, -1)), threshold)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Rows link if their cosine, in double precision, is ``threshold`` or more.
    Vectors that are null, empty or zero or hold a null or non-finite component
    link with nothing, and vectors of different lengths do not link; such rows
    stand alone.  ``component_id`` is the least key that links reach;
    ``n_links`` counts the other rows linked directly.  Repeated rows link with
    one another.  A null key is the least only if a component has no other.
    An empty table gives an empty one; other columns are ignored.
    """
    doubles = column(vectors, vector).cast("array<double>")
    rows = vectors.select(column(vectors, key).alias("key"), doubles.alias("vector"))
    rows = rows.withColumn("good", F.coalesce(valid(F.col("vector")), F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    classes = rows.where("good").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("least"), F.first("vector").alias("vector")
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dims", F.size("vector")), "vectors")
    found = stored(_links(classes, threshold), "vector-links")
    count = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    small = classes.select("h1", "h2", "copies", "least", "id").join(count, "id", "left").join(linked, "id", "left")
    small = small.withColumn("root", F.coalesce("root", "id"))
    first = small.groupBy("root").agg(F.min("least").alias("first"))
    links_ = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links")
    known = small.join(first, "root").select("h1", "h2", "first", links_, F.lit(True).alias("good"))
    out = rows.drop("vector").join(known, ["h1", "h2", "good"], "left")
    component = F.when(F.col("good"), F.col("first")).otherwise(F.col("key"))
    return out.select("key", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("key").eqNullSafe(F.col("component_id"))
    )


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """``id, root, links``: verified links of each class, and a class it is connected to."""
    centroids = _centroids(classes, threshold)
    shared = classes.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            table = pa.table(batch)
            for dims in set(table.column("dims").to_pylist()):
                part = table.filter(pc.equal(table.column("dims"), dims))
                flat = part.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                x = unit(flat.reshape(part.num_rows, -1))
                if len(known) and known.shape[1] == dims:
                    home, visits = cells_of(x, known, threshold)
                else:
                    # Vectors of an unusual length are one cell.
                    home, visits = np.full(len(x), -dims), np.zeros((len(x), 0), bool)
                guest, cell = np.nonzero(visits)
                at = np.concatenate([np.arange(len(x)), guest])
                yield pa.record_batch(
                    {
                        "cell": pa.array(np.concatenate([home, cell]), pa.int64()),
                        "guest": pa.array(np.arange(len(at)) >= len(x)),
                        "id": pa.array(part.column("id").to_numpy()[at]),
                        "copies": pa.array(part.column("copies").to_numpy()[at]),
                        "dims": pa.array(np.full(len(at), dims), pa.int64()),
                        "unit": pa.array([x[i].tobytes() for i in at], pa.binary()),
                    }
                )

    celled = classes.select("id", "copies", "dims", "vector").mapInArrow(
        assign, "cell bigint, guest boolean, id bigint, copies bigint, dims bigint, unit binary"
    )
    celled = stored(celled, "cells")
    pieces = lambda guest: F.ceil(
        F.count(F.when(F.col("guest") == guest, 1)) * F.max("dims") * 8 / PART_BYTES
    ).cast("bigint")
    sizes = celled.groupBy("cell").agg(pieces(False).alias("homes"), pieces(True).alias("guests"))
    placed = celled.join(sizes.where("homes > 0"), "cell")
    # Parts of homes come first, then those of guests; a pair of parts has homes in it.
    own = F.when(F.col("guest"), F.col("homes") + F.pmod(F.xxhash64("id"), F.greatest("guests", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("homes"))
    )
    last = F.when(F.col("guest"), F.col("homes") - 1).otherwise(F.col("homes") + F.col("guests") - 1)
    paired = placed.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    paired = paired.select(
        "cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "copies", "unit"
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cell", "low", "high"]):
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            x = _matrix(table.column("unit"))
            n, middle = len(ids), int((table.column("part").to_numpy() == low).sum())
            count, root = np.zeros(n, np.int64), np.arange(n)
            for s in range(0, n if low == high else middle, TILE):
                a = slice(s, min(s + TILE, n if low == high else middle))
                for t in range(s if low == high else middle, n, TILE):
                    product = x[a] @ x[t : t + TILE].T
                    i, j = np.nonzero(product >= threshold - NEAR)
                    close = product[i, j] < threshold + NEAR
                    i, j = i + s, j + t
                    if close.any():
                        good = ~close
                        good[close] = (x[i[close]] * x[j[close]]).sum(axis=1) >= threshold
                        i, j = i[good], j[good]
                    if low == high:
                        i, j = i[i < j], j[i < j]
                    np.add.at(count, i, copies[j])
                    np.add.at(count, j, copies[i])
                    join_all(root, i, j)
            yield pa.record_batch({"id": pa.array(ids), "root": pa.array(ids[root]), "links": pa.array(count)})

    dealt = paired.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "part", "id")
    return dealt.mapInArrow(compare, "id bigint, root bigint, links bigint")


def vector_report(spark, folder: str) -> DataFrame:
    """``op8``: links and component of each embedding."""
    found = near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select(F.col("key").alias("vec_id"), "n_links", "component_id", "kept")


VECTOR_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(l.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
