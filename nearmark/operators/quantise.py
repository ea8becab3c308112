"""Product quantisation: candidates from byte codes, then exact distances.

A vector is cut into parts, and each part is replaced by the number of its
nearest entry in a codebook of at most 256 vectors.  The measure of a record is
a sum of one number per part, the query's distance to the entry coded there.  Codes are some bytes a
record where vectors are thousands, so the search reads the codes of the corpus
and the vectors of candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmark.operators import blocks
from nearmark.operators.knn import BROADCAST_BYTES, _collect_within, _dims, knn, rerank
from nearmark.schema import COSINE, DOTPRODUCT, EUCLIDEAN, check_metric
from nearmark.session import stored

PARTS, CODES = 8, 256
# Vectors that codebooks are trained on, and what they may take.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
ITERATIONS = 12


def _prepared(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Directions under cosine; vectors that cannot be measured become NaN."""
    length = blocks.lengths(vectors)
    with np.errstate(all="ignore"):
        return vectors / length[:, None] if metric == COSINE else np.where(np.isfinite(length)[:, None], vectors, np.nan)


def _edges(dims: int, parts: int) -> list[int]:
    return [j * dims // parts for j in range(parts + 1)]


def k_means(x: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Centres of the rows of ``x``, from evenly spaced distinct rows."""
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)]
    for _ in range(iterations):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, blocks.SCORE_CELLS // len(centres))
    found = [(-2 * x[s : s + step] @ centres.T + (centres**2).sum(axis=1)).argmin(axis=1) for s in range(0, len(x), step)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def fit_codebooks(records: DataFrame, metric: str, parts: int = PARTS, codes: int = CODES) -> DataFrame:
    """``part, code, values``: the entries of each part's codebook.

    Trained on at most ``SAMPLE_ROWS`` vectors or 64 MB of them, chosen by the
    hash of their ids; each part in a task of its own.  At most 256 codes.
    """
    check_metric(metric)
    if not 0 < codes <= 256:
        raise ValueError("a code is one byte")
    dims = _dims(records)
    parts = min(parts, dims)
    rows, count = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)), records.count()
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = records.where(place < int(min(1.0, rows / max(count, 1)) * (1 << 30))).limit(rows)
    values, edges = F.col("values").cast("array<double>"), _edges(dims, parts)

    def prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _prepared(blocks.matrix(batch.column(0)), metric)
            x = x[np.isfinite(x).all(axis=1)]
            for j in range(parts):
                own = np.ascontiguousarray(x[:, edges[j] : edges[j + 1]])
                flat = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), own.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch({"part": pa.array(np.full(len(own), j), pa.int32()), "values": flat})

    def train(table: pa.Table) -> pa.Table:
        centres = k_means(blocks.matrix(table.column("values")), codes)
        return pa.table(
            {
                "part": pa.array(np.full(len(centres), table.column("part")[0].as_py()), pa.int32()),
                "code": pa.array(np.arange(len(centres)), pa.int32()),
                "values": pa.array(centres.tolist(), pa.list_(pa.float64())),
            }
        )

    cut = some.select(values.alias("values")).mapInArrow(prepare, "part int, values array<double>")
    # By number, so that adaptive execution does not merge the few rows of many parts into one task.
    cut = cut.repartition(parts, "part")
    return stored(cut.groupBy("part").applyInArrow(train, "part int, code int, values array<double>"), "codebooks")


def _books(codebooks: DataFrame) -> list[np.ndarray]:
    """The codebooks, as many numbers in all as 256 vectors have."""
    table = codebooks.toArrow().sort_by([("part", "ascending"), ("code", "ascending")])
    parts = table.column("part").to_numpy()
    return [blocks.matrix(table.filter(pa.array(parts == j)).column("values")) for j in np.unique(parts)]


def encode(records: DataFrame, codebooks: DataFrame, metric: str) -> DataFrame:
    """``records`` with their ``code`` instead of their vector; without a shuffle.

    The code of a vector that cannot be measured (not finite, or zero under
    cosine) is null.
    """
    shared = records.sparkSession.sparkContext.broadcast(_books(codebooks))
    rest = [c for c in records.columns if c != "values"]
    schema = T.StructType([*records.select(*rest).schema.fields, T.StructField("code", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("values")
            x = _prepared(blocks.matrix(batch.column(at)), metric)
            good = np.isfinite(x).all(axis=1) if len(x) else np.empty(0, bool)
            edges = np.cumsum([0, *(b.shape[1] for b in books)])
            x = np.where(good[:, None], x, 0.0)
            code = np.stack([_nearest(x[:, edges[j] : edges[j + 1]], b) for j, b in enumerate(books)], axis=1).astype(np.uint8)
            value = pa.array([c.tobytes() if g else None for c, g in zip(code, good, strict=True)], pa.binary())
            yield batch.drop_columns(["values"]).append_column("code", value)

    return records.withColumn("values", F.col("values").cast("array<double>")).mapInArrow(run, schema)


def decode(codes: DataFrame, codebooks: DataFrame) -> DataFrame:
    """``id, values``: the entries that each record's code names; NaN where the code is null."""
    shared = codes.sparkSession.sparkContext.broadcast(_books(codebooks))
    schema = T.StructType([codes.schema["id"], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        blank = b"\0" * len(books)
        for batch in batches:
            rows = np.frombuffer(b"".join(blank if c is None else c for c in batch.column(1).to_pylist()), np.uint8).reshape(-1, len(books))
            x = np.concatenate([book[rows[:, j]] for j, book in enumerate(books)], axis=1)
            x[batch.column(1).is_null().to_numpy(zero_copy_only=False)] = np.nan
            yield pa.record_batch([batch.column(0), _vectors(x)], ["id", "values"])

    return codes.select("id", "code").mapInArrow(run, schema)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), max(1, x.shape[1])).cast(pa.list_(pa.float64()))


def _asked(queries: DataFrame, metric: str, times: int) -> DataFrame:
    """Queries as codes measure them, with ``times`` as large a ``top_k``."""
    want = F.least(F.col("top_k").cast("bigint") * times, F.lit(2**31 - 1)).cast("int")
    asked = queries.select("query_id", F.col("values").cast("array<double>").alias("values"), want.alias("top_k")).where("top_k > 0")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), _vectors(_prepared(blocks.matrix(batch.column(1)), metric)), batch.column(2)], batch.schema.names)

    return asked.mapInArrow(run, asked.schema)


def candidates(codes: DataFrame, codebooks: DataFrame, queries: DataFrame, metric: str, times: int, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``query_id, id``: the ``times * top_k`` records of each query with the least measure by code.

    The measure adds up one number per part, the query's distance to the entry
    that the code names; that is its distance to all these entries as one
    vector.  So codes are decoded where they are read, and block by block meet
    the queries like the records of a join, within its bounds.  Directions are
    compared by distance too: codes of unit vectors are not of unit length.
    """
    by = DOTPRODUCT if metric == DOTPRODUCT else EUCLIDEAN
    asked = stored(_asked(queries, metric, times), "asked-by-code")
    return knn(decode(codes, codebooks), asked, by, budget=budget).select("query_id", "id")


def pq_search(records: DataFrame, codes: DataFrame, codebooks: DataFrame, queries: DataFrame, metric: str, times: int = 4, budget: int = BROADCAST_BYTES) -> DataFrame:
    """The nearest of each query's ``times * top_k`` candidates, by exact distance.

    With ``times * top_k`` of all records the rows are those of an exact join.
    Of the vectors only those of candidates leave their place.  A query that
    wants as many candidates as there are codes has them all whatever their
    order, so these are not listed pair by pair: its block of queries measures
    the coded records as they pass.
    """
    coded = codes.count()
    every = F.col("top_k").cast("bigint") * times >= coded
    whole = queries.where(every)
    if not whole.isEmpty():
        known = records.join(codes.select("id"), "id", "left_semi")
        found = knn(known, whole, metric, budget=budget)
        rest = queries.where(~every)
        return found if rest.isEmpty() else found.unionByName(pq_search(records, codes, codebooks, rest, metric, times, budget))
    some = stored(candidates(codes, codebooks, queries, metric, times, budget), "candidates")
    ids = some.select("id").distinct()
    # Broadcast if measured small, so that the corpus is not shuffled to meet its candidates.
    side = _collect_within(ids, budget, forced=False)
    if side is not None:
        ids = F.broadcast(records.sparkSession.createDataFrame(side, ids.schema))
    return rerank(some, records.join(ids, "id", "left_semi"), queries, metric)
