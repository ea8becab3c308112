"""Filtered neighbour joins through bitmaps of tags.

Records are numbered, and a block of 32,768 numbers has one bitmap per tag.
The bitmaps of a query's required tags are intersected before any vector is
read: blocks without a match are left out of the scan, and in the others each
query is scored against matching records alone.  Vectors are neither copied
per tag nor shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.operators import blocks
from nearmark.operators.knn import BROADCAST_BYTES, Match, _merge, _output, knn, portions
from nearmark.schema import check_metric
from nearmark.session import stored

# Most blocks named in a scan.
NAMED_BLOCKS = 4096


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``bucket`` and ``bit``, their place in the bitmaps; a stored table.

    Numbers follow the order of the rows, so a block's rows lie together in few files.
    """
    no = F.monotonically_increasing_id()
    return stored(records.withColumn("_no", no).select("*", F.bitmap_bucket_number("_no").alias("bucket"), F.bitmap_bit_position("_no").cast("int").alias("bit")).drop("_no"), "numbered")


def bitmap_index(rows: DataFrame) -> DataFrame:
    """``tag, bucket, bits`` of numbered records; a stored table.

    A hot tag is counted into its bitmaps before the shuffle, 4 KB a block.
    """
    tagged = rows.select(F.explode(F.array_distinct("tags")).alias("tag"), "bucket", "bit").where("tag IS NOT NULL")
    return stored(tagged.groupBy("tag", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmaps")


def _needs(queries: DataFrame) -> DataFrame:
    return queries.withColumn("_need", F.array_sort(F.array_distinct("required")))


def matching(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``need, bucket, bits``: which records hold all tags of each set that a query requires.

    Sets that ask for a tag nobody has, and blocks without a match, are absent.
    """
    sets = _needs(queries).select(F.col("_need").alias("need")).where(F.size("need") > 0).distinct()
    asked = sets.select("need", F.explode("need").alias("tag"))
    both = asked.join(index, "tag").groupBy("need", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("tags"))
    return both.where((F.col("tags") == F.size("need")) & (F.bitmap_count("bits") > 0)).drop("tags")


class Marked(blocks.Queries):
    """Queries that know by bitmaps which records they may see."""

    def __init__(self, table: pa.Table, marks: pa.Table, metric: str, by: tuple[str, ...]):
        super().__init__(table, metric, by=by, tags=True)
        self.marks: dict[tuple, dict[int, np.ndarray]] = {}
        for need, bucket, bits in zip(*(marks.column(c).to_pylist() for c in ("need", "bucket", "bits")), strict=True):
            self.marks.setdefault(tuple(sorted(need)), {})[bucket] = np.frombuffer(bits, np.uint8)

    def _seen(self, marks: dict[int, np.ndarray], buckets: np.ndarray, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buckets), bool)
        for bucket in np.unique(buckets).tolist():
            if bucket in marks:
                rows = np.flatnonzero(buckets == bucket)
                at = bits[rows]
                out[rows] = marks[bucket][at >> 3] >> (at & 7).astype(np.uint8) & 1
        return out

    def tiles(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        buckets, bits = table.column("bucket").to_numpy(), table.column("bit").to_numpy()
        seen: dict[tuple, np.ndarray] = {}
        for key, members in blocks._groups(table, self.by).items():
            for sets in self.plan.get(key, {}).values():
                for need, queries in sets.items():
                    if need not in self.marks:
                        continue
                    if need not in seen:
                        seen[need] = self._seen(self.marks[need], buckets, bits)
                    found = members[seen[need][members]]
                    if len(found):
                        yield np.asarray(queries), found


def knn_by_bitmaps(
    rows: DataFrame, index: DataFrame, queries: DataFrame, metric: str, by: tuple[str, ...] = (), budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Same rows as a filtered :func:`nearmark.operators.knn.knn`.

    ``rows`` are numbered records, ``index`` their bitmaps.  Queries and
    intersected bitmaps are broadcast in portions within the budget each; the
    bitmaps of a portion are of some blocks, and the scan reads those.
    """
    check_metric(metric)
    match = Match(by=by, tags=True)
    queries = queries.select(*match.query_columns(queries)).where(F.col("top_k") > 0)
    free = queries.where(F.col("required").isNull() | (F.size("required") == 0))
    bound = queries.where(F.size("required") > 0)
    schema, id_type, query_id_type = _output(rows, queries)
    read = rows.select("id", "values", *by, "bucket", "bit")
    pairs = None
    for asked in portions(bound, "query_id", budget):
        own = rows.sparkSession.createDataFrame(asked, bound.schema)
        marks = stored(matching(index, own), "matching")
        for part in portions(marks, "bucket", budget):
            if not part.num_rows:
                continue
            shared = rows.sparkSession.sparkContext.broadcast((asked, part))
            buckets = part.column("bucket").unique().to_pylist()
            some = read.where(F.col("bucket").isin(buckets)) if len(buckets) <= NAMED_BLOCKS else read

            def task(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ready = Marked(*shared.value, metric, by)
                parts = (blocks.Records(pa.Table.from_batches([b]), metric) for b in batches)
                yield from blocks.nearest(parts, ready, id_type, query_id_type).to_batches()

            more = some.mapInArrow(task, schema)
            pairs = more if pairs is None else pairs.unionByName(more)
    rest = knn(rows, free, metric, Match(by=by), budget=budget)
    return rest if pairs is None else _merge(pairs).unionByName(rest)
