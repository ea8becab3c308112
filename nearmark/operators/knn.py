"""Exact nearest-neighbour joins.

``records``: ``id, values`` and, where the join uses them, the ``by`` columns,
``tags``, ``step``, ``valid_from``/``valid_to``.
``queries``: ``query_id, values, top_k`` and, in the same order, the ``by``
columns, ``required``, ``step``, ``at``.
Result: ``query_id, rank, id, distance``, nearest first, ties by id.

Three physical shapes give the same rows:

* ``queries``: the query side fits the memory budget.  It is broadcast, the
  records are streamed once and never shuffled; each task emits at most
  ``top_k`` pairs per query and only those pairs are shuffled.
* ``records``: the record side fits the budget instead (centroids, small
  corpora).  Every query's answer is complete in its task; nothing is shuffled.
* ``grid``: neither fits.  Queries are cut into blocks of bounded size by a hash
  of their ids, records into long stripes, and each block meets each stripe in
  one task.  The task holds the block and its answer; the stripe streams past.
  A key of ``by`` that holds many rows is cut into many blocks and stripes.
  Where answers are so long, or queries so many, that blocks would copy the
  records far more often, a cell holds its stripe instead and the queries
  stream past: records are copied a few times, whatever the answers take.
  "As of", blocks are ranges of time as well, and a record goes to the ranges
  that it lives in.

``auto`` takes the first shape that fits, by counting rows and not by guessing.
A side that is broadcast is counted with what a task makes of it: copies of its
vectors, and the answer of each query, which grows with ``top_k``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearmark.functions.distance import distance, literal_vector
from nearmark.operators import blocks
from nearmark.operators.ranges import ranges_of
from nearmark.operators.skew import all_parts, cuts, salted_join, with_cuts
from nearmark.schema import NEIGHBOUR_COLUMNS, check_metric
from nearmark.session import stored

# Bytes one task may hold of a side, and of one grid block with its answer.
BROADCAST_BYTES = 128 << 20
BLOCK_BYTES = 64 << 20
# What a pair of an answer takes while it is held and sorted.
PAIR_BYTES = 96
# Pairs of the answers that a task works on at once where records are broadcast.
SLICE_PAIRS = 250_000
# Records one task may hold where queries stream past them, and cells there are then at least.
HELD_BYTES, HELD_CELLS = 384 << 20, 32
# Records are held if blocks of queries would move more than so many times as much.
HELD_GAIN = 1.5
# Stripes are so many blocks long.  Every block copies the other side once more,
# so a side is cut into more than MOST_CUTS only by the need of BLOCK_BYTES.
STRIPE_BLOCKS, MOST_CUTS = 2, 16


@dataclass(frozen=True)
class Match:
    """Which records a query may see.

    ``by``: columns equal on both sides; ``tags``: the record's ``tags`` hold all
    of the query's ``required``; ``step``: record ``step`` <= query ``step``;
    ``as_of``: ``valid_from <= at < valid_to``; ``lists``: the record's
    ``list_id`` is one of the query's ``lists``, an array without repeats; it may
    be such an array itself, if no record shares two lists with a query.
    ``nested``: lists are parts of the keys of ``by``, so rows that are sent meet
    by these alone and come once for all their lists.
    """

    by: tuple[str, ...] = ()
    tags: bool = False
    step: bool = False
    as_of: bool = False
    lists: bool = False
    nested: bool = False

    def record_columns(self) -> list[str]:
        cols = ["id", "values", *self.by]
        cols += ["tags"] if self.tags else []
        cols += ["step"] if self.step else []
        cols += ["list_id"] if self.lists else []
        return cols + (["valid_from", "valid_to"] if self.as_of else [])

    def query_columns(self, queries: DataFrame) -> list[str]:
        cols = ["query_id", "values", "top_k", *self.by]
        cols += ["required"] if self.tags else []
        cols += ["step"] if self.step else []
        cols += ["at"] if self.as_of else []
        cols += ["lists"] if self.lists else []
        return cols + (["bound"] if "bound" in queries.columns else [])

    def options(self) -> dict:
        return {"by": self.by, "tags": self.tags, "step": self.step, "as_of": self.as_of, "lists": self.lists}


def knn(
    records: DataFrame,
    queries: DataFrame,
    metric: str,
    match: Match = Match(),
    *,
    strategy: str = "auto",
    budget: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    bound_from: DataFrame | None = None,
) -> DataFrame:
    """The ``top_k`` nearest records of every query.

    ``bound_from`` may name any part of ``records``, such as a few of its files.
    The k-th distance found there is an upper limit for the whole corpus, so
    later tasks emit only pairs below it; the answer is unchanged, and the one
    shuffle shrinks from ``tasks * queries * k`` rows to little more than the
    answer.
    """
    check_metric(metric)
    if bound_from is not None:
        # The bounds are found once, however often the queries are looked at.
        queries = _with_bound(bound_from, queries, metric, match, strategy, budget)
    r = records.select(*match.record_columns())
    q = queries.select(*match.query_columns(queries)).where(F.col("top_k") > 0)
    if match.as_of:
        # No moment, or no beginning, matches nothing.
        r, q = r.where(F.col("valid_from").isNotNull()), q.where(F.col("at").isNotNull())
    if strategy in ("auto", "queries"):
        side = _collect_within(q, budget, forced=strategy == "queries")
        if side is not None:
            return _merge(_stream_records(r, q, side, metric, match))
    if strategy in ("auto", "records"):
        side = _collect_within(r, budget, forced=strategy == "records", scan=True)
        if side is not None:
            found = _stream_queries(r, q, side, metric, match)
            # With ``by`` a query may come in several rows, one per key it probes.
            return _merge(found) if match.by else found
    if match.lists and not match.nested:
        # Each list is a key of its own here, and a query goes to those it names.
        q = q.withColumn("list_id", F.explode("lists")).drop("lists")
        if isinstance(r.schema["list_id"].dataType, T.ArrayType):
            r = r.withColumn("list_id", F.explode("list_id"))
        match = replace(match, by=("list_id", *match.by), lists=False)
    return _grid(r, q, metric, match, max(1, block_bytes))


def _dims(vectors: DataFrame) -> int:
    first = vectors.select(F.size("values").alias("d")).first()
    return max(1, first["d"]) if first else 1


def _bytes(df: DataFrame) -> Column:
    """About how much memory a row takes, strings and lists included.

    Vectors are held three times, as they came and as two matrices, and a query
    holds its answer.
    """
    size = F.lit(64).cast("bigint")
    if "values" in df.columns:
        size = size + F.greatest(F.coalesce(16 * F.size("values"), F.lit(0)), F.lit(0))
    if "top_k" in df.columns:
        size = size + F.greatest(F.coalesce(F.col("top_k"), F.lit(0)), F.lit(0)).cast("bigint") * PAIR_BYTES
    for field in df.schema.fields:
        value, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.StringType):
            more = F.octet_length(value) + 64
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            more = F.octet_length(F.concat_ws("", value)) + 64 * F.size(value)
        elif isinstance(kind, T.ArrayType):
            more = 8 * F.size(value)
        elif isinstance(kind, (T.StructType, T.MapType)):
            more = 4 * F.octet_length(F.to_json(value)) + 256
        else:
            more = F.lit(8)
        size = size + F.greatest(F.coalesce(more, F.lit(0)), F.lit(0))
    return size


def _read_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that ``df`` is made from, as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


def _collect_within(df: DataFrame, budget: int, forced: bool, scan: bool = False) -> pa.Table | None:
    """The rows of ``df`` if all they hold stays within ``budget`` bytes.

    What is read from a few small files is taken at once and measured here.
    Other rows are measured where they are and come to the driver only if they
    fit; with ``scan`` they are the corpus itself, which is not read through
    just to learn that it does not fit.
    """
    read = _read_bytes(df)
    if read <= budget // 16:
        table = df.toArrow()
        if _table_bytes(table) <= budget:
            return table
    elif forced or not scan or read <= 64 * budget:
        # Lists of tiles, say, need not be made to learn that the rest is too large.
        slim = df.drop("list_id", "lists")
        for part in (slim, df) if len(slim.columns) < len(df.columns) else (df,):
            held = part.agg(F.sum(_bytes(part).cast("bigint"))).first()[0] or 0
            if held > budget:
                break
        else:
            return df.toArrow()
    if forced:
        raise ValueError(f"the side to broadcast takes over {budget} bytes; use strategy='grid'")
    return None


def _table_bytes(table: pa.Table) -> int:
    """The same of rows that are here."""
    held = table.nbytes
    if "values" in table.column_names:
        held += 2 * table.column("values").nbytes
    if "top_k" in table.column_names:
        held += PAIR_BYTES * max(0, pc.sum(table.column("top_k").cast(pa.int64())).as_py() or 0)
    return held


def portions(df: DataFrame, key: str, budget: int) -> Iterator[pa.Table]:
    """All rows of ``df`` in tables that fit the budget each, rows of one key together."""
    parts = 1
    while parts:
        done = 0
        for p in range(parts):
            part = df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)
            table = _collect_within(part, budget, forced=False)
            if table is None and not done:
                break
            if table is None:
                raise ValueError(f"rows of one {key} take over {budget} bytes")
            done += 1
            yield table
        # Too large a first part shows that more parts are needed.
        parts = 0 if done else 4 * parts


def _output(records: DataFrame, queries: DataFrame) -> tuple[T.StructType, pa.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    query_id, rec_id = queries.schema["query_id"].dataType, records.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("query_id", query_id),
            T.StructField("rank", T.IntegerType()),
            T.StructField("id", rec_id),
            T.StructField("distance", T.DoubleType()),
            T.StructField("top_k", T.IntegerType()),
        ]
    )
    return schema, to_arrow_type(rec_id), to_arrow_type(query_id)


def _stream_records(r, q, side: pa.Table, metric: str, match: Match) -> DataFrame:
    schema, id_type, query_id_type = _output(r, q)
    shared = r.sparkSession.sparkContext.broadcast(side)
    options = match.options()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = blocks.Queries(shared.value, metric, **options)
        parts = (blocks.Records(pa.Table.from_batches([b]), metric, **options) for b in batches)
        yield from blocks.nearest(parts, queries, id_type, query_id_type).to_batches()

    return r.mapInArrow(task, schema)


def _stream_queries(r, q, side: pa.Table, metric: str, match: Match) -> DataFrame:
    schema, id_type, query_id_type = _output(r, q)
    if not match.by:
        schema = T.StructType([schema[c] for c in NEIGHBOUR_COLUMNS])
    names = schema.names
    shared = r.sparkSession.sparkContext.broadcast(side)
    options = match.options()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = blocks.Held(metric, id_type, query_id_type, **options)
        held.add(shared.value)
        for batch in batches:
            for part in _slices(batch, held.rows):
                for found in held.answer(pa.Table.from_batches([part])):
                    yield found.select(names)

    return q.mapInArrow(task, schema)


def _slices(batch: pa.RecordBatch | pa.Table, records: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Queries whose answers hold about ``SLICE_PAIRS`` pairs together."""
    k = np.minimum(batch.column("top_k").to_numpy(zero_copy_only=False).astype(np.int64), records)
    part = (np.cumsum(k) - k) // SLICE_PAIRS
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield batch.slice(a, b - a)


def _by_time(r: DataFrame, q: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_t``, a range of time; a record comes once for each range it lives in."""
    held = q.agg(F.sum(_block_bytes()).alias("held")).first()["held"] or 0
    # A record goes to the few ranges that it lives in, so there are always enough for many tasks.
    ranges = max(MOST_CUTS, -(-held // max(block_bytes, BLOCK_BYTES)))
    cut = ranges_of(q, "at", int(ranges))
    r = r.where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
    first, last = replace(cut, key="valid_from").of(r), replace(cut, key="valid_to").of(r)
    return r.withColumn("_t", F.explode(F.sequence(first, last))), q.withColumn("_t", cut.of(q))


def _block_bytes(most: int | None = None) -> Column:
    """What a query takes in a block: its vector and its answer."""
    k = F.col("top_k").cast("bigint")
    return 8 * F.size("values") + PAIR_BYTES * (k if most is None else F.least(k, F.lit(most)))


def _held_cuts(r: DataFrame, q: DataFrame, records: int, block_bytes: int, held_bytes: int = HELD_BYTES) -> tuple[int, int] | None:
    """Stripes of records that tasks hold, and groups of queries, if blocks of queries would move far more."""
    size = F.sum(8 * F.size("values")).cast("double")
    own = r.agg(size.alias("v")).first()["v"] or 0.0
    k = F.least(F.col("top_k").cast("bigint"), F.lit(records))
    asked = q.agg(size.alias("v"), F.sum(_block_bytes(records)).cast("double").alias("held"), F.sum(k).cast("double").alias("pairs")).first()
    vectors, pairs = asked["v"] or 0.0, 40 * (asked["pairs"] or 0.0)
    groups = -(-(asked["held"] or 0.0) // max(block_bytes, BLOCK_BYTES))
    if groups <= MOST_CUTS:
        return None
    stripes = max(1, int(-(-own // held_bytes)))
    fewer = max(MOST_CUTS, HELD_CELLS // stripes)
    slim = max(1.0, -(-own // (STRIPE_BLOCKS * max(block_bytes, BLOCK_BYTES))))
    by_blocks = own * groups + (vectors + pairs) * slim
    by_stripes = own * fewer + vectors * stripes + (pairs if stripes > 1 else 0) * stripes
    return (stripes, fewer) if by_blocks > HELD_GAIN * by_stripes else None


def _held_grid(r, q, metric: str, match: Match, stripes: int, groups: int) -> DataFrame:
    """A task holds its stripe of the records; its group of the queries streams past."""
    schema, id_type, query_id_type = _output(r, q)
    # A query that has met all records in one task has its answer whole and in order.
    if stripes == 1:
        schema = T.StructType([schema[c] for c in NEIGHBOUR_COLUMNS])
    names = schema.names
    record_columns, query_columns = r.columns, q.columns
    key = ["_r", "_q"]
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = [
        side.select(*[F.col(c).alias(c) for c in columns], F.lit(no).alias("_side"), row.alias("_r"), column.alias("_q"))
        for no, side, columns, row, column in (
            (0, r.withColumn("_copy", copies(groups)), record_columns, part("id", stripes), F.col("_copy")),
            (1, q.withColumn("_copy", copies(stripes)), query_columns, F.col("_copy"), part("query_id", groups)),
        )
    ]
    cells = sides[0].unionByName(sides[1], allowMissingColumns=True)
    # Rows that see about the same records come together.
    within = [*key, "_side", *(["step"] if match.step else [])]
    cells = cells.repartition(4 * stripes * groups, *key).sortWithinPartitions(*within)
    options = match.options()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for fresh, is_query, rows in _pieces(batches, key):
            if fresh:
                held = blocks.Held(metric, id_type, query_id_type, **options)
            if not is_query:
                held.add(rows.select(record_columns))
                continue
            for some in _slices(rows, held.rows):
                for found in held.answer(some.select(query_columns)):
                    yield found.select(names)

    found = cells.mapInArrow(task, schema)
    return found if stripes == 1 else _merge(found)


def _grid(r, q, metric: str, match: Match, block_bytes: int) -> DataFrame:
    """The neighbours, by cells of both sides."""
    records = r.count()
    if not match.by and not match.as_of:
        held = _held_cuts(r, q, records, block_bytes)
        if held:
            return _held_grid(r, q, metric, match, *held)
    return _merge(_block_grid(r, q, metric, match, block_bytes, records))


def _block_grid(r, q, metric: str, match: Match, block_bytes: int, records: int) -> DataFrame:
    schema, id_type, query_id_type = _output(r, q)
    by, record_columns, query_columns = list(match.by), r.columns, q.columns
    # A null key matches nothing, as in the other shapes.
    r, q = (r.dropna(subset=by), q.dropna(subset=by)) if by else (r, q)
    if match.as_of:
        r, q = _by_time(r, q, block_bytes)
        by = [*by, "_t"]
    # An answer is no longer than the records are many.
    block = {"most": MOST_CUTS, "least": max(block_bytes, BLOCK_BYTES)}
    stripe = {"most": MOST_CUTS, "least": STRIPE_BLOCKS * block["least"]}
    r_cuts = cuts(r, by, STRIPE_BLOCKS * block_bytes, "_rcuts", 8 * F.size("values"), **stripe)
    q_cuts = cuts(q, by, block_bytes, "_qcuts", _block_bytes(records), **block)
    left = with_cuts(with_cuts(r, r_cuts, by, "_rcuts"), q_cuts, by, "_qcuts")
    right = with_cuts(with_cuts(q, r_cuts, by, "_rcuts"), q_cuts, by, "_qcuts")
    # A record goes to one row of its key's grid, a query to one column.
    left = left.withColumn("_r", F.pmod(F.xxhash64("id"), F.col("_rcuts")))
    left = left.withColumn("_q", all_parts(F.col("_qcuts")))
    right = right.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.col("_qcuts")))
    right = right.withColumn("_r", all_parts(F.col("_rcuts")))
    key = [*by, "_r", "_q"]
    # Both sides in one table, in each cell the queries first.  The sides may come
    # from one table, so they are told apart by new columns.
    sides = [
        side.select(*[F.col(c).alias(c) for c in [*key, *(c for c in columns if c not in key)]], F.lit(no).alias("_side"))
        for no, side, columns in ((0, right, query_columns), (1, left, record_columns))
    ]
    cells = sides[0].unionByName(sides[1], allowMissingColumns=True)
    # Records that hold at about the same time come together, in the order of the queries' moments.
    cells = cells.repartition(*key).sortWithinPartitions(*key, "_side", *(["valid_from"] if match.as_of else []))
    options = replace(match, by=()).options()
    seen = [c for c in record_columns if c not in match.by]
    asked = [c for c in query_columns if c not in match.by]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[pa.Table] = []
        best = None
        for fresh, is_record, part in _pieces(batches, key):
            if fresh:
                if best is not None:
                    yield from best.result(id_type, query_id_type).to_batches()
                queries, best = [], None
            if not is_record:
                queries.append(part.select(asked))
                continue
            if best is None and queries:
                best = blocks.Best(blocks.Queries(pa.concat_tables(queries), metric, **options))
                queries = []
            if best is not None:
                best.add_block(blocks.Records(part.select(seen), metric, **options))
        if best is not None:
            yield from best.result(id_type, query_id_type).to_batches()

    return cells.mapInArrow(task, schema)


def _pieces(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[bool, bool, pa.Table]]:
    """Sorted rows cut where the cell or the side changes: is the cell new, are they records, the rows."""
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        at = [batch.column(c) for c in (*key, "_side")]
        change = np.ones(batch.num_rows, bool)
        if batch.num_rows:
            change[1:] = False
        for c in at:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(0, len(c) - 1))).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            cell = tuple(c[a].as_py() for c in at[:-1])
            yield cell != last, at[-1][a].as_py() == 1, rows.slice(a, b - a)
            last = cell


def _merge(pairs: DataFrame) -> DataFrame:
    """Rank the pairs kept by the tasks; the only shuffle, and without vectors."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return (
        pairs.drop("rank")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("top_k"))
        .select(*NEIGHBOUR_COLUMNS)
    )


def _with_bound(part, queries, metric, match, strategy, budget) -> DataFrame:
    found = knn(part, queries, metric, match, strategy=strategy, budget=budget)
    full = (
        found.join(queries.select("query_id", "top_k").distinct(), "query_id")
        .where(F.col("rank") == F.col("top_k"))
        .select("query_id", F.col("distance").alias("bound"))
    )
    return stored(queries.drop("bound").join(full, "query_id", "left"), "bounds")


def search(
    records: DataFrame,
    values: list[float],
    top_k: int,
    metric: str,
    predicate: Column | None = None,
) -> DataFrame:
    """One literal query: filter, order by distance and id, keep ``top_k``."""
    seen = records if predicate is None else records.where(predicate)
    scored = seen.select("id", distance(metric, "values", literal_vector(values)).alias("distance"))
    return scored.orderBy("distance", "id").limit(top_k)


def neighbour_lists(neighbours: DataFrame, name: str = "neighbors") -> DataFrame:
    """One row per query with its ids, best first; a list is as long as its k."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return neighbours.groupBy("query_id").agg(F.transform(ordered, lambda x: x["id"]).alias(name))


def attach_neighbours(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Queries with recomputed ground truth; a query without matches gets ``[]``."""
    lists = neighbour_lists(neighbours)
    id_type = neighbours.schema["id"].dataType.simpleString()
    return (
        queries.drop("neighbors")
        .join(lists, "query_id", "left")
        .withColumn("neighbors", F.coalesce("neighbors", F.array().cast(f"array<{id_type}>")))
    )


def rerank(
    candidates: DataFrame, records: DataFrame, queries: DataFrame, metric: str
) -> DataFrame:
    """Re-measure candidate pairs under ``metric`` and cut them to ``top_k``.

    ``candidates`` is an over-fetched answer (``query_id, id``), say of twice
    ``top_k`` pairs by a cheaper measure.
    """
    wanted = candidates.select("query_id", "id")
    # Only records that are a candidate of some query are moved, and a record
    # that is one of very many queries is copied to several tasks.
    measured = records.select("id", F.col("values").alias("_r")).join(wanted.select("id").distinct(), "id", "left_semi")
    asked = wanted.join(queries.select("query_id", "top_k", F.col("values").alias("_q")), "query_id")
    pairs = salted_join(asked, measured, "id", "query_id").select(
        "query_id", "id", "top_k", distance(metric, "_r", "_q").alias("distance")
    )
    return _merge(pairs)
