"""Global order at scale: cutting a table into ranges of an ordering key.

A window without partitions sorts the whole table in one task, and a window
per key sorts a hot key in one task.  Both are avoided by cutting the order
into ranges of about equal row count, working inside each range, and carrying
one small summary row per range (and key) from range to range.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearmark.functions.scalars import chunk_of


# Ranges told apart by comparisons in generated code; more are searched in one array.
RANGES_IN_CODE = 128


@dataclass(frozen=True)
class Ranges:
    """Lower ends of the ranges of ``key`` and the rows before each of them."""

    key: str
    starts: tuple[Any, ...]
    before: tuple[int, ...]
    total: int

    def of(self, df: DataFrame) -> Column:
        """0-based range of a row, by value alone."""
        kind, key = df.schema[self.key].dataType, F.col(self.key)
        n = len(self.starts)
        if n > RANGES_IN_CODE:
            held = F.array(*[F.lit(s).cast(kind) for s in self.starts])
            steps = F.array(*[F.lit(1 << k) for k in reversed(range((n - 1).bit_length()))])

            def step(at: Column, more: Column) -> Column:
                below = (at + more >= F.lit(n)) | (key < F.get(held, at + more))
                return F.when(below, at).otherwise(at + more)

            return F.aggregate(steps, F.lit(0), step)

        def search(low: int, high: int) -> Column:
            # A tree of comparisons, as deep as the logarithm of the ranges.
            if high - low <= 1:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(key < F.lit(self.starts[middle]).cast(kind), search(low, middle)).otherwise(search(middle, high))

        return search(0, n)

    def offset(self, range_column: Column) -> Column:
        """Rows before a range."""
        return F.element_at(F.array(*[F.lit(n).cast("bigint") for n in self.before or (0,)]), range_column + 1)


def ranges_of(df: DataFrame, key: str, parts: int | None = None) -> Ranges:
    """Cut ``df`` into ranges of ``key``, ``parts`` of them if given.

    Only the key column is read and shuffled.  Spark's range partitioning keeps
    equal keys together, and adaptive execution merges neighbouring ranges of
    little data, so each partition's least key and row count describe a value
    range.  One such pair per partition comes back to the driver.
    """
    keyed = df.select(key)
    ranged = keyed.repartitionByRange(parts, key) if parts else keyed.repartitionByRange(key)
    rows = (
        ranged.groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(key).alias("start"), F.count(F.lit(1)).alias("n"))
        .orderBy("part")
        .collect()
    )
    before, seen = [], 0
    for row in rows:
        before.append(seen)
        seen += row["n"]
    return Ranges(key, tuple(r["start"] for r in rows), tuple(before), seen)


def with_row_index(
    df: DataFrame, key: str, name: str = "row_index", ranges: Ranges | None = None
) -> DataFrame:
    """1-based position of each row in the order of a unique ``key``."""
    cut = ranges or ranges_of(df, key)
    inside = Window.partitionBy("_range").orderBy(key)
    return (
        df.withColumn("_range", cut.of(df))
        .withColumn(name, F.row_number().over(inside) + cut.offset(F.col("_range")))
        .drop("_range")
    )


def with_chunk(df: DataFrame, key: str, chunks: int, name: str = "chunk") -> DataFrame:
    """1-based chunk of each row when the order of ``key`` is split evenly.

    Chunks differ by at most one row, larger ones first.  Only the key is
    sorted, to find the first key of each chunk; the rows themselves, vectors
    and all, are labelled where they are and never shuffled.
    """
    cut = ranges_of(df, key)
    position = with_row_index(df.select(key), key, "_at", cut)
    chunk = chunk_of(F.col("_at"), cut.total, chunks)
    before = chunk_of(F.col("_at") - 1, cut.total, chunks)
    first = position.where((F.col("_at") == 1) | (chunk != before)).select(key, "_at")
    # At most one row per chunk comes back.
    starts = tuple(r[key] for r in sorted(first.collect(), key=lambda r: r["_at"]))
    return df.withColumn(name, (Ranges(key, starts, (), cut.total).of(df) + 1).cast("int"))


def lag_within(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, cut: Ranges | None = None
) -> DataFrame:
    """Previous ``value`` per key in the order of ``order``; hot keys are split."""
    return _neighbour(df, keys, order, value, name, cut, backwards=True)


def lead_within(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, cut: Ranges | None = None
) -> DataFrame:
    """Next ``value`` per key in the order of ``order``; hot keys are split."""
    return _neighbour(df, keys, order, value, name, cut, backwards=False)


def _neighbour(df, keys, order, value, name, cut, backwards: bool) -> DataFrame:
    cut = cut or ranges_of(df, order)
    ranged = df.withColumn("_range", cut.of(df))
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    step = F.lag if backwards else F.lead
    pick = F.max_by if backwards else F.min_by
    # The row next to a range's edge lies in the nearest range that has the key.
    edge = ranged.groupBy(*keys, "_range").agg(pick(F.struct(F.col(value).alias("v")), order).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy("_range")
    edge = edge.withColumn("_edge", step("_edge").over(across))
    local = ranged.withColumn("_near", step(F.struct(F.col(value).alias("v"))).over(inside))
    joined = local.join(edge, [*keys, "_range"], "left")
    return joined.withColumn(name, F.coalesce("_near", "_edge")["v"]).drop("_near", "_edge", "_range")


def running_since_reset(
    df: DataFrame, keys: list[str], order: str, count: Column, reset: Column, name: str, cut: Ranges | None = None
) -> DataFrame:
    """Per key, how many ``count`` rows came since the last ``reset`` row.

    The row itself counts; a reset row starts at zero.  Hot keys are split.
    """
    cut = cut or ranges_of(df, order)
    flagged = (
        df.withColumn("_range", cut.of(df))
        .withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("int"))
        .withColumn("_count", (F.coalesce(count, F.lit(False)) & (F.col("_reset") == 0)).cast("bigint"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    # Rows before the first reset of their range go on with the carried count.
    epoch = F.sum("_reset").over(inside)
    local = flagged.withColumn("_epoch", epoch)
    within = Window.partitionBy(*keys, "_range", "_epoch").orderBy(order)
    local = local.withColumn("_sum", F.sum("_count").over(within))
    ends = local.groupBy(*keys, "_range").agg(
        F.max_by("_sum", order).alias("_left"), (F.max("_epoch") > 0).cast("int").alias("_had")
    )
    across = Window.partitionBy(*keys).orderBy("_range")
    ends = ends.withColumn("_era", F.sum("_had").over(across))
    in_era = Window.partitionBy(*keys, "_era").orderBy("_range")
    ends = ends.withColumn("_upto", F.sum("_left").over(in_era))
    ends = ends.withColumn("_carry", F.coalesce(F.lag("_upto").over(across), F.lit(0)))
    joined = local.join(ends.select(*keys, "_range", "_carry"), [*keys, "_range"], "left")
    value = F.col("_sum") + F.when(F.col("_epoch") == 0, F.col("_carry")).otherwise(F.lit(0))
    return joined.withColumn(name, value).drop(
        "_range", "_reset", "_count", "_epoch", "_sum", "_carry"
    )
