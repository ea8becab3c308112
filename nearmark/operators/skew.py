"""Splitting hot keys, so that no task holds a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(df: DataFrame, keys: list[str], rows: int, name: str, weight: Column | None = None, most: int = 0, least: int = 0) -> DataFrame:
    """Parts per key, for the keys that need more than one part of ``rows`` rows.

    With ``weight`` a part holds rows of that weight together.  Beyond ``most``
    parts a key is cut only as far as parts of the larger weight ``least`` ask.
    A key is listed only if it has more than ``rows`` rows, so the list is no
    longer than the row count over ``rows``, and it is broadcast.
    """
    count = F.count(F.lit(1))
    total = count if weight is None else F.sum(weight)
    parts = F.ceil(total / F.lit(rows)).cast("bigint")
    if most:
        parts = F.least(parts, F.greatest(F.lit(most), F.ceil(total / F.lit(least)).cast("bigint")))
    return df.groupBy(*keys).agg(F.least(parts, count).alias(name)).where(F.col(name) > 1)


def with_cuts(df: DataFrame, listed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Each row with the number of parts of its key; 1 for keys not listed."""
    listed = F.broadcast(listed)
    if keys:
        joined = df.join(listed, keys, "left")
    else:
        # One row at most: every row of the side shares one number of parts.
        one = F.lit(1)
        joined = df.withColumn("_all", one).join(listed.withColumn("_all", one), "_all", "left").drop("_all")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(1).cast("bigint")))


def all_parts(count: Column) -> Column:
    """0 .. count-1, to copy a row to every part."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))


def salted_join(many: DataFrame, one: DataFrame, on: str, spread: str, rows: int = 1_000_000, how: str = "inner") -> DataFrame:
    """Join where a value of ``on`` may hold much of ``many``.

    ``one`` has one row per value.  Hot values of ``many`` are spread over parts
    by the hash of ``spread``, and only their rows of ``one`` are copied.
    """
    listed = cuts(many, [on], rows, "_parts")
    left = with_cuts(many, listed, [on], "_parts")
    left = left.withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts"))).drop("_parts")
    right = with_cuts(one, listed, [on], "_parts").withColumn("_part", all_parts(F.col("_parts"))).drop("_parts")
    return left.join(right, [on, "_part"], how).drop("_part")
