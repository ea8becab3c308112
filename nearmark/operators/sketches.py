"""Percentiles of metrics of any range, from sketches that several runs can share.

Histograms of thousandths are exact, but hold a row per value: for metrics whose
values spread over many magnitudes they grow as the log does.  A KLL sketch has
a size of its own, whatever it has seen, and sketches of several runs are merged
to one of all.  The log is shuffled as one partial sketch a task and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("request_type", "metric")
SIZE = 2048


def rank_error(size: int = SIZE) -> float:
    """Share of all rows by which a percentile's rank is off at most, 99 times of 100."""
    return 2.296 / size**0.9723


def sketch(values: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "value", size: int = SIZE) -> DataFrame:
    """``keys, sketch, n, low, high``; nulls and NaN are not counted, nor keys without another value."""
    number = F.col(value).cast("double")
    return (
        values.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(*keys)
        .agg(
            F.kll_sketch_agg_double(number, F.lit(size)).alias("sketch"),
            F.count(F.lit(1)).alias("n"),
            F.min(number).alias("low"),
            F.max(number).alias("high"),
        )
    )


def merge(*parts: DataFrame) -> DataFrame:
    """Sketches of several runs or workers as one per key."""
    both = reduce(DataFrame.unionByName, parts)
    keys = [c for c in both.columns if c not in ("sketch", "n", "low", "high")]
    return both.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def percentiles(sketches: DataFrame, per_mille: dict[str, int]) -> DataFrame:
    """``keys, count, min``, each named percentile, ``max``; the ends are exact."""
    keys = [c for c in sketches.columns if c not in ("sketch", "n", "low", "high")]
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(p / 1000.0)).alias(name) for name, p in per_mille.items()]
    return sketches.select(*keys, F.col("n").alias("count"), F.col("low").alias("min"), *at, F.col("high").alias("max"))
