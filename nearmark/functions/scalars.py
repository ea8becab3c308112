"""Small scalar helpers."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Report percentiles in ten-thousandths of the whole (fixed values):
# 0.1 1 5 10 25 50 75 90 95 99 99.9 99.99 percent.
REPORT_PERCENTILES = (10, 100, 500, 1000, 2500, 5000, 7500, 9000, 9500, 9900, 9990, 9999)
# Metric values are kept at a resolution of one thousandth (fixed value).
RESOLUTION = 1000


def percentile_label(bp: int) -> str:
    return f"{bp / 100:g}"


def percentile_column(bp: int) -> str:
    return "p" + percentile_label(bp).replace(".", "_")


def bucket_of(value: Column) -> Column:
    """Histogram bucket of a value: whole thousandths, rounded down."""
    return F.floor(value * F.lit(RESOLUTION)).cast("bigint")


def bucket_value(bucket: Column) -> Column:
    return bucket.cast("double") / F.lit(float(RESOLUTION))


def whole_div(a: Column, b: Column) -> Column:
    """Integer quotient."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def chunk_of(position: Column, total: Column | int, chunks: Column | int) -> Column:
    """1-based chunk of a 1-based position when ``total`` rows are split evenly.

    The first ``total % chunks`` chunks get one extra row.
    """
    n = total if isinstance(total, Column) else F.lit(total)
    c = chunks if isinstance(chunks, Column) else F.lit(chunks)
    n, c, p = n.cast("bigint"), c.cast("bigint"), position.cast("bigint") - 1
    small = whole_div(n, c)
    extra = n % c
    head = extra * (small + 1)
    in_head = whole_div(p, small + 1)
    in_tail = extra + whole_div(p - head, F.greatest(small, F.lit(1).cast("bigint")))
    return (F.when(p < head, in_head).otherwise(in_tail) + 1).cast("int")


def default_lists(record_count: int) -> int:
    """Number of partitions of an inverted-file index."""
    if record_count <= 1_000_000:
        return max(1, record_count // 1000)
    return isqrt(record_count)


def default_probes(lists: int) -> int:
    return max(1, isqrt(lists))


def lists_for(record_count: Column) -> Column:
    """:func:`default_lists` of a column of counts."""
    few = F.greatest(F.lit(1).cast("bigint"), whole_div(record_count, F.lit(1000)))
    return F.when(record_count <= 1_000_000, few).otherwise(F.floor(F.sqrt(record_count)).cast("bigint"))
