"""The first rows of an order, without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.session import stored

# Rows that one task may sort.
FEW = 65_536
DIGIT_BITS = 16
LEAST = -(1 << 63)


def smallest(df: DataFrame, n: int, order: Column, key: str, few: int = FEW) -> DataFrame:
    """The ``n`` rows of least ``order`` (a whole number, null first), ties by ``key``, sorted by both.

    The value of the n-th row is found digit by digit: each pass counts the rows
    of every digit below the digits found so far (at most 65,536 counts come
    back) and reads ``order`` alone.  Rows below are a plain filter, which Parquet
    can use; only those that share the last digits are sorted by ``key``, and
    there are few of them.  If more than ``few`` rows share one value, those
    kept of them are taken in the order of a stored copy and not by ``key``.
    Fewer than ``n`` rows come back whole, and up to ``few`` by one sort.
    """
    if n <= few:
        return df.orderBy(order, key).limit(n)
    number = order.cast("bigint")
    digits = number.bitwiseXOR(F.lit(LEAST))
    low, high, below, inside = LEAST, -LEAST - 1, 0, 0
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftrightunsigned(digits, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        part = df if shift == 64 - DIGIT_BITS else df.where(number.between(low, high))
        counts = sorted((-1 if d is None else d, c) for d, c in part.groupBy(digit.alias("digit")).count().collect())
        if below + sum(c for _, c in counts) <= n:
            return df.orderBy(order, key)
        for at, inside in counts:
            if below + inside >= n:
                break
            below += inside
        if at < 0:
            return _any(df.where(number.isNull()), n, key, few)
        low, high = low + (at << shift), low + ((at + 1) << shift) - 1
        if inside <= few or below + inside == n:
            break
    least = df.where((number < low) | number.isNull())
    edge = df.where(number.between(low, high))
    if below + inside > n:
        edge = edge.orderBy(order, key).limit(n - below) if inside <= few else _any(edge, n - below, key, few)
    return least.unionByName(edge).orderBy(order, key)


def _any(ties: DataFrame, n: int, key: str, few: int) -> DataFrame:
    """Some ``n`` rows, the same ones whenever the result is computed."""
    name = "_place"
    while name in ties.columns:
        name = f"_{name}"
    held = stored(ties.withColumn(name, F.monotonically_increasing_id()), "ties")
    return smallest(held, n, F.col(name), name, few).drop(name).orderBy(key)
