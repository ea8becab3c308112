"""Exact order statistics: of counted values, and over sliding ranges of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def nearest_rank(n, per_mille: int):
    """1-based nearest rank of a percentile (in thousandths) among ``n`` values, in whole numbers."""
    return (n * per_mille + 999) // 1000


def ranked(counts: DataFrame, keys: list[str], value: str, per_mille: dict[str, int], n: str = "n") -> DataFrame:
    """``keys``, the total as ``requests``, and each named percentile of counted values.

    Nulls are counted in the total and have no rank.
    """
    known = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(F.lit(0).cast("bigint"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_upto", F.sum(known).over(upto)).withColumn("_all", F.sum(known).over(whole))
    rank = lambda p: F.expr(f"(_all * {p} + 999) div 1000")
    reached = lambda p: F.min(F.when(F.col("_upto") >= rank(p), F.col(value)))
    return summed.groupBy(*keys).agg(F.sum(n).alias("requests"), *[reached(p).alias(name) for name, p in per_mille.items()])


class SlidingRanks:
    """A wavelet matrix over values: the k-th least of any range of rows.

    Built in one pass per binary digit of the number of distinct values; all
    questions are answered together, in as many passes.
    """

    def __init__(self, values: np.ndarray):
        self.distinct, code = np.unique(values, return_inverse=True)
        self.levels: list[tuple[np.ndarray, int]] = []
        for bit in range(max(1, int(len(self.distinct)).bit_length()) - 1, -1, -1):
            zero = (code >> bit) & 1 == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            self.levels.append((before, int(before[-1])))
            code = np.concatenate([code[zero], code[~zero]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th least value (from 0) of the rows ``low`` to ``high``, the latter not included."""
        low, high, k = low.copy(), high.copy(), k.copy()
        code = np.zeros(len(low), np.int64)
        for before, zeros in self.levels:
            a, b = before[low], before[high]
            right = k >= b - a
            k = np.where(right, k - (b - a), k)
            low, high = np.where(right, zeros + low - a, a), np.where(right, zeros + high - b, b)
            code = code * 2 + right
        return self.distinct[code]


def sliding(at: np.ndarray, values: np.ndarray, width: int, per_mille: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows within ``width`` before each row of sorted ``at``, ties included, and percentiles of their values.

    Values that are NaN count as rows and have no rank; a range without others gives NaN.
    """
    low, high = np.searchsorted(at, at - width, "left"), np.searchsorted(at, at, "right")
    known = ~np.isnan(values)
    place = np.concatenate([[0], np.cumsum(known)])
    s, e = place[low], place[high]
    some = e > s
    out = []
    ranks = SlidingRanks(values[known]) if known.any() else None
    for p in per_mille:
        got = np.full(len(at), np.nan)
        if ranks is not None:
            got[some] = ranks.kth(s[some], e[some], nearest_rank((e - s)[some], p) - 1)
        out.append(got)
    return high - low, out
