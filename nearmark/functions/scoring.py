"""Retrieval metrics of one result list against its ground truth.

``actual`` and ``expected`` are id arrays, best first.  ``expected`` is cut to
``top_k`` first, ``actual`` is not.  Null ground truth gives a null score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MetricFn = Callable[[Column, Column], Column]


def _zero() -> Column:
    return F.lit(0.0)


def _empty_rules(actual: Column, expected: Column, score: Column) -> Column:
    """Nothing expected: 1 if nothing came, else 0.  Nothing came: 0."""
    return (
        F.when(actual.isNull() | expected.isNull(), F.lit(None).cast("double"))
        .when((F.size(expected) == 0) & (F.size(actual) == 0), F.lit(1.0))
        .when((F.size(expected) == 0) | (F.size(actual) == 0), _zero())
        .otherwise(score)
    )


def recall(actual: Column, expected: Column) -> Column:
    """Share of the expected ids found; repeats in ``expected`` count below."""
    found = F.size(F.array_intersect(expected, actual))
    return _empty_rules(actual, expected, F.try_divide(found.cast("double"), F.size(expected)))


def average_precision(actual: Column, expected: Column) -> Column:
    """Mean over ranks i of the overlap of both lists' first i ids, over i.

    An id held by both lists counts from rank m, the later of its two first
    places, to the end n, so it adds 1/m + ... + 1/n.
    """
    n = F.size(actual)

    def gain(x: Column) -> Column:
        m = F.greatest(F.array_position(actual, x), F.array_position(expected, x)).cast("int")
        ranks = F.when(m <= n, F.sequence(m, F.greatest(m, n))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(ranks, _zero(), lambda s, i: s + F.lit(1.0) / i)

    total = F.aggregate(F.array_intersect(actual, expected), _zero(), lambda s, x: s + gain(x))
    return _empty_rules(actual, expected, F.try_divide(total, n))


def reciprocal_rank(actual: Column, expected: Column) -> Column:
    """One over the place of the first relevant id, 0 if there is none."""
    places = F.transform(
        F.array_intersect(actual, expected), lambda x: F.array_position(actual, x)
    )
    score = F.coalesce(F.try_divide(F.lit(1.0), F.array_min(places)), _zero())
    return _empty_rules(actual, expected, score)


def recall_at_min(actual: Column, expected: Column) -> Column:
    """Recall with the expected list cut to the shorter of both lengths."""
    size = F.least(F.size(actual), F.size(expected))
    found = F.size(F.array_intersect(F.slice(expected, 1, F.greatest(size, F.lit(0))), actual))
    score = F.try_divide(found.cast("double"), size)
    return F.when(F.size(actual) == 0, _zero()).otherwise(score)


# Metrics computed for every search; ``register`` adds a user's own.
METRICS: dict[str, MetricFn] = {
    "recall": recall,
    "average_precision": average_precision,
    "reciprocal_rank": reciprocal_rank,
}


def register(name: str, metric: MetricFn) -> None:
    METRICS[name] = metric


def score(
    results: DataFrame,
    actual: str = "actual",
    expected: str = "neighbors",
    top_k: str = "top_k",
    metrics: dict[str, MetricFn] | None = None,
) -> DataFrame:
    """One column per metric; all in one projection."""
    cut = F.slice(F.col(expected), F.lit(1), F.col(top_k))
    chosen = METRICS if metrics is None else metrics
    return results.withColumn("_e", cut).withColumns(
        {name: fn(F.col(actual), F.col("_e")) for name, fn in chosen.items()}
    ).drop("_e")


def score_long(scored: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Scores as rows ``(keys, metric, value)``; unscored queries give no rows."""
    names = list(METRICS) if metrics is None else metrics
    return scored.unpivot(keys, names, "metric", "value").where(F.col("value").isNotNull())
