"""Run statistics from request logs.

A log has ``request_type``, ``ts``, ``response_time`` (ms), ``failed``, and maps
``metrics`` (double) and ``counters`` (bigint).  Percentiles are discrete
nearest ranks, read off histograms of whole thousandths: the log is shuffled
only as partial counts per bucket, and a stored histogram can be added to later.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearmark.functions.scalars import (
    REPORT_PERCENTILES,
    bucket_of,
    bucket_value,
    percentile_column,
    percentile_label,
    whole_div,
)
from nearmark.operators import ranks
from nearmark.operators.ranges import lag_within, ranges_of

PERCENTILE_COLUMNS = [percentile_column(bp) for bp in REPORT_PERCENTILES]
TRAILING = [
    ("requests", T.LongType()), ("latency_p50", T.DoubleType()), ("latency_p95", T.DoubleType()), ("requests_per_s", T.DoubleType()),
]
SUMMARY_COLUMNS = ["min", *PERCENTILE_COLUMNS, "max", "mean"]


def counters(log: DataFrame, keys: tuple[str, ...] = ("request_type",)) -> DataFrame:
    """Sum of each named counter per key."""
    each = log.select(*keys, F.explode("counters").alias("counter", "amount"))
    return each.groupBy(*keys, "counter").agg(F.sum("amount").alias("total"))


def long_metrics(log: DataFrame, keys: tuple[str, ...] = ("request_type",)) -> DataFrame:
    """One row per request and metric."""
    return log.select(*keys, F.explode("metrics").alias("metric", "value"))


def histogram(
    values: DataFrame,
    keys: tuple[str, ...] = ("request_type", "metric"),
    value: str = "value",
    exact: bool = False,
) -> DataFrame:
    """Counts per thousandth: ``keys, bucket, n``; ``exact`` adds the least,
    greatest and summed value of each bucket."""
    v = F.col(value)
    more = (F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("sum")) if exact else ()
    return (
        values.where(v.isNotNull())
        .groupBy(*keys, bucket_of(v).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), *more)
    )


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """Histograms of several workers or runs as one."""
    both = reduce(DataFrame.unionByName, parts)
    keys = [c for c in both.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n"))


def merge_counters(*parts: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, parts)
    keys = [c for c in both.columns if c != "total"]
    return both.groupBy(*keys).agg(F.sum("total").alias("total"))


def _bucket_mean() -> Column:
    return bucket_value(F.sum(F.col("bucket") * F.col("n")) / F.sum("n"))


def summarise(
    hist: DataFrame,
    keys: tuple[str, ...] = ("request_type", "metric"),
    ends: tuple[Column, ...] | None = None,
    more: tuple[Column, ...] = (),
) -> DataFrame:
    """``keys, count, min, 12 percentiles, max, mean`` of each histogram.

    ``ends`` replaces the expressions of ``min``, ``max`` and ``mean``; ``more`` are further ones.
    """
    low, high, mean = ends or (
        bucket_value(F.min("bucket")).alias("min"),
        bucket_value(F.max("bucket")).alias("max"),
        _bucket_mean().alias("mean"),
    )
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    # In ten-thousandths of the row count: a bucket holds a percentile if the
    # rows below it fall short of the share and the rows up to it reach it.
    ranked = (
        hist.withColumn("_all", F.sum("n").over(whole))
        .withColumn("_upto", F.sum("n").over(upto) * 10_000)
        .withColumn("_below", F.col("_upto") - F.col("n") * 10_000)
    )

    def at(bp: int) -> Column:
        share = F.col("_all") * bp
        here = (F.col("_below") < share) & (share <= F.col("_upto"))
        return bucket_value(F.max(F.when(here, F.col("bucket"))))

    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        low,
        *[at(bp).alias(percentile_column(bp)) for bp in REPORT_PERCENTILES],
        high,
        mean,
        *more,
    )


def operation_summary(log: DataFrame, key: str = "request_type") -> DataFrame:
    """Requests, failures and their rates per operation, in label order.

    A single request spans no time and has no rate.
    """
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
    counted = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("failed").alias("failures"),
        seconds.alias("seconds"),
    )
    return counted.select(key, "requests", "failures", *_rates()).orderBy(key)


def _rates() -> tuple[Column, ...]:
    return (
        (F.lit(100.0) * F.col("failures") / F.col("requests")).alias("fail_pct"),
        F.try_divide("requests", "seconds").alias("requests_per_s"),
        F.try_divide("failures", "seconds").alias("failures_per_s"),
    )


def _exact_ends(hist: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Summary with the least, greatest and mean value unrounded."""
    ends = (F.min("low").alias("min"), F.max("high").alias("max"), (F.sum("sum") / F.sum("n")).alias("mean"))
    return summarise(hist, keys, ends).select(*keys, *SUMMARY_COLUMNS)


def latency_summary(log: DataFrame, keys: tuple[str, ...] = ("request_type",)) -> DataFrame:
    """Least, 12 percentiles, greatest and mean response time per operation."""
    return _exact_ends(histogram(log, keys, "response_time", exact=True), keys)


def metric_summary(log: DataFrame, keys: tuple[str, ...] = ("request_type",)) -> DataFrame:
    return summarise(histogram(long_metrics(log, keys), (*keys, "metric")), (*keys, "metric"))


def metrics_summary(log: DataFrame) -> DataFrame:
    """Per operation the latency row, then a row per metric, in print order.

    Latency is read as one more metric, so the log is scanned once.
    """
    latency = F.struct(
        F.lit(0).alias("section"), F.lit("Latency (ms)").alias("metric"), F.col("response_time").alias("value")
    )
    custom = F.transform(
        F.map_entries("metrics"),
        lambda e: F.struct(F.lit(1).alias("section"), _sentence_case(e["key"]).alias("metric"), e["value"].alias("value")),
    )
    rows = log.select(
        F.col("request_type").alias("operation"),
        F.explode(F.when(F.col("metrics").isNull(), F.array(latency)).otherwise(F.concat(F.array(latency), custom))).alias("_v"),
    ).select("operation", "_v.*")
    keys = ("operation", "section", "metric")
    first = F.min("section") == 0
    ends = (
        F.when(first, F.min("low")).otherwise(bucket_value(F.min("bucket"))).alias("min"),
        F.when(first, F.max("high")).otherwise(bucket_value(F.max("bucket"))).alias("max"),
        F.when(first, F.sum("sum") / F.sum("n")).otherwise(_bucket_mean()).alias("mean"),
    )
    done = summarise(histogram(rows, keys, exact=True), keys, ends)
    return done.select(*keys, *SUMMARY_COLUMNS).orderBy(*keys)


def _sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def attach_metrics(stats: DataFrame, metrics: DataFrame, key: str = "request_type") -> DataFrame:
    """Statistics with their metrics; operations without metrics stay."""
    return stats.join(metrics, key, "left")


def nested_summary() -> Column:
    """One metric's summary as ``{min, max, mean, percentiles: {...}}``."""
    labels = F.array(*[F.lit(percentile_label(bp)) for bp in REPORT_PERCENTILES])
    values = F.array(*PERCENTILE_COLUMNS)
    return F.struct("min", "max", "mean", F.map_from_arrays(labels, values).alias("percentiles"))


def report(log: DataFrame) -> DataFrame:
    """One row per operation with nested metric summaries and counters; the log is read once.

    Each request is one entry for itself and one for each metric and counter it
    carries.  Entries are counted before the shuffle, metrics by thousandth.
    """
    nothing = F.lit(None)

    def entry(part: int, name: Column, bucket: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(part).alias("part"), name.cast("string").alias("name"),
            bucket.cast("bigint").alias("bucket"), amount.cast("bigint").alias("amount"),
        )

    def entries(column: str, make) -> Column:
        return F.coalesce(F.transform(F.map_entries(column), make), F.array())

    each = F.concat(
        F.array(entry(0, nothing, nothing, F.col("failed").cast("int"))),
        entries("metrics", lambda e: entry(1, e["key"], bucket_of(e["value"]), nothing)),
        entries("counters", lambda e: entry(2, e["key"], nothing, e["value"])),
    )
    cells = (
        log.select("request_type", "ts", F.explode(each).alias("_e"))
        .select("request_type", "ts", "_e.*")
        # A metric without a value is none.
        .where((F.col("part") != 1) | F.col("bucket").isNotNull())
        .groupBy("request_type", "part", "name", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    )
    more = (F.sum("amount").alias("amount"), F.min("first").alias("first"), F.max("last").alias("last"))
    parts = summarise(cells, ("request_type", "part", "name"), more=more)
    own = lambda c: F.max(F.when(F.col("part") == 0, F.col(c)))

    def collected(part: int, value: Column) -> Column:
        # As many entries as there are metrics or counters.
        found = F.collect_list(F.when(F.col("part") == part, F.struct("name", value)))
        return F.when(F.size(found) > 0, F.map_from_entries(F.sort_array(found) if part == 2 else found))

    seconds = (F.unix_micros(own("last")) - F.unix_micros(own("first"))) / F.lit(1e6)
    counted = parts.groupBy("request_type").agg(
        own("count").alias("requests"),
        F.coalesce(own("amount"), F.lit(0).cast("bigint")).alias("failures"),
        seconds.alias("seconds"),
        collected(1, nested_summary().alias("summary")).alias("metrics"),
        collected(2, F.col("amount").alias("total")).alias("counters"),
    )
    return counted.select("request_type", "requests", "failures", *_rates(), "metrics", "counters")


def rollup_summary(log: DataFrame) -> DataFrame:
    """Requests and response times per operation and step, and over all steps.

    ``step`` is null, and ``all_steps`` 1, in the rows over all steps.
    """
    return (
        log.groupingSets([["request_type", "step"], ["request_type"]], "request_type", "step")
        .agg(
            F.grouping("step").cast("int").alias("all_steps"),
            F.count(F.lit(1)).alias("requests"),
            F.count_if("failed").alias("failures"),
            F.avg("response_time").alias("mean_response_time"),
        )
        .select("request_type", "step", "all_steps", "requests", "failures", "mean_response_time")
    )


def recall_gate(summary: DataFrame, threshold: float, metric: str = "recall", percentile: str = "p5") -> DataFrame:
    """Does the low percentile of a metric reach the threshold."""
    return summary.where(F.col("metric") == metric).select(
        "request_type",
        F.col(percentile).alias("reached"),
        (F.col(percentile) >= F.lit(threshold)).alias("passed"),
    )


def phase_durations(marks: DataFrame) -> DataFrame:
    """Seconds per phase from ``phase, kind (start/end), ts`` marks.

    A phase that ended without starting has no duration and is flagged.
    """
    starts = F.min(F.when(F.col("kind") == "start", F.unix_micros("ts")))
    ends = F.max(F.when(F.col("kind") == "end", F.unix_micros("ts")))
    spans = marks.groupBy("phase").agg(starts.alias("_s"), ends.alias("_e"))
    return spans.select(
        "phase",
        ((F.col("_e") - F.col("_s")) / F.lit(1e6)).alias("seconds"),
        (F.col("_s").isNull() & F.col("_e").isNotNull()).alias("never_started"),
    )


def gap_stats(log: DataFrame, user: str = "user_id", tie: str | None = None) -> DataFrame:
    """Spread of the seconds between a user's requests, and of their changes.

    Requests of one time are in the order of ``tie``, a column that tells a
    user's requests apart; without it, a user has one request at a time.
    """
    place = F.struct("ts", *[tie] * (tie is not None)).alias("_place")
    micros = log.select(user, place, F.unix_micros("ts").alias("_us"))
    cut = ranges_of(micros, "_us")
    gaps = lag_within(micros, [user], "_place", "_us", "_before", cut)
    gaps = gaps.withColumn("gap", (F.col("_us") - F.col("_before")) / F.lit(1e6))
    gaps = lag_within(gaps, [user], "_place", "gap", "_gap_before", cut)
    change = F.abs(F.col("gap") - F.col("_gap_before"))
    seconds = (F.max("_us") - F.min("_us")) / F.lit(1e6)
    return gaps.groupBy(user).agg(
        F.count(F.lit(1)).alias("requests"),
        F.try_divide(F.count("gap").cast("double"), seconds).alias("rate"),
        F.avg("gap").alias("gap_mean"),
        F.stddev_samp("gap").alias("gap_stddev"),
        F.avg(change).alias("gap_change_mean"),
    )


def trailing(log: DataFrame, seconds: int = 10, keys: tuple[str, ...] = ("request_type",)) -> DataFrame:
    """Rate and response-time percentiles over the seconds before each request.

    Time is cut into slices as long as the window.  A row takes part in its own
    slice and, as history, in the next, so every window lies in one slice and
    no operation is handled by a single task.  Percentiles are exact nearest
    ranks; a slice of n rows takes about n log n steps.  A row without ``ts`` is
    in no window, its own included, and has nulls.
    """
    width = seconds * 1_000_000
    timed = log.withColumn("_us", F.unix_micros("ts")).withColumn(
        "_slice", whole_div(F.col("_us"), F.lit(width))
    )
    own = F.struct(F.col("_slice").alias("slice"), F.lit(False).alias("history"))
    later = F.struct((F.col("_slice") + 1).alias("slice"), F.lit(True).alias("history"))
    spread = timed.withColumn("_at", F.explode(F.array(own, later))).where("_us is not null")
    spread = spread.withColumn("_history", F.col("_at.history")).withColumn("_time", F.col("response_time").cast("double"))
    # Place in a slice and the history before it, and a number for the slice.
    spread = spread.withColumn("_us", F.col("_us") - (F.col("_at.slice") - 1) * width)
    spread = spread.withColumn("_slice", F.xxhash64(*keys, "_at.slice")).drop("_at")
    schema = T.StructType([*log.schema.fields, *[T.StructField(n, k) for n, k in TRAILING]])
    names = list(log.columns)

    def measured(table: pa.Table, number: np.ndarray) -> pa.Table:
        # Slices laid end to end, with room between them, are one sequence.
        at = (np.cumsum(np.append(0, number[1:] != number[:-1])) * 4 * width) + table.column("_us").to_numpy()
        values = table.column("_time").to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
        requests, (p50, p95) = ranks.sliding(at, values, width, [500, 950])
        own = ~np.asarray(table.column("_history").to_numpy(zero_copy_only=False), bool)
        out = table.select(names).filter(pa.array(own))
        for (name, _), column in zip(TRAILING, [requests, p50, p95, requests / float(seconds)], strict=True):
            out = out.append_column(name, pa.array(column[own], from_pandas=True))
        return out

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.table(batch)
            number = new.column("_slice").to_numpy()
            last = int(np.searchsorted(number, number[-1]))
            if not last and held and held[-1].column("_slice")[-1].as_py() == number[-1]:
                # Still the same slice: it goes on in the next batch.
                held.append(new)
                continue
            table = pa.concat_tables([*held, new.slice(0, last)])
            yield from measured(table, table.column("_slice").to_numpy()).to_batches() if table.num_rows else ()
            held = [new.slice(last)]
        if held:
            table = pa.concat_tables(held)
            yield from measured(table, table.column("_slice").to_numpy()).to_batches()

    dealt = spread.repartition("_slice").sortWithinPartitions("_slice", "_us")
    known = dealt.mapInArrow(measure, schema)
    lost = log.where("ts is null").select("*", *[F.lit(None).cast(k).alias(n) for n, k in TRAILING])
    return known.unionByName(lost)
