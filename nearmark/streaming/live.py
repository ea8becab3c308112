"""Streams over request logs, result tables and change logs.

Every stream has a batch twin in :mod:`nearmark.operators` (same aggregate on a
static DataFrame).  Sinks are tables in a shared folder; nothing passes through
the driver.  Aggregates that revise earlier rows are written one folder per
micro-batch, so a replayed batch overwrites its own output and nothing else.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmark.functions.scoring import score
from nearmark.operators.oplog import alive, last_state
from nearmark.operators.ranks import ranked
from nearmark.session import delete_path, scratch_path


# Micro-batches kept apart before they are merged.
COMPACT_BATCHES = 16
# Counts that a task spreads over their windows, each once per window.
TASK_ROWS = 1_000_000

__all__ = [
    "alive", "file_stream", "live_table", "metric_counts", "metric_totals", "run_append", "run_sessions", "run_update", "run_windows",
    "score_stream", "sessions", "totals", "window_counts", "window_metrics",
]


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def window_counts(log: DataFrame, slide: str = "1 second", delay: str | None = None) -> DataFrame:
    """How often each response time occurs per operation and stretch of ``slide``.

    Works on a stream or a table.  On a stream ``delay`` is how late a request
    may come; later ones are dropped by the watermark.  A request is in one
    stretch only, so the state is no larger than the requests of the delay.
    """
    timed = log.withWatermark("ts", delay) if delay else log
    counted = timed.groupBy(F.window("ts", slide).alias("w"), "request_type", "response_time")
    return counted.agg(F.count(F.lit(1)).alias("n")).select("w", "request_type", "response_time", "n")


def window_metrics(
    counts: DataFrame, window: str = "10 seconds", slide: str = "1 second", keys: tuple[str, ...] = ("request_type",)
) -> DataFrame:
    """Requests, rate and response-time percentiles per sliding window.

    ``counts`` are those of :func:`window_counts` with the same ``slide``.
    Percentiles are exact nearest ranks.  ``keys=()`` is over all operations.

    Windows are dealt to tasks by tiles of time as long as a window, so a count
    moves to two tiles and is spread over its windows there; there are as many
    tasks as keep each near ``TASK_ROWS`` spread rows.
    """
    epoch = F.timestamp_micros(F.lit(0).cast("bigint"))
    width, step = (F.unix_micros(epoch + F.expr(f"INTERVAL {t}")) for t in (window, slide))
    shifts = F.explode(F.sequence(F.lit(0).cast("bigint"), width - step, step))
    spark = counts.sparkSession
    rows, most = counts.agg(F.count(F.lit(1)), F.first(F.ceil(width / step))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * (most or 1) // TASK_ROWS))
    tile = lambda start: start - F.pmod(start, width)
    begun = counts.select(F.unix_micros("w.start").alias("_s"), *keys, "response_time", "n")
    dealt = begun.withColumn("_tile", F.explode(F.sequence(tile(F.col("_s") - width + step), tile(F.col("_s")), width)))
    spread = dealt.repartition(tasks, "_tile").withColumn("_shift", shifts).withColumn("_s", F.col("_s") - F.col("_shift"))
    merged = spread.where(tile(F.col("_s")) == F.col("_tile")).groupBy("_tile", "_s", *keys, "response_time").agg(F.sum("n").alias("n"))
    done = ranked(merged, ["_tile", "_s", *keys], "response_time", {"latency_p50": 500, "latency_p95": 950})
    bounds = F.struct(F.timestamp_micros("_s").alias("start"), F.timestamp_micros(F.col("_s") + width).alias("end"))
    rate = F.col("requests") / (width / F.lit(1e6))
    return done.select(bounds.alias("w"), *keys, "requests", rate.alias("requests_per_s"), "latency_p50", "latency_p95")


def run_windows(stream: DataFrame, log: DataFrame, label: str, slide: str = "1 second", delay: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """Counts of a stream's stretches, those still open included; how many rows came too late.

    ``log`` is what the stream has read, as a table.  Stretches that the watermark
    has not passed are counted from it, and rows that the stream has dropped
    as late are those of passed stretches that the stream has not counted.
    """
    done, mark = _run_append(window_counts(stream, slide, delay), label)
    whole = window_counts(log, slide)
    passed = F.col("w.end") <= F.lit(mark).cast("timestamp")
    closed = whole.where(passed).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    kept = done.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    late = closed.crossJoin(kept).select((F.col("all") - F.col("kept")).alias("late_rows"))
    return done.unionByName(whole.where(~passed)), late


def totals(log: DataFrame, key: str = "request_type") -> DataFrame:
    """Running totals per operation."""
    return log.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("failed").alias("failures"),
        F.min("response_time").alias("min"),
        F.max("response_time").alias("max"),
    )


def metric_counts(log: DataFrame) -> DataFrame:
    """Running count of each value of each metric; works on a stream or a table."""
    each = log.select("request_type", F.explode("metrics").alias("metric", "value"))
    return each.groupBy("request_type", "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def metric_totals(counts: DataFrame) -> DataFrame:
    """Count, ends, mean and exact low and middle percentile of each metric, from its counted values."""
    keys = ["request_type", "metric"]
    ends = counts.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean"),
    )
    order = ranked(counts, keys, "value", {"p5": 50, "p50": 500}).withColumnRenamed("requests", "count")
    return order.join(ends, keys).select(*keys, "count", "min", "max", "mean", "p5", "p50")


def live_table(log: DataFrame, update_inserts: bool = True) -> DataFrame:
    """Last write per id of a change stream, with deletes as tombstones.

    The largest ``seq`` wins whenever it comes, so late rows do no harm.  State
    is one row per id, and partial aggregation spares a hot id.
    """
    return last_state(log, update_inserts)


def score_stream(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Score a stream of ``query_id, actual`` against static ground truth."""
    return score(results.join(truth.select("query_id", "top_k", "neighbors"), "query_id"))


def sessions(log: DataFrame, gap: str, keys: list[str], delay: str | None = None) -> DataFrame:
    """Runs of requests with no gap longer than ``gap``, per key.

    On a stream, ``run_sessions`` first joins the requests of a key into runs
    inside each input partition, so a busy key shuffles runs and not requests.
    """
    timed = log.withWatermark("ts", delay) if delay else log
    return (
        timed.groupBy(*keys, F.session_window("ts", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("requests"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(*keys, "requests", "first_ts", "last_ts")
    )


def run_sessions(stream: DataFrame, log: DataFrame, label: str, gap: str, keys: list[str], delay: str) -> DataFrame:
    """All sessions of a stream, those still open included.

    ``log`` is what the stream has read, as a table.  Requests after a key's
    last closed session are joined to sessions from it; of these, the ones that
    the watermark has passed would be of rows that came too late, and are left out.
    """
    with _setting(stream.sparkSession, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        done, mark = _run_append(sessions(stream, gap, keys, delay), label)
    last = done.groupBy(*keys).agg(F.max("last_ts").alias("_last"))
    rest = log.join(last, keys, "left").where("_last is null or ts > _last").drop("_last")
    still = sessions(rest, gap, keys).where(F.col("last_ts") + F.expr(f"INTERVAL {gap}") > F.lit(mark).cast("timestamp"))
    return done.unionByName(still)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option, set for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_append(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there, in append mode; the table it wrote."""
    return _run_append(stream, label)[0]


def _run_append(stream: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The table a stream wrote, and the watermark it came to."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, label), scratch_path(spark, label + "-state")
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    marks = [p.eventTime["watermark"] for p in query.recentProgress if p.eventTime and "watermark" in p.eventTime]
    return spark.read.schema(stream.schema).parquet(path), max(marks, default="1970-01-01T00:00:00.000Z")


def run_update(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an aggregate in update mode; its last row per key.

    Each micro-batch owns one folder, so a batch run twice leaves one result.
    Every ``COMPACT_BATCHES`` of them are merged to the last row per key, and go.
    """
    spark = stream.sparkSession
    path, state = scratch_path(spark, label), scratch_path(spark, label + "-state")
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    # Folders that hold the result so far: a merged one first, then batches.
    held: list[str] = []

    def last_rows() -> DataFrame:
        rest = [c for c in schema.names if c not in keys]
        last: Column = F.max_by(F.struct(*rest), "_batch").alias("_r")
        return spark.read.schema(schema).parquet(*held).groupBy(*keys).agg(last).select(*keys, "_r.*")

    def store(rows: DataFrame, batch: int) -> None:
        own = f"{path}/batch-{batch}"
        rows.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(own)
        if own not in held:
            held.append(own)
        if len(held) > COMPACT_BATCHES:
            merged = f"{path}/upto-{batch}"
            last_rows().write.mode("overwrite").parquet(merged)
            for folder in held:
                delete_path(spark, folder)
            held[:] = [merged]

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not held:
        return spark.createDataFrame([], stream.schema)
    return last_rows().select(*stream.columns)
