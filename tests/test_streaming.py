"""Streams against their batch twins; late and out-of-order rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nearmark.streaming import live

T0 = datetime(2024, 1, 1)
LOG = "request_type string, ts timestamp, response_time double, failed boolean"


def write_batches(spark, folder, batches, schema):
    """One file per batch, so that each is one micro-batch, oldest first."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            path = os.path.join(folder, f)
            if f.endswith(".parquet") and os.path.getmtime(path) > time.time() - 3600:
                os.utime(path, (time.time() - 10_000 + i * 100,) * 2)
    return live.file_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_windows_and_late_rows(spark, tmp_path):
    first = [("Search", at(s), float(s), False) for s in range(0, 60)]
    # Rows are judged late by the watermark of the batch before.
    more = [("Search", at(59), 59.5, False)]
    late = [("Search", at(5), 1000.0, False), ("Search", at(58), 58.5, False)]
    end = [("Search", at(500), 1.0, False)]
    stream = write_batches(spark, str(tmp_path / "log"), [first, more, late, end], LOG)
    log = spark.createDataFrame(first + more + late + end, LOG)
    counts, dropped = live.run_windows(stream, log, "w", delay="5 seconds")
    got = live.window_metrics(counts).collect()
    # The row of second 5 came after the watermark had passed it; the open windows are there.
    assert dropped.first()["late_rows"] == 1
    assert max(r["latency_p95"] for r in got) < 1000 and max(r["w"]["end"] for r in got) == at(510)
    batch = spark.createDataFrame(first + more + late[1:] + end, LOG)
    want = live.window_metrics(live.window_counts(batch)).collect()
    assert sorted(got) == sorted(want)
    for r in want:
        inside = sorted(x[2] for x in first + more + late[1:] + end if r["w"]["start"] <= x[1] < r["w"]["end"])
        n = len(inside)
        assert (r["requests"], r["requests_per_s"]) == (n, n / 10)
        assert (r["latency_p50"], r["latency_p95"]) == (inside[-(-n // 2) - 1], inside[-(-n * 95 // 100) - 1])
    overall = live.window_metrics(counts, keys=()).collect()
    assert sorted((r["w"]["start"], r["requests"]) for r in overall) == sorted((r["w"]["start"], r["requests"]) for r in want)


@pytest.mark.parametrize(("window", "slide"), [(10, 1), (10, 3), (4, 4)])
def test_more_counts_are_spread_by_more_tasks(spark, monkeypatch, window, slide):
    monkeypatch.setattr(live, "TASK_ROWS", 100, raising=False)
    log = [("Search", at(s * 7 % 1000), float(s % 13), False) for s in range(1000)]
    counts = live.window_counts(spark.createDataFrame(log, LOG), f"{slide} seconds")
    found = live.window_metrics(counts, f"{window} seconds", f"{slide} seconds", keys=())
    rows = found.select("w.start", "requests", "latency_p50", "latency_p95", F.spark_partition_id().alias("task")).collect()
    if window > slide:
        # The session has four tasks a shuffle.
        assert len({r["task"] for r in rows}) > 4
    first = int((T0 - datetime(1970, 1, 1)).total_seconds())
    want = {}
    for _, ts, took, _ in log:
        second = int((ts - datetime(1970, 1, 1)).total_seconds())
        stretch = second - second % slide
        for start in range(stretch, stretch - window + slide - 1, -slide):
            want.setdefault(start - first, []).append(took)
    got = {int((r["start"] - T0).total_seconds()): (r["requests"], r["latency_p50"], r["latency_p95"]) for r in rows}
    rank = lambda own, p: sorted(own)[-(-len(own) * p // 100) - 1]
    assert got == {s: (len(own), rank(own, 50), rank(own, 95)) for s, own in want.items()} and len(got) == len(rows)


def test_percentiles_are_exact_beyond_ten_thousand_values(spark):
    rows = spark.range(30_000).select(
        F.lit("Search").alias("request_type"), F.lit(T0).alias("ts"), (F.col("id") * 7919 % 30_000 / 1000.0).alias("response_time"),
        F.create_map(F.lit("m"), F.col("id") * 7919 % 30_000 / 1000.0).alias("metrics"),
    )
    for r in live.window_metrics(live.window_counts(rows)).collect():
        assert (r["latency_p50"], r["latency_p95"]) == (14.999, 28.499)
    (r,) = live.metric_totals(live.metric_counts(rows)).collect()
    assert (r["p5"], r["p50"], r["count"], r["min"], r["max"]) == (1.499, 14.999, 30_000, 0.0, 29.999)


def test_totals(spark, tmp_path):
    batches = [[("Search", at(i), float(i), i % 2 == 0), ("Fetch", at(i), 1.0, False)] for i in range(3)]
    stream = write_batches(spark, str(tmp_path / "log"), batches, LOG)
    got = live.run_update(live.totals(stream), "t", ["request_type"]).collect()
    want = live.totals(spark.createDataFrame(sum(batches, []), LOG)).collect()
    assert sorted(got) == sorted(want)


def test_live_table_takes_late_rows(spark, tmp_path):
    schema = "seq bigint, op string, id string, value int"
    batches = [
        [(5, "insert", "a", 50), (6, "delete", "b", None)],
        [(2, "insert", "b", 20), (3, "update", "a", 30), (8, "insert", "c", 80)],
        [(9, "update", "c", 90), (10, "search", "a", None)],
    ]
    stream = write_batches(spark, str(tmp_path / "log"), batches, schema)
    got = live.alive(live.run_update(live.live_table(stream), "l", ["id"])).collect()
    assert sorted((r["id"], r["value"]) for r in got) == [("a", 50), ("c", 90)]


def test_scores(spark, tmp_path):
    truth = spark.createDataFrame([(1, 2, ["a", "b"]), (2, 2, ["c", "d"])], "query_id int, top_k int, neighbors array<string>")
    stream = write_batches(spark, str(tmp_path / "r"), [[(1, ["a", "x"])], [(2, ["c", "d"]), (3, ["q"])]], "query_id int, actual array<string>")
    got = live.run_append(live.score_stream(stream, truth).select("query_id", "recall"), "s").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0.5), (2, 1.0)]


def test_sessions(spark, tmp_path):
    rows = [(1, at(s)) for s in (0, 5, 9, 100, 104)] + [(2, at(50))]
    stream = write_batches(spark, str(tmp_path / "s"), [rows, [(3, at(10_000))]], "user_id int, ts timestamp")
    log = spark.createDataFrame([*rows, (3, at(10_000))], "user_id int, ts timestamp")
    got = live.run_sessions(stream, log, "s", "10 seconds", ["user_id"], "1 second").collect()
    # That of user 3 is still open when the stream ends.
    assert sorted((r["user_id"], r["requests"]) for r in got) == [(1, 2), (1, 3), (2, 1), (3, 1)]


def test_batches_are_merged_on_the_way(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT_BATCHES", 2)
    batches = [[("Search", at(i), float(i), i % 2 == 0), (f"only {i}", at(i), 1.0, False)] for i in range(6)]
    stream = write_batches(spark, str(tmp_path / "log"), batches, LOG)
    got = live.run_update(live.totals(stream), "t", ["request_type"]).collect()
    assert sorted(got) == sorted(live.totals(spark.createDataFrame(sum(batches, []), LOG)).collect())


def test_a_batch_run_twice_counts_once(spark, tmp_path):
    """Each micro-batch owns its folder: writing it again replaces it."""
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    for _ in range(2):
        rows.write.mode("overwrite").parquet(f"{path}/batch-0")
    assert spark.read.parquet(f"{path}/batch-0").count() == 1


def test_scratch_needs_a_shared_folder(spark):
    from nearmark.session import scratch_path, shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_dir(spark) == named
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    with pytest.raises(Exception):
        spark.read.parquet(scratch_path(spark, "x"))
