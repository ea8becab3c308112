"""Run statistics against brute force."""

import json
import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmark.functions.scalars import REPORT_PERCENTILES, percentile_column, percentile_label
from nearmark.operators import ranks, report

SCHEMA = (
    "request_type string, ts timestamp, user_id int, response_time double, failed boolean, step int,"
    " metrics map<string,double>, counters map<string,bigint>"
)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out, now = [], datetime(2024, 1, 1)
    for i in range(700):
        now += timedelta(milliseconds=rng.randrange(1, 3000))
        search = rng.random() < 0.6
        out.append((
            "Search" if search else rng.choice(["Insert", "Fetch"]), now, 0 if rng.random() < 0.5 else rng.randrange(1, 9),
            round(rng.uniform(0.5, 90), 3), rng.random() < 0.1, i // 200,
            {"recall": rng.choice([0.0, 0.1, 0.25, 0.3333, 1.0]), "reciprocal rank": rng.random()} if search else None,
            None if search else {"requests": rng.randrange(5)},
        ))
    out.append(("Delete", now, 3, 5.5, False, 3, None, {"requests": 2}))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ranked(values, bp):
    cut = sorted(math.floor(v * 1000) for v in values)
    return cut[max(1, -(-len(cut) * bp // 10_000)) - 1] / 1000


def test_percentile_labels():
    assert [percentile_label(b) for b in REPORT_PERCENTILES] == [
        "0.1", "1", "5", "10", "25", "50", "75", "90", "95", "99", "99.9", "99.99"
    ]


def test_metric_summary(log, rows):
    got = {(r["request_type"], r["metric"]): r for r in report.metric_summary(log).collect()}
    assert set(got) == {("Search", "recall"), ("Search", "reciprocal rank")}
    for metric in ("recall", "reciprocal rank"):
        values = [r[6][metric] for r in rows if r[6]]
        cut = [math.floor(v * 1000) / 1000 for v in values]
        row = got["Search", metric]
        assert (row["count"], row["min"], row["max"]) == (len(values), min(cut), max(cut))
        assert row["mean"] == pytest.approx(sum(cut) / len(cut))
        for bp in REPORT_PERCENTILES:
            assert row[percentile_column(bp)] == ranked(values, bp)


def test_latency_summary(log, rows):
    got = {r["request_type"]: r for r in report.latency_summary(log).collect()}
    for kind in {r[0] for r in rows}:
        values = [r[3] for r in rows if r[0] == kind]
        assert got[kind]["min"] == min(values) and got[kind]["max"] == max(values)
        assert got[kind]["mean"] == pytest.approx(sum(values) / len(values))
        assert got[kind]["p50"] == ranked(values, 5000)


def test_operation_summary(log, rows):
    got = report.operation_summary(log).collect()
    assert [r["request_type"] for r in got] == ["Delete", "Fetch", "Insert", "Search"]
    assert got[0]["requests_per_s"] is None  # one request spans no time
    searches = [r for r in rows if r[0] == "Search"]
    seconds = (searches[-1][1] - searches[0][1]).total_seconds()
    assert got[3]["requests"] == len(searches)
    assert got[3]["requests_per_s"] == pytest.approx(len(searches) / seconds)
    assert got[3]["fail_pct"] == pytest.approx(100 * sum(r[4] for r in searches) / len(searches))


def test_parts_merge_to_the_whole(log):
    long = report.long_metrics(log, ("request_type", "step"))
    keys = ("request_type", "metric")
    parts = [report.histogram(long.where(F.col("step") == s), keys) for s in range(4)]
    merged = report.summarise(report.merge_histograms(*parts), keys).orderBy(*keys).collect()
    assert merged == report.metric_summary(log).orderBy(*keys).collect()
    halves = [report.counters(log.where(F.col("step") % 2 == s)) for s in (0, 1)]
    want = sorted(tuple(r) for r in report.counters(log).collect())
    assert sorted(tuple(r) for r in report.merge_counters(*halves).collect()) == want


def test_metrics_summary_order(log):
    got = [(r["operation"], r["metric"]) for r in report.metrics_summary(log).collect()]
    assert got == [
        ("Delete", "Latency (ms)"), ("Fetch", "Latency (ms)"), ("Insert", "Latency (ms)"),
        ("Search", "Latency (ms)"), ("Search", "Recall"), ("Search", "Reciprocal rank"),
    ]


def test_report_json(spark, log, tmp_path):
    from nearmark.sources.tables import write_report

    path = tmp_path / "report"
    write_report(report.report(log), str(path))
    lines = [json.loads(x) for f in path.glob("*.json") for x in f.read_text().splitlines()]
    by = {x["request_type"]: x for x in lines}
    assert set(by) == {"Search", "Insert", "Fetch", "Delete"}
    assert set(by["Search"]["metrics"]["recall"]["percentiles"]) == {percentile_label(b) for b in REPORT_PERCENTILES}
    assert by["Delete"]["counters"] == {"requests": 2} and "metrics" not in by["Delete"]


def test_report_is_its_parts_from_one_scan(spark, log, tmp_path):
    odd = log.limit(1).select(
        F.lit("Odd").alias("request_type"), "ts", "user_id", "response_time", F.lit(None).cast("boolean").alias("failed"), "step",
        F.create_map(F.lit("recall"), F.lit(None).cast("double")).alias("metrics"), F.create_map(F.lit("lost"), F.lit(None).cast("bigint")).alias("counters"),
    )
    log.unionByName(odd).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    done = report.report(log)
    assert done._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {r["request_type"]: r.asDict(recursive=True) for r in done.collect()}
    counts = {}
    for r in report.counters(log).collect():
        counts.setdefault(r["request_type"], {})[r["counter"]] = r["total"]
    wide = report.attach_metrics(report.operation_summary(log), report.metric_summary(log))
    for r in wide.collect():
        one = found[r["request_type"]]
        assert all(one[c] == r[c] for c in ("requests", "failures", "fail_pct", "requests_per_s", "failures_per_s"))
        assert one["counters"] == counts.get(r["request_type"])
        if r["metric"] is None:
            assert one["metrics"] is None
            continue
        nested = one["metrics"][r["metric"]]
        assert all(nested[c] == pytest.approx(r[c]) for c in ("min", "max", "mean"))
        assert nested["percentiles"] == {percentile_label(b): r[percentile_column(b)] for b in REPORT_PERCENTILES}
    assert len(found) == 5 and found["Odd"]["metrics"] is None and found["Odd"]["failures"] == 0
    assert report.report(log.where("false")).count() == 0


def test_rollup_and_gate(log, rows):
    got = {(r["request_type"], r["step"]): r["requests"] for r in report.rollup_summary(log).collect()}
    assert got["Search", None] == sum(r[0] == "Search" for r in rows)
    assert got["Search", 1] == sum(r[0] == "Search" and r[5] == 1 for r in rows)
    low = report.metric_summary(log).where("metric = 'recall'").first()["p5"]
    assert report.recall_gate(report.metric_summary(log), low).first()["passed"]
    assert not report.recall_gate(report.metric_summary(log), low + 0.01).first()["passed"]


def test_phases(spark):
    t = datetime(2024, 1, 1)
    marks = spark.createDataFrame(
        [("load", "start", t), ("load", "end", t + timedelta(seconds=2.5)), ("run", "end", t), ("open", "start", t)],
        "phase string, kind string, ts timestamp",
    )
    got = {r["phase"]: (r["seconds"], r["never_started"]) for r in report.phase_durations(marks).collect()}
    assert got == {"load": (2.5, False), "run": (None, True), "open": (None, False)}


def test_gaps_of_a_hot_user(log, rows):
    got = {r["user_id"]: r for r in report.gap_stats(log.where("request_type <> 'Delete'")).collect()}
    times = [r[1] for r in rows[:-1] if r[2] == 0]
    gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
    assert got[0]["requests"] == len(times)
    assert got[0]["gap_mean"] == pytest.approx(sum(gaps) / len(gaps))
    change = [abs(b - a) for a, b in zip(gaps, gaps[1:])]
    assert got[0]["gap_change_mean"] == pytest.approx(sum(change) / len(change))


def test_gaps_of_requests_at_one_time(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, t + timedelta(seconds=s), i) for i, s in enumerate([0, 4, 4, 4, 9])]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, seq int").repartition(3)
    (r,) = report.gap_stats(df, tie="seq").collect()
    assert (r["gap_mean"], r["gap_change_mean"]) == (2.25, 3.0)


def test_sliding_ranks_are_exact():
    rng = np.random.default_rng(0)
    at = np.sort(rng.integers(0, 400, 600))
    values = np.where(rng.random(600) < 0.1, np.nan, rng.integers(0, 50, 600))
    count, (p50, p95) = ranks.sliding(at, values, 30, [500, 950])
    for i in range(600):
        seen = (at >= at[i] - 30) & (at <= at[i])
        known = np.sort(values[seen & ~np.isnan(values)])
        assert count[i] == seen.sum()
        for got, p in ((p50[i], 0.5), (p95[i], 0.95)):
            assert np.isnan(got) if not len(known) else got == known[math.ceil(round(p * len(known), 9)) - 1]


def test_a_busy_operation_is_not_quadratic(spark):
    """A million requests of one operation in one window."""
    log = spark.range(1_000_000).select(
        F.lit("Search").alias("request_type"), F.timestamp_micros(F.col("id") * 10).alias("ts"),
        (F.col("id") * 7919 % 1_000_003 / 1000.0).alias("response_time"),
    )
    started = time.time()
    got = report.trailing(log, 10).agg(F.count("latency_p95"), F.max("requests"), F.max_by("latency_p50", "ts")).first()
    assert tuple(got)[:2] == (1_000_000, 1_000_000)
    assert got[2] == sorted(i * 7919 % 1_000_003 for i in range(1_000_000))[499_999] / 1000
    assert time.time() - started < 60


def test_rows_without_time_are_in_no_window(spark):
    rows = [("a", datetime(2024, 1, 1), 1.0), ("a", None, 2.0), ("a", datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "request_type string, ts timestamp, response_time double")
    got = sorted((r["response_time"] or 0, r["requests"], r["latency_p50"]) for r in report.trailing(df).collect())
    assert got == [(0, 2, 1.0), (1.0, 2, 1.0), (2.0, None, None)]


def test_trailing_window(log, rows):
    got = report.trailing(log, 10).orderBy("ts").collect()
    assert len(got) == len(rows)
    for r in got[::37]:
        window = [x[3] for x in rows if x[0] == r["request_type"] and 0 <= (r["ts"] - x[1]).total_seconds() <= 10]
        assert r["requests"] == len(window)
        assert r["latency_p50"] == sorted(window)[math.ceil(0.5 * len(window)) - 1]
