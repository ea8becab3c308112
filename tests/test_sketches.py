"""Mergeable percentiles and the first rows of an order, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nearmark.operators import selection, sketches
from nearmark.sources import datasets, synth

PER_MILLE = {"p1": 10, "p50": 500, "p95": 950, "p99_9": 999}


def test_merged_sketches_hold_their_error(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i % 3, rng.choice([-1, 1]) * math.exp(rng.gauss(0, 60))) for i in range(60_000)]
    log = spark.createDataFrame(rows + [("a", 0, None), ("a", 1, float("nan")), ("c", 2, None)], "request_type string, run int, value double")
    runs = [sketches.sketch(log.where(F.col("run") == i), ("request_type",), size=400) for i in range(3)]
    found = {r.request_type: r for r in sketches.percentiles(sketches.merge(*runs), PER_MILLE).collect()}
    assert sorted(found) == ["a", "b"]
    for kind, r in found.items():
        own = sorted(v for k, _, v in rows if k == kind)
        assert (r["count"], r["min"], r["max"]) == (len(own), own[0], own[-1])
        for name, p in PER_MILLE.items():
            assert abs(sum(v <= r[name] for v in own) / len(own) - p / 1000) <= 3 * sketches.rank_error(400)
    assert sketches.sketch(log.where("false"), ("request_type",)).count() == 0


def test_sketch_does_not_grow_with_the_log(spark):
    made = spark.range(400_000).select(F.lit("x").alias("request_type"), F.rand(1).alias("value"), (F.col("id") < 20_000).alias("few"))
    all_, few = (sketches.sketch(d, ("request_type",), size=200).select(F.octet_length("sketch")).first()[0] for d in (made, made.where("few")))
    assert all_ < 1.5 * few


@pytest.mark.parametrize("n", [1, 40, 300, 301, 699, 700, 5000])
@pytest.mark.parametrize("few", [1, 5, 1000])
def test_smallest_rows(spark, n, few):
    rng = random.Random(n)
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 1]
    values = [rng.choice([rng.randrange(-(1 << 63), 1 << 63), rng.randrange(-50, 50), rng.choice(edge)]) for _ in range(680)]
    rows = [(v, i) for i, v in enumerate(values + [None] * 20)]
    df = spark.createDataFrame(rows, "v bigint, id bigint").repartition(3)
    found = [(r.v, r.id) for r in selection.smallest(df, n, F.col("v"), "id", few).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [v for v, _ in found] == [v for v, _ in order[:n]] and len(set(found)) == len(found) and set(found) <= set(rows)
    if few == 1000:
        assert found == order[:n]


def test_many_rows_are_not_gathered(spark):
    df = spark.range(300_000).repartition(4).selectExpr("id", "id * 2 AS twice")
    picked = synth.sample_without_replacement(df, 100_000, 3)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan.split("Union")[0] and "CollectLimit" not in plan
    plain = df.orderBy(F.xxhash64(F.lit(3), F.col("id")), "id").limit(100_000)
    assert picked.exceptAll(plain).count() == 0 and picked.count() == 100_000
    assert [r.id for r in picked.limit(50).collect()] == [r.id for r in plain.limit(50).collect()]
    head = datasets.head(df, 70_000)
    assert head.agg(F.count("*"), F.max("id")).first()[:] == (70_000, 69_999)


def test_one_hot_value(spark):
    df = spark.range(3000).selectExpr("id", "7 AS v", "cast(null AS bigint) AS none")
    for order in ("v", "none"):
        out = selection.smallest(df, 1500, F.col(order), "id", 100)
        first = {r.id for r in out.collect()}
        assert len(first) == 1500 and first == {r.id for r in out.collect()}
