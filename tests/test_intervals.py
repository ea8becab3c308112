import random

import pytest
from pyspark.sql import functions as F

from nearmark.operators.intervals import rooted, tiled
from nearmark.operators.knn import Match, knn


def rows(rng, n, span):
    out = []
    for i in range(n):
        a = rng.randrange(span)
        out.append((i, a, rng.choice([None, a, a + 1, a + rng.randrange(1, span)])))
    return out


@pytest.mark.parametrize("low, span", [(0, 3), (-7, 20), (1 << 40, 1000)])
def test_one_shared_tile_where_an_interval_holds_a_point(spark, low, span):
    rng = random.Random(span)
    states = [(i, a + low, None if b is None else b + low) for i, a, b in rows(rng, 80, span)] + [(900, None, None)]
    points = [(j, low + j - 2) for j in range(0, 2 * span + 4, max(1, span // 40))] + [(-1, None)]
    s = spark.createDataFrame(states, "id int, valid_from bigint, valid_to bigint")
    q = spark.createDataFrame(points, "query_id int, at bigint")
    left, right = tiled(s, q)
    assert left.agg(F.max(F.size("list_id"))).first()[0] <= 2 * (2 * span).bit_length() + 2
    met = left.select("id", F.explode("list_id").alias("t")).join(right.select("query_id", F.explode("lists").alias("t")), "t")
    got = sorted((r["query_id"], r["id"]) for r in met.collect())
    want = sorted((j, i) for j, at in points for i, a, b in states if at is not None and a is not None and a <= at and (b is None or at < b))
    assert got == want


def test_neighbours_as_of(spark):
    rng = random.Random(4)
    held = [(i, a, b, [rng.random(), rng.random()], i % 2) for i, a, b in rows(rng, 120, 50)]
    s = spark.createDataFrame(held, "id int, valid_from bigint, valid_to bigint, values array<double>, space int").repartition(3)
    q = spark.createDataFrame([(j, j - 3, [rng.random(), rng.random()], 4, j % 2) for j in range(70)], "query_id int, at bigint, values array<double>, top_k int, space int")
    show = lambda df: sorted(map(tuple, df.collect()))
    for by in ((), ("space",)):
        want = show(knn(s, q, "euclidean", Match(as_of=True, by=by)))
        for strategy in ("queries", "records", "grid"):
            assert show(knn(*tiled(s, q), "euclidean", Match(lists=True, by=by), strategy=strategy, block_bytes=512)) == want


def test_empty(spark):
    s = spark.createDataFrame([], "id int, valid_from bigint, valid_to bigint")
    q = spark.createDataFrame([(1, 5)], "query_id int, at bigint")
    left, right = tiled(s, q)
    assert left.collect() == [] and right.count() == 1


def test_tiles_below_roots(spark):
    """A state is sent once per root that it lives in, not once per tile."""
    rng = random.Random(9)
    held = [(i, a, b, [rng.random(), rng.random()], i % 2) for i, a, b in rows(rng, 150, 400)] + [(900, None, None, [0.0, 0.0], 0)]
    s = spark.createDataFrame(held, "id int, valid_from bigint, valid_to bigint, values array<double>, space int").repartition(3)
    points = [(j, 2 * j - 3, [rng.random(), rng.random()], 4, j % 2) for j in range(220)] + [(999, None, [0.0, 0.0], 4, 0)]
    q = spark.createDataFrame(points, "query_id int, at bigint, values array<double>, top_k int, space int")
    show = lambda df: sorted(map(tuple, df.collect()))
    want = show(knn(s, q, "euclidean", Match(as_of=True, by=("space",)), strategy="records"))
    for moments in (1, 20, 10_000):
        left, right = rooted(s, q, moments=moments)
        for strategy in ("queries", "records", "grid"):
            match = Match(by=("space", "root"), lists=True, nested=True)
            assert show(knn(left, right, "euclidean", match, strategy=strategy, block_bytes=2000)) == want
    left, right = rooted(s, q, moments=20)
    roots = right.select("root").distinct().count()
    assert 5 < roots < 50 and left.count() <= roots * s.count()
    tiles = left.agg(F.sum(F.size("list_id"))).first()[0]
    assert left.count() < tiles
    assert rooted(s.limit(0), q)[0].count() == 0 and rooted(s, q.limit(0))[1].count() == 0


def test_pairs_of_short_lists_come_together():
    """Lists of few pairs are not scored one by one."""
    import numpy as np
    import pyarrow as pa

    from nearmark.operators import blocks

    rng = np.random.default_rng(5)
    lists = lambda n: pa.array([sorted(set(rng.integers(0, 400, 5).tolist()) | {1000}) for _ in range(n)], pa.list_(pa.int64()))
    vectors = lambda n: pa.array(rng.normal(size=(n, 3)).tolist(), pa.list_(pa.float64()))
    q = blocks.Queries(pa.table({"query_id": np.arange(90), "values": vectors(90), "top_k": pa.array([3] * 90, pa.int32()), "lists": lists(90)}), "euclidean", lists=True)
    table = pa.table({"id": np.arange(70), "values": vectors(70), "list_id": lists(70)})
    every = sorted((a, b) for qi, ri in q.tiles(table) for a in qi.tolist() for b in ri.tolist())
    tiles, pairs = q.met(table)
    tiles, pairs = list(tiles), list(pairs)
    assert len(tiles) == 1 and len(pairs) == 1
    assert sorted([(a, b) for qi, ri in tiles for a in qi.tolist() for b in ri.tolist()] + [(a, b) for qi, ri in pairs for a, b in zip(qi.tolist(), ri.tolist())]) == every


def test_time_is_cut_for_many_tasks(spark):
    """Few searches over many states are work for more than one task; a product needs some length."""
    from nearmark.operators import knn as joins

    rng = random.Random(2)
    held = [(i, a, b, [rng.gauss(0, 1 + 4 * (i % 5)) for _ in range(3)]) for i, a, b in rows(rng, 200, 300)]
    s = spark.createDataFrame(held, "id int, valid_from bigint, valid_to bigint, values array<double>").repartition(3)
    q = spark.createDataFrame([(j, j, [rng.gauss(0, 1) for _ in range(3)], 4) for j in range(300)], "query_id int, at bigint, values array<double>, top_k int")
    assert joins._by_time(s, q, 64 << 20)[1].select("_t").distinct().count() > 4
    show = lambda df: sorted(map(tuple, df.collect()))
    got = show(knn(s, q, "dotproduct", Match(as_of=True), strategy="grid"))
    x = {j: v for j, _, v, _ in q.collect()}
    for j in (0, 50, 299):
        seen = [(-sum(a * b for a, b in zip(x[j], v)), i) for i, a, b, v in held if a <= j and (b is None or j < b)]
        assert [r[2] for r in got if r[0] == j] == [i for _, i in sorted(seen)[:4]]
