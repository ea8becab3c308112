import hashlib
import random

import numpy as np
import pytest

from nearmark.llm.centroids import Walk, cluster

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance double"


def plain(rows, k, rounds, dims, scale):
    """The clustering as it is stated, with Python's whole numbers."""
    kept = [
        (i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        homes = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), h in zip(kept, homes, strict=True) if h == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    inertia = {n: sum(d for _, h, d in found if h == n) for n in range(len(centroids))}
    return [
        (i, n, d, inertia[n], total, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found
    ]


def order(rows):
    return sorted(rows, key=repr)


def test_walk_finds_the_nearest_and_the_smaller_number():
    rng = np.random.default_rng(1)
    for dims, k, span in [(1, 1, 3), (2, 5, 2), (3, 40, 4), (8, 16, 1), (64, 16, 20), (64, 100, 3)]:
        c, x = rng.integers(-span, span + 1, (k, dims)), rng.integers(-span, span + 1, (3000, dims))
        home, best = Walk(c).nearest(x)
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (best == every.min(axis=1)).all() and (home == every.argmin(axis=1)).all()


@pytest.mark.parametrize("dims", [4, 64])
def test_same_as_stated(spark, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.9, 1.0]) for _ in range(dims)]) for i in range(300)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[3][1]), (None, rows[4][1])]
    odd = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None] + [0.5] * (dims - 1), [float("nan")] * dims, [float("inf")] * dims]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in cluster(df, dims=dims).collect()]
    assert order(got) == order(plain(rows, 16, 3, dims, 64))


def test_few_rows_and_none(spark):
    rows = [(1, [0.5, 0.25]), (2, [-0.5, 0.0]), (3, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert order(map(tuple, cluster(df, dims=2).collect())) == order(plain(rows, 16, 3, 2, 64))
    empty = cluster(df.where("vec_id > 9"), dims=2)
    assert empty.collect() == [] and empty.columns[:3] == ["vec_id", "cluster", "distance"]


def test_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], "x", 0.0)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        cluster(df, dims=2)
