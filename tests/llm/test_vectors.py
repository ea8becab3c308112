import numpy as np
import pytest

from nearmark.llm import vectors
from nearmark.llm.vectors import cells_of, choose, near_vectors, unit


def brute(rows, threshold=0.9):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    us = [np.array(v, float) if ok[i] else None for i, (_, v) in enumerate(rows)]
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(us[i]) == len(us[j]) and us[i] @ us[j] / np.sqrt((us[i] @ us[i]) * (us[j] @ us[j])) >= threshold] for i in range(n)]
    out = [None] * n
    for i in range(n):
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        keys = [rows[j][0] for j in group if rows[j][0] is not None]
        least = min(keys) if keys else None
        out[i] = (rows[i][0], len(near[i]), least, rows[i][0] == least)
    return out


def corpus(n=500, dims=16, groups=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    rows = []
    for i in range(n):
        v = centres[i % groups] + rng.normal(size=dims) * rng.choice([0.15, 0.3, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 5])]))
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * dims), (n + 5, [float("nan")] * dims)]
    rows += [(n + 6, [None, *rows[1][1][1:]]), (n + 7, [float("inf"), *rows[1][1][1:]]), (None, rows[7][1]), (None, [1.0] * dims), (3, rows[3][1]), (n + 8, [1.0, 2.0]), (n + 9, [2.0, 4.0]), (n + 10, [1e-38] * dims), (n + 11, [1e38] * dims)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return df.selectExpr("*", "1 AS key", "2 AS good", "3 AS h1")


@pytest.mark.parametrize(("part", "tile"), [(16 << 20, 1024), (3000, 7)])
def test_same_as_all_pairs(spark, monkeypatch, part, tile):
    monkeypatch.setattr(vectors, "PART_BYTES", part)
    monkeypatch.setattr(vectors, "TILE", tile)
    df = frame(spark, corpus())
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, near_vectors(df).collect()), key=order) == sorted(brute(rows), key=order)
    assert near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cells_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    x = unit(np.repeat(rng.normal(size=(40, 12)), 25, axis=0) + rng.normal(size=(1000, 12)) * 0.4)
    centroids = choose(x, 0.9)
    home, visits = cells_of(x, centroids, 0.9)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(centroids) > 1 and len(i) > 100
    assert ((home[i] == home[j]) | visits[i, home[j]] | visits[j, home[i]]).all()
    assert not (visits[i, home[j]] & visits[j, home[i]]).any()
