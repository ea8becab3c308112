import random
import re
import time

import numpy as np
import pytest

from nearmark.llm import neardup
from nearmark.llm.graph import components
from nearmark.llm.neardup import drop_near_duplicates, fewest_matches, join_all, near_duplicates, signatures


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and (len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) if sets[i] or sets[j] else True)] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        keys = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = (rows[j][0], min(keys) if keys else None, len(linked[j]))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(300))
    rows, key = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 90, 300]))]
        if rng.random() < 0.3:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((key, rng.choice([" ", "\n", "  "]).join(text)))
            key += 1
    rows += [(key, None), (key + 1, ""), (key + 2, " \n"), (None, rows[0][1]), (3, rows[3][1]), (None, "odd words only here"), (None, "odd words only here")]
    return rows


@pytest.mark.parametrize(("part", "size"), [(4096, 2_000_000), (3, 100)])
def test_same_as_all_pairs(spark, documents, monkeypatch, part, size):
    monkeypatch.setattr(neardup, "BUCKET_PART", part)
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", size)
    rows = corpus()
    got = near_duplicates(documents(rows, ["key", "digest", "id"])).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2])
    assert sorted(map(tuple, got), key=order) == sorted(brute(rows), key=order)


def test_one_row_of_each_class_stays(spark, documents):
    rows = corpus(1)
    df = documents(rows, ["_key", "_hash", "_place"])
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    classes = {}
    for (key, text), (_, least, _) in zip(rows, brute(rows), strict=True):
        classes.setdefault(least if least is not None else ("none", text), []).append(key)
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted((c if not isinstance(c, tuple) else None for c in classes), key=str)
    assert drop_near_duplicates(df.where("false")).count() == 0
    assert near_duplicates(df.where("false")).count() == 0


def test_large_group_of_near_copies(spark, documents):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(700):
        text = list(base)
        text[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    started = time.time()
    got = near_duplicates(documents(rows)).collect()
    assert {r["class_id"] for r in got} == {0} and len(got) == 700
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert time.time() - started < 300


def test_signatures_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        common = int(2000 * share)
        h = rng.integers(0, 2**64, 4000, dtype=np.uint64)
        a, b = h[:2000], np.concatenate([h[:common], h[2000 : 4000 - common]])
        signs = signatures(np.concatenate([a, b]), np.array([0, 2000, 2000, 4000]), 2000)
        assert abs((signs[0] == signs[2]).mean() - common / (4000 - common)) < 0.04
        assert not signs[1].any()


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = fewest_matches()
    rng = np.random.default_rng(1)
    agree = rng.random((200_000, neardup.HASHES)) < 0.8
    counts = agree.cumsum(axis=1)[:, neardup.STEP - 1 :: neardup.STEP]
    assert (counts >= np.array(fewest)).all(axis=1).mean() > 0.9999
    assert fewest[-1] > 100


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = np.arange(400)
    join_all(root, np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    touched = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: int(root[v]) for v in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stars_take_no_step_and_no_plan_holds_two(spark, monkeypatch):
    from nearmark.llm import graph

    plans, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    stars = [(9, 1), (7, 1), (1, 7), (8, 2), (2, 2)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(stars, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 2, 7: 1, 8: 2, 9: 1} and len(plans) == 1
    path = [(i, i + 1) for i in range(30)]
    assert {r["root"] for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()} == {0}
    assert len(plans) > 3 and max(p.count("Join") for p in plans) == 1
