"""Neighbour joins against brute force, in every physical shape."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearmark.functions.distance import distance, literal_vector
from nearmark.functions.filters import contains, filter_predicate
from nearmark.operators import ivf
from nearmark.operators.knn import Match, knn, rerank, search
from nearmark.operators.postings import knn_by_postings, tag_counts

DIMS = 8


def brute(records, queries, metric, allowed):
    out = []
    for q in queries:
        found = []
        for r in records:
            if not allowed(r, q):
                continue
            a, b = np.array(r["values"]), np.array(q["values"])
            if metric == "euclidean":
                d = float(np.sqrt(((a - b) ** 2).sum()))
            elif metric == "dotproduct":
                d = float(-(a * b).sum())
            else:
                n = np.sqrt((a**2).sum()) * np.sqrt((b**2).sum())
                d = float(1 - (a * b).sum() / n) if n else float("nan")
            found.append((np.isnan(d), d, r["id"]))
        found.sort(key=lambda t: (t[0], 0 if t[0] else t[1], t[2]))
        out += [(q["query_id"], i + 1, t[2]) for i, t in enumerate(found[: q["top_k"]])]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    """A third of the records are copies of one vector, and share a namespace."""
    rng = np.random.default_rng(5)
    records, queries = [], []
    for i in range(240):
        v = [1.0] * DIMS if i % 3 == 0 else rng.integers(-4, 5, DIMS).astype(float).tolist()
        if i in (7, 8, 100):
            v = [0.0] * DIMS
        tags = None if i % 17 == 0 else [str(i % 5), f"m{i % 3}"]
        records.append({
            "id": f"r{i:03d}", "values": v, "tags": tags, "namespace": None if i % 13 == 1 else 0 if i % 3 == 0 else i % 4,
            "step": i // 60, "valid_from": i, "valid_to": None if i % 4 == 0 else i + 50,
        })
    for i in range(40):
        v = [0.0] * DIMS if i == 3 else rng.integers(-4, 5, DIMS).astype(float).tolist()
        required = [None, [str(i % 5)], [str(i % 5), "m1"], ["none"], []][i % 5]
        queries.append({
            "query_id": i, "values": v, "top_k": [1, 5, 20, 500][i % 4], "required": required,
            "namespace": None if i % 9 == 4 else i % 5, "step": i % 4, "at": i * 6,
        })
    r = spark.createDataFrame(
        records,
        "id string, values array<double>, tags array<string>, namespace int, step int, valid_from bigint, valid_to bigint",
    )
    q = spark.createDataFrame(
        queries,
        "query_id int, values array<double>, top_k int, required array<string>, namespace int, step int, at bigint",
    )
    return records, queries, r.repartition(5), q


def same(r, q):
    """A null namespace matches nothing, not even another."""
    return r["namespace"] is not None and r["namespace"] == q["namespace"]


ALLOWED = {
    "all": (Match(), lambda r, q: True),
    "namespace": (Match(by=("namespace",)), lambda r, q: same(r, q)),
    "tags": (Match(tags=True), lambda r, q: set(q["required"] or []) <= set(r["tags"] or [])),
    "step": (Match(step=True), lambda r, q: r["step"] <= q["step"]),
    "as_of": (
        Match(as_of=True),
        lambda r, q: r["valid_from"] <= q["at"] and (r["valid_to"] is None or q["at"] < r["valid_to"]),
    ),
    "namespace and tags": (
        Match(by=("namespace",), tags=True),
        lambda r, q: same(r, q) and set(q["required"] or []) <= set(r["tags"] or []),
    ),
}


def triples(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


CASES = [("euclidean", c) for c in ALLOWED] + [
    (m, c) for m in ("cosine", "dotproduct") for c in ("all", "namespace and tags")
]


@pytest.mark.parametrize("metric, case", CASES)
def test_shapes_agree_with_brute_force(data, metric, case):
    records, queries, r, q = data
    match, allowed = ALLOWED[case]
    want = brute(records, queries, metric, allowed)
    assert triples(knn(r, q, metric, match, strategy="queries")) == want
    assert triples(knn(r, q, metric, match, strategy="records")) == want
    # Blocks of 16 rows: the hot namespace is cut into several.
    assert triples(knn(r, q, metric, match, strategy="grid", block_bytes=16 * 8 * DIMS)) == want
    part = r.where(F.col("id") < "r090")
    assert triples(knn(r, q, metric, match, strategy="queries", bound_from=part)) == want


def test_auto_falls_back_when_nothing_fits(data):
    records, queries, r, q = data
    want = brute(records, queries, "euclidean", lambda r, q: True)
    assert triples(knn(r, q, "euclidean", budget=8 * DIMS * 10, block_bytes=64 * 8 * DIMS)) == want
    with pytest.raises(ValueError, match="grid"):
        knn(r, q, "euclidean", strategy="queries", budget=8 * DIMS * 10)
    # Strings and lists count, not only vectors.
    tagged = q.withColumn("required", F.array(F.lit("t" * 5000)))
    with pytest.raises(ValueError, match="grid"):
        knn(r, tagged, "euclidean", Match(tags=True), strategy="queries", budget=40 * 4000)


def test_near_ties_are_ranked_exactly(spark):
    """Distances that differ by less than one matrix product can resolve."""
    base = [1e6 + i for i in range(DIMS)]
    records = [(i, [*base[:-1], base[-1] + (50 - i) * 1e-7]) for i in range(50)]
    r = spark.createDataFrame(records, "id int, values array<double>")
    q = spark.createDataFrame([(0, base, 5)], "query_id int, values array<double>, top_k int")
    for strategy in ("queries", "records", "grid"):
        got = [x["id"] for x in knn(r, q, "euclidean", strategy=strategy).orderBy("rank").collect()]
        assert got == [49, 48, 47, 46, 45]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dotproduct"])
@pytest.mark.parametrize("where", [0, 3, 59])
def test_damaged_vectors_rank_last_and_cost_no_other(spark, metric, where):
    """NaN, infinite and huge elements, in the first and in later batches, on both sides."""
    rng = np.random.default_rng(where)
    records = [{"id": i, "values": rng.integers(-4, 5, DIMS).astype(float).tolist(), "step": i % 3} for i in range(60)]
    queries = [{"query_id": i, "values": rng.integers(-4, 5, DIMS).astype(float).tolist(), "top_k": [3, 58, 80][i % 3], "step": i % 3} for i in range(9)]
    records[where]["values"][2] = float("nan")
    records[(where + 1) % 60]["values"][0] = float("inf")
    records[(where + 2) % 60]["values"][1] = 1e200
    queries[4]["values"][5] = float("nan")
    r = spark.createDataFrame(records, "id int, values array<double>, step int").coalesce(1)
    q = spark.createDataFrame(queries, "query_id int, values array<double>, top_k int, step int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for match, allowed in ((Match(), lambda r, q: True), (Match(step=True), lambda r, q: r["step"] <= q["step"])):
            with np.errstate(all="ignore"):
                want = brute(records, queries, metric, allowed)
            for strategy in ("queries", "records", "grid"):
                assert triples(knn(r, q, metric, match, strategy=strategy, block_bytes=16 * 8 * DIMS)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("strategy", ["queries", "records", "grid"])
def test_missing_elements_are_refused(spark, strategy):
    r = spark.createDataFrame([(1, [1.0, 2.0]), (2, [None, 1.0])], "id int, values array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0], 1)], "query_id int, values array<double>, top_k int")
    with pytest.raises(Exception, match="must not miss elements"):
        knn(r, q, "euclidean", strategy=strategy).collect()


@pytest.mark.parametrize("bad", [None, [1.0]])
def test_broken_vectors_are_refused(spark, bad):
    r = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "id int, values array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0], 1)], "query_id int, values array<double>, top_k int")
    with pytest.raises(Exception, match="of one length"):
        knn(r, q, "euclidean").collect()


def test_hot_key_is_cut_into_bounded_cells(data, spark):
    from nearmark.operators.skew import cuts

    _, _, r, _ = data
    listed = {x["namespace"]: x["n"] for x in cuts(r, ["namespace"], 40, "n").collect()}
    assert listed[0] >= 3  # over half the rows
    assert all(n > 1 for n in listed.values())


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dotproduct"])
def test_jvm_distance_agrees(data, metric):
    records, queries, r, q = data
    asked = queries[1]
    want = [t[2] for t in brute(records, [dict(asked, top_k=9)], metric, lambda r, q: True)]
    got = search(r, asked["values"], 9, metric)
    assert [x["id"] for x in got.collect()] == want
    zero = r.select(distance(metric, "values", literal_vector([0.0] * DIMS)).alias("d")).first()["d"]
    assert zero == zero or metric == "cosine"


def test_rerank(data):
    records, queries, r, q = data
    everything = knn(r, q.withColumn("top_k", F.lit(1000)), "euclidean")
    want = brute(records, queries, "cosine", lambda r, q: True)
    got = triples(rerank(everything, r, q, "cosine"))
    keep = {(a, b) for a, b, _ in want}
    assert {(a, b) for a, b, _ in got} == keep


def test_postings(data):
    records, queries, r, q = data
    _, allowed = ALLOWED["tags"]
    want = brute(records, queries, "euclidean", allowed)
    assert triples(knn_by_postings(r, q, "euclidean")) == want
    assert triples(knn_by_postings(r, q, "euclidean", strategy="grid", block_bytes=16 * 8 * DIMS)) == want
    counts = {x["tag"]: x["records"] for x in tag_counts(r).collect()}
    assert counts["m1"] == sum("m1" in (x["tags"] or []) for x in records)


def test_literal_filter_predicate(spark):
    rows = [
        (1, '{"tags": ["1", "2"], "n": [1, 2]}'), (2, '{"tags": ["1"]}'), (3, None), (4, '{"tags": "1"}'),
        (5, '{"n": ["1"]}'),
    ]
    df = spark.createDataFrame(rows, "id int, metadata string")

    def ids(predicate):
        return [r["id"] for r in df.where(predicate).orderBy("id").collect()]

    m = F.col("metadata")
    assert ids(filter_predicate(None, m)) == [1, 2, 3, 4, 5]
    assert ids(filter_predicate('{"tags": "1"}', m)) == [1, 2]
    assert ids(filter_predicate('{"$and": [{"tags": "1"}, {"tags": "2"}]}', m)) == [1]
    assert ids(contains(m, "n", 1)) == [1]
    assert ids(contains(m, "n", "1")) == [5]


def clustered(spark, n=600, centres=12):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(centres, DIMS)) * 10
    rows = [(i, (middle[i % centres] + rng.normal(size=DIMS)).tolist()) for i in range(n)]
    r = spark.createDataFrame(rows, "id int, values array<double>")
    return r, r.where("id < 60").select(F.col("id").alias("query_id"), "values", F.lit(10).alias("top_k"))


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dotproduct"])
def test_ivf(spark, metric):
    r, q = clustered(spark)
    centroids = ivf.fit_centroids(r, 12, metric, seed=1).cache()
    assigned = ivf.assign_lists(r, centroids, metric)
    assert triples(ivf.assign_lists(r, centroids, metric, budget=1).select(
        F.col("id").alias("query_id"), F.col("list_id").alias("id"), F.lit(1).alias("rank"))) == triples(
        assigned.select(F.col("id").alias("query_id"), F.col("list_id").alias("id"), F.lit(1).alias("rank")))
    exact = set(triples(knn(r, q, metric)))
    assert set(triples(ivf.ivf_search(assigned, centroids, q, metric, 12))) == exact
    recalls = []
    swept = ivf.probe_sweep(assigned, centroids, q, metric, [1, 4, 12]).collect()
    truth = {(a, c) for a, _, c in exact}
    for p in (1, 4, 12):
        found = {(x["query_id"], x["id"]) for x in swept if x["probes"] == p}
        recalls.append(len(found & truth) / len(truth))
        if p == 4:
            same = triples(ivf.ivf_search(assigned, centroids, q, metric, 4))
            assert sorted((x["query_id"], x["rank"], x["id"]) for x in swept if x["probes"] == 4) == same
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    if metric != "dotproduct":
        assert recalls[1] >= 0.9


def test_lists_on_disk_are_pruned(spark, tmp_path):
    r, q = clustered(spark)
    centroids = ivf.fit_centroids(r, 12, "euclidean", seed=1).cache()
    path = str(tmp_path / "lists")
    ivf.write_lists(ivf.assign_lists(r, centroids, "euclidean"), path)
    stored = spark.read.parquet(path)
    one = q.limit(1)
    found = ivf.ivf_search(stored, centroids, one, "euclidean", 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ = \d+", plan)
    assert found.count() == 10


def test_index_sizes():
    assert ivf.default_lists(10) == 1
    assert ivf.default_lists(1_000_000) == 1000
    assert ivf.default_lists(10_000_000) == 3162
    assert ivf.default_probes(1000) == 31
