"""What tasks hold and what is copied stays bounded, however large the answers."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearmark.operators import knn as joins
from nearmark.operators.knn import Match, knn
from nearmark.operators.skew import cuts


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).tolist(), i % 4 + 1, i % 3) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, values array<double>, step int, space int").repartition(5)


def shown(df):
    return sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())


def asked(vectors, k=3):
    return vectors.select(F.col("id").alias("query_id"), "values", F.lit(k).alias("top_k"), "step", "space", (F.col("id") * 2).alias("at"))


@pytest.mark.parametrize("match", [Match(), Match(step=True), Match(by=("space",), step=True)])
def test_both_sides_of_a_grid_may_come_from_one_table(vectors, match):
    q = asked(vectors)
    want = shown(knn(vectors, q, "euclidean", match, strategy="records"))
    assert shown(knn(vectors, q, "euclidean", match, strategy="grid", block_bytes=2000)) == want


def test_deep_answers_are_counted_and_cut(vectors):
    q = asked(vectors, 5000)
    assert joins._collect_within(q, 1 << 20, forced=False) is None
    assert joins._collect_within(asked(vectors), 1 << 20, forced=False) is not None
    batch = pa.record_batch({"top_k": pa.array([100_000] * 10 + [1] * 50, pa.int32())})
    parts = list(joins._slices(batch, 90_000))
    assert [p.num_rows for p in parts] == [3, 3, 3, 51]
    assert len(shown(knn(vectors, q, "euclidean", budget=1 << 17))) == 300 * 300


def test_copies_of_a_grid_are_few(vectors):
    parts = lambda **o: cuts(vectors, [], 1, "n", 8 * F.size("values"), **o).first()["n"]
    assert parts() == 300
    assert parts(most=16, least=1 << 20) == 16
    assert parts(most=16, least=64) == 150


def test_as_of_meets_the_states_of_its_time_alone(vectors):
    rows = vectors.withColumn("valid_from", F.col("id") * 2).withColumn("valid_to", F.when(F.col("id") % 7 > 0, F.col("id") * 2 + 9))
    rows = rows.unionByName(rows.limit(1).withColumn("id", F.lit(999).cast("bigint")).withColumn("valid_from", F.lit(None).cast("bigint")))
    q = asked(vectors).unionByName(asked(vectors).limit(1).withColumn("query_id", F.lit(999).cast("bigint")).withColumn("at", F.lit(None).cast("bigint")))
    want = shown(knn(rows, q, "euclidean", Match(as_of=True), strategy="records"))
    assert want and max(x[0] for x in want) < 999
    assert shown(knn(rows, q, "euclidean", Match(as_of=True), strategy="grid", block_bytes=2000)) == want
    left, right = joins._by_time(rows.where("valid_from IS NOT NULL"), q.where("at IS NOT NULL"), 2000)
    # Most states live for a moment: they go to few of the many ranges.
    assert right.select("_t").distinct().count() > 4
    assert left.where("valid_to IS NOT NULL").count() < 2 * 300


def test_codes_measure_block_by_block(spark, vectors):
    """Candidates are not listed where all are wanted, and portions of queries do not multiply with the codebooks."""
    from nearmark import session
    from nearmark.operators import quantise

    books = quantise.fit_codebooks(vectors, "cosine", parts=4, codes=16)
    codes = session.stored(quantise.encode(vectors.select("id", "values"), books, "cosine"), "codes")
    before = len(session._HANDED[spark.sparkContext.applicationId])
    found = quantise.pq_search(vectors, codes, books, asked(vectors), "cosine", times=100)
    assert shown(found) == shown(knn(vectors, asked(vectors), "cosine"))
    assert not any("candidates" in p for p in session._HANDED[spark.sparkContext.applicationId][before:])
    near = quantise.candidates(codes, books, asked(vectors), "cosine", 4, budget=1 << 17)
    # One scan of the codes, whatever the budget, and the sums over parts decide.
    assert near._jdf.queryExecution().executedPlan().toString().count("Union") <= 1
    entries = quantise._books(books)
    code = {r["id"]: r["code"] for r in codes.collect()}
    x = {r["id"]: np.array(r["values"]) for r in vectors.collect()}
    got = {}
    for r in near.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    for q in (0, 17, 299):
        unit = x[q] / np.linalg.norm(x[q])
        score = {i: sum(((unit[j : j + 1] - entries[j][c[j]]) ** 2).sum() for j in range(4)) for i, c in code.items()}
        edge = sorted(score.values())[11]
        assert len(got[q]) == 12 and all(score[i] <= edge + 1e-12 for i in got[q])


@pytest.fixture
def small_blocks(monkeypatch):
    """Sizes so small that records are held and deep answers are measured whole."""
    from nearmark.operators import blocks

    monkeypatch.setattr(joins, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(joins, "MOST_CUTS", 3)
    monkeypatch.setattr(joins, "HELD_CELLS", 4)
    monkeypatch.setattr(blocks, "DENSE_PAIRS", 20)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dotproduct"])
def test_deep_answers_are_not_shuffled(vectors, small_blocks, metric):
    """Where answers outweigh the records, pairs leave their task ranked; damaged records come last, by id."""
    last = F.when(F.col("id") % 3 == 0, F.element_at("values", -1)).otherwise(F.lit(float("nan")))
    rows = vectors.withColumn("values", F.concat(F.slice("values", 1, 3), F.array(last)))
    rows = rows.unionByName(rows.where("id = 3").withColumn("id", F.lit(400).cast("bigint")))
    q = asked(rows, 105).withColumn("top_k", F.when(F.col("query_id") % 5 == 0, 4).otherwise(105))
    found = knn(rows, q, metric, strategy="grid", block_bytes=2000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    x = {r["id"]: np.array(r["values"]) for r in rows.collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    for j in (0, 3, 9, 400, 1):
        a, away = x[j], {}
        for i, b in x.items():
            if metric == "euclidean":
                away[i] = np.sqrt(((b - a) ** 2).sum())
            else:
                away[i] = -(a * b).sum() if metric == "dotproduct" else 1 - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())
        want = sorted(away, key=lambda i: (np.isnan(away[i]), 0.0 if np.isnan(away[i]) else round(away[i], 12), i))
        rows_of = sorted(got[j])
        assert [r for r, _, _ in rows_of] == list(range(1, len(rows_of) + 1)) and len(rows_of) == (4 if j % 5 == 0 else 105)
        assert [i for _, i, _ in rows_of] == want[: len(rows_of)]
        assert np.isnan([d for *_, d in rows_of]).sum() == (0 if len(rows_of) == 4 else 105 if j == 1 else 4)


def test_records_are_copied_a_few_times_for_long_answers(vectors, small_blocks):
    q = asked(vectors, 40)
    # Blocks of queries with their answers would copy the records more than 500 times.
    assert joins._held_cuts(vectors, q, 300, 2000) == (1, 4)
    assert joins._held_cuts(vectors, q, 300, 2000, held_bytes=4000) == (3, 3)
    want = shown(knn(vectors, q, "cosine", strategy="records"))
    assert len(want) == 300 * 40
    found = knn(vectors, q, "cosine", strategy="grid", block_bytes=2000)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert shown(found) == want


def test_stripes_are_held_step_by_step(vectors, small_blocks, monkeypatch):
    """Many queries of steps: records in three stripes, each copied a few times, give the answer of the whole."""
    q = asked(vectors, 7)
    monkeypatch.setattr(joins, "HELD_BYTES", 4000)
    assert joins._held_cuts(vectors, q, 300, 2000, joins.HELD_BYTES) == (3, 3)
    want = shown(knn(vectors, q, "cosine", Match(step=True), strategy="records"))
    found = joins._held_grid(vectors.select("id", "values", "step"), q.select("query_id", "values", "top_k", "step"), "cosine", Match(step=True), 3, 3)
    assert shown(found) == want
    assert shown(knn(vectors, q, "cosine", Match(step=True), strategy="grid", block_bytes=2000)) == want
