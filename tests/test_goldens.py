"""Published example values: neighbours, scores, filters."""

import pytest
from pyspark.sql import functions as F

from nearmark.functions import scoring
from nearmark.functions.filters import required_tags, with_required
from nearmark.operators.flat import score_flat
from nearmark.operators.knn import attach_neighbours, knn, neighbour_lists

RECORDS = [
    ("a", [2.0, 0.0, 0.0]), ("b", [0.0, 1.9, 0.0]), ("c", [5.0, 5.0, 0.0]),
    ("d", [-1.0, 0.0, 2.0]), ("e", [-0.1, 5.0, 5.1]), ("f", [0.0, 2.0, 2.1]),
]
QUERIES = [(0, [10.0, 0.5, 0.0], 3), (1, [-1.0, 0.2, 1.0], 3), (2, [0.0, 5.2, 2.1], 2)]
NEIGHBOURS = {
    "cosine": ["acb", "def", "be"],
    "dotproduct": ["cae", "edf", "ec"],
    "euclidean": ["cab", "dbf", "ef"],
}


@pytest.mark.parametrize("metric", NEIGHBOURS)
@pytest.mark.parametrize("strategy", ["queries", "records", "grid"])
def test_neighbours(spark, metric, strategy):
    records = spark.createDataFrame(RECORDS, "id string, values array<double>")
    queries = spark.createDataFrame(QUERIES, "query_id int, values array<double>, top_k int")
    lists = attach_neighbours(queries, knn(records, queries, metric, strategy=strategy))
    got = {r["query_id"]: "".join(r["neighbors"]) for r in lists.collect()}
    assert [got[i] for i in range(3)] == NEIGHBOURS[metric]


def score_one(spark, metric, actual, expected, k=100):
    row = spark.createDataFrame(
        [(list(actual), list(expected), k)], "actual array<string>, neighbors array<string>, top_k int"
    )
    return scoring.score(row, metrics={"m": metric}).first()["m"]


@pytest.mark.parametrize(
    "actual, expected, k, value",
    [("2345", "1234", 100, 0.75), ("1", "1234", 100, 0.25), ("2", "12", 1, 0.0), ("", "", 9, 1.0), ("1", "", 9, 0.0), ("", "1", 9, 0.0)],
)
def test_recall(spark, actual, expected, k, value):
    assert score_one(spark, scoring.recall, actual, expected, k) == value


PRECISION = [
    ("13", "12", 0.75), ("31", "12", 0.25), ("12", "21", 0.5), ("2345", "1234", 0.479166), ("ab", "abcdef", 1.0),
    ("ax", "abcdef", 0.75), ("bac", "abcdef", 0.666666), ("cba", "abcdef", 0.5), ("adcb", "abcdef", 0.791666),
    ("abcfed", "abcdef", 0.925), ("fedcba", "abcdef", 0.383333), ("azbdfx", "abcdef", 0.697222),
    ("", "", 1.0), ("1", "", 0.0), ("", "1", 0.0),
]


@pytest.mark.parametrize("actual, expected, value", PRECISION)
def test_average_precision(spark, actual, expected, value):
    assert score_one(spark, scoring.average_precision, actual, expected) == pytest.approx(value, abs=1e-5)


@pytest.mark.parametrize("actual, expected, value", [("31", "12", 0.5), ("2345", "9615", 0.25), ("", "1", 0.0), ("12", "234", 0.5)])
def test_reciprocal_rank(spark, actual, expected, value):
    assert score_one(spark, scoring.reciprocal_rank, actual, expected) == value


@pytest.mark.parametrize("actual, expected, value", [("1", "12", 1.0), ("13", "2", 0.0), ("123", "3", 1.0), ("", "1", 0.0)])
def test_recall_at_min(spark, actual, expected, value):
    assert score_one(spark, scoring.recall_at_min, actual, expected) == value


def test_no_ground_truth_no_score(spark):
    row = spark.createDataFrame([(["1"], None, 3)], "actual array<string>, neighbors array<string>, top_k int")
    scored = scoring.score(row)
    assert scored.select(*scoring.METRICS).first() == (None, None, None)
    assert scoring.score_long(scored.withColumn("q", F.lit(1)), ["q"]).count() == 0


def test_registered_metric(spark):
    scoring.register("hit", lambda a, e: F.arrays_overlap(a, e).cast("double"))
    try:
        row = spark.createDataFrame([(["1", "2"], ["2"], 3)], "actual array<string>, neighbors array<string>, top_k int")
        assert scoring.score(row).first()["hit"] == 1.0
    finally:
        del scoring.METRICS["hit"]


def test_flat_and_array_scores_agree(spark):
    def flat(name):
        rows = [(q, i + 1, x) for q, case in enumerate(PRECISION) for i, x in enumerate(case[name])]
        return spark.createDataFrame(rows, "query_id int, rank int, id string")

    queries = spark.createDataFrame([(q, 4) for q in range(len(PRECISION))], "query_id int, top_k int")
    arrays = spark.createDataFrame(
        [(q, list(a), list(e), 4) for q, (a, e, _) in enumerate(PRECISION)],
        "query_id int, actual array<string>, neighbors array<string>, top_k int",
    )
    want = {r["query_id"]: r for r in scoring.score(arrays).collect()}
    got = {r["query_id"]: r for r in score_flat(flat(0), flat(1), queries).collect()}
    for q in range(len(PRECISION)):
        for name in scoring.METRICS:
            assert got[q][name] == pytest.approx(want[q][name]), (q, name)


def test_neighbour_lists_keep_rank_order(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (1, 3, "b")], "query_id int, rank int, id string")
    assert neighbour_lists(rows).first()["neighbors"] == ["z", "a", "b"]


@pytest.mark.parametrize(
    "text, tags",
    [
        (None, None), ("null", None), ('{"tags": "4244"}', ["4244"]),
        ('{"$and": [{"tags": "123"}, {"tags": "126"}]}', ["123", "126"]),
        ('{"$and": [{"$and": [{"tags": "1"}, {"tags": "2"}]}, {"tags": "3"}]}', ["1", "2", "3"]),
        ('{"$and": [{"tags": "a\\"b"}, {"tags": "a\\"b"}]}', ['a"b']),
    ],
)
def test_filter_tags(text, tags):
    assert required_tags(text) == tags


@pytest.mark.parametrize(
    "text", ['{"$and": [{"tags": "1"}]}', '{"label": "1"}', '{"tags": "1", "x": "2"}', "[]", "{", '{"tags": 3}']
)
def test_malformed_filters(spark, text):
    with pytest.raises(ValueError):
        required_tags(text)
    asked = spark.createDataFrame([(text,)], "filter string")
    assert with_required(asked, on_error="keep").first()["filter_error"]
    with pytest.raises(Exception, match="malformed filter"):
        with_required(asked).collect()
