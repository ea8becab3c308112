"""Ranges, splits, corpus splits, log replay, readers and writers."""

import bisect
import json
import random
from math import ceil

import os

import pytest
from pyspark.sql import functions as F

from nearmark.operators import corpus, oplog, ranges, splits
from nearmark.operators.ranges import lag_within, lead_within, ranges_of, running_since_reset, with_row_index
from nearmark.operators.skew import salted_join
from nearmark.sources import datasets, tables


def ids(spark, n, kind="bigint"):
    return spark.range(n).select((F.col("id") * 3 + 1).cast(kind).alias("id")).repartition(5, F.rand(1))


@pytest.mark.parametrize("n", [1, 5, 23, 1000])
@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp"])
def test_row_index(spark, n, kind):
    df = ids(spark, n, kind)
    got = [r["id"] for r in with_row_index(df, "id", "at", ranges_of(df, "id", 9)).orderBy("at").collect()]
    assert got == sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("n, chunks", [(10, 3), (3, 7), (100, 7), (64, 8), (1, 1)])
def test_chunks(spark, n, chunks):
    rows = splits.with_chunk(ids(spark, n), "id", chunks).orderBy("id").collect()
    sizes = [sum(r["chunk"] == c + 1 for r in rows) for c in range(chunks)]
    assert sizes == splits.chunk_sizes(n, chunks)
    assert [r["chunk"] for r in rows] == sorted(r["chunk"] for r in rows)


@pytest.mark.parametrize("count", [1, 2, 129, 1000, 3001])
def test_many_ranges_are_searched(spark, monkeypatch, count):
    rng = random.Random(count)
    starts = sorted(rng.sample(range(100_000), count))
    keys = [None, *starts, *(s - 1 for s in starts), *(s + 1 for s in starts), -5, 200_000]
    df = spark.createDataFrame([(k,) for k in keys], "id bigint")
    cut = ranges.Ranges("id", tuple(starts), tuple(range(count)), count)
    found = {r["id"]: r["at"] for r in df.select("id", cut.of(df).alias("at")).collect()}
    assert all(at == max(0, bisect.bisect_right(starts, k) - 1) for k, at in found.items() if k is not None)
    if count < 200:
        monkeypatch.setattr(ranges, "RANGES_IN_CODE", 1 << 20)
        assert found == {r["id"]: r["at"] for r in df.select("id", cut.of(df).alias("at")).collect()}


def test_chunks_of_several_ranges(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        df = ids(spark, 500)
        assert len(ranges_of(df, "id").starts) > 1
        rows = splits.with_chunk(df, "id", 7).orderBy("id").collect()
    finally:
        spark.conf.unset(setting)
    assert [sum(r["chunk"] == c + 1 for r in rows) for c in range(7)] == splits.chunk_sizes(500, 7)
    assert [r["chunk"] for r in rows] == sorted(r["chunk"] for r in rows)


def test_chunk_label_does_not_shuffle(spark):
    plan = splits.with_chunk(ids(spark, 50).coalesce(1), "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("n, size, chunks", [(10, 3, 2), (100, 7, 3), (2, 5, 4)])
def test_batches(spark, n, size, chunks):
    fixed = splits.batch_fixed(ids(spark, n), "id", size, chunks).collect()
    even = splits.batch_balanced(ids(spark, n), "id", size, chunks).collect()
    for c, total in enumerate(splits.chunk_sizes(n, chunks), start=1):
        def sizes(rows):
            batches = [r["batch"] for r in rows if r["chunk"] == c]
            return [batches.count(b) for b in range(1, max(batches, default=0) + 1)]

        assert sizes(fixed) == [size] * (total // size) + ([total % size] if total % size else [])
        assert sizes(even) == splits.chunk_sizes(total, ceil(total / size)) if total else sizes(even) == []


def test_batches_stay_in_their_file(spark, tmp_path):
    path = str(tmp_path / "files")
    spark.range(100).repartitionByRange(3, "id").write.parquet(path)
    rows = splits.batch_per_file(spark.read.parquet(path), "id", 8).collect()
    for name in {r["file"] for r in rows}:
        mine = sorted((r["id"], r["batch"]) for r in rows if r["file"] == name)
        assert [b for _, b in mine] == [i // 8 + 1 for i in range(len(mine))]


def test_labels(spark):
    row = spark.createDataFrame([("Search", "w")], "op string, name string")

    def label(n, stepped=None):
        return row.select(splits.request_label(F.col("op"), F.col("name"), n, stepped).alias("l")).first()["l"]

    assert [label(1), label(2), label(4, True), label(4, False)] == ["Search", "w.Search", "wSearch", "Search"]


@pytest.fixture(scope="module")
def log_rows():
    """Half of the log is one id."""
    rng = random.Random(4)
    return [
        (i, rng.choice(["insert", "update", "update", "delete", "search"]), "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i * 10)
        for i in range(800)
    ]


@pytest.fixture(scope="module")
def log(spark, log_rows):
    return spark.createDataFrame(log_rows, "seq bigint, op string, id string, value bigint").repartition(6, F.rand(2))


def test_lag_and_lead_across_ranges(log, log_rows):
    for fn, sign in ((lag_within, -1), (lead_within, 1)):
        got = {r["seq"]: r["near"] for r in fn(log, ["id"], "seq", "value", "near", ranges_of(log, "seq", 7)).collect()}
        for key in {r[2] for r in log_rows}:
            mine = [r for r in log_rows if r[2] == key]
            for i, r in enumerate(mine):
                j = i + sign
                assert got[r[0]] == (mine[j][3] if 0 <= j < len(mine) else None)


def test_running_count_across_ranges(log, log_rows):
    df = running_since_reset(
        log, ["id"], "seq", F.col("op") == "update", F.col("op") == "insert", "n", ranges_of(log, "seq", 7)
    )
    got = {r["seq"]: r["n"] for r in df.collect()}
    count = {}
    for seq, op, key, _ in log_rows:
        count[key] = 0 if op == "insert" else count.get(key, 0) + (op == "update")
        assert got[seq] == count[key], seq


@pytest.mark.parametrize("upserts", [False, True])
@pytest.mark.parametrize("as_of", [None, 0, 250])
def test_replay(log, log_rows, upserts, as_of):
    state = {}
    for seq, op, key, value in log_rows:
        if as_of is not None and seq > as_of:
            break
        if op == "insert" or (op == "update" and (upserts or key in state)):
            state[key] = value
        elif op == "delete":
            state.pop(key, None)
    got = {r["id"]: r["value"] for r in oplog.replay(log, as_of, upserts).collect()}
    assert got == state
    assert oplog.live_counts(log, as_of, upserts).first()["records"] == len(state)


def test_validity_covers_every_moment(log, log_rows):
    states = oplog.validity(log).collect()
    live = {}
    for seq, op, key, value in log_rows:
        if op in ("insert", "update"):
            live[key] = value
        elif op == "delete":
            live.pop(key, None)
        if seq % 97 == 0:
            now = {r["id"]: r["value"] for r in states if r["valid_from"] <= seq and (r["valid_to"] is None or seq < r["valid_to"])}
            assert now == live


def test_table_changes(spark):
    schema = "seq bigint, id string, value int"
    table = spark.createDataFrame([("a", 1), ("b", 2)], "id string, value int")
    batch = spark.createDataFrame([(1, "b", 20), (2, "b", 21), (3, "c", 30)], schema)

    def pairs(df):
        return sorted((r["id"], r["value"]) for r in df.collect())

    assert pairs(oplog.upsert(table, batch)) == [("a", 1), ("b", 21), ("c", 30)]
    assert pairs(oplog.update(table, batch)) == [("a", 1), ("b", 21)]
    assert pairs(oplog.delete(table, batch)) == [("a", 1)]
    assert pairs(oplog.fetch(table, batch)) == [("b", 2)]
    fresh = spark.createDataFrame([("x", 9)], "id string, value int")
    assert pairs(oplog.insert(table, fresh)) == [("a", 1), ("b", 2), ("x", 9)]
    with pytest.raises(ValueError, match="duplicate"):
        oplog.insert(table, table)
    with pytest.raises(ValueError, match="duplicate"):
        oplog.insert(table, fresh.unionByName(fresh))


def test_update_may_write_null(spark):
    table = spark.createDataFrame([("a", 1)], "id string, value int")
    batch = spark.createDataFrame([(1, "a", None)], "seq bigint, id string, value int")
    assert oplog.update(table, batch).first()["value"] is None


def test_fetch_fills_metadata(spark):
    table = spark.createDataFrame([("a", None), ("b", '{"x":1}')], "id string, metadata string")
    asked = spark.createDataFrame([("a",), ("b",), ("a",), ("zz",)], "id string")
    assert sorted(r["metadata"] for r in oplog.fetch(table, asked).collect()) == ['{"x":1}', "{}"]


def test_corpus_splits(spark):
    records = spark.range(100).withColumn("v", F.col("id") * 2)
    queries = spark.createDataFrame([(1, [3, 5]), (2, [5, 9]), (3, [])], "query_id int, neighbors array<bigint>")
    relevant = corpus.relevant_ids(queries)
    holes, cheese = corpus.holes(records, relevant), corpus.cheese(records, relevant)
    assert sorted(r["id"] for r in holes.collect()) == [3, 5, 9]
    assert cheese.count() == 97 and cheese.join(holes, "id").count() == 0
    steps = corpus.drift_records(records, relevant).groupBy("step").count().collect()
    assert sorted((r["step"], r["count"]) for r in steps) == [(0, 97), (1, 3)]


def test_salted_join(spark):
    many = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9))
    one = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = salted_join(many, one, "k", "id", rows=50)
    assert got.count() == 1000
    assert got.where(F.col("w") != F.col("k") * 10).count() == 0


# Readers and writers -------------------------------------------------------


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    records = spark.range(20).select(
        F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("values"),
        F.when(F.col("id") % 2 == 0, F.lit('{"tags": ["1"], "n": 0}')).alias("metadata"), F.lit("x").alias("other"),
    )
    records.write.parquet(f"{root}/demo/passages")
    records.withColumn("sparse_values", F.lit(None).cast("string")).write.parquet(f"{root}/demo/documents")
    spark.range(6).select(
        F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit(3).alias("top_k"),
        F.struct(F.array(F.lit("7")).alias("neighbors"), F.lit(5).alias("top_k")).alias("blob"),
    ).write.parquet(f"{root}/demo/queries")
    (root / "demo" / "metadata.json").write_text(json.dumps({"name": "demo", "dimensions": 2}, indent=1))
    (root / "more").mkdir()
    (root / "more" / "metadata.json").write_text(json.dumps({"name": "more", "dimensions": 3}, indent=1))
    return str(root)


def test_read_dataset(spark, root):
    data = datasets.read_dataset(spark, root, "demo", "cosine", 2, limit=5, query_limit=2)
    assert data.records.columns == ["id", "values", "metadata"]
    assert data.records.count() == 5 and data.queries.count() == 2
    row = data.queries.first()
    assert row["top_k"] == 5 and row["neighbors"] == ["7"] and row["values"] == [1.0, 2.0]
    assert "other" not in datasets.read_records(spark, root, "demo")._jdf.queryExecution().executedPlan().toString()
    assert datasets.describe(data).first() == ("demo", 5, 2, "cosine", 2)
    names = sorted(r["name"] for r in datasets.catalogue(spark, root).collect())
    assert names == ["demo", "more"]


def test_gates(spark, root):
    records = spark.read.parquet(f"{root}/demo/passages")
    queries = spark.read.parquet(f"{root}/demo/queries")
    with pytest.raises(ValueError, match="id, values"):
        datasets.select_records(records.drop("id", "values"))
    with pytest.raises(ValueError, match="blob"):
        datasets.select_queries(queries.drop("blob"))
    with pytest.raises(ValueError, match="exactly one"):
        datasets.select_queries(queries.drop("vector"))
    with pytest.raises(ValueError, match="exactly one"):
        datasets.select_queries(queries.withColumn("values", F.col("vector")))
    with pytest.raises(ValueError, match="unknown kind"):
        datasets.read_table(spark, root, "demo", "other")
    assert datasets.read_table(spark, root, "demo", "documents").columns == ["id", "values", "sparse_values", "metadata"]
    assert datasets.drop_null_columns(datasets.read_table(spark, root, "demo", "documents")).columns == ["id", "values", "metadata"]
    with pytest.raises(ValueError, match="unknown metric"):
        datasets.read_dataset(spark, root, "demo", "manhattan", 2)


def test_metadata(spark):
    rows = [(1, '{"a": 0, "b": "", "c": [], "d": false, "e": null, "f": "0", "g": [0], "h": 0.0}'), (2, None), (3, '{"a": 0}'), (4, "{}")]
    df = spark.createDataFrame(rows, "id int, metadata string")
    got = {r["id"]: r["metadata"] for r in datasets.clean_metadata(df).collect()}
    assert got == {1: {"f": '"0"', "g": "[0]"}, 2: None, 3: None, 4: None}
    with pytest.raises(TypeError):
        datasets.clean_metadata(df, "id")
    typed = datasets.decode_metadata(df, "a int, f string").orderBy("id").collect()
    assert typed[0]["metadata"] == (0, "0") and typed[1]["metadata"] == (None, None)
    loose = datasets.decode_metadata(df).select("id", F.to_json("metadata").alias("m")).orderBy("id").collect()
    assert loose[1]["m"] == "{}"


def test_tables(spark, tmp_path):
    df = spark.range(10).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("values"), (F.col("id") % 3).alias("namespace"))
    path = str(tmp_path / "t")
    tables.write_namespaced(df, path)
    with pytest.raises(Exception, match="already exists"):
        tables.write_namespaced(df, path)
    tables.write_namespaced(df, path, overwrite=True)
    one = tables.read_namespaced(spark, path, 1)
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(namespace" in one._jdf.queryExecution().executedPlan().toString()
    assert tables.completeness(df, 11).first() == (11, 10, False)
    assert tables.contract(df, 2, "cosine", "cosine").first()["valid"]
    assert not tables.contract(df, 3, "cosine").first()["valid"]
    assert not tables.contract(df, 2, "cosine", "euclidean").first()["valid"]
    assert tables.enforce_dims(df, 2).count() == 10
    with pytest.raises(Exception, match="expected 3 dimensions"):
        tables.enforce_dims(df, 3).collect()


def test_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "layout"
    tables.rewrite_layout(spark.range(1000).coalesce(1), str(path), 400, 100)
    files = sorted(path.glob("*.parquet"))
    metas = [pq.ParquetFile(f).metadata for f in files]
    assert sorted(m.num_rows for m in metas) == [200, 400, 400]
    assert max(m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)) <= 100


def test_scratch_folders_go_when_told(spark):
    from nearmark.session import clear_scratch, scratch_path, stored

    path = scratch_path(spark, "kept")
    df = stored(spark.range(3), "three")
    assert df.count() == 3
    folder = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert os.path.isdir(folder) and not os.path.exists(path.removeprefix("file:"))
    assert clear_scratch(spark) >= 1
    assert not os.path.exists(folder)
    assert clear_scratch(spark) == 0
