"""Tables stored by key."""

import pytest
from pyspark.sql import functions as F

from nearmark.sources import tables


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('keyed')}/table"
    df = spark.range(20_000).selectExpr("id * 2 AS id", "concat('v', id) AS value")
    tables.write_keyed(df.unionAll(spark.createDataFrame([(None, "nobody"), (8, "again")], "id bigint, value string")), path, 8, rows_per_group=500)
    return path


def scanned(found):
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.mark.parametrize("few", [0, 3, 256])
def test_same_as_a_filter(spark, path, few):
    keys = spark.createDataFrame([(8,), (8,), (9,), (None,), (39_998,), (40_000,), (12,), (-4,)], "id int")
    found = tables.lookup(spark, path, keys, few=few)
    assert found.columns == ["id", "value"]
    assert sorted(tuple(r) for r in found.collect()) == [(8, "again"), (8, "v4"), (12, "v6"), (39_998, "v19999")]
    assert tables.lookup(spark, path, keys.where("false"), few=few).count() == 0


def test_row_groups_are_skipped(spark, path):
    there = tables.lookup(spark, path, spark.createDataFrame([(20_000,)], "id bigint"))
    assert [r.value for r in there.collect()] == ["v10000"] and 0 < scanned(there) <= 500
    # Within the range of a row group, and known to be absent by its Bloom filter.
    absent = [tables.lookup(spark, path, spark.createDataFrame([(i,)], "id bigint")) for i in (20_001, 20_003, 20_005, 7, 31_111)]
    assert all(not a.collect() for a in absent)
    assert sorted(scanned(a) for a in absent)[2] == 0
    many = tables.lookup(spark, path, spark.range(30).select((F.col("id") * 1000).alias("id")))
    assert many.count() == 30
    plan = there._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_nothing_stored(spark, tmp_path):
    empty = spark.range(0).selectExpr("id", "'x' AS value")
    tables.write_keyed(empty, f"{tmp_path}/t", 4)
    with pytest.raises(Exception, match="exist"):
        tables.write_keyed(empty, f"{tmp_path}/t", 4)
