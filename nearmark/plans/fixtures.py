"""The vector tables, request log and operation log the checks run on.

Everything is derived from the given tables, whole: every embedding is a record
and a query, every event is a request and an operation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOP_K = 10
REQUEST_TYPES = {
    "view": "Search", "signup": "Insert", "click": "Update", "purchase": "Fetch", "error": "Delete",
}
OPS = {k: v.lower() for k, v in REQUEST_TYPES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(column: str, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.col(column))


def _scaled() -> Column:
    """Lengths 1 to 5, so that the three metrics rank differently."""
    return F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5))


def _tags() -> Column:
    tags = F.array(F.col("label").cast("string"), F.concat(F.lit("m"), F.col("vec_id") % 3))
    return F.when(F.col("vec_id") % 17 != 0, tags)


def _filter_text() -> Column:
    """No filter, one tag, or two tags; some ask for a tag nobody has."""
    label = F.when(F.col("vec_id") % 23 == 0, F.lit("99")).otherwise(F.col("label").cast("string"))
    one = F.concat(F.lit('{"tags": "'), label, F.lit('"}'))
    return (
        F.when(F.col("vec_id") % 3 == 1, one)
        .when(F.col("vec_id") % 3 == 2, F.concat(F.lit('{"$and": ['), one, F.lit(', {"tags": "m1"}]}')))
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), _scaled().alias("values"), _tags().alias("tags"),
        (F.col("label") % 2).alias("namespace"), "label",
    )


def queries(spark: SparkSession, sf_dir: str, top_k: Column | None = None) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), _scaled().alias("values"),
        (F.lit(TOP_K) if top_k is None else top_k).cast("int").alias("top_k"),
        _filter_text().alias("filter"), (F.col("label") % 2).alias("namespace"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def as_requests(raw: DataFrame) -> DataFrame:
    """Events as a request log; searches carry metrics, the rest counters."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    search = F.col("event_type") == "view"
    metrics = F.create_map(
        F.lit("recall"), k / F.lit(100.0), F.lit("reciprocal rank"), F.lit(1.0) / (1 + k % 10)
    )
    return raw.select(
        F.col("event_id").alias("seq"),
        _mapped("event_type", REQUEST_TYPES).alias("request_type"),
        "ts",
        "user_id",
        F.col("value").alias("response_time"),
        (F.col("value") > 200).alias("failed"),
        F.when(search, metrics).alias("metrics"),
        F.when(~search, F.create_map(F.lit("requests"), k)).alias("counters"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))


def as_operations(raw: DataFrame) -> DataFrame:
    """Events as an operation log on users."""
    return raw.select(
        F.col("event_id").alias("seq"), _mapped("event_type", OPS).alias("op"),
        F.col("user_id").alias("id"), "value",
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_operations(table(spark, sf_dir, "events"))
