"""Readers of vector datasets: ``<root>/<name>/{passages,queries,documents}``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearmark import schema as layout
from nearmark.operators.selection import smallest
from nearmark.schema import VectorDataset


def _missing(kind: str, columns: list[str]) -> ValueError:
    return ValueError(f"{kind} lack required columns: {', '.join(sorted(columns))}")


def select_records(df: DataFrame) -> DataFrame:
    """Required and known optional columns of a records table, nothing else."""
    lacking = [c for c in layout.RECORD_REQUIRED if c not in df.columns]
    if lacking:
        raise _missing("records", lacking)
    return df.select(*[c for c in (*layout.RECORD_REQUIRED, *layout.RECORD_OPTIONAL) if c in df.columns])


def select_queries(df: DataFrame) -> DataFrame:
    """Known columns of a queries table, with the vector named ``values``."""
    lacking = [c for c in layout.QUERY_REQUIRED if c not in df.columns]
    if lacking:
        raise _missing("queries", lacking)
    vectors = [c for c in layout.QUERY_VECTOR if c in df.columns]
    if len(vectors) != 1:
        raise ValueError(f"queries need exactly one of {layout.QUERY_VECTOR}, found {vectors}")
    known = [c for c in layout.QUERY_OPTIONAL if c in df.columns]
    return df.select(*known, *layout.QUERY_REQUIRED, *vectors).withColumnRenamed(vectors[0], "values")


def unnest_blob(queries: DataFrame) -> DataFrame:
    """Fields of ``blob`` as columns; they win over columns of the same name."""
    inner = queries.schema["blob"].dataType.fieldNames()
    kept = [c for c in queries.columns if c != "blob" and c not in inner]
    return queries.select(*kept, "blob.*")


def read_records(spark: SparkSession, root: str, name: str) -> DataFrame:
    return select_records(spark.read.parquet(f"{root}/{name}/passages"))


def read_queries(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Queries as ``query_id, values, top_k[, filter, neighbors]``."""
    flat = unnest_blob(select_queries(spark.read.parquet(f"{root}/{name}/queries")))
    return flat.withColumnRenamed("id", "query_id") if "id" in flat.columns else flat


def read_table(spark: SparkSession, root: str, name: str, kind: str) -> DataFrame:
    """A table by kind: ``passages``, ``queries`` or ``documents``."""
    if kind == "passages":
        return read_records(spark, root, name)
    if kind == "queries":
        return read_queries(spark, root, name)
    if kind == "documents":
        return spark.read.parquet(f"{root}/{name}/documents").select(*layout.DOCUMENT_COLUMNS)
    raise ValueError(f"unknown kind {kind!r}; expected passages, queries or documents")


def read_dataset(
    spark: SparkSession, root: str, name: str, metric: str | None = None, dims: int | None = None,
    limit: int = 0, query_limit: int = 0,
) -> VectorDataset:
    """A dataset by name; metric and dimensions are its ``metadata.json``'s unless given."""
    if metric is None or dims is None:
        known = catalogue(spark, f"{root}/{name}").select("metric", F.col("dimension").cast("int")).first()
        metric, dims = metric or known[0], dims or known[1]
    records, queries = read_records(spark, root, name), read_queries(spark, root, name)
    if limit:
        records = head(records, limit)
    if query_limit:
        queries = head(queries, query_limit, "query_id" if "query_id" in queries.columns else None)
    return VectorDataset(name, records, queries, dims, metric)


def head(df: DataFrame, n: int, key: str | None = "id") -> DataFrame:
    """The first ``n`` rows in key order, so that a limit is repeatable.

    However many they are, rows of whole-number keys are not gathered in one task.
    """
    if key and isinstance(df.schema[key].dataType, T.IntegralType):
        return smallest(df, n, F.col(key), key)
    return (df.orderBy(key) if key else df).limit(n)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all; one counting pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def decode_metadata(df: DataFrame, schema: T.StructType | str | None = None, column: str = "metadata") -> DataFrame:
    """JSON metadata as a struct of a known schema, else VARIANT; null is ``{}``."""
    text = F.coalesce(F.col(column), F.lit("{}"))
    decoded = F.parse_json(text) if schema is None else F.from_json(text, schema)
    return df.withColumn(column, decoded)


def _truthy(json_text: Column) -> Column:
    """Is a JSON value kept by clean-up: not null, false, zero or empty."""
    number = json_text.try_cast("double")
    empty = json_text.isNull() | json_text.isin("null", "false", '""', "", "[]", "{}")
    return ~empty & ~F.coalesce(number == 0, F.lit(False))


def clean_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    """Object fields as a map of JSON texts, without empty ones; none is null.

    JSON text, maps and structs are taken; other types are an error.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.MapType, T.StructType)):
        text = F.to_json(F.col(column))
    elif isinstance(kind, T.StringType):
        text = F.col(column)
    else:
        raise TypeError(f"metadata must be text, a map or a struct, not {kind.simpleString()}")
    # Elements stay VARIANT so that "0" the text and 0 the number differ.
    fields = F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")
    shown = F.transform_values(fields, lambda _, v: F.to_json(v))
    kept = F.map_filter(shown, lambda _, v: _truthy(v))
    return df.withColumn(column, F.when(F.size(kept) > 0, kept))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """All dataset descriptions below ``root`` (``*/metadata.json``)."""
    return (
        spark.read.option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "metadata.json")
        .json(root)
    )


def describe_all(datasets: list[VectorDataset]) -> DataFrame:
    """A row per dataset."""
    return reduce(DataFrame.unionByName, map(describe, datasets))


def describe(dataset: VectorDataset) -> DataFrame:
    """One row: ``name, records, dims, metric, requests``."""
    records = dataset.records.agg(
        F.count(F.lit(1)).alias("records"), F.max(F.size("values")).alias("dims")
    )
    requests = dataset.queries.agg(F.count(F.lit(1)).alias("requests"))
    # Two single rows side by side, joined on a constant key.
    left, right = records.withColumn("_k", F.lit(1)), requests.withColumn("_k", F.lit(1))
    return left.join(right, "_k").select(
        F.lit(dataset.name).alias("name"), "records", "dims", F.lit(dataset.metric).alias("metric"), "requests"
    )
