"""Writers and table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_namespaced(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store records by namespace; refuses existing data unless told to replace it."""
    mode = "overwrite" if overwrite else "errorifexists"
    df.write.mode(mode).partitionBy("namespace").parquet(path)


def read_namespaced(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame:
    """All namespaces, or one, whose folder alone is then read."""
    df = spark.read.parquet(path)
    return df if namespace is None else df.where(F.col("namespace") == namespace)


def rewrite_layout(df: DataFrame, path: str, rows_per_file: int, rows_per_group: int, overwrite: bool = False) -> None:
    """Rewrite Parquet with bounded files and row groups."""
    (
        df.write.mode("overwrite" if overwrite else "errorifexists")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.block.row.count.limit", rows_per_group)
        .parquet(path)
    )


def _bucket(key: str, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets).cast("int")


def write_keyed(df: DataFrame, path: str, buckets: int, key: str = "id", rows_per_group: int = 100_000, overwrite: bool = False) -> None:
    """Store rows so that single keys can be looked up: by a hash of the key in
    ``buckets`` folders, sorted by key, with a Bloom filter of the keys of each row group.

    The number of buckets is part of the folders' names and need not be told
    again.  A table without rows has no folders and cannot be read.
    """
    placed = df.select("*", F.lit(buckets).alias("buckets"), _bucket(key, F.lit(buckets)).alias("bucket"))
    (
        placed.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", key)
        .write.mode("overwrite" if overwrite else "errorifexists")
        .partitionBy("buckets", "bucket")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", rows_per_group)
        .option("parquet.block.row.count.limit", rows_per_group)
        .parquet(path)
    )


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "id", few: int = 256) -> DataFrame:
    """Rows of a table of ``write_keyed`` by key; missing and null keys are absent, repeated ones count once.

    Up to ``few`` keys are named in the scan: only their folders are read, and of
    them only row groups whose Bloom filter knows a key.  More are met by a join on the key.
    """
    table = spark.read.parquet(path)
    columns = [c for c in table.columns if c not in ("buckets", "bucket")]
    first = table.select("buckets").first()
    asked = keys.select(F.col(key).cast(table.schema[key].dataType)).where(F.col(key).isNotNull()).distinct()
    asked = asked.select(key, _bucket(key, F.lit(first["buckets"])).alias("bucket"))
    known = asked.limit(few + 1).collect()
    if len(known) > few:
        return table.join(asked, ["bucket", key], "left_semi").select(columns)
    if not known:
        return table.where("false").select(columns)
    # Single comparisons reach the Bloom filters; a long list would be pushed down as a range.
    tests = [F.col(key) == F.lit(r[key]) for r in known]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + (tests[-1:] if len(tests) % 2 else [])
    return table.where(F.col("bucket").isin(sorted({r["bucket"] for r in known})) & tests[0]).select(columns)


def write_description(spark: SparkSession, folder: str, **facts) -> None:
    """One row of facts as ``metadata.json`` in ``folder``, where the catalogue looks for it."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in facts.items()])
    part = f"{folder}/_description"
    row.coalesce(1).write.mode("overwrite").json(part)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Spark names its own files; the one it wrote is given the name.
    (written,) = [f.getPath() for f in store.listStatus(path(part)) if f.getPath().getName().startswith("part-")]
    target = path(f"{folder}/metadata.json")
    store.delete(target, False)
    store.rename(written, target)
    store.delete(path(part), True)


def write_report(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """Nested statistics as JSON lines."""
    report.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def completeness(df: DataFrame, expected: int) -> DataFrame:
    """One row: ``expected, actual, complete``."""
    return df.agg(
        F.lit(expected).cast("bigint").alias("expected"),
        F.count(F.lit(1)).alias("actual"),
        (F.count(F.lit(1)) >= F.lit(expected)).alias("complete"),
    )


def contract(df: DataFrame, dims: int, metric: str, stored_metric: str | None = None) -> DataFrame:
    """One row: do the vectors have ``dims`` numbers, and is the metric the stored one."""
    wrong = F.count_if(F.coalesce(F.size("values") != dims, F.lit(True)))
    same = stored_metric is None or stored_metric == metric
    return df.agg(
        F.lit(dims).alias("dims"),
        F.lit(metric).alias("metric"),
        wrong.alias("wrong_dims"),
        ((wrong == 0) & F.lit(same)).alias("valid"),
    )


def enforce_dims(df: DataFrame, dims: int) -> DataFrame:
    """Fails the job on the first vector of another length."""
    error = F.raise_error(F.concat(F.lit(f"expected {dims} dimensions, found "), F.size("values").cast("string")))
    values = F.when(F.size("values") == dims, F.col("values"))
    return df.withColumn("values", F.coalesce(values, error.cast(df.schema["values"].dataType)))
