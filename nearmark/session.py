"""Session helpers: settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("nearmark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    ``spark.checkpoint.dir`` wins, then a checkpoint folder set on the context.
    Only a local session falls back to a temporary folder of its own; on a
    cluster a missing setting is an error, as its machines share no local disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="nearmark-"))
    return sc.getCheckpointDir()


# Paths handed out, by application.
_HANDED: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _HANDED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application has put below the shared folder; how many paths.

    Tables that were stored and not yet written elsewhere are lost with it.
    """
    return sum(delete_path(spark, path) for path in _HANDED.pop(spark.sparkContext.applicationId, []))


def delete_path(spark: SparkSession, name: str) -> bool:
    """Delete a folder, in whatever store it is; False if there was none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage, keeps a result used more than once from being computed
    twice, and tells Catalyst the true size, so that it broadcasts the table in
    later joins only if it is small.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
