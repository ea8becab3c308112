"""Table changes: insert, upsert, update, delete, fetch, and log replay.

A table has key and payload columns.  The key is ``id``, or ``namespace`` and
``id`` where a table holds several namespaces (``key=("namespace", "id")``).  A log has ``seq`` (unique), ``op``
(``insert``/``update``/``delete``, others are ignored), ``id`` and the same
payload.  The last write per id is found with partial aggregation, so an id
that holds a large part of the log does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.operators.ranges import Ranges, lead_within, ranges_of, running_since_reset

WRITES = ("insert", "update", "delete")
Key = tuple[str, ...]
ID: Key = ("id",)


def _payload(df: DataFrame, skip: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in skip]


def latest(batch: DataFrame, seq: str = "seq", key: Key = ID) -> DataFrame:
    """Last row per key, without ``seq``."""
    cols = _payload(batch, (*key, seq))
    last = F.max_by(F.struct(*cols), F.col(seq)).alias("_w")
    return batch.groupBy(*key).agg(last).select(*key, "_w.*")


def insert_conflicts(table: DataFrame, batch: DataFrame, key: Key = ID) -> DataFrame:
    """Keys a strict insert must refuse: repeated in the batch, or present."""
    per_key = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    marked = per_key.join(table.select(*key).withColumn("_present", F.lit(True)), list(key), "left")
    return marked.where((F.col("_n") > 1) | F.col("_present")).select(*key).distinct()


def insert(table: DataFrame, batch: DataFrame, key: Key = ID) -> DataFrame:
    """Strict insert; raises if any key is repeated or already present."""
    clash = insert_conflicts(table, batch, key).limit(1).collect()
    if clash:
        raise ValueError(f"duplicate key {tuple(clash[0])!r}")
    return table.unionByName(batch)


def upsert(table: DataFrame, batch: DataFrame, seq: str = "seq", key: Key = ID) -> DataFrame:
    """Insert or replace.  The table side is not regrouped: a small batch is
    broadcast, a large one meets the table in one join."""
    new = latest(batch, seq, key)
    return table.join(new.select(*key), list(key), "left_anti").unionByName(new)


def update(table: DataFrame, batch: DataFrame, seq: str = "seq", key: Key = ID) -> DataFrame:
    """Replace rows that exist; keys that do not are ignored."""
    new = latest(batch, seq, key)
    cols = _payload(new, key)
    packed = new.select(*key, F.struct(*cols).alias("_new"))
    joined = table.join(packed, list(key), "left")
    return joined.select(
        *key, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in cols]
    )


def delete(table: DataFrame, keys: DataFrame, key: Key = ID) -> DataFrame:
    """Remove rows; missing keys are ignored."""
    return table.join(keys.select(*key).distinct(), list(key), "left_anti")


def fetch(table: DataFrame, keys: DataFrame, key: Key = ID) -> DataFrame:
    """Rows by key; missing keys are absent, null metadata becomes ``{}``."""
    found = table.join(keys.select(*key).distinct(), list(key), "left_semi")
    if "metadata" in found.columns:
        found = found.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))
    return found


def _alive_ops(update_inserts: bool) -> Column:
    return F.col("op").isin("insert", "update") if update_inserts else F.col("op") == "insert"


def last_state(log: DataFrame, update_inserts: bool, key: Key = ID) -> DataFrame:
    """Per key: ``life``, the last operation that made or removed it, and
    ``row``, its last written payload with its ``seq``.

    Partial aggregation only, on a stream as on a table.
    """
    cols = _payload(log, (*key, "op"))
    written = F.when(F.col("op") != "delete", F.col("seq"))
    life = F.when(_alive_ops(update_inserts) | (F.col("op") == "delete"), F.col("seq"))
    return (
        log.where(F.col("op").isin(*WRITES))
        .groupBy(*key)
        .agg(F.max_by("op", life).alias("life"), F.max_by(F.struct(*cols), written).alias("row"))
    )


def alive(states: DataFrame, key: Key = ID) -> DataFrame:
    """The records among the states of :func:`last_state`."""
    return states.where(F.col("life") != "delete").select(*key, "row.*")


def replay(log: DataFrame, as_of: int | None = None, update_inserts: bool = False, key: Key = ID) -> DataFrame:
    """The table after the log, or after all operations with ``seq <= as_of``.

    An update changes only a live id; with ``update_inserts`` it also creates
    one, as in stores whose only write is an upsert.
    """
    seen = log if as_of is None else log.where(F.col("seq") <= as_of)
    return alive(last_state(seen, update_inserts, key), key)


def live_counts(log: DataFrame, as_of: int | None = None, update_inserts: bool = False, key: Key = ID) -> DataFrame:
    """One row: ``records`` alive at the end."""
    return replay(log, as_of, update_inserts, key).agg(F.count(F.lit(1)).alias("records"))


def versions(log: DataFrame, cut: Ranges | None = None, key: Key = ID) -> DataFrame:
    """Log rows with ``version``: updates of the key since its last insert."""
    writes = log.where(F.col("op").isin(*WRITES))
    return running_since_reset(
        writes, list(key), "seq", F.col("op") == "update", F.col("op") == "insert", "version", cut
    )


def validity(log: DataFrame, cut: Ranges | None = None, key: Key = ID) -> DataFrame:
    """Every state of every record with ``valid_from <= seq < valid_to``.

    Updates create missing keys here.  ``valid_to`` is null for the last state.
    """
    writes = log.where(F.col("op").isin(*WRITES))
    cut = cut or ranges_of(writes, "seq")
    ended = lead_within(writes, list(key), "seq", "seq", "valid_to", cut)
    return ended.where(F.col("op") != "delete").withColumnRenamed("seq", "valid_from").drop("op")
