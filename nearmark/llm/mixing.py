"""Mixing sources to target weights by systematic sampling, in SQL functions only.

Every document of a source is expected ``target / source words`` times.  These
expected copies are summed up over the source's documents in a fixed order,
one offset per source is added, and a document is emitted once for each whole
number that its stretch of the running sum passes.  So it comes either the
whole part of its expectation often or once more, and never above the limit.

The order runs through classes of like size, and by a hash within a class, so
the words taken stay close to the target.  Classes are cut into 4,096 parts by
that hash.  One summary row per source, class and part carries the running sum
on, and a hot source is sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.llm.common import WORD_PATTERN, column, fresh, text_of
from nearmark.session import stored

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
# Hexadecimal digits of the hash that name a part of a size class.
PART_DIGITS = 3


def size_class(size: Column) -> Column:
    """Sizes that share their highest four binary digits and their length."""
    digits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(digits * 16 + F.conv(F.substring(F.bin(size), 1, 4), 2, 10).cast("int")).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target words of each row of ``source, words``, one row per source.

    Sources in the order of their code points, null last, have ``weights`` in
    turn and share all words by them; none gets more than ``most`` times its
    own, and what it cannot take is shared among the rest by weight.
    Sources with the least room per weight reach their limit first, so one pass
    in that order finds all that do.  The windows see one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), turn + 1))
    weighed = weighed.withColumn("room", F.col("words") * most)
    order = every.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("bigint"))
    share = (F.sum("words").over(every) - past("room")) / (F.sum("weight").over(every) - past("weight"))
    full = weighed.withColumn("full", share * F.col("weight") > F.col("room"))
    kept = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(every)
    level = (F.sum("words").over(every) - kept("room")) / (F.sum("weight").over(every) - kept("weight"))
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(level * F.col("weight"))
    return full.select("source", "words", target.alias("target"))


def coded(source: Column) -> Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def offset_of(source: Column, seed: str) -> Column:
    """A number in [0, 1) per source."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(2.0**32)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: str = "mix",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the mix of each row, and the names of the added columns.

    Added are ``size`` (words), ``source_size``, ``target`` and ``copies``; a
    name that ``docs`` has already gets underscores before it.  Null text has no
    words, null sources are one source, null keys and repeated rows count as
    rows; which of several equal rows is repeated makes no difference.  Sources
    without words have target 0 and no copies.  An empty table gives an empty one.
    """
    names = fresh(docs, "size", "source_size", "target", "copies", "_class", "_order", "_part", "_before", "_source", "_tie",
                  "_rank", "_of_source", "_of_class", "_of_part")
    size, total, target, copies, kind, order, part, before, origin, tie, rank, of_source, of_class, of_part = names
    words = F.regexp_count(text_of(docs, text), F.lit(WORD_PATTERN)).cast("bigint")
    # Keys that are never null: the join needs no filter on them, which would count
    # the words again, and has the partitioning of the window below it.
    sized = (
        docs.withColumn(size, F.coalesce(words, F.lit(0).cast("bigint")))
        .withColumn(origin, coded(column(docs, source)))
        .withColumn(order, F.md5(F.coalesce(column(docs, key).cast("string"), F.lit("")).cast("binary")))
        .withColumn(tie, F.xxhash64(text_of(docs, text)))
    )
    sized = sized.withColumn(kind, F.coalesce(size_class(F.col(size)), F.lit(0)))
    sized = sized.withColumn(part, F.substring(order, 1, PART_DIGITS))
    counted = stored(
        sized.groupBy(F.col(origin).alias("source"), F.col(kind).alias("class"), F.col(part).alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(size).alias("words")
        ),
        "mix-parts",
    )
    shares = counted.groupBy("source").agg(F.sum("words").alias("words"))
    decoded = F.when(F.col("source") != "", F.expr("substring(source, 2)"))
    aims = targets(shares.select(decoded.alias("source"), "words"), weights, most)
    aims = aims.select(coded(F.col("source")).alias("source"), F.col("words").alias("all_words"), "target")
    # Rows before a part: those of the source's lower classes, and of the class's lower parts.
    below = lambda *keys: F.coalesce(
        F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")
    )
    classes = counted.groupBy("source", "class").agg(F.sum("n").alias("n")).withColumn("lower", below("source", "class"))
    carried = counted.withColumn("before", below("source", "class", "part"))
    carried = carried.join(classes.select("source", "class", "lower"), ["source", "class"]).join(aims, "source")
    carried = carried.select(
        F.col("source").alias(of_source), F.col("class").alias(of_class), F.col("part").alias(of_part),
        (F.col("before") + F.col("lower")).alias(before), F.col("all_words").alias(total), F.col("target").alias(target),
    )
    inside = Window.partitionBy(origin, kind, part).orderBy(order, tie)
    ranked = sized.withColumn(rank, F.row_number().over(inside).cast("bigint"))
    joined = ranked.join(
        carried,
        (F.col(origin) == F.col(of_source)) & (F.col(kind) == F.col(of_class)) & (F.col(part) == F.col(of_part)),
    )
    each = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    at, start = F.col(before) + F.col(rank), offset_of(column(ranked, source).cast("string"), seed)
    passed = F.floor(at * each + start) - F.floor((at - 1) * each + start)
    out = joined.withColumn(copies, F.least(passed, F.lit(most).cast("bigint")).cast("bigint"))
    given = [column(out, c) for c in docs.columns]
    added = {"size": size, "source_size": total, "target": target, "copies": copies}
    return out.select(*given, *added.values()), added


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    out, added = mix(docs, **options)
    times = F.explode(F.array_repeat(F.lit(0), F.col(added["copies"]).cast("int")))
    (copy,) = fresh(out, "_copy")
    return out.withColumn(copy, times).select(*[column(docs, c) for c in docs.columns])


def mix_report(spark, folder: str) -> DataFrame:
    """``op7``: size, target of the source, and words taken of each document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    out, _ = mix(docs)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), classed AS (
  SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 16 + (size >> (length(bin(size)) - 4)) END AS class FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY source
), weighed AS (
  SELECT source, words, 3 * words AS room, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources
), past AS (
  SELECT *, sum(words) OVER () AS all_words, sum(weight) OVER () AS all_weight,
         coalesce(sum(room) OVER before, 0) AS past_room, coalesce(sum(weight) OVER before, 0) AS past_weight
  FROM weighed
  WINDOW before AS (ORDER BY CAST(room AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, CAST(all_words - past_room AS DOUBLE) / CAST(all_weight - past_weight AS DOUBLE) * weight > room AS is_full FROM past
), aims AS (
  SELECT source, words, CASE WHEN is_full THEN CAST(room AS DOUBLE) ELSE
    CAST(all_words - coalesce(sum(room) FILTER (is_full) OVER (), 0) AS DOUBLE)
    / CAST(all_weight - coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS DOUBLE) * weight END AS target
  FROM filled
), ranked AS (
  SELECT c.*, a.words AS source_size, a.target,
         row_number() OVER (PARTITION BY c.source ORDER BY class, place, size) AS pos,
         CASE WHEN a.words > 0 THEN a.target / a.words ELSE 0.0 END AS each_one,
         CAST('0x' || substr(md5('mix:' || coalesce(c.source, '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS start
  FROM classed c JOIN aims a ON c.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(least(floor(pos * each_one + start) - floor((pos - 1) * each_one + start), 3) AS BIGINT) * size AS taken
FROM ranked
"""
