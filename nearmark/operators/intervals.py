"""Points in time and the intervals that hold them, met by equality.

Time is cut in halves, these in halves, and so on: tiles.  An interval is made
of few tiles, at most two of a size, and a point lies in one tile of each size.
An interval holds a point if one of its tiles is one of the point's, and then
exactly one is; so "as of" becomes an equi-join on tiles, which Spark can hash,
instead of a comparison of every interval with every point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Moments that share a root, about.
ROOT_MOMENTS = 50_000


def interval_tiles(start: Column, end: Column, bits: int, levels: int | None = None) -> Column:
    """The tiles of ``start <= x < end``, of whole numbers from 0 below ``2**bits``.

    A tile is numbered like a node of a binary heap whose leaves are the numbers.
    ``levels`` sizes above a leaf are enough if the interval lies in one tile of that size.
    """
    leaf = F.lit(1 << bits).cast("bigint")
    tiles = []
    for level in range((bits if levels is None else levels) + 1):
        a = F.shiftright(start + leaf + F.lit((1 << level) - 1).cast("bigint"), level)
        b = F.shiftright(end + leaf, level)
        # An odd end has no sibling inside the interval: it is a tile of its own.
        tiles += [F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)]
    return F.array_compact(F.array(*tiles))


def point_tiles(at: Column, bits: int, levels: int | None = None) -> Column:
    """The tiles that hold a number, of each size one."""
    leaf = at + F.lit(1 << bits).cast("bigint")
    return F.array(*[F.shiftright(leaf, level) for level in range((bits if levels is None else levels) + 1)])


def tiled(states: DataFrame, asked: DataFrame, start: str = "valid_from", end: str = "valid_to", at: str = "at") -> tuple[DataFrame, DataFrame]:
    """``states`` with their tiles as ``list_id``, ``asked`` with those of its moment as ``lists``.

    For ``knn(..., Match(lists=True))`` and for joins on the exploded tiles.  A
    null ``end`` is open.  A moment before every state, or a null one, has no
    tiles; an interval that ends where it begins, or whose start is null, has none.
    """
    ends = states.agg(F.min(start).alias("low"), F.greatest(F.max(start), F.max(end)).alias("high")).first()
    low, high = (ends["low"] or 0), (ends["high"] or 0)
    # Room for the largest end and for all that comes after it.
    bits = max(1, (high - low + 1).bit_length())
    top = F.lit(1 << bits).cast("bigint")
    zero = F.lit(low).cast("bigint")
    begin = F.col(start).cast("bigint") - zero
    close = F.coalesce(F.col(end).cast("bigint") - zero, top)
    none = F.array().cast("array<bigint>")
    own = F.when(begin < close, interval_tiles(begin, close, bits)).otherwise(none)
    # least() would pass over a null.
    moment = F.when(F.col(at).isNotNull(), F.least(F.col(at).cast("bigint") - zero, top - 1))
    seen = F.when(moment >= 0, point_tiles(moment, bits)).otherwise(none)
    return states.withColumn("list_id", own), asked.withColumn("lists", seen)


def rooted(
    states: DataFrame, asked: DataFrame, start: str = "valid_from", end: str = "valid_to", at: str = "at", moments: int = ROOT_MOMENTS
) -> tuple[DataFrame, DataFrame]:
    """Like :func:`tiled`, with tiles no larger than a ``root`` that holds about ``moments`` moments.

    A moment has one root; a state comes once for each root it lives in, with
    its tiles in there.  For ``knn(..., Match(by=("root",), lists=True, nested=True))``:
    rows meet by their root, so a vector is sent once per root and not once per
    tile.  States that no moment can see are left out.
    """
    ends = asked.agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(at).alias("n")).first()
    zero, span = ends["low"] or 0, (ends["high"] or 0) - (ends["low"] or 0) + 1
    bits = max(1, span.bit_length())
    level = min(bits, max(0, (span * moments // max(1, ends["n"])).bit_length() - 1))
    begin = F.greatest(F.col(start).cast("bigint") - zero, F.lit(0).cast("bigint"))
    close = F.least(F.col(end).cast("bigint") - zero, F.lit(span).cast("bigint"))
    lives = states.where(F.col(start).isNotNull()).withColumn("_a", begin).withColumn("_b", close).where("_a < _b")
    lives = lives.withColumn("root", F.explode(F.sequence(F.shiftright("_a", level), F.shiftright(F.col("_b") - 1, level))))
    low = F.greatest("_a", F.shiftleft("root", level))
    high = F.least("_b", F.shiftleft(F.col("root") + 1, level))
    # Most of what lives long fills its roots.
    whole = (low == F.shiftleft("root", level)) & (high == F.shiftleft(F.col("root") + 1, level))
    top = F.array(F.col("root") + F.lit(1 << (bits - level)).cast("bigint"))
    lives = lives.withColumn("list_id", F.when(whole, top).otherwise(interval_tiles(low, high, bits, level))).drop("_a", "_b")
    moment = F.col(at).cast("bigint") - zero
    seen = asked.where(F.col(at).isNotNull()).withColumn("root", F.shiftright(moment, level))
    return lives, seen.withColumn("lists", point_tiles(moment, bits, level))
