"""Documents whose word shingles overlap: a Jaccard join with Bayesian pruning.

1. Every text gets a MinHash signature and a digest of its shingle set.  Texts
   of equal sets are one class from here on.
2. Bands of the signature put classes into buckets.  Of buckets with the same
   members one is kept.  In a bucket signatures are compared a few values at a
   time, and a pair is dropped once the posterior probability that it reaches
   the threshold is below the tolerance.  Pairs that stay join classes to groups.
3. In a group all pairs are verified on whole shingle sets.  Tasks emit each
   class's number of links and a spanning set of them, never the pairs.
4. Components of the verified links are the near-duplicate classes.

Large buckets and groups are cut into parts, and pairs of parts are dealt to
tasks; no bucket, group or number of partners is capped.  A pair at exactly the
threshold is missed with a probability of about 1e-6: it must share no band
(1.2e-7 at 0.8), or be pruned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.llm.common import Words, blocks, column, forget, fresh, mixed, runs, text_of, utf8
from nearmark.llm.graph import components
from nearmark.session import stored

THRESHOLD = 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
# Signature values are bytes: two different minima agree once in 256 times.
VALUES = 256
TOLERANCE = 1e-7
# Values of a signature looked at before the next decision.
STEP = 20
# Classes in a part of a bucket, and shingles in a part of a group.
BUCKET_PART, GROUP_SHINGLES = 4096, 2_000_000


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = mixed(seed)
    return drawn[:n] | np.uint64(1), drawn[n:]


def signatures(h: np.ndarray, at: np.ndarray, n: int = HASHES) -> np.ndarray:
    """A row of ``n`` 32-bit minima per text, of its shingles ``h[at[i]:at[i+1]]``; zero if none."""
    a, b = multipliers(n)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, n), np.uint32)
    if len(full):
        starts = at[:-1][full]
        x = np.empty_like(h)
        for k in range(n):
            np.multiply(h, a[k], out=x)
            x += b[k]
            out[full, k] = np.minimum.reduceat(x, starts) >> np.uint64(32)
    return out


def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = HASHES, step: int = STEP) -> list[int]:
    """For each number of values compared, the matches needed to go on.

    With a uniform prior, a similarity given m matches of k has a Beta(m+1,
    k-m+1) posterior, and reaches t with probability P(Binomial(k+1, t) <= m).
    ``t`` is the threshold with chance agreements of the values added.
    """
    t = threshold + (1 - threshold) / VALUES
    out = []
    for k in range(step, n + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        out.append(m)
    return out


def survivors(signs: np.ndarray, one: int, others: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Which of ``others`` are not pruned against ``one``."""
    same = np.zeros(len(others), np.int64)
    for i, least in enumerate(fewest):
        part = slice(i * STEP, (i + 1) * STEP)
        same = same + (signs[others, part] == signs[one, part]).sum(axis=1)
        good = same >= least
        if not good.all():
            others, same = others[good], same[good]
        if not len(others):
            break
    return others


def spanning(signs: np.ndarray, fewest: list[int]) -> list[tuple[int, int]]:
    """Pairs that connect all rows which any chain of surviving pairs connects.

    Each row is compared with all rows not yet connected to it, so no pair that
    could connect more is left out.
    """
    out, rest = [], np.arange(len(signs))
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            one = frontier.pop()
            found = survivors(signs, one, rest, fewest)
            if len(found):
                out += [(one, int(f)) for f in found]
                frontier += found.tolist()
                rest = np.setdiff1d(rest, found, assume_unique=True)
    return out


def intersections(sets: list[np.ndarray], rows: range, columns: range) -> np.ndarray:
    """Sizes of the intersections of some sets with others."""
    both = sorted(set(rows) | set(columns))
    place = {i: p for p, i in enumerate(both)}
    h = np.concatenate([sets[i] for i in both])
    owner = np.repeat(np.arange(len(both)), [len(sets[i]) for i in both])
    values, number, times = np.unique(h, return_inverse=True, return_counts=True)
    # A shingle of one set meets no other.
    shared = times[number] > 1
    rank = np.cumsum(times > 1) - 1
    owner, number, width = owner[shared], rank[number[shared]], int((times > 1).sum())
    out = np.zeros((len(rows), len(columns)), np.float32)
    r, c = [place[i] for i in rows], [place[i] for i in columns]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for s in range(0, width, 4096):
        low, high = np.searchsorted(number, [s, s + 4096])
        has = np.zeros((len(both), min(4096, width - s)), np.float32)
        has[owner[low:high], number[low:high] - s] = 1
        out += has[r] @ has[c].T
    return out


def links(sets: list[np.ndarray], threshold: float, left: range, right: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (i, j), i in ``left``, j in ``right``, with Jaccard at the threshold or above."""
    sizes = np.array([len(s) for s in sets])
    for s in range(left.start, left.stop, 1024):
        a = range(s, min(s + 1024, left.stop))
        for t in range(right.start, right.stop, 1024):
            b = range(t, min(t + 1024, right.stop))
            common = intersections(sets, a, b).astype(np.float64)
            union = sizes[a.start : a.stop, None] + sizes[None, b.start : b.stop] - common
            i, j = np.nonzero((common >= threshold * union - 1e-9 * union) & (union > 0))
            yield i + a.start, j + b.start


def read_signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, hash, digest, shingles, signature`` of every row; equal shingle sets have equal digests."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for s, e in blocks(offsets, 1 << 20):
                h, _, at = words.weighted(data, offsets[s : e + 1])
                signs = signatures(h, at).astype(np.uint8)
                digests = [hashlib.blake2b(h[at[i] : at[i + 1]], digest_size=16).digest() for i in range(e - s)]
                hashes = [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).digest() for i in range(s, e)]
                yield pa.record_batch(
                    {
                        "key": batch.column(0)[s:e],
                        "hash": pa.array(hashes, pa.binary()),
                        "digest": pa.array(digests, pa.binary()),
                        "shingles": pa.array(np.diff(at), pa.int64()),
                        "signature": pa.array([r.tobytes() for r in signs], pa.binary()),
                    }
                )

    kind = docs.select(column(docs, key).alias("key")).schema["key"].dataType.simpleString()
    picked = docs.select(column(docs, key).alias("key"), text_of(docs, text).alias("text"))
    return picked.mapInArrow(sign, f"key {kind}, hash binary, digest binary, shingles bigint, signature binary")


def _cells(df: DataFrame, parts: Column, place: Column) -> DataFrame:
    """Each row once for every pair of parts that has its own: ``low <= high``."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    out = df.withColumn("part", F.pmod(place, parts)).withColumn("other", every)
    return out.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Edges ``a, b`` that connect classes whose signatures were not pruned."""
    fewest = fewest_matches(threshold)
    band = [F.xxhash64(F.lit(i), F.substring("signature", 1 + i * ROWS, ROWS)) for i in range(BANDS)]
    keyed = classes.where("shingles > 0").select("id", F.explode(F.array(*band)).alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    # Buckets with the same members are compared once.
    kept = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    kept = stored(kept.select("bucket", F.ceil(F.col("n") / BUCKET_PART).cast("bigint").alias("parts")), "buckets")
    members = stored(keyed.join(kept, "bucket"), "members")
    signed = members.join(classes.select("id", "signature"), "id")
    celled = _cells(signed, F.col("parts"), F.xxhash64("id", F.lit(2))).select("bucket", "low", "high", "id", "signature")

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_a, held_b = [], []
        for table in runs(batches, ["bucket", "low", "high"]):
            ids = table.column("id").to_numpy()
            signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), HASHES)
            for i, j in spanning(signs, fewest):
                held_a.append(ids[i])
                held_b.append(ids[j])
            if len(held_a) > 10_000:
                yield pa.record_batch({"a": pa.array(held_a, pa.int64()), "b": pa.array(held_b, pa.int64())})
                held_a, held_b = [], []
        yield pa.record_batch({"a": pa.array(held_a, pa.int64()), "b": pa.array(held_b, pa.int64())})

    dealt = celled.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
    return dealt.mapInArrow(prune, "a bigint, b bigint")


def _verified(texts: DataFrame, wanted: DataFrame, threshold: float) -> DataFrame:
    """``id, root, links`` from rows of a group: verified links, and a vertex each is connected to.

    ``texts`` has ``grp, id, copies, text``; ``wanted`` has the ``grp, shingles`` of each class, once
    however often its text is repeated, so that counting them reads no text.
    """
    totals = wanted.groupBy("grp").agg(F.ceil(F.sum("shingles") / GROUP_SHINGLES).cast("bigint").alias("parts"))
    celled = _cells(texts.join(totals, "grp"), F.greatest("parts", F.lit(1)), F.xxhash64("id", F.lit(3)))
    celled = celled.select("grp", "low", "high", "part", "id", "copies", "text")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for table in runs(batches, ["grp", "low", "high"]):
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            # Repeated rows have brought the text of a class more than once.
            ids = table.column("id").to_numpy()
            table = table.filter(pa.array(np.append(True, ids[1:] != ids[:-1])))
            # Rows come sorted by part: those of the first part, then the others.
            part = table.column("part").to_numpy()
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            data, offsets = utf8(table.column("text"))
            sets: list[np.ndarray] = []
            for s, e in blocks(offsets):
                h, _, at = words.weighted(data, offsets[s : e + 1])
                sets += [h[at[i] : at[i + 1]].copy() for i in range(e - s)]
            n, middle = len(ids), int((part == low).sum())
            left, right = (range(n), range(n)) if low == high else (range(middle), range(middle, n))
            count, root = np.zeros(n, np.int64), np.arange(n)
            for i, j in links(sets, threshold, left, right):
                if low == high:
                    i, j = i[i < j], j[i < j]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                join_all(root, i, j)
            yield pa.record_batch({"id": pa.array(ids), "root": pa.array(ids[root]), "links": pa.array(count)})

    dealt = celled.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high", "part", "id")
    return dealt.mapInArrow(verify, "id bigint, root bigint, links bigint")


def join_all(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the trees of ``i`` and ``j``; ``root`` leads from every row to its tree's least row."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _key(key: Column) -> Column:
    """A key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Each row's ``key, digest``, and for each digest its class: ``least`` row and ``n_links``."""
    signed = stored(read_signatures(docs, key, text), "signatures")
    row = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    classes = signed.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(row).alias("least"),
        F.first("shingles").alias("shingles"), F.first("signature").alias("signature"),
    )
    # The numbers are fixed by being written.
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    groups = components(_candidates(classes, threshold)).select("id", F.col("root").alias("grp"))
    wanted = groups.join(classes.select("id", "copies", "shingles", "least"), "id").select(
        "grp", "id", "copies", "shingles", _key(F.col("least.key")).alias("k"), F.col("least.hash").alias("h")
    )
    body = text_of(docs, text)
    read = docs.select(_key(column(docs, key)).alias("k"), F.unhex(F.sha2(body, 256)).alias("h"), body.alias("text"))
    verified = stored(_verified(read.join(wanted, ["k", "h"]).drop("k", "h", "shingles"), wanted, threshold), "links")
    count = verified.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(verified.select(F.col("id").alias("a"), F.col("root").alias("b")))
    small = classes.select("digest", "copies", "least", "id").join(count, "id", "left").join(linked, "id", "left")
    # It is read twice by what follows; a plan of all steps at once would take the driver's memory.
    small = stored(small.withColumn("root", F.coalesce("root", "id")).drop("id"), "small")
    first = small.groupBy("root").agg(F.min("least").alias("first"))
    links_ = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links")
    return signed.select("key", "digest"), small.join(first, "root").select("digest", "first", links_)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, class_id, n_links`` of every row of ``docs``.

    Rows link if the Jaccard similarity of their sets of five-word shingles is
    ``threshold`` or more.  ``class_id`` is the least key that links reach, the
    row's own included; ``n_links`` counts the other rows linked directly.
    Rows with equal shingle sets link, and so do all rows without words (null
    and empty texts).  Repeated rows are rows.  A null key is the least one
    only if all keys of the class are null.  An empty table gives an empty one;
    columns other than key and text are ignored.
    """
    signed, classes = _classes(docs, key, text, threshold)
    return signed.join(classes, "digest").select("key", F.col("first.key").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: that with the least key.

    Of rows with that key, the least text hash decides, then a hash of the row.
    All columns are kept, whatever they are called; the rest is as in
    ``near_duplicates``.
    """
    _, classes = _classes(docs, key, text, threshold)
    k, h, place = fresh(docs, "_key", "_hash", "_place")
    kept = classes.select(_key(F.col("first.key")).alias(k), F.col("first.hash").alias(h)).distinct()
    hashed = docs.withColumn(k, _key(column(docs, key))).withColumn(h, F.unhex(F.sha2(text_of(docs, text), 256)))
    simple = [column(docs, f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    same = Window.partitionBy(k, h).orderBy(F.xxhash64(*simple))
    found = hashed.join(kept, [k, h], "left_semi").withColumn(place, F.row_number().over(same))
    return found.where(F.col(place) == 1).select(*[column(found, c) for c in docs.columns])


def near_duplicate_report(spark, folder: str) -> DataFrame:
    """``op6``: class and number of links of each document."""
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(F.col("key").alias("doc_id"), "class_id", "n_links")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    ELSE [array_to_string(ws, ' ')] END AS shingles FROM w
), u AS (SELECT doc_id, unnest(shingles) AS shingle, len(shingles) AS n FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(l.b, d.doc_id)) AS class_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN least l ON l.a = d.doc_id LEFT JOIN degree g ON g.a = d.doc_id
"""
