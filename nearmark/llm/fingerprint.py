"""Document fingerprints by consistent weighted sampling.

A text is the set of its five-word shingles, each weighted by how often it
occurs.  Every sample draws, per shingle and from the shingle's hash alone,
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1).  For weight S, with

    t = floor(ln S / r + b),   ln a = ln c - r (t - b) - r,

the shingle of least a and its t are the sample.  Two texts' samples are equal
with a probability that is their generalised Jaccard similarity.

At weight 1, a = c exp(-r (1 - b)) is exponentially distributed.  So a is drawn
first and the rest given a: c = a + e1, z = ln(c / a), r = z + e2, b = 1 - z / r
with e1, e2 exponential, which have jointly the distributions above.  For the
many shingles of weight 1 the least a is then the least uniform hash, t is 0,
and only shingles that repeat need the logarithms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nearmark.llm.common import Words, blocks, column, fresh, mixed, text_of, utf8
from nearmark.session import stored

SAMPLES = 64
# Bytes kept of a sample's hash: unequal samples agree once in 65,536 times.
SAMPLE_BYTES = 2
ULP = 2.0**-64
# Shingles that repeat, worked on at once.
REPEATED = 1 << 15


def _draws(samples: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mixed(np.arange(1, 2 * samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return drawn[:samples] | np.uint64(1), drawn[samples:]


def _exponential(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.minimum((x.astype(np.float64) + 0.5) * ULP, 1 - 2.0**-53))


def gammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of uniform 64-bit hashes ``x``; the least x has the least a at weight 1."""
    a = _exponential(x)
    c = a + _exponential(mixed(x ^ np.uint64(0xA0761D6478BD642F)))
    z = np.log(c / a)
    r = z + _exponential(mixed(x ^ np.uint64(0xE7037ED1A0B428DB)))
    return r, np.log(c), 1 - z / r


def sample(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and t of shingles with hashes ``x`` in a sample."""
    r, log_c, b = gammas(x)
    t = np.floor(np.log(weight) / r + b)
    return log_c - r * (t - b) - r, t


def fingerprints(h: np.ndarray, weight: np.ndarray, at: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit sample hashes for each text; zeros for a text without words."""
    n = len(at) - 1
    out = np.zeros((n, samples), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    a, b = _draws(samples)
    starts = at[:-1][full]
    owner = np.repeat(np.arange(len(full)), np.diff(at)[full])
    many = np.flatnonzero(weight > 1)
    x = np.empty_like(h)
    for k in range(samples):
        np.multiply(h, a[k], out=x)
        x += b[k]
        picked = x.copy() if len(many) else x
        # Shingles that repeat take no part in the search for the least hash.
        picked[many] = np.uint64(2**64 - 1)
        least = np.minimum.reduceat(picked, starts)
        chosen, times = least, np.zeros(len(full), np.uint64)
        if len(many):
            best = np.log(_exponential(least))
            best[least == np.uint64(2**64 - 1)] = np.inf
            chosen = least.copy()
            for s in range(0, len(many), REPEATED):
                part = many[s : s + REPEATED]
                log_a, t = sample(x[part], weight[part])
                order = np.lexsort((x[part], log_a, owner[part]))
                first = order[np.append(True, np.diff(owner[part][order]) > 0)]
                better = log_a[first] < best[owner[part][first]]
                i, f = owner[part][first][better], first[better]
                best[i], chosen[i], times[i] = log_a[f], x[part][f], t[f].astype(np.int64).astype(np.uint64)
        # One hash of the shingle and its t stands for both.
        mark = mixed(chosen ^ (times * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(48)
        out[full, k] = np.maximum(mark, np.uint64(1)).astype(np.uint16)
    return out


def of_texts(words: Words, data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    rows = [fingerprints(*words.weighted(data, offsets[s : e + 1]), samples) for s, e in blocks(offsets, 1 << 20)]
    return np.concatenate(rows) if rows else np.zeros((0, samples), np.uint16)


def hexed(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints (hexadecimal text)."""
    width = 2 * SAMPLE_BYTES
    same = [(F.substring(one, 1 + i * width, width) == F.substring(other, 1 + i * width, width)).cast("int") for i in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, samples: int = SAMPLES) -> DataFrame:
    """Rows with ``fingerprint``, the hexadecimal samples of the whole text.

    Equal texts have equal fingerprints.  Null and empty texts and texts without
    words have that of zeros.  Repeated rows get the same one each; an empty
    table gives an empty one; a name in use gets underscores before it.
    """
    names = docs.columns if keep is None else list(keep)
    base = docs.select(*[column(docs, c) for c in names])
    body, mark = fresh(base, "_body", "fingerprint")
    picked = docs.select(*[column(docs, c) for c in names], text_of(docs, text).alias(body))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(body)))
            marks = [hexed(r) for r in of_texts(words, data, offsets, samples)]
            yield batch.drop_columns([body]).append_column(mark, pa.array(marks, pa.string()))

    return picked.mapInArrow(run, base.schema.add(mark, StringType()))


def spliced(text: str, other: str) -> str:
    """``text``, its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and of the text after it.

    Texts follow one another in descending order of the key, nulls at the end,
    and after the last comes the first.  Rows of equal keys are ordered by a
    hash of the text.  The order is cut into ranges; tasks go through theirs,
    and the last row of each range is finished with the first row of the next.
    Only these rows, two of each range, are joined.
    """
    body = text_of(docs, text)
    ordered = docs.select(column(docs, key).alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"))
    order = [F.col("key").desc_nulls_last(), F.col("tie")]
    ranged = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = ordered.schema["key"].dataType.simpleString()
    results = f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, next_fingerprint binary"

    def edit(words: Words, texts: list[str], nexts: list[str]) -> tuple[list[str], list[bytes]]:
        edited = pa.array([spliced(t, n) for t, n in zip(texts, nexts, strict=True)], pa.large_string())
        data, offsets = utf8(edited)
        marks = [r.astype(">u2").tobytes() for r in of_texts(words, data, offsets)]
        return [hashlib.sha256(data[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(len(texts))], marks

    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = Words(), TaskContext.get().partitionId()
        held = None  # the last row so far: key, text, fingerprint
        first = None
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                rows = batch.slice(s, 256)
                data, offsets = utf8(rows.column(1))
                marks = [r.astype(">u2").tobytes() for r in of_texts(words, data, offsets)]
                keys, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
                if held is None:
                    first = (texts[0], marks[0])
                else:
                    keys, texts, marks = [held[0], *keys], [held[1], *texts], [held[2], *marks]
                held = (keys[-1], texts[-1], marks[-1])
                if len(keys) > 1:
                    shas, edited = edit(words, texts[:-1], texts[1:])
                    yield rows_of(batch.schema.field(0).type, keys[:-1], [len(t) for t in texts[:-1]], shas, marks[:-1], edited, marks[1:])
        if held is not None:
            yield edge_of(batch.schema.field(0).type, held, first, part)

    plain = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("next_fingerprint", pa.binary())])
    edge = pa.schema([("part", pa.int64()), ("last_text", pa.string()), ("first_text", pa.string()), ("first_mark", pa.binary())])

    def rows_of(key_type, keys, *values) -> pa.RecordBatch:
        arrays = [pa.array(keys, key_type), *[pa.array(v, f.type) for v, f in zip(values, plain, strict=True)]]
        arrays += [pa.nulls(len(keys), f.type) for f in edge]
        return pa.RecordBatch.from_arrays(arrays, names=["key", *plain.names, *edge.names])

    def edge_of(key_type, last, first, part) -> pa.RecordBatch:
        values = [[last[0]], [len(last[1])], [None], [last[2]], [None], [None], [part], [last[1]], [first[0]], [first[1]]]
        types = [key_type, *[f.type for f in plain], *[f.type for f in edge]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["key", *plain.names, *edge.names])

    done = stored(ranged.mapInArrow(inner, f"{results}, part bigint, last_text string, first_text string, first_mark binary"), "fingerprints")
    edges = done.where("part is not null")
    # One number per range; what comes after the last range is the first.
    every = Window.partitionBy(F.lit(0))
    after = edges.select("part").withColumn("next", F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)))
    firsts = edges.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"), F.col("first_mark").alias("next_mark"))
    open_ = edges.select("key", "part", "n_chars", "fingerprint", "last_text").join(after, "part").join(firsts, "next")

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            d = batch.to_pydict()
            shas, edited = edit(words, d["last_text"], d["next_text"])
            arrays = [batch.column(batch.schema.get_field_index("key")), *[pa.array(v, f.type) for v, f in zip((d["n_chars"], shas, d["fingerprint"], edited, d["next_mark"]), plain, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *plain.names])

    closed = open_.select("key", "n_chars", "fingerprint", "last_text", "next_text", "next_mark").mapInArrow(finish, results)
    inside = done.where("part is null").select("key", *plain.names)
    return inside.unionByName(closed)


def fingerprint_report(spark, folder: str) -> DataFrame:
    """``op1``: fingerprints of all documents and their edited texts, and likenesses."""
    found = with_next(spark.read.parquet(f"{folder}/documents.parquet"))
    text = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")}
    return found.select(
        F.col("key").alias("doc_id"), "n_chars", "edited_sha256",
        text["fingerprint"].alias("fingerprint"), text["edited_fingerprint"].alias("edited_fingerprint"),
        likeness(text["fingerprint"], text["edited_fingerprint"]).alias("near_edited"),
        likeness(text["fingerprint"], text["next_fingerprint"]).alias("near_next"),
    )
