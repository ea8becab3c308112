"""Cross-entropy difference: how much more a text is like a target than like all texts.

Two models of word trigrams, of the target rows and of all rows, have one
vocabulary, one order and one smoothing, and are matched in size: background
counts are scaled to the target's total, so that smoothing weighs the same in
both.  A text's score is the mean over its tokens of the loss under the target
model less the loss under the background; it is negative for texts more like the
target.

Counts are exact, cover every token of every row and grow with the corpus; words
are known by 64-bit hashes.  Texts are worked on in blocks of bounded size:

* ``ask``: every block names its distinct n-grams once, with its own counts, in
  buckets of their hashes;
* ``answer``: every bucket adds the counts up and answers each block with the
  totals of the n-grams it named, in the order it named them;
* the n-grams are asked for in three slices; what one has shuffled is deleted
  before the next, so that only the answers of all are held at once;
* ``measured``: every block meets its answers and adds up its texts' losses.

So an n-gram is shuffled once a block and not once an occurrence, only counts
come back, and a hot n-gram is one entry of each block.  Keys are sent as
differences and counts as bytes, as many as their block needs.  A block's rows
with too few n-grams for all buckets name the buckets they need only, so what is
sent grows with the corpus at every number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from nearmark.llm.common import BASE, Words, blocks, column, fresh, mixed, runs, text_of, utf8
from nearmark.session import scratch_path

# Pseudo-counts of the next lower order.
SMOOTHING = 2.0
# Words that no text has: two before a text and one after it.
FIRST, SECOND, END = np.array([0x51ED270B, 0x2545F491, 0x6C62272E], np.uint64) * np.uint64(BASE)
# Bytes of texts whose n-grams are counted together before they are sent.
COUNTED_BYTES = 1 << 23
# Tokens of the corpus for one bucket of each order.
BUCKET_TOKENS = 1 << 21
# Tasks that answer; further buckets follow one another in a task.
ANSWERING = 8192
ORDERS = (1, 2, 3)
# What is asked, answered and given back before the next: orders, and the first bit of the hashes or None for both.
SLICES = (((1, 2), None), ((3,), 0), ((3,), 1))
# Marks compressed numbers.
PRESSED = 0x80
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(BASE) + mixed(second))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs, compressed where that is shorter."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    short = pa.compress(planes, "zstd", asbytes=True)
    if len(short) + 8 < planes.size:
        return bytes([width | PRESSED]) + planes.size.to_bytes(8, "little") + short
    return bytes([width]) + planes.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    width = held[0] & ~PRESSED
    planes = held[1:]
    if held[0] & PRESSED:
        planes = pa.decompress(held[9:], int.from_bytes(held[1:9], "little"), "zstd")
    planes = np.frombuffer(planes, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def sequences(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts with the words around them, and the number of each one's text."""
    hashes, at = words.words(data, offsets)
    n = np.diff(at)
    ends = np.cumsum(n + 3)
    row = np.repeat(np.arange(len(n)), n + 3)
    out = np.empty(len(row), np.uint64)
    out[ends - n - 3], out[ends - n - 2], out[ends - 1] = FIRST, SECOND, END
    out[np.arange(len(hashes)) + np.repeat(3 * np.arange(len(n)) + 2, n)] = hashes
    return out, row


def ngrams(w: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words, bigrams and trigrams, and the number of each one's text.

    Every text begins with FIRST and SECOND: it has one word less than ``w``
    (FIRST is none), as many bigrams, and a trigram for each of its tokens.
    """
    single = mixed(w[1:] + np.uint64(BASE))
    two = pair(w[:-1], w[1:])
    three = pair(two[:-1], two[1:])
    inner, last = row[:-1] == row[1:], row[:-2] == row[2:]
    return [(single[inner], row[1:][inner]), (two[inner], row[1:][inner]), (three[last], row[2:][last])]


def gathered(picked: DataFrame, body: str, wanted: str) -> DataFrame:
    """The rows in blocks of about COUNTED_BYTES, one row of Arrow bytes each, with their numbers of tokens."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            data, offsets = utf8(table.column(body))
            n = np.diff(words.words(data, offsets)[1]) + 1
            good = np.asarray(table.column(wanted).to_pylist(), bool)
            return pa.record_batch({"rows": pa.array([sink.getvalue().to_pybytes()]), "target": pa.array([int(n[good].sum())], pa.int64()), "background": pa.array([int(n.sum())], pa.int64())})

        for batch in batches:
            _, offsets = utf8(batch.column(batch.schema.get_field_index(body)))
            for first, last in blocks(offsets, COUNTED_BYTES):
                more = int(offsets[last] - offsets[first])
                if held and size + more > COUNTED_BYTES:
                    yield block()
                    held, size = [], 0
                held.append(batch.slice(first, last - first))
                size += more
        if held:
            yield block()

    out = picked.mapInArrow(gather, "rows binary, target bigint, background bigint")
    return _kept(out.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored, and what was shuffled for it given back at once: it is not read again."""
    conf, path = df.sparkSession.conf, scratch_path(df.sparkSession, label)
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        # Made anew, so that it is planned under this setting.
        df.select("*").write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _opened(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all().combine_chunks()


def ask(held: DataFrame, body: str, wanted: str, bits: int, orders: tuple[int, ...] = ORDERS, half: int | None = None) -> DataFrame:
    """The distinct n-grams of every block, in 2**bits buckets, with the block's counts in the target and in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _opened(rows.as_py())
                good = np.asarray(table.column(wanted).to_pylist(), bool)
                grams = ngrams(*sequences(*utf8(table.column(body)), words))
                for order in orders:
                    keys, row = grams[order - 1]
                    if half is not None:
                        ours = keys >> np.uint64(63) == half
                        keys, row = keys[ours], row[ours]
                    kinds, which = np.unique(keys, return_inverse=True)
                    ours, all_ = np.bincount(which, good[row], len(kinds)), np.bincount(which, minlength=len(kinds))
                    bucket = (kinds >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]])
                    steps = np.diff(kinds, prepend=np.uint64(0))
                    heads = cuts[:-1]
                    steps[heads] = kinds[heads] & np.uint64((1 << (64 - bits)) - 1)
                    yield from _portions(block, order, bucket[heads], cuts, (steps, ours, all_))

    return held.select("block", "rows").mapInArrow(run, "`block` bigint, `order` int, `bucket` int, `keys` binary, `target` binary, `background` binary")


def _portions(block: int, order: int, bucket: np.ndarray, cuts: np.ndarray, parts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    names = ("keys", "target", "background")
    for s in range(0, len(bucket), 4096):
        some = range(s, min(len(bucket), s + 4096))
        blobs = {n: pa.array([packed(v[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()) for n, v in zip(names, parts, strict=True)}
        fixed = {"block": pa.array([block] * len(some), pa.int64()), "order": pa.array([order] * len(some), pa.int32()), "bucket": pa.array(bucket[s : s + len(some)], pa.int32())}
        yield pa.record_batch(fixed | blobs)


def answer(asked: DataFrame, bits: int) -> DataFrame:
    """The totals of the n-grams each block has named, in its order; ``kinds`` of a bucket stands in one of its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["order", "bucket"]):
            bucket = table.column("bucket")[0].as_py()
            base = np.uint64(bucket << (64 - bits))
            keys = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) + base for k in table.column("keys")]
            ends = np.cumsum([0, *map(len, keys)])
            kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
            totals = {}
            for name in ("target", "background"):
                counts = np.concatenate([unpacked(c.as_py()) for c in table.column(name)])
                # Whole numbers below 2**53 add up exactly.
                sums = np.bincount(which, counts, len(kinds)).astype(np.uint64)[which]
                totals[name] = pa.array([packed(sums[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            told = np.zeros(table.num_rows, np.int64)
            told[0] = len(kinds)
            yield pa.record_batch({c: table.column(c).combine_chunks() for c in ("block", "order", "bucket")} | totals | {"kinds": pa.array(told)})

    dealt = asked.repartition(min(ANSWERING, len(ORDERS) << bits), "order", "bucket").sortWithinPartitions("order", "bucket")
    return dealt.mapInArrow(run, "`block` bigint, `order` int, `bucket` int, `target` binary, `background` binary, `kinds` bigint")


def losses(w: np.ndarray, row: np.ndarray, counted: list[np.ndarray], size: float, kinds: int, scale: float, k: float) -> np.ndarray:
    """Loss of every token, in nats, from the totals of its block's distinct n-grams."""
    whole = [np.unique(keys, return_inverse=True)[1] for keys, _ in ngrams(w, row)]
    one, two, three = (counted[i][whole[i]] * scale for i in range(3))
    # A text of n + 3 places has n + 2 words and bigrams and n + 1 trigrams: its tokens.
    r = row[np.flatnonzero(row[:-1] == row[1:]) + 1]
    first = np.diff(r, prepend=-1) != 0
    last = np.diff(r, append=-1) != 0
    c, b = one[~first], one[~last]
    p1 = (c + 1) / (size + kinds + 1)
    p2 = (two[~first] + k * p1) / (b + k)
    return -np.log((three + k * p2) / (two[~last] + k))


def score_words(docs: DataFrame, target: Column, text: str = "text", keep: tuple[str, ...] | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """Rows with ``n_tokens`` (words and the end), ``target_loss``, ``background_loss`` and ``score``, under models of word trigrams.

    ``docs`` are the background, those where ``target`` is true the target; a
    null there is false.  Whole texts count, every copy of a repeated row too.  A
    null or empty text has one token, its end.  Equal texts get equal scores; an
    empty table gives an empty one; a name in use gets underscores before it.
    """
    names = docs.columns if keep is None else list(keep)
    base = docs.select(*[column(docs, c) for c in names])
    body, wanted, tokens, ours, theirs, difference = fresh(base, "_body", "_wanted", "n_tokens", "target_loss", "background_loss", "score")
    picked = docs.select(*[column(docs, c) for c in names], text_of(docs, text).alias(body), F.coalesce(target, F.lit(False)).alias(wanted))
    held = gathered(picked, body, wanted)
    in_target, in_all = (x or 0 for x in held.agg(F.sum("target"), F.sum("background")).first())
    bits = max(1, (in_all // BUCKET_TOKENS).bit_length())
    told = reduce(DataFrame.unionByName, [_kept(answer(ask(held, body, wanted, bits, *some), bits), "counts") for some in SLICES])
    # SECOND stands for no token.
    kinds = max(0, (told.where("`order` = 1").agg(F.sum("kinds")).first()[0] or 0) - 1)
    scales = (1.0, in_target / in_all if in_all else 1.0)
    schema = base.schema.add(tokens, LongType()).add(ours, DoubleType()).add(theirs, DoubleType())

    def measured(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for rows in block.column("rows"):
            table = _opened(rows.as_py())
            w, row = sequences(*utf8(table.column(body)), Words())
            n = np.bincount(row, minlength=table.num_rows) - 2
            in_order = answers.sort_by([("order", "ascending"), ("bucket", "ascending")])
            order = in_order.column("order").to_numpy()
            text_row = np.repeat(np.arange(table.num_rows), n)
            means = []
            for name, scale in zip(("target", "background"), scales, strict=True):
                blobs = in_order.column(name)
                counted = [np.concatenate([unpacked(blobs[i].as_py()) for i in np.flatnonzero(order == o)]).astype(np.float64) for o in ORDERS]
                loss = losses(w, row, counted, in_target, kinds, scale, smoothing)
                means.append(pa.array(np.bincount(text_row, loss, table.num_rows) / n))
            rest = table.drop_columns([body, wanted]).append_column(tokens, pa.array(n, pa.int64()))
            out.append(rest.append_column(ours, means[0]).append_column(theirs, means[1]))
        return pa.concat_tables(out) if out else block.schema.empty_table().select([])

    out = held.select("block", "rows").groupBy("block").cogroup(told.drop("kinds").groupBy("block")).applyInArrow(measured, schema)
    return out.withColumn(difference, column(out, ours) - column(out, theirs))


def score_report(spark, folder: str) -> DataFrame:
    """``op4``: all documents by their likeness to those labelled as of quality."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Labels grow with the documents, so they are met by sorting at every size and never broadcast.
    labelled = docs.join(labels.hint("merge"), "doc_id", "left").withColumn("wanted", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return score_words(labelled, F.col("wanted"), keep=("doc_id",))
