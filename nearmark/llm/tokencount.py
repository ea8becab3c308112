"""Exact token counts of texts of any length, by a SentencePiece BPE model.

A merge makes a piece of the vocabulary.  So where no piece holds two
neighbouring characters side by side, no merge ever crosses the place between
them, whatever stands around: the text may be cut there and its parts encoded
on their own.  Long texts are cut into chunks that overlap, each is encoded
with the offsets of its tokens, and neighbours are spliced at the first place
of their overlap that is proven in this way and at which both have a token
boundary.  Where an overlap has none, it is doubled and the text done again,
until one chunk is the whole text; so every count is the library's own.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from nearmark.llm.common import column, fresh, per_process, text_of
from nearmark.session import stored

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 256
PREFIX = "▁"


class Encoder:
    """A SentencePiece model, with the pairs of characters its pieces hold.

    Needs a BPE model that leaves the text as it is (identity rules, one space
    put before it, white space kept, bytes for unknown characters), so that
    offsets in the tokens are offsets in the text.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = self._specs(self.model.serialized_model_proto())
        if spec != ("identity", True, False, True, 2):
            raise ValueError(f"not an identity BPE model: {spec}")
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # Characters each id stands for; of the bytes of a character, the first counts.
        self.chars = np.zeros(size, np.int64)
        for i, p in enumerate(pieces):
            if self.model.is_byte(i):
                value = int(p[3:5], 16)
                self.chars[i] = value < 0x80 or value >= 0xC0
            elif not self.model.is_control(i):
                self.chars[i] = len(p)

    @staticmethod
    def _specs(proto: bytes) -> tuple:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        rules = model.normalizer_spec
        trained = model.trainer_spec
        return rules.name, rules.add_dummy_prefix, rules.remove_extra_whitespaces, trained.byte_fallback, trained.model_type

    def counts(self, texts: list[str]) -> list[int]:
        return [len(t) for t in self.model.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray:
        """Where tokens end, in characters of ``text``."""
        ids = np.asarray(self.model.encode(text), np.int64)
        ends = np.cumsum(self.chars[ids]) if len(ids) else np.empty(0, np.int64)
        # The model puts a space before the text, which is no character of it.
        return np.maximum(ends - 1, 0)

    def proven(self, text: str, at: int) -> bool:
        """No token can cross ``at``."""
        return text[at - 1 : at + 1].replace(" ", PREFIX) not in self.pairs

    def splice(self, text: str, low: int, high: int, ends: np.ndarray) -> int:
        """First proven token boundary in ``low`` < place < ``high``, or -1."""
        marks = ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high, "left")]
        for at in marks.tolist():
            if self.proven(text, at):
                return at
        return -1


def chunk_tokens(encoder: Encoder, text: str, first: bool, last: bool, overlap: int) -> int:
    """Tokens of one chunk between its two splices; -1 if one of them is missing.

    The chunk's head, ``overlap`` long, is also the tail of the one before; its
    own tail is the head of the next.  Both find the same splice there, because
    a proven place is a boundary of both, and of any other chunk that has it.
    """
    ends = encoder.ends(text)
    low, high = 0, len(text)
    if not first:
        low = encoder.splice(text, 0, overlap, ends)
    if not last:
        high = encoder.splice(text, len(text) - overlap, len(text), ends)
    if low < 0 or high < 0:
        return -1
    # A token that ends at 0 is the space put before the text: the first chunk's.
    after = -1 if first else low
    return int(((ends > after) & (ends <= high)).sum())


def _encoder(model: str) -> Encoder:
    return per_process(f"pieces:{model}", lambda: Encoder(model))


def token_counts(
    docs: DataFrame,
    model: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``keep`` columns, ``n_bytes`` and ``n_tokens`` of every row.

    ``model`` is a path that executors have too.  Null text counts as empty, an
    empty text has no bytes and no tokens; repeated rows are counted each on
    its own; an empty table gives an empty one.  Other columns are ignored.

    Texts of up to two chunks are encoded where they are.  Chunks of longer ones
    are dealt over the cluster, and only their counts are gathered.
    """
    if not 2 <= overlap <= chunk:
        raise ValueError("the overlap is 2 characters at least and a chunk at most")
    spark = docs.sparkSession
    base = docs.select(*[column(docs, c) for c in keep])
    body, row, size, tokens = fresh(base, "_text", "_row", "n_bytes", "n_tokens")
    picked = docs.select(*[column(docs, c) for c in keep], text_of(docs, text).alias(body))
    picked = picked.withColumn(size, F.octet_length(body).cast("bigint"))
    long = F.char_length(body) > 2 * chunk

    def short_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(body)).to_pylist()
            rest = batch.drop_columns([body])
            yield rest.append_column(tokens, pa.array(encoder.counts(texts), pa.int64()))

    whole = picked.where(~long)
    schema = whole.drop(body).schema.add(tokens, LongType())
    small = whole.mapInArrow(short_counts, schema)
    # The row number is fixed by being written; it tells repeated rows apart.
    pending = stored(picked.where(long).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    done = [small]
    step, width = chunk, overlap
    while not pending.isEmpty():
        counts = stored(_by_chunk(pending, model, body, row, step, width), "chunk-counts")
        found = counts.groupBy(row).agg(F.sum("n").alias(tokens), (F.min("n") >= 0).alias("ok"))
        ready = found.where("ok").drop("ok")
        done.append(pending.drop(body).join(ready, row).drop(row))
        failed = found.where(~F.col("ok")).select(row)
        pending = stored(pending.join(failed, row, "left_semi"), "long-texts")
        width *= 2
        step = max(step, width)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _by_chunk(texts: DataFrame, model: str, body: str, row: str, step: int, overlap: int) -> DataFrame:
    """Token count of each chunk of each text; negative where a splice is missing."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = value.as_py()
                # The last chunk has more than its head, or it would add nothing.
                n = max(1, -(-(len(value) - overlap) // step))
                for k in range(n):
                    last = k == n - 1
                    part = value[k * step : len(value) if last else (k + 1) * step + overlap]
                    yield pa.record_batch({row: pa.array([key], pa.int64()), "k": pa.array([k], pa.int32()), "last": [last], "part": [part]})

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            d = batch.to_pydict()
            n = [chunk_tokens(encoder, p, k == 0, last, overlap) for p, k, last in zip(d["part"], d["k"], d["last"], strict=True)]
            yield pa.record_batch({row: batch.column(0), "n": pa.array([x if x >= 0 else -(1 << 40) for x in n], pa.int64())})

    chunks = texts.select(row, body).mapInArrow(cut, f"{row} bigint, k int, last boolean, part string")
    dealt = chunks.repartition(row, "k")
    return dealt.mapInArrow(encode, f"{row} bigint, n bigint")


def default_model() -> str:
    """The 32k piece model of the public tokenizers, where they are installed."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("piece_bpe_32k.model"))


def token_report(spark, folder: str, limit: int = 4096) -> DataFrame:
    """``op5``: bytes, tokens and whether a text exceeds ``limit`` tokens."""
    counted = token_counts(spark.read.parquet(f"{folder}/documents.parquet"), default_model())
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
