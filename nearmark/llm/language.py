"""Language identification by averaged embeddings of hashed subwords.

A text's subwords are its runs of two to four bytes within words, the places
before and after a word included.  Each is hashed to a row of an embedding
table; the rows of all subwords of the whole text are averaged and a linear
softmax gives the languages' probabilities.  Both are trained together by
stochastic gradient descent in NumPy on a bounded sample of labelled rows.
A temperature, fitted on a part of the sample that training never saw, makes
the probabilities honest.  They tell learned languages apart and not those from
others, so rejection looks at the subwords: one is known in a language that has
it more often than a hash has a bucket.  A text goes if the share of its subwords
known in its predicted language is below a floor, midway between that of random
subwords and a low quantile of the calibration rows that are predicted rightly.
The floor does not depend on how many languages are learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType
from pyspark.sql.window import Window

from nearmark.llm.common import column, forget, fresh, text_of, utf8

BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (2, 3, 4)
# Expected rows of the training sample, in all and of one language at most.
SAMPLE_ROWS, SAMPLE_LANGUAGE = 2400, 600
EPOCHS, BATCH, RATE = 20, 32, 1.0
# A fifth of the sample calibrates.
CALIBRATE = 5
# Of the calibration rows, as many may have a smaller share of known subwords.
LEAST_QUANTILE = 0.01
UNKNOWN = "und"
# Texts counted at once, and bytes of a long text worked on at once.
COUNTED, SLICE = 16, 1 << 20


class Subwords:
    """Counts of hashed subwords."""

    def __init__(self) -> None:
        self.fold = np.full(256, 0x20, np.uint32)
        letters = [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]
        self.fold[letters] = letters
        self.fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)

    def _hashes(self, data: np.ndarray) -> Iterator[np.ndarray]:
        b = self.fold[data]
        # Capitals of the Latin-1 letters, as two bytes of UTF-8.
        capital = (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97) & (b[:-1] == 0xC3)
        b[1:][capital] += 0x20
        word = b != 0x20
        for n in ORDERS:
            m = len(b) - n + 1
            if m <= 0:
                continue
            good = np.ones(m, bool)
            for k in range(1, n - 1):
                good &= word[k : k + m]
            if n == 2:
                good = word[:m] | word[1 : 1 + m]
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ b[k : k + m]
            h *= np.uint32(0x9E3779B1)
            yield np.where(good, h >> np.uint32(17), BUCKETS).astype(np.int64)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of counts for each text; the last column counts what is no subword."""
        n = len(offsets) - 1
        out = np.zeros((n, BUCKETS), np.float32)
        for i in range(n):
            low, high = int(offsets[i]), int(offsets[i + 1])
            for s in range(low, high, SLICE):
                # Subwords that begin in a slice reach into the next.
                e = min(high, s + SLICE + max(ORDERS) - 1)
                part = data[s:e] if s > low else np.concatenate([[0x20], data[s:e]])
                part = np.append(part, 0x20).astype(np.uint8) if e == high else part
                for h in self._hashes(part):
                    out[i] += np.bincount(h, minlength=BUCKETS + 1)[:BUCKETS]
                if e == high:
                    break
        return out


@dataclass
class Model:
    """Languages, and what each subword adds to each one's score."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    # Of each bucket and language; the least share of a text that is known.
    known: np.ndarray | None = None
    floor: float = 0.0

    def shares(self, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The share of each text's subwords that are known in the language ``at`` it."""
        if self.known is None:
            return np.ones(len(counts))
        return (counts @ self.known)[np.arange(len(counts)), at] / np.maximum(counts.sum(axis=1), 1)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        if not self.languages:
            return np.zeros((len(counts), 0))
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return softmax((counts / total) @ self.weights + self.bias, self.temperature)


def softmax(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    z = np.asarray(logits, np.float64) / temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def share(row: tuple[np.ndarray, np.ndarray, str]) -> np.ndarray:
    """A row's counts as shares of their sum; made anew each time, as all rows' shares are larger than the rows."""
    return row[1] / max(1, row[1].sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 0) -> Model:
    """Fit on rows of (bucket numbers, their counts, language), in the order given."""
    languages = sorted({lang for *_, lang in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    label = np.array([languages.index(lang) for *_, lang in rows])
    rng = np.random.default_rng(seed)
    held = np.arange(len(rows)) % CALIBRATE == CALIBRATE - 1
    fit = np.flatnonzero(~held)
    # Averages of many rows are short; one factor brings them to length one.
    scale = 1 / max(1e-9, float(np.mean([np.sqrt((share(r) ** 2).sum()) for r in rows])))
    table = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
    top = rng.normal(0, 0.3, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), BUCKETS), np.float32)
        for r, i in enumerate(which):
            x[r, rows[i][0]] = share(rows[i]) * scale
        return x

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for s in range(0, len(order), BATCH):
            batch = order[s : s + BATCH]
            x, y = dense(batch), label[batch]
            mean = x @ table
            g = softmax(mean @ top + bias).astype(np.float32)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            used = np.flatnonzero(x.any(axis=0))
            step = x[:, used].T @ (g @ top.T)
            top -= rate * (mean.T @ g)
            bias -= rate * g.sum(axis=0)
            table[used] -= rate * step
    model = Model(languages, (table @ top).astype(np.float64) * scale, bias.astype(np.float64))
    model.temperature = temperature(model, rows, label, np.flatnonzero(held))
    model.known = np.zeros((BUCKETS, len(languages)), np.float32)
    for i in fit:
        model.known[rows[i][0], label[i]] += share(rows[i])
    model.known = (model.known * BUCKETS >= np.bincount(label[fit], minlength=len(languages))).astype(np.float32) * (model.known > 0)
    model.floor = floor(model, rows, label, np.flatnonzero(held))
    return model


def floor(model: Model, rows, label: np.ndarray, held: np.ndarray) -> float:
    """Midway between random subwords and the lowest of the held rows that are predicted rightly."""
    right = [i for i in held if (model.weights[rows[i][0]].T @ share(rows[i]) + model.bias).argmax() == label[i]]
    if not right:
        return 0.0
    least = np.quantile([model.known[rows[i][0], label[i]] @ share(rows[i]) for i in right], LEAST_QUANTILE)
    return float(least + model.known.mean(axis=0).max()) / 2


def temperature(model: Model, rows, label: np.ndarray, held: np.ndarray) -> float:
    """The divisor of the scores that makes the held rows' labels most likely."""
    if not len(held):
        return 1.0
    logits = np.array([model.weights[rows[i][0]].T @ share(rows[i]) + model.bias for i in held])
    loss = lambda t: -np.log(softmax(logits, t)[np.arange(len(held)), label[held]] + 1e-12).mean()
    return float(min(np.geomspace(0.25, 8, 41), key=loss))


def held_out(key: Column) -> Column:
    """Rows whose labels are for testing: CRC-32 of the key's text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows: int = SAMPLE_ROWS,
    per_language: int = SAMPLE_LANGUAGE,
) -> Model:
    """Train on a sample of the labelled rows outside the held-out quarter.

    The sample has ``rows`` rows and ``per_language`` of a language in
    expectation, as a row is taken by the hash of its key, and never more than
    twice as many, however often a key is repeated.  Only the ``rows`` most
    frequent labels are learned.  Rows without key or label are never taken.
    Only subword counts reach the driver.
    """
    labelled = docs.select(
        column(docs, key).cast("string").alias("k"), column(docs, lang).cast("string").alias("lang"), text_of(docs, text).alias("body"),
        F.crc32(column(docs, key).cast("string").cast("binary")).alias("c"),
    ).where("k is not null and lang is not null and c % 4 <> 2")
    frequent = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows)
    found = {r["lang"]: r["count"] for r in frequent.collect()}
    if not found:
        return train([])
    quota = min(per_language, max(1, rows // len(found)))
    chance = F.lit(0.0)
    for name, n in found.items():
        chance = F.when(F.col("lang") == name, F.lit(min(1.0, quota / n))).otherwise(chance)
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.where(place < chance).select("k", "lang", "body", F.xxhash64("k", "body").alias("h"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        subwords = Subwords()
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i in range(batch.num_rows):
                counts = subwords.counts(data, offsets[i : i + 2])[0]
                used = np.flatnonzero(counts)
                yield pa.record_batch({"k": batch.column(0)[i : i + 1], "lang": batch.column(1)[i : i + 1], "buckets": pa.array([used.astype(np.int16)]), "counts": pa.array([counts[used].astype(np.int32)]), "h": batch.column(3)[i : i + 1]})

    counted = sample.mapInArrow(count, "k string, lang string, buckets array<smallint>, counts array<int>, h bigint")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k"))
    table = counted.withColumn("n", number).where(F.col("n") <= 2 * quota).drop("n").toArrow()
    gathered = []
    for k, lang, b, c, h in zip(*[table.column(x).to_pylist() for x in (0, 1)], table.column(2), table.column(3), table.column(4).to_pylist(), strict=True):
        gathered.append((k, lang, b.values.to_numpy(), c.values.to_numpy(), h))
    # Arrival order varies; repeated keys are told apart by what they hold.
    gathered.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[1], r[4]))
    return train([(b, c, lang) for _, lang, b, c, _ in gathered])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Rows with ``lang_pred``, ``score`` and ``rejected``, and the names of these.

    A text that is null or has no letter is ``und`` with score 0 and rejected,
    and so is every text if there was nothing to learn from.  The whole text
    counts.  Rows are judged one by one, repeated ones alike; a name that the
    rows have already gets underscores before it.
    """
    names = docs.columns if keep is None else list(keep)
    base = docs.select(*[column(docs, c) for c in names])
    body, letters, pred, score, rejected = fresh(base, "_body", "_letters", "lang_pred", "score", "rejected")
    source = text_of(docs, text)
    picked = docs.select(*[column(docs, c) for c in names], source.alias(body), source.rlike(r"\p{L}").alias(letters))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = base.schema.add(pred, StringType()).add(score, DoubleType()).add(rejected, BooleanType())

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, subwords = shared.value, Subwords()
        languages = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(body)))
            good = np.asarray(batch.column(batch.schema.get_field_index(letters)).to_pylist(), bool)
            best, at = np.zeros(batch.num_rows), np.full(batch.num_rows, len(known.languages))
            gone = np.full(batch.num_rows, not known.languages)
            for s in range(0, batch.num_rows if known.languages else 0, COUNTED):
                counts = subwords.counts(data, offsets[s : s + COUNTED + 1])
                p = known.probabilities(counts)
                at[s : s + COUNTED], best[s : s + COUNTED] = p.argmax(axis=1), p.max(axis=1)
                gone[s : s + COUNTED] = known.shares(counts, at[s : s + COUNTED]) < known.floor
            at[~good], best[~good], gone[~good] = len(known.languages), 0.0, True
            rest = batch.drop_columns([body, letters])
            rest = rest.append_column(pred, pa.array(languages[at].tolist(), pa.string())).append_column(score, pa.array(best))
            yield rest.append_column(rejected, pa.array(gone))

    return picked.mapInArrow(predict, schema), {"lang_pred": pred, "score": score, "rejected": rejected}


def language_report(spark, folder: str) -> DataFrame:
    """``op2``: predicted language and its score, for every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, _ = identify(docs, fit(docs), keep=("doc_id",))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
