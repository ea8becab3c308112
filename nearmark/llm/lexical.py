"""Ranked lexical search over an index stratified by document length.

Documents of equal normaliser ``m`` are one stratum.  In a stratum a term's
weight depends on how often a document has it and on nothing else, so its
postings are kept in runs of equal ``tf`` and the impact of each ``tf`` is
computed once.  A stratum is stored in blocks of at most ``BLOCK_DOCS``
documents; the largest ``tf`` of each term bounds what any of a block's
documents can score for a query.

Blocks with the highest bounds are visited first; they give each query the
score of a k-th document, and no other block is opened for a query whose bound
there is lower.  Queries are broadcast in portions of bounded size, the index
is read in place, and only documents that reach the score so far are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType
from pyspark.sql.window import Window

from nearmark.llm.common import blocks, column, fresh, text_of, utf8
from nearmark.session import stored

# Fixed values of the ranking.
SCALE, LENGTH_PART, FLAT = 1_000_000_000, 50, 50
TOP = 50
# Documents of a block and bytes of its distinct terms, about; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 20
# Bytes of queries searched for at once.
QUERY_BYTES = 4 << 20
# Blocks that are visited first for each query.
FIRST_BLOCKS = 4
# Postings weighed at once.
POSTINGS = 1 << 18

_LOWER = bytes(range(128)).lower() + bytes(range(128, 256))
TABLE = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in _LOWER)


def terms_of(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    out: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        part = text[at:end].translate(TABLE)
        if end < len(text):
            # A term that reaches the cut belongs to the next part, unless it fills this one.
            cut = part.rfind(b" ")
            if cut >= 0:
                part = part[:cut]
                end = at + cut + 1
            else:
                while end < len(text) and TABLE[text[end]] != 0x20:
                    end += 1
                part = text[at:end].translate(TABLE)
        out.update(part.split())
        at = end
    return out


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (SCALE * tf) // (1000 * tf + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Index:
    """Blocks of strata, and the number of documents with terms."""

    blocks: DataFrame
    documents: int
    key: str


class Block:
    """A block being filled with the documents of one stratum."""

    def __init__(self, m: int):
        self.m, self.bytes = m, 0
        self.keys: list[pa.Array] = []
        self.terms: list[bytes] = []
        self.tf: list[np.ndarray] = []
        self.sizes: list[int] = []

    def add(self, key: pa.Array, terms: list[bytes], tf: np.ndarray) -> None:
        self.keys.append(key)
        self.terms += terms
        self.tf.append(tf)
        self.sizes.append(len(terms))
        self.bytes += 8 * len(terms)

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def row(self, number: int, names: list[str]) -> pa.RecordBatch:
        coded = pa.array(self.terms, pa.binary()).dictionary_encode()
        code, tf = coded.indices.to_numpy(), np.concatenate(self.tf).astype(np.int64)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        by = np.lexsort((doc, -tf, code))
        code, tf, doc = code[by], tf[by], doc[by]
        starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (tf[1:] != tf[:-1])]))
        run_code, run_tf = code[starts], tf[starts]
        ints = lambda v, kind: pa.array([np.asarray(v, kind).tobytes()], pa.binary())
        values = [
            pa.array([self.m]),
            pa.array([number]),
            pa.ListArray.from_arrays([0, len(self.keys)], pa.concat_arrays(self.keys)),
            pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())),
            # Documents of each term, its largest tf (that of its first run), its runs.
            ints(np.bincount(code), "<i4"),
            ints(run_tf[np.searchsorted(run_code, np.arange(len(coded.dictionary)))], "<i8"),
            ints(np.bincount(run_code), "<i4"),
            ints(run_tf, "<i8"),
            ints(np.diff(np.append(starts, len(doc))), "<i4"),
            ints(doc, "<u2"),
        ]
        return pa.record_batch(values, names)


NAMES = ["m", "block", "keys", "terms", "term_docs", "term_most", "term_runs", "run_tf", "run_docs", "postings"]


def listed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n, terms, tf, place`` of each row with a term; a stored table.

    ``terms`` are the distinct ones with spaces between, ``tf`` how often each
    occurs as 32-bit numbers; ``place`` tells copies of a row apart.
    """
    rows = docs.select(column(docs, key).alias("key"), text_of(docs, text).alias("body"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).cast(pa.large_binary())
            _, offsets = utf8(bodies)
            for s, e in blocks(offsets):
                found = [terms_of(b.as_py()) for b in bodies.slice(s, e - s)]
                keep = [i for i, f in enumerate(found) if f]
                yield pa.record_batch(
                    {
                        "key": batch.column(0).slice(s, e - s).take(pa.array(keep, pa.int64())),
                        "n": pa.array([found[i].total() for i in keep], pa.int64()),
                        "terms": pa.array([b" ".join(found[i]) for i in keep], pa.binary()).cast(pa.string()),
                        "tf": pa.array([np.fromiter(found[i].values(), "<i4").tobytes() for i in keep], pa.binary()),
                    }
                )

    schema = rows.select("key").schema.add("n", LongType()).add("terms", StringType()).add("tf", BinaryType())
    return stored(rows.mapInArrow(split, schema).withColumn("place", F.monotonically_increasing_id()), "lexical-texts")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all rows of ``docs`` that have a term; a stored table.

    A text's terms are its runs of ASCII letters and digits and of characters
    beyond ASCII, A to Z in lower case; null and empty texts have none.  A
    repeated row is a document of its own.  Other columns are ignored.
    """
    texts = listed(docs, key, text)
    total = texts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    documents, terms = total["docs"], total["terms"] or 1
    m = F.expr(f"{100 - LENGTH_PART}L + ({LENGTH_PART}L * n * {documents}L) div {terms}L").alias("m")
    placed = texts.select("key", "terms", "tf", m, "place")
    # Strata of more than a block are dealt in parts; there are fewer such strata than blocks.
    need = F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum(2 * F.octet_length("tf").cast("bigint")) / BLOCK_BYTES)
    large = placed.groupBy("m").agg(F.ceil(need).cast("bigint").alias("parts")).where("parts > 1")
    # Stored, so that its size is known and decides whether it is broadcast.
    large = stored(large, "lexical-strata")
    part = F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1).cast("bigint"))).alias("part")
    dealt = placed.join(large, "m", "left").select("m", part, "key", "terms", "tf")
    dealt = dealt.repartition("m", "part").sortWithinPartitions("m", "part", "key")

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, of = None, None
        for batch in batches:
            keys, bodies, tfs = batch.column(2), batch.column(3).cast(pa.large_binary()), batch.column(4)
            for i, stratum in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if block is not None and (of != stratum or block.full()):
                    yield block.row(number, NAMES)
                    number, block = number + 1, None
                if block is None:
                    block, of = Block(stratum[0]), stratum
                block.add(keys.slice(i, 1), bodies[i].as_py().split(b" "), np.frombuffer(tfs[i].as_py(), "<i4"))
        if block is not None:
            yield block.row(number, NAMES)

    schema = StructType().add("m", LongType()).add("block", LongType())
    schema = schema.add("keys", ArrayType(texts.schema["key"].dataType)).add("terms", ArrayType(StringType()))
    for name in NAMES[4:]:
        schema = schema.add(name, BinaryType())
    return Index(stored(dealt.mapInArrow(fill, schema), "lexical"), documents, key)


class Asked:
    """The terms of a portion of queries."""

    def __init__(self, texts: list[str | None]):
        found = [sorted(terms_of((t or "").encode())) for t in texts]
        self.terms = sorted(set().union(*found))
        number = {t: i for i, t in enumerate(self.terms)}
        self.of = np.asarray([number[t] for own in found for t in own], np.int64)
        self.query = np.repeat(np.arange(len(found)), [len(own) for own in found])
        self.number = len(found)
        # The queries of each term, as ranges of ``by_term``.
        order = np.argsort(self.of, kind="stable")
        self.by_term = self.query[order]
        self.at = np.searchsorted(self.of[order], np.arange(len(self.terms) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)

    def places(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each block: its row, and which of its terms are which of the asked ones."""
        lists = batch.column(batch.schema.get_field_index("terms"))
        asked = pa.array([t.decode() for t in self.terms], pa.string())
        found = pc.index_in(lists.flatten(), asked).fill_null(-1).to_numpy()
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i in range(len(lists)):
            own = found[at[i] : at[i + 1]]
            here = np.flatnonzero(own >= 0)
            yield i, here, own[here]

    def bounds(self, m: int, term: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The most a document of normaliser ``m`` can score for each query."""
        best = np.zeros(len(self.terms), np.int64)
        best[term] = self.weights[term] * impact(most, m)
        out = np.zeros(self.number, np.int64)
        np.add.at(out, self.query, best[self.of])
        return out


def _binary(batch: pa.RecordBatch, name: str, row: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_py(), kind)


class Visit:
    """Opens blocks and keeps the best scores of each query, in one task."""

    def __init__(self, asked: Asked, top: int, least: np.ndarray):
        self.asked, self.top, self.least = asked, top, least.copy()
        self.held: list[np.ndarray] = [np.empty(0, np.int64)] * asked.number

    def open(self, batch: pa.RecordBatch, row: int, here: np.ndarray, term: np.ndarray, on: np.ndarray) -> Iterator[tuple]:
        """(queries, places of documents, scores) that may be among the best; ``on`` are the queries to try."""
        asked, m = self.asked, batch.column(0)[row].as_py()
        docs = len(batch.column(batch.schema.get_field_index("keys"))[row])
        runs = np.concatenate([[0], np.cumsum(_binary(batch, "term_runs", row, "<i4"))])
        sizes = _binary(batch, "run_docs", row, "<i4")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        postings = _binary(batch, "postings", row, "<u2").astype(np.int64)
        # One impact per tf of the stratum.
        tf, which = np.unique(_binary(batch, "run_tf", row, "<i8"), return_inverse=True)
        value = np.repeat(impact(tf, m)[which], sizes)
        place = np.full(asked.number, -1)
        tried = np.flatnonzero(on)
        place[tried] = np.arange(len(tried))
        total = np.zeros(len(tried) * docs, np.int64)
        # Pairs of a query and a term of it that is here.
        times = asked.at[term + 1] - asked.at[term]
        spot = np.repeat(np.arange(len(term)), times)
        query = place[asked.by_term[np.repeat(asked.at[term] - np.cumsum(times) + times, times) + np.arange(len(spot))]]
        spot, query = spot[query >= 0], query[query >= 0]
        start, length = ends[runs[here]][spot], (ends[runs[here + 1]] - ends[runs[here]])[spot]
        through = np.concatenate([[0], np.cumsum(length)])
        s = 0
        while s < len(spot):
            e = max(s + 1, int(np.searchsorted(through, through[s] + POSTINGS, "right")) - 1)
            n = length[s:e]
            at = np.repeat(start[s:e] - through[s:e] + through[s], n) + np.arange(through[e] - through[s])
            score = value[at] * np.repeat(asked.weights[term[spot[s:e]]], n)
            np.add.at(total, np.repeat(query[s:e] * docs, n) + postings[at], score)
            s = e
        total = total.reshape(len(tried), docs)
        good = total >= np.maximum(self.least[tried], 1)[:, None]
        for q in np.flatnonzero(good.any(axis=1)).tolist():
            own = np.flatnonzero(good[q])
            score = total[q, own]
            if len(own) > self.top:
                # Equal scores in order of place, which is that of keys.
                keep = np.sort(np.argsort(-score, kind="stable")[: self.top])
                own, score = own[keep], score[keep]
            number = int(tried[q])
            best = np.concatenate([self.held[number], score])
            if len(best) >= self.top:
                best = np.partition(best, len(best) - self.top)[-self.top :]
                self.least[number] = max(self.least[number], best.min())
            self.held[number] = best
            yield number, own, score


def _weighed(index: Index, asked: Asked) -> None:
    """Set the weights of the asked terms from the number of documents that hold each."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            for row, here, term in asked.places(batch):
                df[term] += _binary(batch, "term_docs", row, "<i4")[here]
        used = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(used), "df": pa.array(df[used])})

    part = index.blocks.select("m", "terms", "term_docs").mapInArrow(count, "term bigint, df bigint")
    for r in part.groupBy("term").agg(F.sum("df").alias("df")).collect():
        asked.weights[r["term"]] = weight(index.documents, r["df"])


def _first_blocks(index: Index, asked: Asked) -> list[int]:
    """The blocks with the highest bounds of each query."""

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = np.zeros((asked.number, FIRST_BLOCKS), np.int64), np.full((asked.number, FIRST_BLOCKS), -1)
        for batch in batches:
            ms, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, here, term in asked.places(batch):
                bounds = asked.bounds(int(ms[row]), term, _binary(batch, "term_most", row, "<i8")[here])
                worst = best.argmin(axis=1)
                q = np.flatnonzero(bounds > best[np.arange(asked.number), worst])
                best[q, worst[q]], block[q, worst[q]] = bounds[q], numbers[row]
        q, i = np.nonzero(block >= 0)
        yield pa.record_batch({"query": pa.array(q), "bound": pa.array(best[q, i]), "block": pa.array(block[q, i])})

    found = index.blocks.select("m", "block", "terms", "term_most").mapInArrow(bound, "query bigint, bound bigint, block bigint")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    # At most ``FIRST_BLOCKS`` for each query of a portion.
    return [r["block"] for r in found.withColumn("_place", place).where(F.col("_place") <= FIRST_BLOCKS).select("block").distinct().collect()]


def _scored(blocks: DataFrame, asked: Asked, top: int, least: np.ndarray) -> DataFrame:
    """``query, key, score`` of documents that may be among the best of their query."""
    key = blocks.schema["keys"].dataType.elementType

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits = Visit(asked, top, least)
        for batch in batches:
            ms = batch.column(0).to_numpy()
            found = []
            for row, here, term in asked.places(batch):
                bounds = asked.bounds(int(ms[row]), term, _binary(batch, "term_most", row, "<i8")[here])
                found.append((int(bounds.max(initial=0)), row, here, term, bounds))
            found.sort(key=lambda f: (-f[0], f[1]))
            keys = batch.column(batch.schema.get_field_index("keys"))
            for _, row, here, term, bounds in found:
                on = (bounds >= visits.least) & (bounds > 0)
                if not on.any():
                    continue
                own = keys[row].values
                for number, places, score in visits.open(batch, row, here, term, on):
                    yield pa.record_batch(
                        {"query": pa.array(np.full(len(places), number)), "key": own.take(pa.array(places)), "score": pa.array(score)}
                    )

    schema = StructType().add("query", LongType()).add("key", key).add("score", LongType())
    return blocks.mapInArrow(visit, schema)


def _best(scored: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return scored.withColumn("rank", place).where(F.col("rank") <= top)


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each query's ``top`` documents with a score above 0.

    Highest scores first, equal ones by ascending document key.  A term counts
    once however often a query has it; null and empty queries find nothing, and
    so does any query in an empty index.  Repeated queries are answered each,
    repeated documents are ranked each, and null keys come out null.  Queries
    are read to the driver in portions of about 4 MB.
    """
    rows = queries.select(column(queries, key).alias("key"), text_of(queries, text).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body") + 64)).first()[0] or 0
    portions = -(-size // QUERY_BYTES) or 1
    names = fresh(queries.select(), key, "rank", index.key, "score")
    answers = []
    for p in range(portions):
        of = rows if portions == 1 else rows.where(F.pmod(F.xxhash64("key", "body"), F.lit(portions)) == p)
        held = of.orderBy("key", "body").collect()
        asked = Asked([r["body"] for r in held])
        if not asked.terms:
            continue
        _weighed(index, asked)
        first = _first_blocks(index, asked)
        least = np.zeros(asked.number, np.int64)
        early = stored(_best(_scored(index.blocks.where(F.col("block").isin(first)), asked, top, least), top), "lexical-first")
        for r in early.where(F.col("rank") == top).select("query", "score").collect():
            least[r["query"]] = r["score"]
        later = _scored(index.blocks.where(~F.col("block").isin(first)), asked, top, least)
        best = _best(early.drop("rank").unionByName(later), top)
        number = rows.sparkSession.createDataFrame(
            [(i, r["key"]) for i, r in enumerate(held)], StructType().add("query", LongType()).add("item", rows.schema["key"].dataType)
        )
        best = best.join(F.broadcast(number), "query")
        answers.append(best.select(*[F.col(c).alias(n) for c, n in zip(["item", "rank", "key", "score"], names, strict=True)]))
    if not answers:
        kinds = StructType().add(names[0], rows.schema["key"].dataType).add(names[1], IntegerType())
        kinds = kinds.add(names[2], index.blocks.schema["keys"].dataType.elementType).add(names[3], LongType())
        return rows.sparkSession.createDataFrame([], kinds)
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def ranked_report(spark, folder: str) -> DataFrame:
    """``op11``: the fifty best documents of each benchmark item."""
    index = build(spark.read.parquet(f"{folder}/documents.parquet"))
    return search(index, spark.read.parquet(f"{folder}/benchmark.parquet"))


RANKED_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
terms AS (
  SELECT rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM d
), total AS (SELECT count(DISTINCT rid) AS docs, count(*) AS all_terms FROM terms),
tf AS (SELECT rid, term, count(*) AS tf FROM terms GROUP BY rid, term),
length AS (SELECT rid, 50 + (50 * count(*) * (SELECT docs FROM total)) // (SELECT all_terms FROM total) AS m FROM terms GROUP BY rid),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term
), asked AS (
  SELECT DISTINCT i.item_id, unnest(regexp_extract_all(translate(i.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term
  FROM benchmark i
), scores AS (
  SELECT a.item_id, tf.rid, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * l.m))) AS BIGINT) AS score
  FROM asked a JOIN tf USING (term) JOIN weights w USING (term) JOIN length l USING (rid) GROUP BY a.item_id, tf.rid
)
SELECT s.item_id, CAST(row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id) AS INTEGER) AS rank, d.doc_id, s.score
FROM scores s JOIN d USING (rid) WHERE s.score > 0
QUALIFY row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, d.doc_id) <= 50
"""
