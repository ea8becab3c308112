"""Packing token sequences into windows by minimum bin slack.

Texts longer than a window fill whole windows; what remains of each is put into
a pool of lengths.  A window is begun with the longest remaining length, and a
subset-sum dynamic program over the pool's lengths, kept as bitsets, finds the
multiset of lengths that fills the window closest; the bitsets of the steps are
followed back to how many of each length it takes.

Every task packs the texts of its own partition.  What is left at a task's end,
less than a window of ids, is packed with that of other tasks: groups of 256
tasks meet in one, which leaves less than a window again, and groups of groups
meet until there is one.  Only what that leaves is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import operator
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from nearmark.llm.common import blocks, column, fresh, per_process, text_of, utf8
from nearmark.session import stored

WINDOW = 4096
END_ID = 2
# Remainders held by a task before it packs, and the least kept for later choices.
POOL, POOL_LEFT = 4096, 1024
# What may follow a word of plain letters and is split off by the tokenizer.
MARKS = ".,;:!?|%*&#$+=/)@~^-"
LETTERS = "^[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+$"
# Tasks, or groups of tasks, whose remainders are packed together: less than 4 MB of ids.
GROUP = 256
# Bytes of text split into words at once, and words whose ids are placed at once.
TEXT_BYTES, WORDS_PLACED = 1 << 22, 1 << 17
# Words whose ids a worker remembers, and the longest such word.
MEMORY_WORDS, WORD_CHARS = 600_000, 40


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library that drops white space.

    Its rules split texts at white space before anything else, so a text's ids
    are those of its words, which are remembered while they fit.  Of a word of
    plain letters and marks after them the letters and the marks are apart too,
    in lower case.
    """

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        # Words asked for since memory was last half full, and those before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # The same pieces for words of small letters, which need no other rule.
        self.plain = tokenizers.Tokenizer(self.tokenizer.model)
        byte_level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.CharDelimiterSplit(" "), byte_level])
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")

    def direct(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        """Ids of words of small letters, many in one call; each ends with its own last piece."""
        for s in range(0, len(words), 4096):
            part = words[s : s + 4096]
            texts = [" ".join(part[t : t + 128]) for t in range(0, len(part), 128)]
            found = self.plain.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in found])
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(part):
                raise ValueError("words and their last pieces differ in number")
            data = ids.tobytes()
            self.known.update(zip(part, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _recall(self, words: Iterable[str]) -> list[str]:
        """Words that are not known, nor were before."""
        known, older = self.known, self.older
        missing = [w for w in words if w not in known]
        if not older:
            return missing
        again = [w for w in missing if w in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        return [w for w in missing if w not in older] if again else missing

    def _learn(self, words: list[str]) -> None:
        table = pa.array(words, pa.string())
        cores = pc.utf8_rtrim(table, MARKS)
        plain = pc.match_substring_regex(cores, LETTERS)
        odd = table.filter(pc.invert(plain)).to_pylist()
        split = strings(table.filter(plain))
        cores = cores.filter(plain)
        marks = [w[n:] for w, n in zip(split, pc.utf8_length(cores).to_pylist(), strict=True)]
        cores = strings(pc.utf8_lower(cores))
        for w in self._recall({*marks, *odd}):
            self.known[w] = self.direct(w)
        self._learn_letters(self._recall(set(cores)))
        get = self.known.__getitem__
        self.known.update(zip(split, map(operator.add, map(get, cores), map(get, marks)), strict=True))

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = lists.flatten().dictionary_encode()
        words = strings(found.dictionary)
        if len(words) > MEMORY_WORDS // 2 and len(texts) > 1:
            half = len(texts) // 2
            return self.ids(texts.slice(0, half)) + self.ids(texts.slice(half))
        # Long words are kept for these texts alone.
        is_long = pc.greater(pc.utf8_length(found.dictionary), WORD_CHARS)
        long = {w: self.direct(w) for w in strings(found.dictionary.filter(is_long))}
        self._learn(self._recall([w for w in words if w not in long] if long else words))
        get = self.known.__getitem__
        held = [long[w] if w in long else get(w) for w in words] if long else list(map(get, words))
        if len(self.known) > MEMORY_WORDS // 2:
            # One text may have more words than that.
            self.known, self.older = {}, self.known if len(self.known) <= MEMORY_WORDS else {}
        # The ids of all distinct words, and where the words of the texts find theirs.
        ids = np.frombuffer(b"".join(held), "<u4")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        starts, at = np.cumsum(sizes) - sizes, found.indices.to_numpy()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        out = []
        for s, e in blocks(cuts, WORDS_PLACED):
            own = at[cuts[s] : cuts[e]]
            counts = sizes[own]
            ends = np.concatenate([[0], np.cumsum(counts)])
            placed = ids[np.repeat(starts[own] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
            edges = (4 * ends[cuts[s : e + 1] - cuts[s]]).tolist()
            out += [placed[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return out


def fill(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest of at most ``room``.

    ``counts`` says how many of each length there are; ``lengths`` are its keys
    in order, if they are at hand.  A bit of ``reach`` is a
    sum that can be made; lengths are added one after the other, long ones
    first, in powers of two of their number, and the steps are kept.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    lengths = sorted(counts) if lengths is None else lengths
    for at in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        most, times = min(counts[length], room // length), 1
        while most and not reach >> room & 1:
            times = min(times, most)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & full
            most -= times
            times *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + times
            at -= length * times
    return taken


class Packer:
    """Packs documents of one task; gives (document, start, length, sequence, offset)."""

    def __init__(self, window: int, pool: int = POOL, left: int = POOL_LEFT):
        self.window, self.pool, self.left = window, pool, left
        # length -> remainders of that length and how many, and the lengths in order
        self.held: dict[int, list[tuple[int, int]]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.size = self.tokens = self.sequence = 0
        self.out: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int, length: int) -> None:
        start = 0
        while length - start >= self.window:
            self._emit([(doc, start, self.window)])
            start += self.window
        if length > start:
            self._hold(doc, start, length - start)
        if self.size >= self.pool:
            self.pack(self.left)

    def _hold(self, doc: int, start: int, length: int) -> None:
        if length not in self.held:
            self.held[length] = []
            bisect.insort(self.lengths, length)
        self.held[length].append((doc, start))
        self.counts[length] = len(self.held[length])
        self.size += 1
        self.tokens += length

    def _emit(self, pieces: list[tuple[int, int, int]]) -> None:
        offset = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.sequence, offset))
            offset += length
        self.sequence += 1

    def _take(self, length: int) -> tuple[int, int, int]:
        of = self.held[length]
        doc, start = of.pop()
        self.counts[length] -= 1
        if not of:
            del self.held[length], self.counts[length], self.lengths[bisect.bisect_left(self.lengths, length)]
        self.size -= 1
        self.tokens -= length
        return doc, start, length

    def pack(self, left: int) -> None:
        """Fill windows until ``left`` remainders are held, or too few tokens for a window."""
        while self.size > left and self.tokens >= self.window:
            pieces = [self._take(self.lengths[-1])]
            taken = fill(self.counts, self.window - pieces[0][2], self.lengths)
            pieces += [self._take(n) for n, times in taken.items() for _ in range(times)]
            room = self.window - sum(p[2] for p in pieces)
            if room and self.held:
                # No multiset fits; a remainder is cut, and its rest goes back.
                doc, start, length = self._take(self.lengths[bisect.bisect_right(self.lengths, room)])
                pieces.append((doc, start, room))
                self._hold(doc, start + room, length - room)
            self._emit(pieces)

    def rest(self) -> list[tuple[int, int, int]]:
        """Fill windows while they can be; (document, start, length) of what is left, long ones first."""
        self.pack(0)
        return [self._take(n) for n in sorted(self.held, reverse=True) for _ in range(len(self.held[n]))]

    def finish(self) -> None:
        rest = self.rest()
        total = sum(p[2] for p in rest)
        bit = self.window
        while total:
            if total >= bit:
                pieces, room = [], bit
                while room:
                    doc, start, length = rest.pop()
                    cut = min(length, room)
                    pieces.append((doc, start, cut))
                    room -= cut
                    if cut < length:
                        rest.append((doc, start + cut, length - cut))
                self._emit(pieces)
                total -= bit
            else:
                bit //= 2


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW, end: int = END_ID
) -> DataFrame:
    """Pieces of documents, and where they lie in sequences of ``window`` ids.

    A document's ids are those of its text and ``end``.  Per piece: the ``keep``
    columns, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of its ids as little-endian 32-bit numbers), ``doc_tokens``
    (ids of the document), ``sequence_id`` and ``offset`` there.  Every id lies
    in one piece.  Sequences are full windows or have a power of two of ids; a
    sequence is a number of the task or group of tasks and one within it, so that
    reruns over the same partitions agree.  ``window`` is a power of two.

    A null or empty text has the one id ``end``.  Repeated rows are packed each;
    an empty table gives an empty one; names that ``keep`` has already get
    underscores before them.
    """
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    base = docs.select(*[column(docs, c) for c in keep])
    body, group, ids_left, *names = fresh(base, "_body", "_group", "_ids", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    picked = docs.select(*[column(docs, c) for c in keep], text_of(docs, text).alias(body))
    schema = base.schema
    for name in names:
        schema = schema.add(name, LongType())
    # A piece that is left has its ids and the number of its task instead of a sequence.
    schema = schema.add(group, LongType()).add(ids_left, BinaryType())
    closing, own_columns = np.asarray([end], "<u4").tobytes(), list(keep)

    def rows_of(kept: list[pa.Table], values: list[list], group_: int | None, left: list[bytes] | None) -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        table = pa.concat_tables(kept).combine_chunks()
        for name, value in zip(names, values, strict=True):
            table = table.append_column(name, pa.array(value, pa.int64()))
        table = table.append_column(group, pa.array([group_] * len(kept), pa.int64()))
        table = table.append_column(ids_left, pa.array(left or [None] * len(kept), pa.binary()))
        yield from table.to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(f"words:{tokenizer}", lambda: WordEncoder(tokenizer))
        packer = Packer(window)
        number_of_task = TaskContext.get().partitionId()
        task = number_of_task << 40
        ids: dict[int, bytes] = {}
        kept: dict[int, pa.Table] = {}
        waiting: dict[int, int] = {}
        number = 0

        def piece(doc: int, start: int, length: int) -> memoryview:
            return memoryview(ids[doc])[4 * start : 4 * (start + length)]

        def ready() -> Iterator[pa.RecordBatch]:
            """Rows of the pieces placed so far; documents all placed are forgotten."""
            rows, packer.out = packer.out, []
            crcs = [zlib.crc32(piece(*r[:3])) for r in rows]
            totals = [len(ids[r[0]]) // 4 for r in rows]
            values = [[r[1] for r in rows], [r[2] for r in rows], crcs, totals, [task + r[3] for r in rows], [r[4] for r in rows]]
            yield from rows_of([kept[r[0]] for r in rows], values, None, None)
            for doc, _, length, _, _ in rows:
                waiting[doc] -= length
            for doc in {r[0] for r in rows}:
                if not waiting[doc]:
                    del ids[doc], kept[doc], waiting[doc]

        for batch in batches:
            table = pa.table(batch)
            texts, rest = table.column(body), table.drop_columns([body])
            for s, e in blocks(utf8(texts)[1], TEXT_BYTES):
                for i, own in enumerate(encoder.ids(texts.slice(s, e - s).combine_chunks())):
                    ids[number] = own + closing
                    kept[number] = rest.slice(s + i, 1)
                    waiting[number] = len(own) // 4 + 1
                    packer.add(number, waiting[number])
                    number += 1
                yield from ready()
        left = packer.rest()
        yield from ready()
        nothing = [None] * len(left)
        values = [[p[1] for p in left], [p[2] for p in left], nothing, [len(ids[p[0]]) // 4 for p in left], nothing, list(range(len(left)))]
        yield from rows_of([kept[p[0]] for p in left], values, number_of_task, [bytes(piece(*p)) for p in left])

    def pack_left(last: bool, level: int):
        def one(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by([(group, "ascending"), (names[5], "ascending")])
            number = key[0].as_py()
            starts, totals = table.column(names[0]).to_pylist(), table.column(names[3]).to_pylist()
            ids = table.column(ids_left).to_pylist()
            rest = table.select(own_columns)
            packer = Packer(window)
            for i, own in enumerate(ids):
                packer.add(i, len(own) // 4)
            left = [] if last else packer.rest()
            if last:
                packer.finish()
            sequence = (level << 60) + (number << 40)
            rows = [(i, s, n, sequence + q, o) for i, s, n, q, o in packer.out] + [(*p, None, o) for o, p in enumerate(left)]
            pieces = [ids[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in rows]
            out = rest.take(pa.array([r[0] for r in rows], pa.int64()))
            values = [
                [starts[r[0]] + r[1] for r in rows],
                [r[2] for r in rows],
                [None if r[3] is None else zlib.crc32(p) for r, p in zip(rows, pieces, strict=True)],
                [totals[r[0]] for r in rows],
                [r[3] for r in rows],
                [r[4] for r in rows],
            ]
            for name, value in zip(names, values, strict=True):
                out = out.append_column(name, pa.array(value, pa.int64()))
            out = out.append_column(group, pa.array([number if r[3] is None else None for r in rows], pa.int64()))
            return out.append_column(ids_left, pa.array([p if r[3] is None else None for r, p in zip(rows, pieces, strict=True)], pa.binary()))

        return one

    placed = stored(picked.mapInArrow(run, schema), "packed")
    out, level = placed.where(F.col(group).isNull()), 0
    most = placed.agg(F.max(group)).first()[0]
    while most is not None:
        level, last = level + 1, most < GROUP
        left = placed.where(F.col(group).isNotNull())
        more = left.groupBy(F.expr(f"{group} div {GROUP}L")).applyInArrow(pack_left(last, level), schema)
        if last:
            out = out.unionByName(more)
            break
        placed = stored(more, "packed")
        out = out.unionByName(placed.where(F.col(group).isNull()))
        most //= GROUP
    return out.drop(group, ids_left)


def default_tokenizer() -> str:
    """The 49k word tokenizer of the public tokenizers, where they are installed."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


def packing_report(spark, folder: str) -> DataFrame:
    """``op10``: all documents packed into sequences of at most 4,096 ids."""
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), default_tokenizer())
