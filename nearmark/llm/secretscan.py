"""Secrets in texts, found through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived
that holds for every text with a match.  Texts are indexed in blocks: for the
trigrams that the queries use, the postings of the block's texts.  A query's
postings are intersected and united, and the rule's expression runs over the
texts left.  A rule without mandatory trigrams runs over all texts.

Index and queries fold ASCII letters to lower case, which only adds candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, IntegralType, StringType, StructType

from nearmark.llm.common import blocks, column, fresh, text_of, utf8

# A set of strings that an expression can stand for is followed up to this size.
EXACT_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, left to right without overlap, if ``group`` is long enough."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # As runs of hexadecimal digits are maximal, the length can be asked for at once.
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (any text), or ("and" | "or", parts), or a trigram.
Query = object


def _both(op: str, parts: Iterable) -> Query:
    parts = set(parts)
    if op == "and":
        parts.discard(True)
        if not parts:
            return True
    elif True in parts or not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else (op, frozenset(parts))


def _needs(strings: set[bytes]) -> Query:
    """A text that holds one of the strings holds all trigrams of one of them."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def trigram_query(pattern: str) -> Query:
    """Trigrams that any text with a match of ``pattern`` must hold."""
    from re import _constants as kind
    from re import _parser

    def lower(code: int) -> set[bytes]:
        return {chr(code).lower().encode() if code < 128 else chr(code).encode()}

    def joined(a: set | None, b: set | None) -> set | None:
        if a is None or b is None or len(a) * len(b) > EXACT_STRINGS:
            return None
        return {x + y for x in a for y in b}

    def one(op, value) -> tuple[set | None, Query]:
        """All strings an item can be, if few, and the query of its own."""
        if op is kind.LITERAL:
            return lower(value), True
        if op is kind.IN:
            out: set[bytes] = set()
            for sort, v in value:
                if sort is kind.LITERAL:
                    out |= lower(v)
                elif sort is kind.RANGE and v[1] - v[0] < EXACT_STRINGS:
                    for code in range(v[0], v[1] + 1):
                        out |= lower(code)
                else:
                    return None, True
            return (out, True) if len(out) <= EXACT_STRINGS else (None, True)
        if op is kind.SUBPATTERN:
            return several(value[3])
        if op is kind.BRANCH:
            found = [several(branch) for branch in value[1]]
            exact = None if any(e is None for e, _ in found) else set().union(*[e for e, _ in found])
            query = _both("or", [_both("and", [q, _needs(e)]) if e is not None else q for e, q in found])
            return (exact, True) if exact is not None and len(exact) <= EXACT_STRINGS else (None, query)
        if op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
            low, high, item = value
            exact, query = several(item)
            if (low, high) == (0, 1) and exact is not None:
                return exact | {b""}, True
            if low == 0:
                return None, True
            if exact is None:
                return None, query
            # The item once, or as often as it must stand, as far as that is few strings.
            times, total = exact, 1
            while total < low and (more := joined(times, exact)) is not None:
                times, total = more, total + 1
            return (times, True) if total == low == high else (None, _needs(times))
        if op is kind.AT:
            return {b""}, True
        return None, True

    def several(items) -> tuple[set | None, Query]:
        whole, run, queries = True, {b""}, []
        for op, value in items:
            exact, query = one(op, value)
            queries.append(query)
            longer = joined(run, exact)
            if longer is None:
                # What came before must hold; the run starts anew behind it.
                queries.append(_needs(run))
                whole, run = False, exact if exact is not None else {b""}
            else:
                run = longer
        if whole:
            return run, _both("and", queries)
        return None, _both("and", [*queries, _needs(run)])

    exact, query = several(_parser.parse(pattern))
    return query if exact is None else _both("and", [query, _needs(exact)])


def trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*[trigrams(q) for q in query[1]])


class Scanner:
    """Rules with their queries and the codes of the trigrams they use."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r.kind, r.compiled(), r.group, r.least, trigram_query(r.pattern)) for r in rules]
        self.order = {r.kind: i for i, r in enumerate(rules)}
        grams = sorted(set().union(*[trigrams(q) for *_, q in self.rules]))
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.int16)
        for g, i in self.number.items():
            self.table[int.from_bytes(g, "big")] = i + 1
        self.fold = np.arange(256, dtype=np.int32)
        self.fold[ord("A") : ord("Z") + 1] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The texts of a block that hold each trigram."""
        low, high = int(offsets[0]), int(offsets[-1])
        folded = self.fold[data[low:high]]
        if len(folded) < 3:
            return [np.empty(0, np.int64)] * len(self.number)
        found = self.table[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
        at = np.flatnonzero(found)
        texts = np.searchsorted(offsets, at + low, "right") - 1
        # A trigram over the end of a text belongs to none.
        inside = at + low + 3 <= offsets[texts + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(offsets) + texts[inside])
        gram, text = pairs // len(offsets) - 1, pairs % len(offsets)
        cuts = np.searchsorted(gram, np.arange(len(self.number) + 1))
        return [text[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def candidates(self, query: Query, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def spans(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, str, int]]]:
        """(start, kind, end) of each text's matches, in order of start, then rule."""
        found: list[list] = [[] for _ in texts]
        postings = self.postings(data, offsets)
        for kind, pattern, group, least, query in self.rules:
            for i in self.candidates(query, postings, len(texts)).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(group) - m.start(group) >= least:
                        found[i].append((m.start(), kind, m.end()))
        for spans in found:
            spans.sort(key=lambda s: (s[0], self.order[s[1]]))
        return found


SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", StringType()))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """Every row, its ``keep`` columns (all if None) and ``secrets``, its spans.

    Spans are in code points, the end not included, by start and then by the
    order of ``rules``.  Null and empty texts have none.  Each repeated row is
    searched on its own; an empty table gives an empty one.  If ``docs`` has a
    column named ``secrets``, that of the spans gets underscores before it.
    """
    names = docs.columns if keep is None else list(keep)
    base = docs.select(*[column(docs, c) for c in names])
    spans, body = fresh(base, "secrets", "_searched")
    picked = base.withColumn(body, text_of(docs, text)) if keep is None else docs.select(
        *[column(docs, c) for c in names], text_of(docs, text).alias(body)
    )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            column_ = batch.column(batch.schema.get_field_index(body))
            data, offsets = utf8(column_)
            out: list = []
            for s, e in blocks(offsets):
                texts = column_.slice(s, e - s).to_pylist()
                for found in scanner.spans(texts, data, offsets[s : e + 1]):
                    out.append([{"start": a, "end": b, "kind": k} for a, k, b in found])
            yield batch.drop_columns([body]).append_column(spans, pa.array(out, kind))

    return picked.mapInArrow(search, base.schema.add(spans, SPANS))


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``.

    Overlapping spans are masked as one.  Texts without secrets, null and empty
    ones stay as they are; ``n_chars``, if there is one of whole numbers, follows
    the text.  Repeated rows are masked alike, and an empty table gives an empty one.
    """
    schema = docs.schema
    counted = "n_chars" in docs.columns and isinstance(schema["n_chars"].dataType, IntegralType)

    def hide(value: str, spans: list) -> str:
        parts, at = [], 0
        for a, _, b in spans:
            if a >= at:
                parts += [value[at:a], mask]
            at = max(at, b)
        return "".join([*parts, value[at:]])

    def masked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            where = batch.schema.get_field_index(text)
            column_ = batch.column(where)
            data, offsets = utf8(column_)
            changed: dict[int, str] = {}
            for s, e in blocks(offsets):
                texts = ["" if t is None else t for t in column_.slice(s, e - s).to_pylist()]
                for i, spans in enumerate(scanner.spans(texts, data, offsets[s : e + 1])):
                    if spans:
                        changed[s + i] = hide(texts[i], spans)
            if changed:
                values = column_.to_pylist()
                for i, value in changed.items():
                    values[i] = value
                batch = batch.set_column(where, batch.schema.field(where), pa.array(values, column_.type))
                if counted:
                    place = batch.schema.get_field_index("n_chars")
                    lengths = batch.column(place).to_pylist()
                    for i, value in changed.items():
                        lengths[i] = len(value)
                    batch = batch.set_column(place, batch.schema.field(place), pa.array(lengths, batch.column(place).type))
            yield batch

    return docs.mapInArrow(masked, schema)


def secret_report(spark, folder: str) -> DataFrame:
    """``op9``: per document, counts and digest of the base spans, and all spans."""
    found = find_secrets(spark.read.parquet(f"{folder}/documents.parquet"), keep=("doc_id",))
    kinds = [r.kind for r in BASE_RULES]

    def of(*wanted: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*wanted))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(joined(of(*kinds)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
