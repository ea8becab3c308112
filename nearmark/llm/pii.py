"""Personal data by a skip-chain conditional random field.

Mentions are what the base patterns match (email, ip, card, phone) and what
looks like such a thing and is matched by none: words with ``@`` and runs of
digits with separators.  Each mention of a text is a variable whose label is
one of the four kinds or "other".  Neighbouring mentions share a potential, and
so do repeated or similar ones (the same last ten digits, or the same part
before the ``@``), however far apart they are.  Base matches are given; loopy belief
propagation carries their labels along the links to the others, so that an
entity written again in a form the patterns do not know is found too.

Weights are learned in NumPy on a bounded sample of base matches.  A base match
written again in a damaged form has the label of its first mention; the same
form alone, and any other mention of the sample, is "other".  So evidence for a
label comes from the links and not from the looks of a number.

Links join each mention to the next one like it, so there are fewer links than
mentions however often an entity occurs.  A text's labels depend on the text
and the weights alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from nearmark.llm.common import blocks, column, fresh, text_of, utf8

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1
# Texts the weights are learned on, how many are looked at to find them, and mentions of each.
SAMPLE_TEXTS, SAMPLE_LOOK, SAMPLE_MENTIONS = 500, 40_000, 32
# Rounds of messages, their damping, and the least belief of a label that is added.
MESSAGES, DAMPING, BELIEF = 10, 0.3, 0.5
STEPS, RATE, DECAY = 60, 0.3, 1e-4
# Links whose messages are worked out at once.
LINKS = 1 << 16

# Fixed patterns and limits of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NO_DIGIT = re.compile(r"[^0-9]+")

# What may be another form of an entity.
AT_WORD = re.compile(r"[^\s@<>()\[\]{}\"',;:]+@[^\s<>()\[\]{}\"',;:]*")
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().,/_:-]{0,2}[0-9])+")
LEAST_DIGITS = 6
# Numbers are alike if so many of their last digits are: country codes come and go.
LAST_DIGITS = 10


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each ``@`` outward."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        # What was walked over belongs to this ``@`` alone.
        done = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    text: str
    # Base kinds that match it (an overlap can have two), the first of them its label.
    kind: int


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """Base matches and other candidates that overlap none, in order."""
    out = [Mention(a, b, text[a:b], k) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    held = [(m.start(), m.end()) for m in AT_WORD.finditer(text)] if "@" in text else []
    numbers = [m.span() for m in NUMBER.finditer(text) if sum(c.isdigit() for c in m[0]) >= LEAST_DIGITS]
    i, free, last = 0, [], -1
    for a, b in sorted(held + numbers, key=lambda s: (s[0], -s[1])):
        while i < len(merged) and merged[i][1] <= a:
            i += 1
        if a >= last and not (i < len(merged) and merged[i][0] < b):
            free.append(Mention(a, b, text[a:b], OTHER))
            last = b
    return sorted(out + free, key=lambda m: (m.start, m.kind, m.end))


def identity(text: str) -> str:
    """What repeated and similar mentions have in common."""
    at = text.find("@")
    if at >= 0:
        return text[:at].lower() + "@"
    return NO_DIGIT.sub("", text)[-LAST_DIGITS:]


# Features of the looks of a mention.
FEATURES = 24


def looks(text: str) -> list[int]:
    digits = NO_DIGIT.sub("", text)
    n = len(digits)
    out = [0]
    if "@" in text:
        out.append(1 if "." in text[text.find("@") :] else 2)
    else:
        out.append(3 + min(n, 20) // 2)
    for i, mark in enumerate("+(.- ,/_:"):
        if mark in text:
            out.append(14 + i)
    if 13 <= n <= 19 and luhn(digits):
        out.append(23)
    return out


class Graph:
    """Mentions of many texts, their neighbours and their likes, as arrays.

    Links between two given mentions say nothing about others and are left out.
    """

    def __init__(self):
        self.kind: list[int] = []
        self.free: list[bool] = []
        self.look: list[int] = []
        self.looks: list[int] = []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, own: list[Mention], given: list[bool] | None = None) -> None:
        """Mentions of one text; base ones are given, or those that ``given`` says."""
        first, seen = len(self.kind), {}
        for i, m in enumerate(own):
            at, found = first + i, looks(m.text)
            self.kind.append(m.kind)
            self.free.append(m.kind == OTHER if given is None else not given[i])
            self.look += found
            self.looks.append(len(found))
            if i and (self.free[at] or self.free[at - 1]):
                self.edges.append((at - 1, at, 0))
            key = identity(m.text)
            if key in seen and (self.free[at] or self.free[seen[key]]):
                self.edges.append((seen[key], at, 1))
            seen[key] = at

    def arrays(self) -> Arrays:
        edges = np.asarray(self.edges, np.int64).reshape(-1, 3)
        # Neighbours first, so that each kind of link is a range.
        edges = edges[np.argsort(edges[:, 2], kind="stable")]
        rows = np.repeat(np.arange(len(self.kind)), self.looks)
        return Arrays(np.asarray(self.look, np.int64), rows, np.asarray(self.kind, np.int64), np.asarray(self.free, bool), edges)


@dataclass
class Arrays:
    look: np.ndarray
    row: np.ndarray
    kind: np.ndarray
    free: np.ndarray
    edges: np.ndarray


@dataclass
class Weights:
    """Of looks, of neighbours and of likes; the latter two symmetric."""

    look: np.ndarray
    pair: np.ndarray


def _shares(log: np.ndarray) -> np.ndarray:
    out = np.exp(log - log.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def beliefs(weights: Weights, g: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of each mention's labels, and what either end of each link says to it.

    Messages are passed a fixed number of times, so those of one text are the
    same whatever other texts there are.
    """
    own = np.zeros((len(g.kind), LABELS))
    np.add.at(own, g.row, weights.look[g.look])
    own[~g.free] = -30.0
    own[np.flatnonzero(~g.free), g.kind[~g.free]] = 0
    a, b, sort = g.edges.T
    pair = np.exp(weights.pair)
    right, left = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))
    middle = int(np.searchsorted(sort, 1))
    parts = [(k, slice(s, min(s + LINKS, e))) for k, (f, e) in enumerate([(0, middle), (middle, len(a))]) for s in range(f, e, LINKS)]

    def total() -> np.ndarray:
        out = own.copy()
        np.add.at(out, b, right)
        np.add.at(out, a, left)
        return out

    for _ in range(MESSAGES if len(a) else 0):
        now = total()
        for k, p in parts:
            to_b = np.log(_shares(now[a[p]] - left[p]) @ pair[k] + 1e-30)
            to_a = np.log(_shares(now[b[p]] - right[p]) @ pair[k] + 1e-30)
            right[p] = DAMPING * right[p] + (1 - DAMPING) * (to_b - to_b.max(axis=1, keepdims=True))
            left[p] = DAMPING * left[p] + (1 - DAMPING) * (to_a - to_a.max(axis=1, keepdims=True))
    now = total()
    return _shares(now), _shares(now[a] - left), _shares(now[b] - right)


def train(graph: Graph) -> Weights:
    """Weights by gradient ascent: what the labels have less what the beliefs expect."""
    g = graph.arrays()
    a, b, sort = g.edges.T
    weights = Weights(np.zeros((FEATURES, LABELS)), np.zeros((2, LABELS, LABELS)))
    truth = np.eye(LABELS)[g.kind]
    has = np.zeros_like(weights.pair)
    np.add.at(has, (sort, g.kind[a], g.kind[b]), 1)
    n = max(1, int(g.free.sum()))
    speed_look, speed_pair = np.zeros_like(weights.look), np.zeros_like(weights.pair)
    for _ in range(STEPS):
        node, from_a, from_b = beliefs(weights, g)
        look = np.zeros_like(weights.look)
        np.add.at(look, g.look, ((truth - node) * g.free[:, None])[g.row])
        pair = has.copy()
        for k in range(2):
            both = from_a[sort == k][:, :, None] * from_b[sort == k][:, None, :] * np.exp(weights.pair[k])
            pair[k] -= (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        look = look / n - DECAY * weights.look
        pair = (pair + pair.transpose(0, 2, 1)) / (2 * n) - DECAY * weights.pair
        # Steps are scaled by the gradients so far (Adagrad), as looks differ in number.
        speed_look += look**2
        speed_pair += pair**2
        weights.look += RATE * look / np.sqrt(speed_look + 1e-10)
        weights.pair += RATE * pair / np.sqrt(speed_pair + 1e-10)
    return weights


def damaged(kind: int, text: str, way: int) -> str:
    """A form of a base match that its pattern does not know."""
    digits = NO_DIGIT.sub("", text)
    if kind == 0:
        at = text.find("@")
        return [text[: at + 1] + text[at + 1 :].split(".")[0], text[:at] + "@" + text[at + 1 :].replace(".", "_")][way % 2]
    if kind == 1:
        return text.replace(".", "-:_"[way % 3])
    marks = "._/"[way % 3]
    if kind == 2:
        return marks.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = digits[-LAST_DIGITS:] if way % 2 else digits
    return [digits, digits[:-7] + "-" + digits[-7:-4] + "-" + digits[-4:], marks.join([digits[:-7], digits[-7:-4], digits[-4:]])][way % 3]


def learn(samples: list[list[tuple[int, str]]]) -> Weights | None:
    """Weights from (kind, text) mentions of sampled texts; None if there is no base match."""
    samples = [own for own in samples if any(k != OTHER for k, _ in own)]
    graph, way = Graph(), 0
    for i, own in enumerate(samples):
        base = [(k, t) for k, t in own if k != OTHER]
        # What is like a base match may well be the same entity: its label is not known.
        like = {identity(t) for _, t in base}
        own = base + [(k, t) for k, t in own if k == OTHER and identity(t) not in like]
        other = [(k, t) for k, t in own if k == OTHER]
        strange = [(k, t) for k, t in samples[(i + 1) % len(samples)] if k != OTHER]
        names = {identity(t) for _, t in own}
        # Beside its first mention a damaged form is the entity, that of another text's entity is not.
        rows, given = list(own), [k != OTHER for k, _ in own]
        for j, (k, t) in enumerate(base):
            pair = [(k, damaged(k, t, way))]
            far, form = strange[j % len(strange)]
            if identity(form) not in names:
                pair.append((OTHER, damaged(far, form, way // 2)))
            rows += pair[:: 1 - 2 * (way // 3 % 2)]
            given += [False] * len(pair)
            way += 1
        graph.add([Mention(0, len(t), t, k) for k, t in rows], given)
        # Without one it is not either.
        alone = other + [(OTHER, damaged(k, t, way + j)) for j, (k, t) in enumerate(base)]
        graph.add([Mention(0, len(t), t, k) for k, t in alone], [False] * len(alone))
    return train(graph) if graph.kind else None


def label(weights: Weights | None, texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans and added spans, each (kind, start, end), of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    graph, where = Graph(), []
    if weights is None:
        return base, added
    for i, text in enumerate(texts):
        own = mentions(text, base[i])
        # Without a given and a free mention there is nothing to carry over.
        if base[i] and any(m.kind == OTHER for m in own):
            graph.add(own)
            where += [(i, m) for m in own]
    if where:
        arrays = graph.arrays()
        node, _, _ = beliefs(weights, arrays)
        best = node[:, :OTHER].argmax(axis=1)
        for j in np.flatnonzero(arrays.free & (node[np.arange(len(node)), best] >= BELIEF)).tolist():
            i, m = where[j]
            added[i].append((int(best[j]), m.start, m.end))
    return base, added


def sample(docs: DataFrame, text: str = "text") -> list[list[tuple[int, str]]]:
    """Mentions of at most ``SAMPLE_TEXTS`` texts with base matches, those of the least hashes.

    About ``SAMPLE_LOOK`` rows are looked at, chosen by hash; copies of a text
    have one hash and count once.  Of each text the first ``SAMPLE_MENTIONS``.
    """
    count = docs.count()
    body = text_of(docs, text)
    rows = docs.select(F.xxhash64(body).alias("h"), body.alias("body"))
    if count > SAMPLE_LOOK:
        rows = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(SAMPLE_LOOK / count * (1 << 30)))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                base = base_spans(t)
                if base:
                    keep.append(h)
                    found.append([{"kind": m.kind, "text": m.text} for m in mentions(t, base)[:SAMPLE_MENTIONS] if len(m.text) <= 200])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
            yield pa.record_batch({"h": pa.array(keep, pa.int64()), "found": pa.array(found, kind)})

    found = rows.mapInArrow(find, "h bigint, found array<struct<kind: int, text: string>>")
    # Copies meet in partial aggregation before the least are picked.
    first = found.groupBy("h").agg(F.min("found").alias("found")).orderBy("h").limit(SAMPLE_TEXTS).collect()
    return [[(f["kind"], f["text"]) for f in r["found"]] for r in first]


SPAN = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


def find_personal(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row, its ``keep`` columns (all if None), its ``base`` spans and its ``added`` ones.

    Spans are ``kind, start, end`` in code points, the end not included, by
    kind as listed and then start.  Added ones overlap no base span.  Null and
    empty texts have none.  Repeated rows are searched each and have the same
    spans; an empty table gives an empty one.  If the sample has no base match,
    nothing is added.  If ``docs`` has columns named
    like the two, these get underscores before them.
    """
    weights = learn(sample(docs, text))
    names = docs.columns if keep is None else list(keep)
    rows = docs.select(*[column(docs, c) for c in names])
    base_name, added_name, body = fresh(rows, "base", "added", "_searched")
    picked = docs.select(*[column(docs, c) for c in names], text_of(docs, text).alias(body))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        as_rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            _, offsets = utf8(batch.column(batch.schema.get_field_index(body)))
            for s, e in blocks(offsets):
                part = batch.slice(s, e - s)
                base, added = label(weights, part.column(part.schema.get_field_index(body)).to_pylist())
                out = part.drop_columns([body]).append_column(base_name, pa.array([as_rows(b) for b in base], kind))
                yield out.append_column(added_name, pa.array([as_rows(sorted(a)) for a in added], kind))

    return picked.mapInArrow(search, rows.schema.add(base_name, SPAN).add(added_name, SPAN))


def personal_report(spark, folder: str) -> DataFrame:
    """``op12``: per document, counts and digest of the base spans, and all spans."""
    found = find_personal(spark.read.parquet(f"{folder}/documents.parquet"), keep=("doc_id",))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def place(span: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, KINDS)), span["kind"])

    every = F.array_sort(
        F.concat("base", "added"),
        lambda a, b: F.when(place(a) != place(b), (place(a) - place(b)).cast("int")).otherwise(a["start"] - b["start"]),
    )
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
