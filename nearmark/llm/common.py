"""What the operators share: column handling, Arrow text, words and shingles.

Words are runs of bytes other than ASCII white space, so a word is the same in
every language and in SQL (``[^\\x20\\x09-\\x0D]+``).  A shingle is a run of
five words; a text of one to four words is one shingle, a text of none has none.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
# Bytes of text worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
# A word's hash is a polynomial in an odd base modulo 2**64, which has an inverse.
BASE = 0x9E3779B97F4A7C15
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def text_of(df: DataFrame, name: str) -> Column:
    """The text column; null is the empty text."""
    return F.coalesce(column(df, name).cast("string"), F.lit(""))


def per_process(key: str, make: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker, such as a loaded vocabulary."""
    home = sys.modules.setdefault("_nearmark_worker", types.ModuleType("_nearmark_worker"))
    if not hasattr(home, key):
        setattr(home, key, make())
    return getattr(home, key)


def forget() -> None:
    """Drop what earlier operators keep in this Python worker; tasks that keep nothing call it when they begin."""
    sys.modules.pop("_nearmark_worker", None)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held, offsets


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, one row at least."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def spaces() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of SplitMix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Hashes of words and of shingles of many texts at once."""

    def __init__(self, width: int = SHINGLE_WORDS):
        self.width = width
        self.space = spaces()
        self.inverse = pow(BASE, -1, 1 << 64)
        self.up, self.down = _powers(BASE, BLOCK_BYTES), _powers(self.inverse, BLOCK_BYTES)
        self.places = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.up, self.down = _powers(BASE, len(data)), _powers(self.inverse, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self.down[starts])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of the texts in order, and where each text's words begin."""
        low, high = int(offsets[0]), int(offsets[-1])
        hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        at = low
        while at < high:
            end = min(high, at + BLOCK_BYTES)
            # Cut long stretches where a word ends, so that no word is split.
            while end < high:
                gap = np.flatnonzero(self.space[data[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                    break
                end = min(high, end + BLOCK_BYTES)
            part = data[at:end]
            letter = ~self.space[part]
            edge = np.zeros(len(part) + 1, bool)
            inside = offsets[(offsets >= at) & (offsets <= end)] - at
            edge[inside] = True
            before = np.concatenate([[False], letter])
            after = np.concatenate([letter, [False]])
            starts = np.flatnonzero(after & (~before | edge))
            ends = np.flatnonzero(before & (~after | edge))
            hashes.append(self._hashes(part, starts, ends))
            places.append(starts + at)
            at = end
        begins = np.concatenate(places)
        return np.concatenate(hashes), np.searchsorted(begins, offsets)

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of the texts, sorted within each text, and each text's range."""
        words, at = self.words(data, offsets)
        counts = np.diff(at)
        n = np.where(counts >= self.width, counts - self.width + 1, np.minimum(counts, 1))
        out_at = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(out_at[-1], np.uint64)
        if len(words) >= self.width:
            rolled = words[: len(words) - self.width + 1] * self.places[0]
            for k in range(1, self.width):
                rolled += words[k : len(words) - self.width + 1 + k] * self.places[k]
            rolled = mixed(rolled)
        for i in range(len(n)):
            s, e = out_at[i], out_at[i + 1]
            if counts[i] >= self.width:
                out[s:e] = rolled[at[i] : at[i] + n[i]]
                out[s:e].sort()
            elif counts[i]:
                few = words[at[i] : at[i + 1]]
                out[s] = mixed((few * self.places[: len(few)]).sum(keepdims=True, dtype=np.uint64))[0]
        return out, out_at

    def weighted(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text, how often each occurs, and each text's range."""
        h, at = self.shingles(data, offsets)
        if not len(h):
            return h, np.empty(0, np.int64), at
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[at[:-1][at[:-1] < len(h)]] = True
        first = np.flatnonzero(new)
        return h[first], np.diff(np.append(first, len(h))), np.searchsorted(first, at)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with equal keys, of rows sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table(batch)
        values = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(table.num_rows, bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(v[s] for v in values)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(s, e - s))
            last = key
    if held:
        yield pa.concat_tables(held)
