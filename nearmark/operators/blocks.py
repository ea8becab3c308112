"""Nearest neighbours between one block of records and one block of queries.

This is the code that runs inside a task.  A cheap score from one matrix
product picks the pairs that can be among the nearest, a rigorous rounding
bound decides how far beyond the k-th score to look, and the pairs found are
measured again in full precision.  Ties are ordered by id.

Scores are products in single precision while these can tell the records apart,
and in double precision otherwise; what is measured is always double.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from nearmark.schema import COSINE, DOTPRODUCT, EUCLIDEAN

# Elements of one score matrix, and of one gathered block of vectors.
SCORE_CELLS = 4_000_000
GATHER_CELLS = 4_000_000
# Least number of pairs held before they are cut back to the best k per query.
HELD_PAIRS = 100_000
UNIT_ROUNDOFF = {np.float64: 2.0**-53, np.float32: 2.0**-24}
# Lengths whose products neither overflow nor vanish in single precision.
SINGLE = (1e-12, 1e12)
# Single precision is given up for a tile if it passes more than so many times the pairs wanted.
LOOSE = 4
# An answer of this share of the records, and so many pairs, is measured without scoring first.
DENSE, DENSE_PAIRS = 1 / 16, 1000
# Rows of a block of records that queries stream past, and bytes.
HELD_ROWS, HELD_NBYTES = 40_000, 64 << 20
# Pairs of one list that are measured at once with those of others: to score them alone takes as long.
FEW_PAIRS = 2048
# Elements measured at a time, few enough for a processor's cache.
CACHE_CELLS = 1 << 17


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long vectors as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    n = len(column)
    if not n:
        return np.empty((0, 0))
    lengths = pc.min_max(pc.list_value_length(column))
    if column.null_count or lengths["min"] != lengths["max"]:
        raise ValueError("vectors must be present and of one length")
    if column.flatten().null_count:
        raise ValueError("vectors must not miss elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def lengths(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt((vectors**2).sum(axis=1))


def _single(norms: np.ndarray) -> np.ndarray:
    """Vectors of these lengths may be scored in single precision."""
    return (norms == 0) | ((norms >= SINGLE[0]) & (norms <= SINGLE[1]))


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row positions and elements of a list column; null lists have no elements."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    rows = np.asarray(pc.list_parent_indices(column))
    return rows, column.flatten().to_numpy(zero_copy_only=False)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that sorts; struct ids become tuples, field by field."""
    if not pa.types.is_struct(column.type):
        return column.to_pandas().to_numpy()
    out = np.empty(len(column), dtype=object)
    out[:] = list(zip(*[field.to_pylist() for field in column.flatten()], strict=True))
    return out


def _true(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true elements, sought eight at a time."""
    flat = mask.ravel()
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64))
    row, column = np.nonzero(flat[:even].reshape(-1, 8)[words])
    return np.concatenate([words[row] * 8 + column, even + np.flatnonzero(flat[even:])])


def _by_id(ids: np.ndarray) -> np.ndarray:
    """Positions in the order of the ids, missing ones last."""
    return pd.Series(ids).sort_values(kind="stable").index.to_numpy()


def _groups(table: pa.Table, by: tuple[str, ...]) -> dict:
    """Row positions per key; rows with a null key match nothing."""
    if not by:
        return {(): np.arange(table.num_rows)}
    frame = table.select(list(by)).to_pandas()
    keys = list(by) if len(by) > 1 else by[0]
    return {k: np.asarray(v) for k, v in frame.groupby(keys, sort=False).indices.items()}


def _listed(table: pa.Table, by: tuple[str, ...], name: str) -> dict:
    """Row positions per list named in ``name`` and per key; vectors are held once."""
    rows, elements = _lists(table.column(name))
    frame = table.select(list(by)).to_pandas().iloc[rows].reset_index(drop=True)
    frame.insert(0, "list_id", elements)
    keys = ["list_id", *by] if by else "list_id"
    return {k: rows[np.asarray(v)] for k, v in frame.groupby(keys, sort=False).indices.items()}


class Queries:
    """A block of queries, prepared once and used against many record blocks."""

    def __init__(self, table: pa.Table, metric: str, by=(), tags=False, step=False, as_of=False, lists=False):
        self.metric, self.by = metric, ("list_id", *by) if lists else tuple(by)
        self.tags, self.step, self.as_of = tags, step, as_of
        self.ids = _ids(table.column("query_id"))
        self.vectors = matrix(table.column("values"))
        self.norms = lengths(self.vectors) if len(self.ids) else np.empty(0)
        self.odd = ~np.isfinite(self.norms)
        self.single = _single(self.norms)
        self.k = table.column("top_k").to_numpy().astype(np.int64)
        self.groups = _listed(table, tuple(by), "lists") if lists else _groups(table, self.by)
        # Distance already known to be enough for each query's k-th neighbour.
        self.bound = np.full(len(self.ids), np.inf)
        if "bound" in table.column_names:
            given = table.column("bound").to_pandas().to_numpy(dtype=np.float64, na_value=np.nan)
            self.bound = np.where(np.isnan(given), np.inf, given)
        self.steps = table.column("step").to_numpy() if step else None
        self.at = table.column("at").to_numpy() if as_of else None
        # Queries that see about the same records are scored together.
        order = self.at if as_of else self.steps
        if order is not None:
            self.groups = {k: r[np.argsort(order[r], kind="stable")] for k, r in self.groups.items()}
        self.listed = None
        if lists and not (by or tags or step or as_of):
            # Queries by the whole numbers of their lists; lists may be many and short.
            rows, elements = _lists(table.column("lists"))
            if elements.dtype.kind in "iu":
                order = np.argsort(elements, kind="stable")
                self.listed = elements[order], rows[order]
        # key -> anchor tag -> tag set -> query positions; None anchors no tag.
        self.plan: dict = {}
        required = self._required(table) if tags else None
        for key, rows in self.groups.items():
            plan = self.plan.setdefault(key, {})
            if required is None:
                plan[None] = {(): rows}
                continue
            for r in rows:
                need = required[r]
                anchor = need[0] if need else None
                plan.setdefault(anchor, {}).setdefault(need, []).append(r)

    @staticmethod
    def _required(table: pa.Table) -> list[tuple]:
        wanted = table.column("required").to_pylist()
        return [tuple(sorted(set(w))) if w else () for w in wanted]

    def met(self, table: pa.Table) -> tuple[Iterator, Iterator]:
        """Tiles to be scored each, and pairs of short lists, of which many come at once."""
        column = table.column("list_id") if self.listed is not None else None
        rows = elements = None
        if column is not None and pa.types.is_list(column.type):
            rows, elements = _lists(column)
        elif column is not None and not column.null_count:
            rows, elements = np.arange(table.num_rows), column.to_numpy()
        if elements is None or elements.dtype.kind not in "iu":
            return self.tiles(table), iter(())
        order = np.argsort(elements, kind="stable")
        rows = rows[order]
        found, first, count = np.unique(elements[order], return_index=True, return_counts=True)
        wanted, asking = self.listed
        low, high = np.searchsorted(wanted, found), np.searchsorted(wanted, found, "right")
        cells = count * (high - low)
        many = ((asking[low[j] : high[j]], rows[first[j] : first[j] + count[j]]) for j in np.flatnonzero(cells > FEW_PAIRS))
        few = np.flatnonzero((cells > 0) & (cells <= FEW_PAIRS))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            ends = np.cumsum(cells[few])
            for part in np.split(few, np.flatnonzero(np.diff(ends // HELD_PAIRS)) + 1):
                own = cells[part]
                at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                wide = np.repeat(high[part] - low[part], own)
                yield asking[np.repeat(low[part], own) + at % wide], rows[np.repeat(first[part], own) + at // wide]

        return many, pairs() if len(few) else iter(())

    def tiles(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (query positions, record positions) that may match."""
        rows_by_tag: dict = {}
        if self.tags:
            rows, elements = _lists(table.column("tags"))
            rows_by_tag = {
                t: np.unique(rows[i])
                for t, i in pd.Series(elements).groupby(elements).indices.items()
            }
        for key, members in self.members(table).items():
            for anchor, sets in self.plan.get(key, {}).items():
                if anchor is not None and anchor not in rows_by_tag:
                    continue
                for need, queries in sets.items():
                    found = members
                    for tag in need:
                        found = np.intersect1d(found, rows_by_tag.get(tag, found[:0]))
                    if len(found):
                        yield np.asarray(queries), found

    def members(self, table: pa.Table) -> dict:
        """Records per key; one may be in several lists."""
        if self.by[:1] == ("list_id",) and pa.types.is_list(table.schema.field("list_id").type):
            return _listed(table, self.by[1:], "list_id")
        return _groups(table, self.by)

    def reachable(self, r: Records, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
        """Drop records that none of these queries can see."""
        if self.step:
            ri = ri[r.steps[ri] <= self.steps[qi].max()]
        if self.as_of:
            at = self.at[qi]
            ri = ri[(r.start[ri] <= at.max()) & (r.end[ri] > at.min())]
        return ri


class Records:
    """A block of records, prepared once and used against many query blocks."""

    def __init__(self, table: pa.Table, metric: str, by=(), tags=False, step=False, as_of=False, lists=False):
        # The vectors are held as a matrix alone.
        self.table = table.drop_columns(["values"])
        self.ids = _ids(table.column("id"))
        self.vectors = matrix(table.column("values"))
        self.norms = lengths(self.vectors)
        # Vectors with a NaN or infinite element, or too long to square, are not scored.
        self.odd = ~np.isfinite(self.norms)
        # No query has a distance to these: all of them rank last, by id.
        self.lost = self.odd.copy()
        self.lost[self.odd] = np.isnan(self.vectors[self.odd]).any(axis=1)
        self.scale = None
        if metric == COSINE:
            self.scale = np.where(self.norms > 0, self.norms, 1.0)
        self.single = _single(self.norms[~self.odd]).all()
        # Odd vectors are never scored.
        self.scored = np.empty((0, 0), np.float32)
        if self.single:
            with np.errstate(all="ignore"):
                self.scored = (self.vectors if self.scale is None else self.vectors / self.scale[:, None]).astype(np.float32)
        self.steps = table.column("step").to_numpy() if step else None
        if as_of:
            top = np.iinfo(np.int64).max
            self.start = table.column("valid_from").to_numpy()
            self.end = table.column("valid_to").fill_null(top).to_numpy()


def _score(q: Queries, r: Records, qi: np.ndarray, ri: np.ndarray, kind: type):
    """Scores that order records as the metric does, their limit, and the slack.

    The slack bounds the rounding of one matrix product of d terms, of vectors
    that may have been scaled to unit length and rounded to ``kind``.
    """
    whole = len(ri) == len(r.ids)
    if kind is np.float32:
        rv = r.scored if whole else r.scored[ri]
    else:
        rv = r.vectors if whole else r.vectors[ri]
        if r.scale is not None:
            rv = rv / (r.scale if whole else r.scale[ri])[:, None]
    rn = r.norms if whole else r.norms[ri]
    qn, bound = q.norms[qi], q.bound[qi]
    qv = q.vectors[qi].astype(kind, copy=False)
    widest = rn.max() if len(rn) else 0.0
    unit = 8 * (rv.shape[1] + 8) * UNIT_ROUNDOFF[kind]
    with np.errstate(all="ignore"):
        if q.metric == EUCLIDEAN:
            score = (-2 * qv) @ rv.T
            score += (rn**2).astype(kind, copy=False)
            limit = bound**2 - qn**2
            slack = unit * (widest + qn) ** 2
        elif q.metric == COSINE:
            score = -qv @ rv.T
            score[:, rn == 0] = np.inf
            score[qn == 0, :] = np.inf
            limit = (bound - 1) * qn
            slack = unit * qn
        else:
            score = -qv @ rv.T
            limit = bound
            slack = unit * widest * qn
    limit = np.where(np.isfinite(bound), limit + unit * np.abs(limit), np.inf)
    return score, limit, slack


def _exact(q: Queries, r: Records, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
    """Full-precision distances of single pairs."""
    out = np.empty(len(qi))
    step = max(1, GATHER_CELLS // max(1, q.vectors.shape[1]))
    for s in range(0, len(qi), step):
        a, b = q.vectors[qi[s : s + step]], r.vectors[ri[s : s + step]]
        with np.errstate(all="ignore"):
            if q.metric == EUCLIDEAN:
                out[s : s + step] = np.sqrt(((b - a) ** 2).sum(axis=1))
                continue
            inner = (a * b).sum(axis=1)
        if q.metric == COSINE:
            with np.errstate(all="ignore"):
                inner = inner / (r.norms[ri[s : s + step]] * q.norms[qi[s : s + step]])
            out[s : s + step] = 1 - inner
        else:
            out[s : s + step] = -inner
    return out


class Best:
    """The nearest records seen so far, per query."""

    def __init__(self, queries: Queries):
        self.q = queries
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.trigger = max(HELD_PAIRS, 2 * int(queries.k.sum()))
        self.first = True

    def add_block(self, r: Records) -> None:
        if not len(r.ids) or not len(self.q.ids):
            return
        tiles, pairs = self.q.met(r.table)
        for queries, rows in tiles:
            width = max(1, SCORE_CELLS // len(rows))
            for s in range(0, len(queries), width):
                self._add_tile(r, queries[s : s + width], rows)
        for queries, rows in pairs:
            away = _exact(self.q, r, queries, rows)
            near = (away <= self.q.bound[queries]) | (np.isnan(away) & np.isinf(self.q.bound[queries]))
            self._keep(queries[near], r.ids[rows[near]], away[near])
        # The first block already gives limits that later blocks are held to.
        if self.first or self.size > self.trigger:
            self.cut()
            self.first = False

    def _add_tile(self, r: Records, qi: np.ndarray, ri: np.ndarray) -> None:
        q = self.q
        ri = q.reachable(r, qi, ri)
        if not len(ri):
            return
        odd_q, odd_r = q.odd[qi], r.odd[ri]
        if odd_q.any() or odd_r.any():
            # Neither scores nor their slack mean anything for these.
            self._add_lost(r, qi, ri[r.lost[ri]])
            known = ~r.lost[ri]
            ri, odd_r = ri[known], odd_r[known]
            self._add_odd(r, qi[odd_q], ri)
            self._add_odd(r, qi[~odd_q], ri[odd_r])
            qi, ri = qi[~odd_q], ri[~odd_r]
            if not len(qi) or not len(ri):
                return
        if q.metric == DOTPRODUCT:
            # A product is no larger than that of the lengths, so a record needs some length.
            with np.errstate(all="ignore"):
                need = np.where(q.bound[qi] < 0, -q.bound[qi] / q.norms[qi], 0.0).min() * (1 - 1e-9)
            ri = ri[r.norms[ri] >= need] if need > 0 else ri
            if not len(ri):
                return
        k = q.k[qi]
        if k.max() <= 0:
            return
        enough = max(1000, LOOSE * int(np.minimum(k, len(ri)).sum()))
        if r.single and q.single[qi].all():
            a, b = self._near(r, qi, ri, np.float32)
            if len(a) <= enough:
                self._hold(r, qi[a], ri[b])
                return
        a, b = self._near(r, qi, ri, np.float64)
        if len(a):
            self._hold(r, qi[a], ri[b])

    def _near(self, r: Records, qi: np.ndarray, ri: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that can be among the nearest, by their scores."""
        q = self.q
        score, limit, slack = _score(q, r, qi, ri, kind)
        # Most records of a tile are seen by all of its queries.
        if q.step:
            some = np.flatnonzero(r.steps[ri] > q.steps[qi].min())
            if len(some):
                score[:, some] = np.where(q.steps[qi][:, None] < r.steps[ri[some]][None, :], np.nan, score[:, some])
        if q.as_of:
            at, start, end = q.at[qi], r.start[ri], r.end[ri]
            some = np.flatnonzero((start > at.min()) | (end <= at.max()))
            if len(some):
                hidden = (at[:, None] < start[some][None, :]) | (at[:, None] >= end[some][None, :])
                score[:, some] = np.where(hidden, np.nan, score[:, some])
        k = q.k[qi]
        deep = int(k.max())
        # Where no limit is known yet, this tile's own k-th score gives one.
        fresh = ~np.isfinite(limit)
        if fresh.any() and deep < len(ri):
            part = np.partition(score[fresh], deep - 1, axis=1)[:, :deep]
            part.sort(axis=1)
            kth = part[np.arange(len(part)), np.maximum(k[fresh], 1) - 1].astype(np.float64)
            limit[fresh] = np.where(np.isnan(kth), np.inf, kth)
        with np.errstate(all="ignore"):
            cut = np.where(np.isfinite(limit), limit + 2 * slack, np.inf)
            # Rounded up, so that no pair is passed over.
            cut = np.nextafter(cut.astype(kind), kind(np.inf))
            found = _true(score <= cut[:, None])
        return np.divmod(found, len(ri))

    def _add_lost(self, r: Records, qi: np.ndarray, ri: np.ndarray) -> None:
        """Records without a distance, which matter only to queries that lack nearer ones."""
        q = self.q
        qi = qi[np.isinf(q.bound[qi]) & (q.k[qi] > 0)]
        if not len(qi) or not len(ri):
            return
        ri = ri[_by_id(r.ids[ri])]
        if not (q.step or q.as_of):
            # All of these see the same ones.
            ri = ri[: int(q.k[qi].max())]
        width = max(1, HELD_PAIRS // len(ri))
        for s in range(0, len(qi), width):
            part = qi[s : s + width]
            seen = self._seen(r, part, ri)
            seen &= np.cumsum(seen, axis=1) <= q.k[part][:, None]
            a, b = np.nonzero(seen)
            if len(a):
                self._keep(part[a], r.ids[ri[b]], np.full(len(a), np.nan))

    def _seen(self, r: Records, qi: np.ndarray, ri: np.ndarray) -> np.ndarray:
        """Which of these queries sees which of these records."""
        q = self.q
        seen = np.ones((len(qi), len(ri)), bool)
        if q.step:
            seen &= q.steps[qi][:, None] >= r.steps[ri][None, :]
        if q.as_of:
            at = q.at[qi][:, None]
            seen &= (at >= r.start[ri][None, :]) & (at < r.end[ri][None, :])
        return seen

    def _add_odd(self, r: Records, qi: np.ndarray, ri: np.ndarray) -> None:
        """All visible pairs, measured exactly; NaN distances rank last."""
        for s in range(0, len(qi) if len(ri) else 0, max(1, HELD_PAIRS // max(1, len(ri)))):
            part = qi[s : s + max(1, HELD_PAIRS // len(ri))]
            seen = self._seen(r, part, ri)
            a, b = np.nonzero(seen)
            if len(a):
                self._hold(r, part[a], ri[b])

    def _hold(self, r: Records, pq: np.ndarray, pr: np.ndarray) -> None:
        self._keep(pq, r.ids[pr], _exact(self.q, r, pq, pr))

    def _keep(self, pq: np.ndarray, ids: np.ndarray, away: np.ndarray) -> None:
        if not len(pq):
            return
        self.held.append((pq, ids, away))
        self.size += len(pq)
        if self.size > 2 * self.trigger:
            self.cut()

    def cut(self) -> pd.DataFrame:
        """Keep each query's k best pairs and tighten its limit."""
        if not self.held:
            return pd.DataFrame({"q": [], "id": [], "distance": []}, dtype=object)
        frame = pd.DataFrame({n: np.concatenate([h[i] for h in self.held]) for i, n in enumerate(("q", "id", "distance"))})
        if frame["id"].dtype.kind in "iu":
            frame = frame.take(np.lexsort([frame[n].to_numpy() for n in ("id", "distance", "q")])).reset_index(drop=True)
        else:
            frame = frame.sort_values(["q", "distance", "id"], na_position="last", ignore_index=True)
        at = frame["q"].to_numpy()
        place = np.arange(len(at)) - np.searchsorted(at, at)
        need = self.q.k[frame["q"].to_numpy()]
        last = frame[place == need - 1]
        reached = last["distance"].to_numpy()
        at = last["q"].to_numpy()
        finite = ~np.isnan(reached)
        self.q.bound[at[finite]] = np.minimum(self.q.bound[at[finite]], reached[finite])
        frame = frame[place < need]
        self.held = [(frame["q"].to_numpy(), frame["id"].to_numpy(), frame["distance"].to_numpy())]
        self.size = len(frame)
        return frame

    def result(self, id_type: pa.DataType, query_id_type: pa.DataType) -> pa.Table:
        frame = self.cut()
        at = frame["q"].to_numpy().astype(np.int64)
        rank = frame.groupby("q").cumcount().to_numpy() + 1
        return pa.table(
            {
                "query_id": pa.array(self.q.ids[at], type=query_id_type),
                "rank": pa.array(rank, type=pa.int32()),
                "id": pa.array(frame["id"].to_numpy(), type=id_type),
                "distance": pa.array(frame["distance"].to_numpy(dtype=np.float64)),
                "top_k": pa.array(self.q.k[at], type=pa.int32()),
            }
        )


def nearest(
    records: Iterable[Records], queries: Queries, id_type: pa.DataType, query_id_type: pa.DataType
) -> pa.Table:
    """Each query's ``top_k`` nearest among all blocks."""
    best = Best(queries)
    for block in records:
        best.add_block(block)
    return best.result(id_type, query_id_type)


class Held:
    """All records of a task, against which queries pass slice by slice.

    What a slice's answer takes is bounded, and so its length is: an answer may
    be as long as the records are many.
    """

    def __init__(self, metric: str, id_type: pa.DataType, query_id_type: pa.DataType, **options):
        self.metric, self.options = metric, options
        self.types = id_type, query_id_type
        self.blocks: list[Records] = []
        self.pending: list[pa.Table] = []
        self.rows = 0
        # Nothing but distances decides which record a query sees.
        self.plain = not any(options.values())
        self.places: list[np.ndarray] | None = None

    def add(self, table: pa.Table) -> None:
        self.pending.append(table)
        self.rows += table.num_rows
        if sum(t.num_rows for t in self.pending) >= HELD_ROWS or sum(t.nbytes for t in self.pending) >= HELD_NBYTES:
            self._pack()

    def _pack(self) -> None:
        """Blocks of many rows, so that the first one gives good limits."""
        table, self.pending = pa.concat_tables(self.pending), []
        block = Records(table, self.metric, **self.options)
        if block.lost.any() and not block.lost.all():
            # Those with distances stand together.
            block = Records(table.take(np.argsort(block.lost, kind="stable")), self.metric, **self.options)
        self.blocks.append(block)
        self.places = None

    def answer(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if self.pending:
            self._pack()
        deep = np.zeros(table.num_rows, bool)
        if self.plain:
            deep = table.column("top_k").to_numpy() >= max(DENSE_PAIRS, DENSE * self.rows)
        if not deep.all():
            rest = Queries(table.filter(pa.array(~deep)), self.metric, **self.options)
            yield from nearest(self.blocks, rest, *self.types).to_batches()
        if deep.any():
            yield from self._whole(table.filter(pa.array(deep)))

    def _order(self) -> None:
        """Ids in order, those with distances first, and where each block's records stand there."""
        ids = np.concatenate([b.ids for b in self.blocks])
        lost = np.concatenate([b.lost for b in self.blocks])
        order = _by_id(ids)
        order = np.concatenate([order[~lost[order]], order[lost[order]]])
        self.ids, self.known = ids[order], int((~lost).sum())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.places = np.split(place, np.cumsum([len(b.ids) for b in self.blocks])[:-1])

    def _whole(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Deep answers: each query is measured against all records, and these are sorted."""
        q = Queries(table, self.metric)
        if not self.rows:
            return
        if self.places is None:
            self._order()
        away = np.empty(self.known)
        for i in range(len(q.ids)):
            for block, place in zip(self.blocks, self.places, strict=True):
                self._measure(q, i, block, place, away)
            order = np.argsort(away)
            near = away[order]
            if len(near) and (np.isnan(near[-1]) or (near[1:] == near[:-1]).any()):
                # Ties by id, in whose order the records stand.
                order = np.argsort(away, kind="stable")
                near = away[order]
            k = min(int(q.k[i]), self.rows)
            ids = np.concatenate([self.ids[order], self.ids[self.known :]]) if k > self.known else self.ids[order[:k]]
            if len(near) and np.isnan(near[-1]):
                # Those without a distance to this query stand among the lost ones.
                far = int(np.isnan(near).argmax())
                ids = np.concatenate([self.ids[order], self.ids[self.known :]])
                ids[far:] = ids[far:][_by_id(ids[far:])]
            ids, near = ids[:k], near[:k]
            yield pa.record_batch(
                {
                    "query_id": pa.array(q.ids[i : i + 1], type=self.types[1]).take(pa.array(np.zeros(k, np.int8))),
                    "rank": pa.array(np.arange(1, k + 1, dtype=np.int32)),
                    "id": pa.array(ids, type=self.types[0]),
                    "distance": pa.array(np.concatenate([near, np.full(k - len(near), np.nan)])),
                    "top_k": pa.array(np.full(k, q.k[i], np.int32)),
                }
            )

    def _measure(self, q: Queries, i: int, r: Records, place: np.ndarray, away: np.ndarray) -> None:
        """The distances of one query, as :func:`_exact` has them, put where the records stand."""
        count = int((~r.lost).sum())
        step = max(1, CACHE_CELLS // max(1, r.vectors.shape[1]))
        for s in range(0, count, step):
            part = slice(s, min(count, s + step))
            with np.errstate(all="ignore"):
                if q.metric == EUCLIDEAN:
                    found = np.sqrt(((r.vectors[part] - q.vectors[i]) ** 2).sum(axis=1))
                else:
                    found = (q.vectors[i] * r.vectors[part]).sum(axis=1)
                    found = 1 - found / (r.norms[part] * q.norms[i]) if q.metric == COSINE else -found
            away[place[part]] = found
