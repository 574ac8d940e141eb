"""What one task of a search does with its rows: score them, keep the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Memory and speed only, no effect on results.
TILE_SCORES = 1 << 21
SEGMENT_ROWS = 1 << 8
RESCORE_PAIRS = 1 << 8
CROWDED = 1 << 14
WAITING_ROWS = 1 << 14

# Speed only: with so many queries of so many dimensions, an outline of the rows is made; an eighth of the
# dimensions is kept there, others share a place by threes. A tile where it leaves more than this share open is
# multiplied in full.
OUTLINED_QUERIES = 1 << 10
OUTLINED_DIM = 1 << 8
KEPT_SHARE = 8
SHARED_DIMS = 3
OPEN_SHARE = 1 / 32
CHECKED_PAIRS = 1 << 7


def dense_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    """``[n, dim]`` float32 of an Arrow list column: cut or zero-padded, NULL is zero."""
    count = len(vectors)
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    flat = np.asarray(pc.fill_null(vectors.flatten(), 0.0), dtype=np.float32)
    if (lengths == dim).all():
        return flat.reshape(count, dim)
    out = np.zeros((count, dim), dtype=np.float32)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(count), lengths)
    position = np.arange(len(flat)) - np.repeat(starts, lengths)
    fits = position < dim
    out[row[fits], position[fits]] = flat[fits]
    return out


def distinct(*columns) -> tuple[np.ndarray, np.ndarray]:
    """First position of every distinct item, and for every item the number of its equal."""
    numbers: dict = {}
    slots = np.array([numbers.setdefault(item, len(numbers)) for item in zip(*columns)], dtype=np.int64)
    firsts = np.full(len(numbers), len(slots), dtype=np.int64)
    np.minimum.at(firsts, slots, np.arange(len(slots)))
    return firsts, slots


def row_bytes(vectors: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in vectors + np.float32(0)]  # -0.0 becomes 0.0


def exact_scores(rows: np.ndarray, row: np.ndarray, queries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Dot products of the given pairs in double precision. NaN, which has no rank, becomes the lowest."""
    out = np.empty(len(row))
    for start in range(0, len(row), RESCORE_PAIRS):
        part = slice(start, start + RESCORE_PAIRS)
        left, right = rows[row[part]].astype(np.float64), queries[query[part]].astype(np.float64)
        out[part] = np.einsum("ij,ij->i", left, right)
    out[np.isnan(out)] = -np.inf
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for every start, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(starts - before, lengths)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row; NaN is the lowest."""
    known = np.where(np.isnan(scores), np.float32(-np.inf), scores)
    return np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]


class Outline:
    """A shorter form of vectors, whose dot products are at least those of the vectors.

    The dimensions where the queries weigh most stay as they are. The others are
    dealt out to places, and a place has the length of its numbers, rounded up:
    by Cauchy and Schwarz the product of two lengths is at least that of the
    numbers, whatever their signs. Next to exact where most numbers are zero.
    """

    def __init__(self, queries: np.ndarray):
        weight = np.einsum("ij,ij->j", queries, queries, dtype=np.float64)
        order = np.argsort(-weight, kind="stable")
        self.kept, rest = np.split(order, [len(order) // KEPT_SHARE])
        places = -(-len(rest) // SHARED_DIMS)
        self.shared = [rest[start : start + places] for start in range(0, len(rest), places)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        squares = np.zeros((len(vectors), len(self.shared[0])))
        for dims in self.shared:
            squares[:, : len(dims)] += np.square(vectors[:, dims], dtype=np.float64)
        with np.errstate(over="ignore"):
            lengths = np.sqrt(squares).astype(np.float32)
        lengths[lengths > 0] = np.nextafter(lengths[lengths > 0], np.float32(np.inf))
        return np.concatenate([vectors[:, self.kept], lengths], axis=1)


class BestRows:
    """The best rows so far of every query: highest score, then lowest keys.

    A float32 matrix product finds the rows that can be among the best; only
    those are scored again in double precision. A float32 dot product of
    ``dim`` terms is off by at most ``dim * 2**-23 * |row| * |query|``, and the
    bar is lowered by that much, so no row is missed.

    The product is made in tiles of ``tile`` scores. Of a tile only the largest
    score of every segment of rows is looked at; scores of a segment are
    compared one by one if that one reaches the bar.

    Where the bars are known, the product of outlines (``Outline``) comes first
    and tells most rows apart with less than half the work; only pairs that it
    leaves open are multiplied in full. Vectors that an outline says little of,
    as those with few zeros, are multiplied in full as before: after a tile in
    vain it is tried again more and more seldom.

    Many rows can reach the bar together, as copies of one text do. They are
    then scored once per distinct vector, and of equal scores only the lowest
    keys are kept before anything is sorted. What was found waits until there
    is as much of it as of the best rows, so sorting costs no more per row for
    a large batch of queries than for a small one.
    """

    def __init__(
        self,
        vectors: np.ndarray,
        limits: np.ndarray,
        keys: list[str],
        digits: int | None,
        floor: np.ndarray | None = None,
        tile: int = TILE_SCORES,
    ):
        self.tile = tile
        self.vectors = vectors
        self.limits = limits
        self.keys = keys
        self.digits = digits
        self.rounding = 0.0 if digits is None else 10.0**-digits
        self.noise = vectors.shape[1] * 2.0**-23 * np.linalg.norm(vectors.astype(np.float64), axis=1)
        # a score that is reached elsewhere: rows below it are of no use
        self.floor = np.full(len(limits), -np.inf) if floor is None else np.array(floor, np.float64)
        self.table: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.outline: Outline | None = None
        if len(vectors) >= OUTLINED_QUERIES and vectors.shape[1] >= OUTLINED_DIM:
            self.outline = Outline(vectors)
            self.outlines = self.outline.of(vectors)
        self.in_vain, self.resting = 0, 0

    def add(self, vectors: np.ndarray, rows: pa.Table, queries: np.ndarray) -> None:
        """Offer ``rows`` with their ``vectors`` to the queries of the given numbers."""
        if not len(vectors):
            return
        longest = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64).max())
        step = max(1, self.tile // len(vectors))
        outlines = self.outline.of(vectors) if self.outline and len(queries) >= OUTLINED_QUERIES else None
        for start in range(0, len(queries), step):
            self._offer(vectors, outlines, longest, rows, queries[start : start + step])

    def _offer(
        self, vectors: np.ndarray, outlines: np.ndarray | None, longest: float, rows: pa.Table, queries: np.ndarray
    ) -> None:
        found = None if outlines is None else self._left_open(vectors, outlines, longest, queries)
        at, column = self._candidates(vectors, longest, queries) if found is None else found
        if not len(at):
            return
        number = queries[column]
        if len(at) <= CROWDED:
            values = self._rounded(exact_scores(vectors, at, self.vectors, number))
        else:
            values = self._scores_of_copies(vectors, at, number)
            kept = self._thin(rows, at, number, values)
            at, number, values = at[kept], number[kept], values[kept]
        found = rows.take(pa.array(at))
        found = found.append_column("query", pa.array(number))
        found = found.append_column("score", pa.array(values))
        self.waiting.append(found)
        if sum(map(len, self.waiting)) >= max(WAITING_ROWS, 0 if self.table is None else len(self.table)):
            self.settle()

    def settle(self) -> None:
        """Bring ``table`` up to date."""
        if self.waiting:
            self.table = self._best(pa.concat_tables([*([] if self.table is None else [self.table]), *self.waiting]))
            self.waiting = []

    def _candidates(self, vectors: np.ndarray, longest: float, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that can be among the best, each with the place of its query."""
        rough = self.vectors[queries] @ vectors.T
        starts = np.arange(0, len(vectors), SEGMENT_ROWS)
        most = np.maximum.reduceat(rough, starts, axis=1)  # NaN, which is unsure, if there is one
        bar = self._bar(np.maximum(self.floor[queries], self._kth_of_tile(rough, most, queries)), longest, queries)
        query, segment = np.nonzero(~(most < bar))
        at = starts[segment][:, None] + np.arange(min(SEGMENT_ROWS, len(vectors)))
        inside = at < len(vectors)
        reached = ~(rough[query[:, None], np.where(inside, at, 0)] < bar[query]) & inside
        return at[reached], np.repeat(query, reached.sum(axis=1))

    def _left_open(
        self, vectors: np.ndarray, outlines: np.ndarray, longest: float, queries: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray] | None:
        """The same by outlines first; None if these leave too much open, or are not to be tried now."""
        bar = self._bar(self.floor[queries], longest, queries)
        allowed = OPEN_SHARE * len(queries) * len(vectors)
        if np.isneginf(bar).sum() * len(vectors) > allowed:
            return None
        if self.resting:
            self.resting -= 1
            return None
        left = np.flatnonzero(~(outlines @ self.outlines[queries].T < bar[:, 0]))
        if len(left) > allowed:
            self.in_vain += 1
            self.resting = 1 << min(self.in_vain, 10)
            return None
        self.in_vain = 0
        at, query = np.divmod(left, len(queries))
        asked, reached = self.vectors[queries], np.empty(len(at), bool)
        for start in range(0, len(at), CHECKED_PAIRS):
            part = slice(start, start + CHECKED_PAIRS)
            rough = np.einsum("ij,ij->i", vectors[at[part]], asked[query[part]])
            reached[part] = ~(rough < bar[query[part], 0])
        return at[reached], query[reached]

    def _bar(self, floor: np.ndarray, longest: float, queries: np.ndarray) -> np.ndarray:
        """What a float32 score must reach, a column."""
        slack = self.rounding + 2 * np.nan_to_num(longest, nan=np.inf) * self.noise[queries]
        bar = np.where(np.isfinite(slack), floor - slack, -np.inf)
        with np.errstate(over="ignore"):
            return np.nextafter(bar.astype(np.float32), np.float32(-np.inf))[:, None]

    def _kth_of_tile(self, rough: np.ndarray, most: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """A score that as many rows of the tile reach as a query has results: in as many segments, if there are enough."""
        keep = min(int(self.limits[queries].max()), rough.shape[1])
        if keep <= most.shape[1]:
            return _kth(most, keep)
        kth = np.full(len(queries), -np.inf)
        unknown = np.isneginf(self.floor[queries])
        if unknown.any():
            kth[unknown] = _kth(rough[unknown], keep)
        return kth

    def _rounded(self, values: np.ndarray) -> np.ndarray:
        return values if self.digits is None else np.round(values, self.digits) + 0.0

    def _scores_of_copies(self, vectors: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        used, place = np.unique(at, return_inverse=True)
        firsts, slots = distinct(row_bytes(vectors[used]))
        pairs, back = np.unique(slots[place] * len(self.limits) + number, return_inverse=True)
        slot, query = np.divmod(pairs, len(self.limits))
        return self._rounded(exact_scores(vectors[used[firsts]], slot, self.vectors, query))[back]

    def _thin(self, rows: pa.Table, at: np.ndarray, number: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Positions of the candidates that can still win: above the k-th score, or the lowest keys at it."""
        key_rank = np.empty(len(rows), dtype=np.int64)
        key_rank[np.asarray(pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in self.keys]))] = np.arange(len(rows))
        by_query = np.argsort(number, kind="stable")
        asked, starts = np.unique(number[by_query], return_index=True)
        kept = []
        for query, mine in zip(asked, np.split(by_query, starts[1:])):
            limit = self.limits[query]
            if len(mine) > limit:
                own = values[mine]
                kth = np.partition(own, len(own) - limit)[len(own) - limit]
                ties = mine[own == kth]
                if len(ties) > limit:
                    ties = ties[np.argpartition(key_rank[at[ties]], limit)[:limit]]
                mine = np.concatenate([mine[own > kth], ties])
            kept.append(mine)
        return np.concatenate(kept)

    def _best(self, table: pa.Table) -> pa.Table:
        order = [("query", "ascending"), ("score", "descending"), *((k, "ascending") for k in self.keys)]
        table = table.take(pc.sort_indices(table, sort_keys=order))
        query = np.asarray(table["query"])
        rank = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        last = rank == self.limits[query] - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], np.asarray(table["score"])[last])
        return table.filter(pa.array(rank < self.limits[query]))
