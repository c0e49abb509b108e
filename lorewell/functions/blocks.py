"""Blocks of queries, and the blocks of chunks that are scored against them, as columns: no step of Python for a row or a token."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a task holds at once: scores of chunks and queries, pairs of a chunk's token with a query that has it, tokens or components of chunks, and the weights of
#: those tokens that many queries have (a sixteenth of them, ``COMMON`` tokens at most), as a matrix.
SCORES = 1 << 19
PAIRS = 1 << 17
ENTRIES = 1 << 18
WEIGHTS = 1 << 20
COMMON = 2048
#: Products of greater weights than this don't vanish.
TINY = 1e-150


def flat(column: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(values, where each row's begin, their number; a null row has -1)."""
    n = column.value_lengths().fill_null(-1).to_numpy().astype(np.int64)
    held = np.maximum(n, 0)
    return column.flatten(), np.cumsum(held) - held, n


def gather(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each entry, row it is of) for rows whose n entries begin at ``start``."""
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) + np.repeat(start - (np.cumsum(n) - n), n), row


def runs(column: pa.ListArray, most: int) -> list[tuple[int, int]]:
    """(first row, end) of runs of up to ``most`` rows, each with ``ENTRIES`` entries and one row's more at most."""
    held = np.cumsum(column.value_lengths().fill_null(0).to_numpy().astype(np.int64)) // ENTRIES
    ends = np.unique(np.r_[np.arange(0, len(column), most), np.flatnonzero(np.diff(held)) + 1, len(column)])
    return list(zip(ends[:-1].tolist(), ends[1:].tolist()))


class Best:
    """The k best chunks of each query so far. Equal scores, to so many digits, go by the chunk's id."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.digits = k, digits
        self.query, self.score, self.ids = np.empty(0, np.int64), np.empty(0), None
        #: The k-th best score of each query, rounded, and its chunk; what is below can't come in.
        self.least, self.last = np.full(queries, -np.inf), None

    def add(self, scores: np.ndarray, of: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: of chunks (rows, with their ``ids``) and queries (columns, with their numbers ``of``); null where there is none."""
        if not scores.size:
            return
        cut = self.least[of]
        new = np.isneginf(cut)
        if len(scores) > self.k and new.any():
            cut[new] = np.partition(np.where(np.isnan(scores[:, new]), -np.inf, scores[:, new]), -self.k, axis=0)[-self.k]
        finite = np.isfinite(cut)
        cut[finite] -= 10.0**-self.digits + 1e-12 * np.abs(cut[finite])  # more than rounding takes away
        row, col = np.nonzero(scores >= cut)
        query, score = of[col], scores[row, col]
        value = np.round(score, self.digits)
        if self.ids is None:
            self.ids, self.last = ids[:0], np.empty(len(self.least), ids.dtype)
        inside = value > self.least[query]
        tied = np.flatnonzero((value == self.least[query]) & np.isfinite(value))
        inside[tied] = ids[row[tied]] < self.last[query[tied]]
        inside |= np.isinf(value)
        if not inside.any():
            return
        query, score, row = query[inside], score[inside], row[inside]
        met = np.zeros(len(self.least), bool)
        met[query] = True
        old = met[self.query]
        query, score, own = np.r_[self.query[old], query], np.r_[self.score[old], score], np.concatenate([self.ids[old], ids[row]])
        place = own if own.dtype.kind in "iu" else np.unique(own, return_inverse=True)[1]
        value = np.round(score, self.digits)
        order = np.lexsort((place, -value, query))
        first = np.flatnonzero(np.r_[True, np.diff(query[order]) != 0])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        order, rank = order[rank < self.k], rank[rank < self.k]
        last = order[rank == self.k - 1]
        self.least[query[last]], self.last[query[last]] = value[last], own[last]
        self.query, self.score, self.ids = np.r_[self.query[~old], query[order]], np.r_[self.score[~old], score[order]], np.concatenate([self.ids[~old], own[order]])

    def rows(self, query_ids: pa.Array, kind: pa.DataType) -> pa.RecordBatch | None:
        if self.ids is None or not len(self.ids):
            return None
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.query)), pa.array(self.ids, kind), pa.array(self.score)], ["query_id", "chunk_id", "score"])


class DenseQueries:
    """Vectors of queries as matrices, one for each dimension that occurs. Scores are cosines (null for a vector of length 0) or inner products."""

    def __init__(self, metric: str, vectors: pa.ListArray):
        self.metric = metric
        values, start, n = self.look(vectors)
        self.n = len(n)
        self.parts = [(d, np.flatnonzero(n == d), self._matrix(values, start, n, np.flatnonzero(n == d), d)) for d in np.unique(n[n > 0]).tolist()]

    @staticmethod
    def look(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, start, n = flat(vectors)
        return values.to_numpy(zero_copy_only=False), start, n

    @staticmethod
    def _matrix(values: np.ndarray, start: np.ndarray, n: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
        return values[gather(start[rows], n[rows])[0]].reshape(len(rows), dim).astype(np.float64)

    def take(self, of: np.ndarray) -> DenseQueries:
        out = object.__new__(DenseQueries)
        out.metric, out.n, out.parts = self.metric, len(of), []
        for dim, own, matrix in self.parts:
            at = np.full(self.n, -1)
            at[own] = np.arange(len(own))
            mine = np.flatnonzero(at[of] >= 0)
            if len(mine):
                out.parts.append((dim, mine, matrix[at[of[mine]]]))
        return out

    def score(self, block: tuple, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of some rows of a block that ``look`` has read."""
        values, start, n = block
        scores = np.full((len(rows), self.n), np.nan)
        for dim, own, matrix in self.parts:
            fits = np.flatnonzero(n[rows] == dim)
            if len(fits):
                c = self._matrix(values, start, n, rows[fits], dim)
                s = c @ matrix.T
                if self.metric == "cosine":  # divided at the end: whole numbers then give equal bits where the cosines are equal
                    both = np.outer(np.linalg.norm(c, axis=1), np.linalg.norm(matrix, axis=1))
                    s = np.divide(s, both, out=np.full_like(s, np.nan), where=both > 0)
                if s.shape == scores.shape:
                    return np.arange(self.n), s
                scores[np.ix_(fits, own)] = s
        return np.arange(self.n), scores


class Entries(NamedTuple):
    """The tokens of some rows that a query has, as numbers, and their weights."""

    token: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    n: np.ndarray


class SparseQueries:
    """Token weights of queries, by token: for each token the queries that have it. The score is an inner product; null without a common token."""

    def __init__(self, tokens: pa.ListArray, weights: pa.ListArray):
        values, _, n = flat(tokens)
        self.n = len(n)
        self.words = values.unique()
        token = pc.index_in(values, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        weight = flat(weights)[0].to_numpy(zero_copy_only=False).astype(np.float64)
        query = np.repeat(np.arange(self.n), np.maximum(n, 0))
        there = ~np.isnan(weight)
        self._order(token[there], query[there], weight[there])

    def _order(self, token: np.ndarray, query: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(token, kind="stable")
        self.token, self.query, self.weight = token[order], query[order], weight[order]
        count = np.bincount(token, minlength=len(self.words))
        self.begin = np.r_[0, np.cumsum(count)]
        #: What many queries have is a matrix, if that is of use: a product with it takes every query, but far less for each than a pair does.
        often = np.flatnonzero(count >= max(1, self.n // 16))
        often = often[np.argsort(-count[often], kind="stable")][: min(COMMON, WEIGHTS // max(self.n, 1))]
        self.place = np.full(len(self.words), -1)
        if np.isfinite(self.weight).all():
            self.place[often] = np.arange(len(often))
        mine = np.flatnonzero(self.place[self.token] >= 0)
        self.common = np.zeros((self.place.max(initial=-1) + 1, self.n))
        self.common[self.place[self.token[mine]], self.query[mine]] = self.weight[mine]
        self.positive = bool((self.weight > TINY).all())

    def take(self, of: np.ndarray) -> SparseQueries:
        out = object.__new__(SparseQueries)
        at = np.full(self.n, -1)
        at[of] = np.arange(len(of))
        mine = at[self.query] >= 0
        out.n, out.words = len(of), self.words
        out._order(self.token[mine], at[self.query[mine]], self.weight[mine])
        return out

    def look(self, tokens: pa.ListArray, weights: pa.ListArray) -> Entries:
        values, _, n = flat(tokens)
        token = pc.index_in(values, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        weight = flat(weights)[0].to_numpy(zero_copy_only=False).astype(np.float64)
        known = (token >= 0) & ~np.isnan(weight)
        held = np.maximum(n, 0)
        count = np.bincount(np.repeat(np.arange(len(n)), held)[known], minlength=len(n))
        return Entries(token[known], weight[known], np.cumsum(count) - count, count)

    def bound(self, token: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What no chunk of a block can exceed, for each query: each of its tokens with the largest, or the least, weight that the token has there."""
        high, low = np.zeros(len(self.words)), np.zeros(len(self.words))
        np.maximum.at(high, token, weight)
        np.minimum.at(low, token, weight)
        return np.bincount(self.query, weights=np.maximum(self.weight * high[self.token], self.weight * low[self.token]), minlength=self.n)

    def score(self, block: Entries, rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of some rows of a block that ``look`` has read. Queries whose k-th score the block can't reach are left out."""
        at, row = gather(block.start[rows], block.n[rows])
        token, weight = block.token[at], block.weight[at]
        most = self.bound(token, weight)
        reach = np.flatnonzero(most + 1e-8 * (1 + np.abs(most)) >= least)
        if not len(reach) or not len(token):
            return reach[:0], np.empty((len(rows), 0))
        if 2 * len(reach) < self.n:
            return reach, self.take(reach)._scores(len(rows), row, token, weight)
        return np.arange(self.n), self._scores(len(rows), row, token, weight)

    def _scores(self, rows: int, row: np.ndarray, token: np.ndarray, weight: np.ndarray) -> np.ndarray:
        place = self.place[token] if np.isfinite(weight).all() else np.full(len(token), -1)
        # with weights above 0 only a score above 0 has a common token; else those are counted
        positive = self.positive and bool((weight > TINY).all())
        mine = place >= 0
        chunks = np.zeros((rows, len(self.common)))
        chunks[row[mine], place[mine]] = weight[mine]
        scores = chunks @ self.common
        shared = None
        if not positive:
            chunks[row[mine], place[mine]] = 1
            at, there = np.flatnonzero(self.place[self.token] >= 0), np.zeros_like(self.common)
            there[self.place[self.token[at]], self.query[at]] = 1
            shared = chunks @ there
        rest = np.flatnonzero(~mine)
        count = self.begin[token[rest] + 1] - self.begin[token[rest]]
        ends, first = np.cumsum(count), 0
        while first < len(rest):
            end = max(first + 1, int(np.searchsorted(ends, ends[first] - count[first] + PAIRS, "right")))
            part = rest[first:end]
            at, entry = gather(self.begin[token[part]], count[first:end])
            a, b = row[part[0]], row[part[-1]] + 1
            cell = (row[part] - a)[entry] * self.n + self.query[at]
            scores[a:b] += np.bincount(cell, weights=weight[part][entry] * self.weight[at], minlength=(b - a) * self.n).reshape(b - a, self.n)
            if shared is not None:
                shared[a:b] += np.bincount(cell, minlength=(b - a) * self.n).reshape(b - a, self.n)
            first = end
        scores[(scores if shared is None else shared) == 0] = np.nan
        return scores
