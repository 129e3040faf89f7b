"""The best rows of each query while rows come by in blocks; what a task holds depends on the queries and k, not on the rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows that are held beyond the best ones before they are sorted out.
HELD = 1_000_000


def sortable(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids as an array that can be ordered, nulls as the least value, and which of them are null."""
    null = np.asarray(ids.is_null())
    if null.any():
        ids = ids.fill_null(np.iinfo(np.int64).min if ids.type == pa.int64() else np.iinfo(np.int32).min if ids.type == pa.int32() else "")
    return ids.to_numpy(zero_copy_only=False), null


class Best:
    """The k rows of greatest score of each of n queries; of equal scores the least ids, and NaN is the greatest score."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        #: Scores below these cannot be among the best any more, nor equal ones with ids above the bounds of full queries.
        self.least = np.full(n, -np.inf)
        self.full = np.zeros(n, bool)
        self.bound: np.ndarray | None = None
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = self.kept = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
        """Rows: number of the query, score, id, and whatever goes with them."""
        if self.bound is None:
            self.bound = np.zeros(len(self.least), ids.dtype)
        order = np.where(np.isnan(score), np.inf, score)
        fair = (order > self.least[query]) | ((order == self.least[query]) & ~self.full[query])
        same = np.nonzero((order == self.least[query]) & self.full[query])[0]
        fair[same] = ids[same] < self.bound[query[same]]
        rows = (query, score, ids, *more)
        if not fair.all():
            rows = tuple(c[fair] for c in rows)
        if len(rows[0]):
            self.rows.append(rows)
            self.held += len(rows[0])
            if self.held > 2 * self.kept + HELD // 8 and self.held > self.kept + self.k * len(self.least):
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...] | None:
        """Leaves the best rows only, by query, score and id; None if there are none."""
        if not self.rows:
            return None
        query, score, ids, *more = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        by_id = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((by_id, -np.where(np.isnan(score), np.inf, score), query))
        query = query[order]
        starts = np.r_[0, np.nonzero(query[1:] != query[:-1])[0] + 1]
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = place == self.k - 1
        order, query = order[place < self.k], query[place < self.k]
        rows = (query, score[order], ids[order], *(c[order] for c in more))
        self.rows, self.held, self.kept = [rows], len(query), len(query)
        last = last[place < self.k]
        full = query[last]
        self.full[full], self.bound[full] = True, rows[2][last]
        self.least[full] = np.where(np.isnan(rows[1][last]), np.inf, rows[1][last])
        return rows
