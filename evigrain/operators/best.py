"""The k best rows of each query in a stream of score blocks, in memory bounded by queries x k and one block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores that are looked at together.
BLOCK_SCORES = 1 << 20


class Best:
    """Ties go to the row that came first, so rows must come in ascending order of their keys."""

    def __init__(self, queries: int, k: int, decimals: int | None = None):
        self.k, self.decimals, self.seen = k, decimals, 0
        self.score = np.full((queries, k), -np.inf)
        self.row = np.zeros((queries, k), np.int64)
        self.keys = np.empty((queries, k), object)

    def update(self, scores: np.ndarray, keys: np.ndarray, first: int = 0) -> None:
        """``scores`` (queries from ``first`` on, rows); what isn't finite is no match. Rows of one block may come in several calls; ``next_rows`` ends it."""
        n, k = scores.shape[1], self.k
        most = slice(first, first + len(scores))
        least = self.score[most, -1]
        slack = 0.0 if self.decimals is None else 10.0**-self.decimals
        bar = least - slack
        if n > 4 * k and (empty := np.flatnonzero(np.isneginf(least))).size:
            known = np.where(np.isfinite(scores[empty]), scores[empty], -np.inf)
            bar[empty] = np.partition(known, n - k, axis=1)[:, n - k] - 2 * slack
        with np.errstate(invalid="ignore"):
            q, c = np.nonzero(scores >= bar[:, None])
        s = scores[q, c]
        s = (s if self.decimals is None else np.round(s, self.decimals)) + 0.0
        good = np.isfinite(s) & (s > least[q])
        q, c, s = q[good] + first, c[good], s[good]
        if not len(q):
            return
        own = np.unique(q)
        old_q, old_c = np.nonzero(self.score[own] > -np.inf)
        old_q = own[old_q]
        all_q, all_s = np.concatenate([old_q, q]), np.concatenate([self.score[old_q, old_c], s])
        all_r, all_k = np.concatenate([self.row[old_q, old_c], self.seen + c]), np.concatenate([self.keys[old_q, old_c], keys[c]])
        order = np.lexsort((all_r, -all_s, all_q))
        all_q = all_q[order]
        place = np.arange(len(order)) - np.searchsorted(all_q, all_q)
        kept = place < k
        at, order, place = all_q[kept], order[kept], place[kept]
        self.score[at, place], self.row[at, place], self.keys[at, place] = all_s[order], all_r[order], all_k[order]

    def next_rows(self, n: int) -> None:
        self.seen += n

    def rows(self, query_ids: pa.Array, key_type: pa.DataType, at_once: int = 65536) -> "list[pa.Array]":
        """Columns (query_id, key, score), in pieces."""
        q, c = np.nonzero(self.score > -np.inf)
        for i in range(0, len(q), at_once):
            a, b = q[i : i + at_once], c[i : i + at_once]
            yield [query_ids.take(pa.array(a)), pa.array(self.keys[a, b].tolist(), key_type), pa.array(self.score[a, b])]


def key_array(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out
