"""Scores of rows against a set of queries by weighted words, in chunks of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Scores held at a time.
CELLS = 4_000_000


class Queries:
    """Terms with the queries that have them and their weights; ``naming`` terms also mark a row as named."""

    def __init__(self, rows: list[tuple[str, int, float, bool]]):
        self.ids = np.array(sorted({q for _, q, _, _ in rows}), np.int64)
        rows = sorted(rows)
        self.terms: dict[str, int] = {}
        for t, _, _, _ in rows:
            self.terms.setdefault(t, len(self.terms))
        self.query = np.searchsorted(self.ids, np.array([q for _, q, _, _ in rows], np.int64))
        self.weight = np.array([w for _, _, w, _ in rows])
        self.naming = np.array([n for _, _, _, n in rows], bool)
        own = np.array([self.terms[t] for t, _, _, _ in rows], np.int64)
        self.start = np.searchsorted(own, np.arange(len(self.terms) + 1))

    def score(self, rows: list[list[str]], ids: list[str], most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query id, score, named) of the scores over 0, ``most`` best of each query and chunk (ties by ``ids``) or all."""
        n = len(self.ids)
        step = max(1, CELLS // max(1, n))
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(np.array(ids, object), kind="stable")] = np.arange(len(ids))
        for low in range(0, len(rows) if n else 0, step):
            mine = rows[low : low + step]
            term = [self.terms.get(t, -1) for r in mine for t in r]
            at = np.repeat(np.arange(len(mine)), [len(r) for r in mine])
            term = np.array(term, np.int64)
            at, term = at[term >= 0], term[term >= 0]
            count = self.start[term + 1] - self.start[term]
            cell = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[term], count)
            flat = np.repeat(at, count) * n + self.query[cell]
            score = np.bincount(flat, self.weight[cell], len(mine) * n)
            named = np.zeros(len(mine) * n, bool)
            named[flat[self.naming[cell]]] = True
            score = np.round(score * 100) / 100
            score = score.reshape(len(mine), n)
            if most is None or len(mine) <= most:
                r, q = np.nonzero(score > 0)
            else:
                least = np.partition(score, len(mine) - most, axis=0)[len(mine) - most]
                r, q = np.nonzero((score >= least) & (score > 0))
                order = np.lexsort((rank[low + r], -score[r, q], q))
                r, q = r[order], q[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                r, q = r[nth < most], q[nth < most]
            yield low + r, self.ids[q], score[r, q], named[r * n + q]
