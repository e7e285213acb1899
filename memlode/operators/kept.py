"""The best hits of many keys in a task, in memory that does not grow with the documents."""

from __future__ import annotations

import numpy as np


class Kept:
    """The k highest scores of each key so far, ties by id, null first; a hit takes 16 bytes.

    `value` gives of scores the numbers that rank. `bound` is of each key what a hit must reach to be among its k best, as far as
    is known; callers need not pass on lower hits. Of the documents only those are held that a kept hit names.
    """

    def __init__(self, keys: int, k: int | None, value=lambda score: score, held: int = 1_000_000):
        self.k, self.value, self.held = k, value, held
        self.bound = np.full(keys, -np.inf)
        self.ids: list = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (key, place in ids, score)
        self.fresh = self.settled = 0

    def documents(self, ids: list) -> int:
        """Takes the ids of more documents; the place of the first."""
        self.ids += ids
        return len(self.ids) - len(ids)

    def add(self, key: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        if len(key):
            self.parts.append((key.astype("i4"), doc.astype("i4"), score))
            self.fresh += len(key)

    def settle(self) -> None:
        """Between documents: drops what is not among the best once more than `held` hits or documents came."""
        if self.k is not None and (self.fresh > self.held or len(self.ids) - self.settled > self.held):
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            self.ids, self.settled = [], 0
            return
        key, doc, score = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        used = np.zeros(len(self.ids), dtype=bool)
        used[doc] = True
        used = np.flatnonzero(used)
        self.ids = sorted_ = [self.ids[i] for i in used]
        order = sorted(range(len(sorted_)), key=lambda i: (sorted_[i] is not None, sorted_[i]))
        rank = np.empty(len(used), dtype="i4")
        rank[order] = np.arange(len(order), dtype="i4")
        self.ids = [sorted_[i] for i in order]  # from here on a place is its rank
        doc = rank[np.searchsorted(used, doc)]
        if self.k is not None:
            value = self.value(score)
            at = np.lexsort((doc, -value, key))
            sorted_key = key[at]
            place = np.arange(len(at)) - np.searchsorted(sorted_key, sorted_key, "left")
            last = at[place == self.k - 1]
            self.bound[key[last]] = value[last]
            at = at[place < self.k]
            key, doc, score = key[at], doc[at], score[at]
        self.parts, self.fresh, self.settled = [(key, doc, score)], 0, len(self.ids)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, place in ids, score) of all that is kept."""
        self.shrink()
        return self.parts[0] if self.parts else (np.zeros(0, dtype="i4"), np.zeros(0, dtype="i4"), np.zeros(0))
