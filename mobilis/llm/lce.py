"""Longest common extensions by a difference cover.

Only positions whose remainder belongs to a difference cover are sorted as
suffixes. Any two positions reach a pair of sampled ones after the same few
steps: these words are compared one by one, the rest is the minimum of the
common prefixes between the two samples in suffix order, read from a sparse
table.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference cover: each remainder but 0 is the difference of exactly one pair of members.
PERIOD, COVER = 13, (0, 1, 3, 9)
_SLOT = np.full(PERIOD, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))
#: Steps after which two positions with given remainders are both sampled.
_STEPS = np.array([[min(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
                    for b in range(PERIOD)] for a in range(PERIOD)])


class Extensions:
    """Common extensions of positions of ``values``, small positive integers.

    Two positions that are asked about must differ somewhere before the end,
    which a unique value behind each text ensures.
    """

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.values = np.concatenate([values, np.zeros(2 * PERIOD, values.dtype)]).astype(np.int64)
        blocks = -(-self.size // PERIOD)
        places = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        self.places = places[places < self.size]
        ranks = self._sorted()
        self.rank = ranks[-1] - 1
        self.table = self._minima(self._prefixes(ranks))

    def _index(self, place: np.ndarray) -> np.ndarray:
        return place // PERIOD * len(COVER) + _SLOT[place % PERIOD]

    def _sorted(self) -> list[np.ndarray]:
        """Ranks (from 1) of the samples by their first PERIOD * 2 ** k values, until all differ."""
        bits = max(1, int(self.values.max()).bit_length())
        per = max(1, 62 // bits)
        keys = []
        for first in range(0, PERIOD, per):
            key = np.zeros(len(self.places), np.int64)
            for t in range(first, min(first + per, PERIOD)):
                key = (key << bits) | self.values[self.places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(order), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        ranks, width = [self._numbered(order, new)], PERIOD
        while ranks[-1].max(initial=0) < len(order):
            nxt = self.places + width
            inside = nxt < self.size
            second = np.zeros(len(order), np.int64)
            second[inside] = ranks[-1][self._index(nxt[inside])]
            key = ranks[-1] * (len(order) + 1) + second
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order[1:]] != key[order[:-1]]])
            ranks.append(self._numbered(order, new))
            width *= 2
        return ranks

    @staticmethod
    def _numbered(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new) + 1
        return out

    def _prefixes(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sample with the next one in suffix order."""
        suffixes = np.empty(len(self.places), np.int64)
        suffixes[self.rank] = self.places
        x, y = suffixes[:-1].copy(), suffixes[1:].copy()
        found = np.zeros(len(x), np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            inside = np.maximum(x, y) < self.size
            same = np.zeros(len(x), bool)
            same[inside] = ranks[level][self._index(x[inside])] == ranks[level][self._index(y[inside])]
            step = np.where(same, PERIOD << level, 0)
            x, y, found = x + step, y + step, found + step
        return found + self._compared(x, y, np.full(len(x), PERIOD))

    def _compared(self, x: np.ndarray, y: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Values that agree from x and y on, of the first ``steps`` each, one by one."""
        found = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(steps > 0)
        while len(open_):
            at = found[open_]
            open_ = open_[self.values[x[open_] + at] == self.values[y[open_] + at]]
            found[open_] += 1
            open_ = open_[found[open_] < steps[open_]]
        return found

    @staticmethod
    def _minima(prefixes: np.ndarray) -> list[np.ndarray]:
        table, width = [prefixes], 1
        while 2 * width <= len(prefixes):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many values agree from x and from y on; x and y differ."""
        steps = _STEPS[x % PERIOD, y % PERIOD]
        found = self._compared(x, y, steps)
        left = np.flatnonzero(found == steps)
        if len(left):
            a = self.rank[self._index(x[left] + steps[left])]
            b = self.rank[self._index(y[left] + steps[left])]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = level == k
                row, width = self.table[k], 1 << int(k)
                found[left[at]] += np.minimum(row[low[at]], row[high[at] - width])
        return found
