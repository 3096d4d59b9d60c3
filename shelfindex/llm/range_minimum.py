"""Minima of ranges, and how far a lower bound holds, by a sparse table."""

from __future__ import annotations

import numpy as np


class RangeMinimum:
    """Row k of the table holds the minima of the 2^k values from each place on."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.rows = [np.asarray(values)]
        while 2 << (len(self.rows) - 1) <= self.size:
            half = 1 << (len(self.rows) - 1)
            row = self.rows[-1]
            self.rows.append(np.minimum(row[:-half], row[half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The minimum of each range; both ends belong to it."""
        level = np.frexp(last - first + 1)[1] - 1
        found = np.empty(len(first), dtype=self.rows[0].dtype)
        for k, row in enumerate(self.rows):
            here = level == k
            found[here] = np.minimum(row[first[here]], row[last[here] - (1 << k) + 1])
        return found

    def reach_right(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The last place up to which all values after `places` are at least `bounds`."""
        found = places.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            start = found + 1
            inside = start + step <= self.size
            holds = inside & (row[np.where(inside, start, 0)] >= bounds)
            found = np.where(holds, found + step, found)
        return found

    def reach_left(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The first place from which all values up to `places`, save its own, are at least `bounds`.

        Value i stands between places i - 1 and i, as common prefixes of neighbours do.
        """
        found = places.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            start = found - step + 1
            inside = start >= 1
            holds = inside & (row[np.where(inside, start, 0)] >= bounds)
            found = np.where(holds, found - step, found)
        return found
