"""Longest common extensions through a suffix tree.

Ukkonen's construction, online and in linear time, over numbers instead of letters. An Euler tour
of the finished tree, with a range minimum over the string depths it meets, gives the depth of the
lowest common ancestor of two leaves, which is the length of what two suffixes share.
"""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """The suffixes of `numbers`, which are positive; 0 ends the text and sorts first."""

    def __init__(self, numbers: np.ndarray):
        self.length = len(numbers)
        self._build([*numbers.tolist(), 0])
        self._tour()

    def _build(self, text: list[int]) -> None:
        self.symbols = symbols = max(text) + 1
        end = len(text)
        begin, stop, link, suffix = [0], [0], [0], [-1]
        edges: dict[int, int] = {}  # node * symbols + first number of the edge: node below
        node = first = matched = waiting = 0
        for at, number in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not matched:
                    first = at
                key = node * symbols + text[first]
                below = edges.get(key)
                if below is None:
                    edges[key] = len(begin)
                    begin.append(at)
                    stop.append(end)
                    link.append(0)
                    suffix.append(at - waiting + 1)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    start = begin[below]
                    width = min(stop[below], at + 1) - start
                    if matched >= width:
                        first += width
                        matched -= width
                        node = below
                        continue
                    branch = text[start + matched]
                    if branch == number:
                        if unlinked:
                            link[unlinked] = node
                        matched += 1
                        break
                    middle = len(begin)
                    begin += (start, at)
                    stop += (start + matched, end)
                    link += (0, 0)
                    suffix += (-1, at - waiting + 1)
                    edges[key] = middle
                    edges[middle * symbols + number] = middle + 1
                    edges[middle * symbols + branch] = below
                    begin[below] = start + matched
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif matched:
                    matched -= 1
                    first = at - waiting + 1
        self.begin, self.suffix = begin, suffix
        self.width = (np.array(stop) - np.array(begin)).tolist()
        # Nodes below a node lie together, in the order of the numbers that their edges start with.
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.below = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order].tolist()
        owners = keys[order] // symbols
        above = np.zeros(len(begin), dtype=np.int64)
        above[self.below] = owners
        self.above = above.tolist()
        self.first_below = np.searchsorted(owners, np.arange(len(begin) + 1)).tolist()

    def _tour(self) -> None:
        """Depths in the order of an Euler tour, and where the tour meets each leaf."""
        below, bounds, width, suffix, above = (
            self.below, self.first_below, self.width, self.suffix, self.above
        )
        depth = [0] * len(suffix)
        depths, met = [0], [0] * (self.length + 1)
        waiting = below[bounds[1] - 1 :: -1]
        while waiting:
            node = waiting.pop()
            start = depth[above[node]]
            if depths[-1] != start:
                depths.append(start)  # back at the node above, from the child before
            if suffix[node] >= 0:
                met[suffix[node]] = len(depths)
            else:
                waiting += below[bounds[node] : bounds[node + 1]][::-1]
            depth[node] = start + width[node]
            depths.append(depth[node])
        self.depths = np.array(depths, dtype=np.int32)
        self.met = np.array(met, dtype=np.int64)

    def ranks(self, descending: bool = False) -> list[int]:
        """The rank of each suffix; with `descending`, numbers sort downwards, the end still first."""
        if not descending:
            return np.argsort(np.argsort(self.met)).tolist()
        below, bounds, suffix = self.below, self.first_below, self.suffix
        found, rank = [0] * (self.length + 1), 0
        stack = [0]
        while stack:
            node = stack.pop()
            if suffix[node] >= 0:
                found[suffix[node]] = rank
                rank += 1
                continue
            start, last = bounds[node], bounds[node + 1]
            ends_here = self.begin[below[start]] == self.length
            stack += below[start + ends_here : last]
            if ends_here:
                stack.append(below[start])
        return found

    def shared(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How far the suffixes at two lists of places agree; the places of a pair differ."""
        low = np.minimum(self.met[one], self.met[other])
        high = np.maximum(self.met[one], self.met[other])
        level = np.frexp(high - low + 1)[1] - 1
        found = np.zeros(len(low), dtype=np.int64)
        row = self.depths
        # Row k of the sparse table holds minima of 2^k depths; only one row is kept at a time.
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << (k - 1)
                row = np.minimum(row[:-half], row[half:])
            here = level == k
            found[here] = np.minimum(row[low[here]], row[high[here] - (1 << k) + 1])
        return found
