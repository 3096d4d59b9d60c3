"""Exact top-k search with a vector-approximation file.

Components are turned into the integers floor(1024 x). Every block of rows gets an approximation:
each dimension is cut into `CELLS` cells at quantiles of the block, and a row keeps one byte per
dimension. The cells bound a row's inner product with a query from both sides: with the cell's
middle m and half width h the product lies within q.m -/+ |q|.h. The approximation is scanned
first; rows whose upper bound is below the k-th best lower bound are out. The others' exact
vectors are read in order of their bound, most promising first, until the k-th exact score is
above every bound left. The k best of every block are then merged.

Vectors that are null or hold null or non-finite components take no part; zero vectors do. Vectors
are compared with those of their own dimension. Ties go to the smaller id. Rows that repeat an id are
separate candidates and queries: only the query's own row is left out. Rows without an id are
candidates that come last among ties. Products that could leave 64 bits are computed in whole numbers
of any length; a result that does not fit a long raises an error rather than wrap around. Vectors are
read whole whatever their length. Only vec_id and embedding are read, so further columns and their
names do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.vectors import NO_ID, nearest, search_blocks, shown, stacked, usable

SCALE = 1024
CELLS = 64
STEP = 64  # exact vectors read at a time
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096
LARGEST = 2.0**62  # magnitude up to which sums of products are left to 64 bits


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 x) of every component, as longs or, beyond their range, as Python's integers."""
    scaled = np.floor(SCALE * vectors)
    if np.abs(scaled).max(initial=0) < LARGEST:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], dtype=object).reshape(scaled.shape)


def products(exact: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query, exact at any size."""
    reach = np.abs(exact).max(axis=1, initial=0).astype(np.float64) * float(np.abs(query).sum(dtype=object))
    if exact.dtype != object and reach.max(initial=0) < LARGEST:
        return exact @ query
    return np.array([sum(int(x) * int(y) for x, y in zip(row, query, strict=True)) for row in exact], dtype=object)


def as_longs(scores) -> list[int]:
    if any(not -(2**63) <= int(score) < 2**63 for score in scores):
        raise OverflowError("an inner product of the result does not fit a long")
    return [int(score) for score in scores]


class Approximation:
    """Cells of one block's rows."""

    def __init__(self, exact: np.ndarray):
        shares = np.linspace(0, 1, CELLS + 1)
        exact = exact.astype(np.float64)
        self.edges = np.quantile(exact, shares, axis=0, method="nearest")
        self.cells = np.empty(exact.shape, dtype=np.uint8)
        for d in range(exact.shape[1]):
            place = np.searchsorted(self.edges[1:-1, d], exact[:, d], side="right")
            self.cells[:, d] = place
        dimension = np.arange(exact.shape[1])
        low, high = self.edges[self.cells, dimension], self.edges[self.cells + 1, dimension]
        self.middle, self.half = (low + high) / 2, (high - low) / 2

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products, one row per query."""
        centre, reach = queries @ self.middle.T, np.abs(queries) @ self.half.T
        slack = 1e-9 * (np.abs(queries) @ np.abs(self.middle).T + reach) + 1  # rounding
        return centre - reach - slack, centre + reach + slack


def best_of(exact, ids, query, lower, upper, k):
    """Positions and scores of the k best rows, reading exact vectors by falling bound."""
    rows = np.flatnonzero(upper > -np.inf)
    if len(rows) > k:
        rows = rows[upper[rows] >= np.partition(lower[rows], -k)[-k]]
    rows = rows[np.argsort(-upper[rows], kind="stable")]
    place, score = rows[:0], np.array([], dtype=np.int64)
    for start in range(0, len(rows), STEP):
        if len(place) == k and upper[rows[start]] < score[-1]:
            break
        read = rows[start : start + STEP]
        place = np.concatenate([place, read])
        score = np.concatenate([score, products(exact[read], query)])
        if score.dtype == object:
            order = sorted(range(len(place)), key=lambda n: (-score[n], ids[place[n]]))[:k]
        else:
            order = np.lexsort((ids[place], -score))[:k]
        place, score = place[order], score[order]
    return place, score


def searcher(k: int):
    def search(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if len(base) and len(queries):
            exact, ids = integers(stacked(base["vec"])), base["vec_id"].to_numpy()
            asked, asked_ids = integers(stacked(queries["vec"])), queries["vec_id"].to_numpy()
            rows, asked_rows = base["row"].to_numpy(), queries["row"].to_numpy()
            approximation = Approximation(exact)
            for at in range(0, len(asked), STEP):
                lower, upper = approximation.bounds(asked[at : at + STEP].astype(np.float64))
                own = asked_rows[at : at + STEP, None] == rows[None, :]
                lower[own] = upper[own] = -np.inf
                for n in range(len(lower)):
                    place, score = best_of(exact, ids, asked[at + n], lower[n], upper[n], k)
                    found["query_row"] += [asked_rows[at + n]] * len(place)
                    found["query_id"] += [asked_ids[at + n]] * len(place)
                    found["vec_id"] += list(ids[place])
                    found["score"] += as_longs(score)
        return pd.DataFrame(found)

    return search


def top_products(embeddings: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query."""
    base = usable(embeddings, zero_counts=True)
    queries = base.filter((F.col("vec_id") != NO_ID) & is_query)
    hits = search_blocks(base, queries, searcher(k), "long", BLOCK_ROWS, QUERY_ROWS)
    return shown(nearest(hits, k))
