"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: centred, projected on their principal directions and turned by a
learned rotation whose corners lie close to the data. A code is split into substrings and each
substring has an index of its own. Two codes within Hamming distance r differ by at most
floor(r / m) bits in one of m substrings at least, so probing every index within that many bits
retrieves every code within r. What is retrieved and lies within r is ranked by cosine on the
original vectors.

The codes and the radius are learned on at most `SAMPLE` vectors, taken by the hash of their row;
every row is indexed. The radius is the one that holds `COVER` of the true neighbours inside the
sample. Neighbours come closer as rows are added, so it errs on the safe side for more rows.
A query that retrieves fewer than k rows is searched again with a radius that spans all codes.

Null, zero and non-finite vectors take no part. Vectors are compared with those of their own
dimension, each dimension with a coding of its own. Equal vectors tie and the smaller id wins. Rows
that repeat an id are separate candidates and queries: only the query's own row is left out. Rows
without an id are candidates that come last among ties. Vectors are read whole whatever their length.
Only vec_id and embedding are read, so further columns and their names do not matter. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept
from shelfindex.llm.vectors import NO_ID, nearest, search_blocks, shown, stacked, usable

SAMPLE = 4_000
SAMPLE_QUERIES = 1_000
COVER = 0.97
BITS = 64
SUBSTRING_BITS = 8
ROUNDS = 40
BLOCK_ROWS = 8_192
QUERY_ROWS = 4_096


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@dataclass(frozen=True)
class Codes:
    """A learned coding: sign bits of rotated, centred unit vectors."""

    centre: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """One row of substring values for each vector."""
        signs = (unit(vectors) - self.centre) @ self.turn > 0
        parts = []
        for low in range(0, self.bits, SUBSTRING_BITS):
            part = signs[:, low : low + SUBSTRING_BITS]
            parts.append(part @ (1 << np.arange(part.shape[1])))
        return np.stack(parts, axis=1).astype(np.uint8)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn(sample: np.ndarray, k: int, seed: int = 7) -> Codes:
    """Fit the rotation by alternating signs and Procrustes solutions, then the radius."""
    rows = unit(sample)
    centre = rows.mean(axis=0)
    _, _, directions = np.linalg.svd(rows - centre, full_matrices=False)
    basis = directions[:BITS].T
    projected = (rows - centre) @ basis
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        corners = np.where(projected @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ corners)
        turn = left @ right
    codes = Codes(centre, basis @ turn, basis.shape[1])
    words = codes.encode(sample)
    spread = []
    for i in range(min(SAMPLE_QUERIES, len(rows))):
        cosines = rows @ rows[i]
        cosines[i] = -np.inf
        near = np.argsort(-cosines)[: min(k, len(rows) - 1)]
        spread.append(hamming(words[near], words[i]))
    found = np.concatenate(spread) if spread else np.array([], dtype=int)
    radius = int(np.ceil(np.quantile(found, COVER))) if found.size else codes.bits
    return Codes(centre, codes.turn, radius)


def flips(width: int, most: int) -> np.ndarray:
    """All masks over `width` bits that change at most `most` of them."""
    masks = [
        sum(1 << bit for bit in changed)
        for n in range(min(most, width) + 1)
        for changed in combinations(range(width), n)
    ]
    return np.array(masks, dtype=np.int64)


class SubstringIndex:
    """Buckets of one block's codes, for every substring."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.orders, self.starts = [], []
        for part in words.T:
            self.orders.append(np.argsort(part, kind="stable"))
            counts = np.bincount(part, minlength=1 << SUBSTRING_BITS)
            self.starts.append(np.concatenate([[0], np.cumsum(counts)]))

    def within(self, word: np.ndarray, radius: int, masks: np.ndarray) -> np.ndarray:
        """Rows whose code differs from `word` in at most `radius` bits."""
        seen = np.zeros(len(self.words), dtype=bool)
        for part, order, starts in zip(word, self.orders, self.starts, strict=True):
            probes = int(part) ^ masks
            low, size = starts[probes], starts[probes + 1] - starts[probes]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            seen[order[np.repeat(low, size) + inside]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.words[rows], word) <= radius]


def searcher(codings: dict[int, Codes], k: int):
    def search(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        hits = []
        if len(base) and len(queries):
            vectors, ids = stacked(base["vec"]), base["vec_id"].to_numpy()
            codes = codings[vectors.shape[1]]
            parts = -(-codes.bits // SUBSTRING_BITS)
            masks = flips(SUBSTRING_BITS, codes.radius // parts)
            lengths, rows = np.linalg.norm(vectors, axis=1), base["row"].to_numpy()
            index = SubstringIndex(codes.encode(vectors))
            asked = stacked(queries["vec"])
            for own, own_id, vector, word in zip(
                queries["row"], queries["vec_id"], asked, codes.encode(asked), strict=True
            ):
                near = index.within(word, codes.radius, masks)
                near = near[rows[near] != own]
                cosines = (vectors[near] @ vector) / (lengths[near] * np.linalg.norm(vector))
                best = np.lexsort((ids[near], -cosines))[:k]
                hits.append(
                    pd.DataFrame(
                        {"query_row": own, "query_id": own_id, "vec_id": ids[near][best],
                         "score": cosines[best]}
                    )
                )
        empty = pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        return pd.concat(hits) if hits else empty

    return search


def codings_of(base: DataFrame, k: int) -> dict[int, Codes]:
    """A coding for each dimension that occurs, learned on a sample of its vectors."""
    found = {}
    for size in sorted(row["size"] for row in base.select("size").distinct().collect()):
        order = [F.xxhash64("row"), "row"]
        sample = base.filter(F.col("size") == size).orderBy(*order).limit(SAMPLE).select("vec")
        found[size] = learn(np.array([row["vec"] for row in sample.collect()]), k)
    return found


def nearest_neighbours(embeddings: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `is_query`."""
    base = usable(embeddings, zero_counts=False)
    queries = base.filter((F.col("vec_id") != NO_ID) & is_query)
    codings = codings_of(base, k)

    def hits(asked: DataFrame, used: dict[int, Codes]) -> DataFrame:
        return search_blocks(base, asked, searcher(used, k), "double", BLOCK_ROWS, QUERY_ROWS)

    found = kept(nearest(hits(queries, codings), k), "ann-found")
    enough = found.groupBy("query_row").count().filter(F.col("count") >= k)
    short = kept(
        queries.join(enough, F.col("row") == F.col("query_row"), "left_anti"), "ann-short"
    )
    if short.isEmpty():
        return shown(found)
    wide = {size: Codes(c.centre, c.turn, c.bits) for size, c in codings.items()}
    again = nearest(hits(short, wide), k)
    return shown(found.join(enough, "query_row", "left_semi").unionByName(again))
