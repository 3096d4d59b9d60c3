"""Periodic runs of words: stretches that repeat with a period, found by longest common extensions.

A run is a stretch of at least `max(LEAST, TIMES * period)` words in which words `period` apart are
the same, `period` is the smallest such number, and no neighbouring word extends it. Every run holds
a Lyndon word of its period's length that is the longest one starting at its place, under the order
of words or under the reverse order. So the longest Lyndon words of both orders are the candidates:
one per place and order. Each is extended to the right by a suffix tree of the words and to the left
by one of the reversed words, where a common extension takes constant time.

Only stretches that can hold a run reach the trees: all words of a run occur at least four times
within it and all its triples of words at least three times, so a text is cut at words and triples
that are rarer. That drops no run, and it leaves ordinary prose out.

A text is worked on whole, in one task; trees are as large as the longest stretch that repeats
words, not as the text. Words are whatever stands between the characters space and \\x09 to \\x0D.
Null and empty texts have no words and no runs. Equal texts give equal results and repeated rows
stay rows; ties between overlapping runs need no rule, since all runs are returned, by start and
then period. Only the given columns are read, so further columns and their names do not matter, and
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.suffix_tree import SuffixTree

LEAST, TIMES = 6, 4  # words, and periods, that a run must hold
WORD = re.compile("[^\x20\x09-\x0d]+")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers from 1, by first occurrence."""
    seen: dict[str, int] = {}
    return np.array([seen.setdefault(word, len(seen) + 1) for word in words], dtype=np.int64)


def stretches(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where `mask` holds for at least `least` places in a row, as [start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def counts_here(values: np.ndarray) -> np.ndarray:
    """How often the value at each place occurs."""
    _, places, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[places]


def possible(numbers: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches [start, end) that hold every run, cut until nothing more can be cut."""
    waiting = [(0, len(numbers))]
    while waiting:
        start, end = waiting.pop()
        here = numbers[start:end]
        found = []
        for a, b in stretches(counts_here(here) >= 4, LEAST) if len(here) else []:
            part = here[a:b]
            size = int(part.max()) + 1
            _, pairs = np.unique(part[:-1] * size + part[1:], return_inverse=True)
            often = counts_here(pairs[:-1] * size + part[2:]) >= 3
            found += [(a + c, a + d + 2) for c, d in stretches(often, LEAST - 2)]
        for a, b in found:
            if b - a == len(here):
                yield start, end
            else:
                waiting.append((start + a, start + b))


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one of a smaller rank: where the longest Lyndon word ends."""
    found = [0] * len(ranks)
    open_places: list[int] = []
    for place, rank in enumerate(ranks):
        while open_places and ranks[open_places[-1]] > rank:
            found[open_places.pop()] = place
        open_places.append(place)
    return found


def runs_within(numbers: np.ndarray) -> set[tuple[int, int, int]]:
    """start, length and period of the runs of a list of numbers above 0."""
    size = len(numbers)
    tree = SuffixTree(numbers)
    places = np.tile(np.arange(size), 2)
    ends = np.array(
        next_smaller(tree.ranks())[:size] + next_smaller(tree.ranks(descending=True))[:size]
    )
    fits = TIMES * (ends - places) <= size
    left, right = np.divmod(np.unique(places[fits] * (size + 1) + ends[fits]), size + 1)
    ahead = tree.shared(left, right)
    del tree
    behind = np.zeros(len(left), dtype=np.int64)
    inner = left > 0
    mirror = SuffixTree(numbers[::-1])
    behind[inner] = mirror.shared(size - left[inner], size - right[inner])
    start, period = left - behind, right - left
    length = right + ahead - start
    long = (length >= LEAST) & (length >= TIMES * period)
    return set(zip(start[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True))


def runs(words: list[str]) -> list[tuple[int, int, int]]:
    """start, length and period of every run, by start and period."""
    numbers = numbered(words)
    found = set()
    for start, end in possible(numbers):
        _, part = np.unique(numbers[start:end], return_inverse=True)
        found |= {(start + at, n, q) for at, n, q in runs_within(part.astype(np.int64) + 1)}
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    """The words without those that any run holds after its first period, by single spaces."""
    if not found:
        return " ".join(words)
    stays = np.ones(len(words), dtype=bool)
    for start, length, period in found:
        stays[start + period : start + length] = False
    return " ".join([words[place] for place in np.flatnonzero(stays).tolist()])


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch.pop("text"):
            words = words_of(text)
            found = runs(words)
            listed = [{"start": s, "length": n, "period": q} for s, n, q in found]
            out.append((len(words), listed, collapsed(words, found)))
        yield batch.assign(
            n_words=[row[0] for row in out],
            runs=[row[1] for row in out],
            collapsed=[row[2] for row in out],
        )


def with_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and the text with its runs cut to one period, of every document."""
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInPandas(
        rows_of, f"doc_id long, n_words long, runs {RUNS}, collapsed string"
    )
