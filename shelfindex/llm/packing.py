"""Best-fit packing of documents into token sequences, improved by bin completion.

A document is its token ids and an end id. Documents longer than a sequence are cut into pieces
of a full sequence each; only the last piece is shorter. Pieces are never cut again.

How many pieces there are of each length decides the packing, and there are at most `capacity`
lengths, so the packing is planned on the counts alone and pieces take their places by rank:

1. Best fit, longest first, on counts: equal bins are moved together. This is the incumbent.
2. If it exceeds the lower bound, branch-and-bound by bin completion: the longest piece left is
   put in a bin, all undominated fillings around it are enumerated, each when its turn comes, and
   the bin is repeated as often as the counts allow. A branch is pruned when the space it has wasted exceeds what a packing
   with one bin less than the incumbent may waste. The search ends at the lower bound or after
   `EFFORT` steps, which limits effort only: the incumbent always packs everything.

A filling is undominated if no piece can be added and none can be swapped for a longer one.

Null and empty texts are the end id alone. Repeated documents are packed as often as they come.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept, numbered
from shelfindex.llm.word_ids import word_ids

CAPACITY = 4_096
END = 1
EFFORT = 100_000  # steps of all enumerations together
LENGTHS_PER_STEP = 256  # of the table of sums that an enumeration looks into
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long"

Bin = tuple[tuple[int, int], ...]  # (length, copies), longest first


# --- planning on counts ----------------------------------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total length, and by lengths that exclude each other."""
    number = np.zeros(capacity + 1, dtype=object)
    for length, count in counts.items():
        number[length] = count
    total = number * np.arange(capacity + 1)
    pieces, tokens = np.cumsum(number), np.cumsum(total)
    best = -(-int(tokens[-1]) // capacity)
    for small in range(1, capacity // 2 + 1):
        alone = int(pieces[-1] - pieces[capacity - small])  # share a bin with none of the rest
        half = int(pieces[capacity - small] - pieces[capacity // 2])
        rest = int(tokens[capacity - small] - tokens[small - 1])
        spare = half * capacity - int(tokens[capacity - small] - tokens[capacity // 2])
        small_ones = rest - int(tokens[capacity - small] - tokens[capacity // 2])
        best = max(best, alone + half + max(0, -(-(small_ones - spare) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Bins and how often each occurs, longest pieces first, each in the fullest bin it fits."""
    open_bins: dict[int, list[tuple[Bin, int]]] = {capacity: []}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length and r < capacity):
            waiting, open_bins[room] = open_bins[room], []
            for content, times in waiting:
                each = room // length
                full = min(times, left // each)
                parts = [(each, full)]
                left -= each * full
                if full < times and left:
                    parts.append((left, 1))
                    full, left = full + 1, 0
                parts.append((0, times - full))
                for copies, n in parts:
                    if n:
                        grown = (*content, (length, copies)) if copies else content
                        open_bins.setdefault(room - copies * length, []).append((grown, n))
            if not left:
                break
        each = capacity // length
        for copies, n in ((each, left // each), (left % each, 1)):
            if n and copies:
                open_bins.setdefault(capacity - copies * length, []).append(
                    (((length, copies),), n)
                )
    return [entry for entries in open_bins.values() for entry in entries]


@dataclass
class Effort:
    """What is left of `EFFORT`."""

    left: int = EFFORT


def sums_of(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Entry i has bit s set if pieces of the first i lengths can add up to s."""
    sums, within = [1], (2 << room) - 1
    for n in lengths:
        found, spare, part = sums[-1], min(counts[n], room // n), 1
        while spare:
            found |= (found << min(part, spare) * n) & within
            spare -= min(part, spare)
            part *= 2
        sums.append(found)
    return sums


def fillings(counts: dict[int, int], room: int, waste: int, effort: Effort) -> Iterator[Bin]:
    """All undominated fillings of `room` that leave at most `waste`, fullest first.

    Among equally full ones those with the most of the longest pieces come first. A step chooses
    a length and its copies, and only where the rest can be filled exactly. `counts` may change
    while the iterator waits if it is put back before the next one is asked for; an iterator that
    waits holds one filling.
    """
    target, chosen = room, None  # (place of the length, copies), longest first
    while target >= max(room - waste, 0) and effort.left > 0:
        lengths = sorted(n for n, c in counts.items() if c and n <= room)
        sums = sums_of(counts, lengths, room)
        effort.left -= 1 + len(lengths) // LENGTHS_PER_STEP
        found = None
        while found is None and effort.left > 0:
            effort.left -= 1
            chosen = following(counts, lengths, sums, target, chosen)
            if chosen is None:
                target -= 1
                while target >= 0 and not sums[-1] >> target & 1:
                    target -= 1
                if target < max(room - waste, 0):
                    return
                continue
            filling = {lengths[at]: copies for at, copies in chosen}
            if undominated(counts, lengths, filling, room - target):
                found = tuple(filling.items())
        lengths = sums = None  # many iterators wait at once
        if found is not None:
            yield found


def following(counts, lengths, sums, target, chosen):
    """The choice after `chosen` (None: the first) of pieces that add up to `target`, or None."""
    if chosen is None:
        if not sums[-1] >> target & 1:
            return None
        path, at, copies, left = [], len(lengths), 0, target
    else:
        path, left = list(chosen), 0
        while path:  # take back the last choice that has another after it
            at, copies = path.pop()
            left += copies * lengths[at]
            copies -= 1
            while copies >= 0 and not sums[at] >> (left - copies * lengths[at]) & 1:
                copies -= 1
            if copies >= 0:
                break
        else:
            return None
        if copies:
            path.append((at, copies))
            left -= copies * lengths[at]
    while left:  # the lengths before `at` can add up to `left`
        at = min(at, bisect_right(lengths, left)) - 1
        n = lengths[at]
        copies = min(counts[n], left // n)
        while copies and not sums[at] >> (left - copies * n) & 1:
            copies -= 1
        if copies:
            path.append((at, copies))
            left -= copies * n
    return path


def undominated(counts, lengths, chosen, left) -> bool:
    """No spare length fits the room left, and none that fits after a swap is longer."""
    for own in (0, *chosen):
        low, high = bisect_right(lengths, own), bisect_right(lengths, own + left)
        if any(chosen.get(n, 0) < counts[n] for n in lengths[low:high]):
            return False
    return True


@dataclass
class Branch:
    length: int
    options: Iterator[Bin]
    made: Bin | None = None
    times: int = 0


def complete(
    counts: dict[int, int], capacity: int, incumbent: list[tuple[Bin, int]], bound: int
) -> list[tuple[Bin, int]]:
    """The incumbent, or a packing in fewer bins if the search finds one."""
    best, most = incumbent, sum(n for _, n in incumbent)
    total = sum(n * c for n, c in counts.items())
    left, bins, wasted = dict(counts), 0, 0
    effort = Effort(EFFORT)

    def opened() -> Branch:
        longest = max(n for n, c in left.items() if c)
        allowed = (most - 1) * capacity - total - wasted
        return Branch(longest, fillings(left, capacity - longest, max(allowed, 0), effort))

    if most <= bound:
        return best
    path = [opened()]
    while path and effort.left > 0 and most > bound:
        branch = path[-1]
        if branch.made is not None:  # take the last choice back
            for n, c in branch.made:
                left[n] += c * branch.times
            bins -= branch.times
            wasted -= branch.times * (capacity - sum(n * c for n, c in branch.made))
            branch.made = None
        left[branch.length] -= 1
        filling = next(branch.options, None)
        left[branch.length] += 1
        if filling is None:
            path.pop()
            continue
        content = dict(filling)
        content[branch.length] = content.get(branch.length, 0) + 1
        made = tuple(sorted(content.items(), reverse=True))
        spare = capacity - sum(n * c for n, c in made)
        times = min(left[n] // c for n, c in made)
        if spare:
            times = min(times, max(1, ((most - 1) * capacity - total - wasted) // spare))
        branch.made, branch.times = made, times
        for n, c in made:
            left[n] -= c * times
        bins += times
        wasted += times * spare
        effort.left -= 1
        if wasted > (most - 1) * capacity - total:
            continue
        if any(left.values()):
            path.append(opened())
        elif bins < most:
            best, most = [(b.made, b.times) for b in path], bins
    return best


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Bins and how often each occurs, holding all pieces that `counts` counts."""
    return complete(
        counts, capacity, best_fit(counts, capacity), lower_bound(counts, capacity)
    ) if counts else []


# --- pieces ----------------------------------------------------------------------------------


def cutter(path: str, capacity: int):
    """A function for mapInPandas: the pieces of every document, without their ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = word_ids(path), np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            names = [part.split()[0] for part in PIECE.split(", ")]
            out = pd.DataFrame(rows, columns=names)
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return cut


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        cutter(path, capacity), PIECE
    )


def places(bins: list[tuple[Bin, int]]) -> pd.DataFrame:
    """Runs of ranks of one length: where the pieces of these ranks go."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in bins:
        offset = 0
        for length, copies in content:
            rank = taken.get(length, 0)
            rows.append((length, rank, copies, sequence, offset))
            taken[length] = rank + copies * times
            offset += copies * length
        sequence += times
    return pd.DataFrame(
        rows, columns=["length", "rank", "copies", "sequence_id", "offset"]
    ).sort_values(["length", "rank"], ignore_index=True)


def packed(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece and its place: columns of `PACKED`."""
    cut = kept(pieces(documents, path, capacity), "pieces")
    counted = cut.groupBy("length").count().collect()  # at most `capacity` rows
    runs = places(plan({row["length"]: row["count"] for row in counted}, capacity))
    table = {name: runs[name].to_numpy(dtype="int64") for name in runs.columns}

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = np.searchsorted(table["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            run = np.empty(len(batch), dtype="int64")
            for own in np.unique(length):
                rows, low, high = length == own, begin[own], begin[own + 1]
                run[rows] = (
                    low + np.searchsorted(table["rank"][low:high], rank[rows], side="right") - 1
                )
            nth, copies = rank - table["rank"][run], table["copies"][run]
            yield batch.assign(
                sequence_id=table["sequence_id"][run] + nth // copies,
                offset=table["offset"][run] + nth % copies * length,
                doc_id=batch["doc_id"].astype("Int64"),
            )

    ranked = numbered(cut, "length", ("doc_id", "piece", "ids_crc32"), "rank")
    return ranked.mapInPandas(put, PACKED)
