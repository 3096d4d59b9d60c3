"""The trie of conversation prefixes, by range minima over sorted common prefixes.

Conversations are sequences of turns, a turn being a digest of its role and text. Distinct sequences
are sorted; between neighbours stands the number of turns they share. A prefix belongs to the
stretch of the sorted sequences in which that number never falls below its depth, and each prefix
finds the left and the right end of its stretch by its own binary search in a sparse table of range
minima. Everything a node tells is then a difference of running sums over its stretch.

Sorted sequences are cut into blocks of about `BLOCK` by range, which no common first turn or
conversation can unbalance, since copies are one row with a count. A prefix that goes on beyond its
block gives one partial result per block (so at most blocks x turns of one sequence in all), and
these are added up by the prefix's digest.

The turns' digests of one conversation form one row: 16 bytes a turn. The ids of the conversations
that end at a node are hashed as they stream by in order, so a conversation repeated very often
never forms one list; SHA-256 itself must be taken in sequence, over lists of up to `CELL` ids that
are joined beforehand.

Rows without a conversation id take no part. Null roles and texts count as empty. Turns are ordered
by number, null first, and ties by digest; equal rows stay rows. A conversation without turns is a
member of the root alone. Empty tables have no nodes. Texts of any length are read whole. Only the
four named columns are read, so further columns and their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.llm.common import kept, shuffle_partitions
from shelfindex.llm.range_minimum import RangeMinimum

KEY = 16  # bytes of a turn's digest
BLOCK = 50_000  # distinct sequences
CELL = 4_096  # width of an id range whose ids are joined at once
WORDS = r"[^\x20\x09-\x0D]+"
CLASSES = "path binary, words array<long>, n_convs long, conv_id long, ends_sha256 string"
PIECES = "block int, depth int, prefix binary, n_convs long, conv_id long, n_children long, "
PIECES += "n_leaves long, saved_tokens long"
NODES = """
    conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,
    saved_tokens long, ends_sha256 string
"""
SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NOTHING = hashlib.sha256().hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """A turn's digest in hexadecimal digits; the length keeps role and text apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(whole, 256), 1, 2 * KEY)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as a digest and its number of words; kept."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            "turn",
            turn_key(role, text).alias("key"),
            F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
        ).alias("turn"),
    )
    found = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    slim = F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return kept(found.select("conv_id", slim.alias("turns")), "sequences")


def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sequence from its cells of ids, which come in order."""
    columns = ["path", "words", "n_convs", "conv_id", "ends_sha256"]
    current, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for row in batch.itertuples(index=False):
            if current is not None and current[0] == row.path:
                digest.update(b",")
                current[2] += row.n_convs
            else:
                if current is not None:
                    done.append([*current, digest.hexdigest()])
                current = [row.path, row.words, row.n_convs, row.conv_id]
                digest = hashlib.sha256()
            digest.update(row.ids.encode())
        if done:
            yield pd.DataFrame(done, columns=columns)
    if current is not None:
        yield pd.DataFrame([[*current, digest.hexdigest()]], columns=columns)


def classes(found: DataFrame) -> DataFrame:
    """Distinct sequences with the number, least id and digest of their conversations."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    cells = (
        found.select("conv_id", path.alias("path"), F.col("turns.words").alias("words"))
        .groupBy("path", F.expr(f"conv_id div {CELL}").alias("cell"))
        .agg(
            F.first("words").alias("words"),
            F.count("*").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"),
        )
    )
    return (
        cells.repartition("path").sortWithinPartitions("path", "cell").mapInPandas(fold, CLASSES)
    )


def common(one: bytes, other: bytes) -> int:
    """Turns that two sequences begin with alike."""
    low, high = 0, min(len(one), len(other)) // KEY
    if one[:KEY] != other[:KEY]:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if one[low * KEY : middle * KEY] == other[low * KEY : middle * KEY]:
            low = middle
        else:
            high = middle - 1
    return low


class Block:
    """A block of sorted sequences between the sequence before and the one after it."""

    def __init__(self, rows: pd.DataFrame, before: bytes | None, after: bytes | None):
        rows = rows.sort_values("path", ignore_index=True)
        self.rows, self.paths = rows, rows["path"].tolist()
        last = len(self.paths) - 1
        self.lengths = np.array([len(path) // KEY for path in self.paths], dtype=np.int64)
        self.before = -1 if before is None else common(before, self.paths[0])
        self.after = -1 if after is None else common(self.paths[last], after)
        inner = [common(a, b) for a, b in zip(self.paths, self.paths[1:], strict=False)]
        self.shared = np.array([self.before, *inner], dtype=np.int64)
        self.table = RangeMinimum(self.shared)
        self.ids = RangeMinimum(rows["conv_id"].to_numpy(np.int64))

        # words[starts[i] + d] are the words of the first d turns of sequence i.
        counts = [np.asarray(w, dtype=np.int64) for w in rows["words"]]
        sums = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        self.words = np.concatenate(sums)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths + 1)[:-1]))
        copies = rows["n_convs"].to_numpy(np.int64)
        repeated = self.upto(np.arange(last + 1), self.shared)
        repeated += (copies - 1) * self.upto(np.arange(last + 1), self.lengths)
        leaf = np.append(self.shared[1:], self.after) < self.lengths
        self.copies, self.repeated, self.leaves = (
            np.concatenate(([0], np.cumsum(v))) for v in (copies, repeated, leaf.astype(np.int64))
        )
        # Places where a sequence leaves its predecessor for a turn of its own, by depth.
        self.size = last + 1
        branch = np.flatnonzero(self.lengths > self.shared)
        self.branches = np.sort(self.shared[branch] * self.size + branch)

    def upto(self, places: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Words of the first `depths` turns of the sequences at `places`."""
        return self.words[self.starts[places] + np.maximum(depths, 0)]

    def nodes(self, places: np.ndarray, depths: np.ndarray) -> pd.DataFrame:
        """What this block tells about the prefixes of `depths` turns of the sequences at `places`."""
        left = self.table.reach_left(places, depths)
        right = self.table.reach_right(places, depths)
        starts_here = self.shared[left] < depths
        n = self.copies[right + 1] - self.copies[left]
        known = self.upto(left, depths - 1)
        saved = self.repeated[right + 1] - self.repeated[left] - n * known
        saved += np.where(starts_here, known - self.upto(left, self.shared[left]), 0)
        base = depths * self.size
        inner = np.searchsorted(self.branches, base + right, "right") - np.searchsorted(
            self.branches, base + left, "left"
        )
        return pd.DataFrame(
            {
                "left": left,
                "right": right,
                "depth": depths,
                "n_convs": n,
                "conv_id": self.ids.least(left, right),
                "n_children": inner + (starts_here & (self.lengths[left] > depths)),
                "n_leaves": self.leaves[right + 1] - self.leaves[left],
                "saved_tokens": saved,
                "open": ((right == self.size - 1) & (depths <= self.after)) | ~starts_here,
            }
        )

    def prefix(self, place: int, depth: int) -> bytes:
        return hashlib.sha256(self.paths[place][: depth * KEY]).digest()

    def open_pieces(self) -> pd.DataFrame:
        """Partial results of the prefixes that go on beyond this block."""
        ahead, behind = np.arange(self.after + 1), np.arange(self.before + 1)
        found = self.nodes(
            np.concatenate((np.zeros_like(behind), np.full_like(ahead, self.size - 1))),
            np.concatenate((behind, ahead)),
        ).drop_duplicates(["left", "depth"])
        pairs = zip(found["left"], found["depth"], strict=True)
        return found.assign(prefix=[self.prefix(place, depth) for place, depth in pairs])

    def own_nodes(self, merged: dict[tuple[int, bytes], dict]) -> pd.DataFrame:
        """The nodes that begin in this block, whole: `merged` has those that go on beyond it."""
        fresh = self.lengths - self.shared
        places = np.repeat(np.arange(self.size), fresh)
        steps = np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh)
        depths = self.shared[places] + 1 + steps
        found = self.whole(self.nodes(places, depths), merged)
        above = self.whole(self.nodes(places, np.maximum(depths - 1, 0)), merged)
        parents = above["conv_id"].astype("Int64").mask(depths == 0)
        ends = self.rows["ends_sha256"].to_numpy()[places]
        return found.assign(
            parent_conv_id=parents,
            ends_sha256=np.where(self.lengths[places] == depths, ends, NOTHING),
        )

    def whole(self, found: pd.DataFrame, merged: dict[tuple[int, bytes], dict]) -> pd.DataFrame:
        """`found` with the results that are open taken from `merged`."""
        opened = np.flatnonzero(found["open"].to_numpy())
        pairs = found[["left", "depth"]].to_numpy(np.int64)[opened]
        distinct, codes = np.unique(pairs, axis=0, return_inverse=True)
        known = [merged[depth, self.prefix(left, depth)] for left, depth in distinct.tolist()]
        for name in (*SUMS, "conv_id"):
            values = found[name].to_numpy().copy()
            values[opened] = np.array([row[name] for row in known], dtype=np.int64)[codes]
            found[name] = values
        return found


def block_of(rows: pd.DataFrame, edge: pd.DataFrame) -> Block:
    before, after = edge["before"].iat[0], edge["after"].iat[0]
    return Block(rows, before, after)


def pieces_of(key: tuple, rows: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
    names = [column.split()[0] for column in PIECES.split(", ")]
    return block_of(rows, edge).open_pieces().assign(block=key[0])[names]


def nodes_of(key: tuple, rows: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
    merged = {(row["depth"], bytes(row["prefix"])): row for row in edge["merged"].iat[0]}
    names = [column.split()[0] for column in NODES.split(",")]
    return block_of(rows, edge).own_nodes(merged)[names]


def trie(found: DataFrame) -> DataFrame:
    """One row per node of the trie of `found`, sequences as `sequences` gives them.

    conv_id is the smallest member, ends_sha256 the digest of the ids that end at the node, and
    saved_tokens what sharing saves in its subtree: the words of each node's last turn once for
    every member beyond the first.
    """
    spark = found.sparkSession
    blocks = max(shuffle_partitions(spark), -(-found.count() // BLOCK))
    rows = kept(
        classes(found)
        .repartitionByRange(blocks, "path")
        .sortWithinPartitions("path")
        .withColumn("block", F.spark_partition_id()),
        "trie-blocks",
    )
    # One row per block: what stands before and after it.
    in_order = W.orderBy("block")
    edges = kept(
        rows.groupBy("block")
        .agg(F.min("path").alias("first"), F.max("path").alias("last"))
        .select(
            "block",
            F.lag("last").over(in_order).alias("before"),
            F.lead("first").over(in_order).alias("after"),
        ),
        "trie-edges",
    )
    by_block = rows.groupBy("block")
    pieces = kept(
        by_block.cogroup(edges.groupBy("block")).applyInPandas(pieces_of, PIECES), "trie-pieces"
    )
    merged = pieces.groupBy("depth", "prefix").agg(
        *[F.sum(name).alias(name) for name in SUMS], F.min("conv_id").alias("conv_id")
    )
    wanted = (
        pieces.select("block", "depth", "prefix")
        .join(merged, ["depth", "prefix"])
        .groupBy("block")
        .agg(F.collect_list(F.struct(*merged.columns)).alias("merged"))
    )
    told = edges.join(wanted, "block", "left").select(
        "block", "before", "after",
        F.coalesce("merged", F.array().cast(wanted.schema["merged"].dataType)).alias("merged"),
    )
    return by_block.cogroup(told.groupBy("block")).applyInPandas(nodes_of, NODES)
