"""N-gram Jaccard join: all pairs of texts that share most of their word n-grams.

1. Words are runs of letters and digits in lower case. A text's n-grams of `WORDS` words form its
   set; a text with fewer words has one n-gram, all its words. Texts without a word match nothing.
2. Texts of equal sets form a class, represented by the smallest doc_id. Only representatives go
   on, so copies cost nothing further.
3. MinHash banding: rows and bands are chosen for the target recall at the threshold (`banding`).
   Band hashes are shuffled; every member of a bucket is tied to the bucket's smallest member.
   The ties' connected components hold every candidate pair.
4. Within a component all pairs are verified on full n-gram sets, not only those that met in a
   band, so recall is above the target. Components are cut into blocks of about `BLOCK`
   representatives and each pair of blocks is verified in one task. A task gives the number of
   links of each member and a spanning forest of the links, never the list of pairs, so a group
   of near copies costs rows in proportion to its members.
5. Connected components of the forests are the groups.

`joined` gives one row per document: doc_id, class_id (smallest doc_id of an equal set), links
(how many other classes are within the threshold), group_id (smallest doc_id reachable by links)
and keep (whether it is its group's first document).

Null and empty texts are classes of their own with no links. Texts of any length are read whole.
Repeated rows are copies. An id with several texts is as many documents: a row is known by its id and
its text, a class by its set, so each text has links and a group of its own; where ids tie, the lower
set or text digest comes first. Rows without an id get a negative one of their own from the hash of
their text. Only doc_id and text are read, so further columns and their names do not matter. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept
from shelfindex.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK = 512
CHUNK = 1 << 12  # n-grams hashed at a time
CELLS = 1 << 21  # entries of a dense block
WORD_BREAK = r"[^\p{L}\p{N}]+"

SETS = "doc_id long, text_key string, set_key binary, bands array<long>"
FOUND = "doc_id long, links long, other long"


def banding(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance meetings) that reach `recall`."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches the recall with so few hashes")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a sequence of word hashes, as sorted 64-bit hashes."""
    words = words.view(np.uint64)
    width = min(n, len(words))
    if not width:
        return words
    whole = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        whole = mixed(whole + words[k : len(words) - width + 1 + k])
    return np.unique(whole)


class MinHash:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        size = (2, bands * rows)
        draw = np.random.default_rng(seed).integers(1, 2**63, size=size, dtype=np.uint64)
        self.times, self.plus = draw[0][:, None] | np.uint64(1), draw[1][:, None]
        self.bands, self.rows = bands, rows

    def least(self, found: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(found), CHUNK):
            part = (found[None, at : at + CHUNK] ^ self.plus) * self.times
            part ^= part >> np.uint64(32)
            part *= self.times
            part = part.min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return least

    def band_hashes(self, found: np.ndarray) -> np.ndarray:
        least = self.least(found).reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in range(self.rows):
            out = mixed(out + least[:, row])
        return out.view(np.int64)


def word_hashes(documents: DataFrame) -> DataFrame:
    """The hashes of the words of each text, in order, in place of the text."""
    words = F.filter(F.split(F.lower("text"), WORD_BREAK), lambda w: w != "")
    others = [c for c in documents.columns if c != "text"]
    return documents.select(*others, F.transform(words, lambda w: F.xxhash64(w)).alias("words"))


def sketcher(bands: int, rows: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        hashes = MinHash(bands, rows)
        for batch in batches:
            keys, found = [], []
            for words in batch["words"]:
                own = grams(np.asarray(words, dtype=np.int64)) if words is not None else ()
                keys.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                found.append(hashes.band_hashes(own) if len(own) else None)
            yield batch[["doc_id", "text_key"]].assign(set_key=keys, bands=found)

    return sketch


def links_of(sets: list[np.ndarray], first: int, threshold: float) -> np.ndarray:
    """Which sets are within the threshold of each other: rows before `first` against all if
    `first` is their number, else rows before `first` against the rows from there on."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[gram] > 1
    owner, gram = owner[shared], np.cumsum(often > 1)[gram[shared]] - 1
    width = int(gram.max()) + 1 if len(gram) else 0
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    left, right = slice(0, first), slice(0 if first == len(sets) else first, len(sets))
    common = np.zeros((sizes[left].size, sizes[right].size))
    step = max(1, CELLS // len(sets))
    for low in range(0, width, step):
        a, b = np.searchsorted(gram, [low, low + step])
        dense = np.zeros((len(sets), min(step, width - low)), dtype=np.float32)
        dense[owner[a:b], gram[a:b] - low] = 1
        common += dense[left] @ dense[right].T
    either = sizes[left][:, None] + sizes[right][None, :] - common
    linked = common >= threshold * either - 1e-9
    if first == len(sets):
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links connect: a search tree over the link matrix."""
    nodes = np.concatenate([left, right])
    n, out, edges = len(left), np.zeros(len(nodes), dtype=bool), []
    for start in range(len(nodes)):
        if out[start]:
            continue
        out[start] = True
        waiting = [start]
        while waiting:
            at = waiting.pop()
            near = np.flatnonzero(linked[at]) + n if at < n else np.flatnonzero(linked[:, at - n])
            near = near[~out[near]]
            out[near] = True
            edges += [(int(nodes[at]), int(nodes[x])) for x in near]
            waiting += near.tolist()
    return edges


def verifier(threshold: float):
    """A function for applyInPandas: links inside a bundle of components or a pair of blocks."""

    def verify(members: pd.DataFrame) -> pd.DataFrame:
        ids, links, edges = [], [], []
        for _, part in members.groupby("component", sort=False):
            part = part.sort_values(["block", "doc_id"])
            own, block = part["doc_id"].to_numpy(), part["block"].to_numpy()
            if len(own) < 2:
                continue
            sets = [grams(np.asarray(w, dtype=np.int64)) for w in part["words"]]
            within = part["low"].iloc[0] == part["high"].iloc[0]
            first = len(own) if within else int((block == part["low"].iloc[0]).sum())
            if not 0 < first < len(own) and not within:
                continue
            linked = links_of(sets, first, threshold)
            counts = linked.sum(axis=1)
            if not within:
                counts = np.concatenate([counts, linked.sum(axis=0)])
                pairs = forest(linked, own[:first], own[first:])
            else:
                pairs = forest(np.triu(linked), own, own)
            some = counts > 0
            ids += own[some].tolist()
            links += counts[some].tolist()
            edges += pairs
        count = len(ids)
        return pd.DataFrame(
            {
                "doc_id": pd.Series(ids + [a for a, _ in edges], dtype="Int64"),
                "links": pd.Series(links + [0] * len(edges), dtype="Int64"),
                "other": pd.Series([None] * count + [b for _, b in edges], dtype="Int64"),
            }
        )

    return verify


def candidates(sketches: DataFrame) -> DataFrame:
    """Representatives that met another in some band, with the component of their meetings."""
    spread = sketches.select("doc_id", F.explode("bands").alias("band"))
    buckets = (
        spread.groupBy(F.col("band").alias("bucket"))
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter(F.col("first") < F.col("last"))
        .select("bucket", "first")
    )
    ties = spread.join(buckets, F.col("band") == F.col("bucket")).select(
        F.col("doc_id").alias("a"), F.col("first").alias("b")
    )
    return components(ties)


def blocked(members: DataFrame) -> DataFrame:
    """Members by the pair of blocks they are verified in: bundle, low, high, block.

    A component of up to `BLOCK` members is one block and shares a bundle with others; a larger
    one is cut by the hash of the id and its members go to every pair that has their block.
    """
    sizes = members.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("size"))
    total = max(1, members.count() // BLOCK)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.join(sizes, F.col("component") == F.col("of")).select(
        "node",
        "component",
        blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", other).select(
        "node",
        "component",
        "block",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        F.when(F.col("blocks") > 1, F.col("component"))
        .otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(total)))
        .alias("bundle"),
    )


def own_id() -> Column:
    """doc_id; rows without one get an id from their text, below all others."""
    drawn = -F.lit(2**62) - F.abs(F.xxhash64(F.coalesce("text", F.lit(""))) % 2**61)
    return F.coalesce(F.col("doc_id").cast("long"), drawn)


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def numbered_classes(texts: DataFrame) -> DataFrame:
    """Distinct sets: of_key, first document (class_id, text_key), bands, and a number of their own.

    The number is the class_id; where several sets have one class_id, all but the first get a
    negative number from their digest.
    """
    document = F.struct("doc_id", "text_key")
    found = kept(
        texts.groupBy(F.col("set_key").alias("of_key"))
        .agg(F.min(document).alias("rep"), F.min_by("bands", document).alias("bands"))
        .select("of_key", F.col("rep.doc_id").alias("class_id"), "rep.text_key", "bands"),
        "classes",
    )
    first = found.groupBy(F.col("class_id").alias("of_id")).agg(F.min("of_key").alias("first_key"))
    drawn = -F.lit(2**61) - F.abs(F.xxhash64("of_key") % 2**60)
    return kept(
        found.join(first, F.col("class_id") == F.col("of_id")).select(
            *found.columns,
            F.when(F.col("of_key") == F.col("first_key"), F.col("class_id")).otherwise(drawn)
            .alias("number"),
        ),
        "numbered-classes",
    )


def described(documents: DataFrame, threshold: float, recall: float) -> DataFrame:
    """doc_id, text_key, class_id, links, group_id and keep of every document."""
    named = documents.select(own_id().alias("doc_id"), text_key().alias("text_key"), "text")
    sketches = kept(
        word_hashes(named).mapInPandas(sketcher(*banding(threshold, recall)), SETS), "sketches"
    )
    classes = numbered_classes(sketches.filter(F.col("set_key").isNotNull()))
    members = candidates(classes.select(F.col("number").alias("doc_id"), "bands"))
    shares = blocked(members)
    wanted = classes.join(members, F.col("number") == F.col("node"), "left_semi").select(
        "number", F.col("class_id").alias("doc_id"), "text_key"
    )
    words = word_hashes(named.join(wanted, ["doc_id", "text_key"]))
    one = words.groupBy("number").agg(F.first("words").alias("words"))  # equal texts of one id
    checked = (
        shares.join(one, F.col("node") == F.col("number"))
        .select(
            F.col("number").alias("doc_id"), "words", "component", "block", "low", "high", "bundle"
        )
        .groupBy("bundle", "low", "high")
        .applyInPandas(verifier(threshold), FOUND)
    )
    found = kept(checked, "links")
    links = found.groupBy(F.col("doc_id").alias("linked")).agg(F.sum("links").alias("links"))
    groups = components(
        found.filter(F.col("other").isNotNull()).select(
            F.col("doc_id").alias("a"), F.col("other").alias("b")
        )
    )
    tied = (
        classes.select("of_key", "class_id", "number")
        .join(links, F.col("number") == F.col("linked"), "left")
        .join(groups, F.col("number") == F.col("node"), "left")
        .select(
            "of_key",
            "class_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("links"),
            F.coalesce("component", "number").alias("group"),
        )
    )
    heads = tied.groupBy(F.col("group").alias("headed")).agg(
        F.min(F.struct("class_id", "of_key")).alias("head")
    )
    whole = tied.join(heads, F.col("group") == F.col("headed")).drop("headed")
    return (
        sketches.select("doc_id", "text_key", "set_key")
        .join(whole, F.col("set_key") == F.col("of_key"), "left")
        .select(
            "doc_id",
            "text_key",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("links", F.lit(0).cast("long")).alias("links"),
            F.coalesce("head.class_id", "doc_id").alias("group_id"),
            F.coalesce(
                (F.col("doc_id") == F.col("head.class_id")) & (F.col("set_key") == F.col("head.of_key")),
                F.lit(True),
            ).alias("keep"),
            F.col("head.of_key").alias("head_key"),
        )
    )


def joined(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, links, group_id and keep of every document."""
    return described(documents, threshold, recall).drop("text_key", "head_key")


def first_of_groups(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with its columns as they came.

    Texts without words are kept once per id and text.
    """
    found = described(documents, threshold, RECALL).filter("keep")
    grouped = found.filter(F.col("head_key").isNotNull()).groupBy("doc_id", "head_key").agg(
        F.min("text_key").alias("text_key")
    )
    wanted = (
        grouped.select("doc_id", "text_key")
        .unionByName(found.filter(F.col("head_key").isNull()).select("doc_id", "text_key"))
        .distinct()
        .select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    )
    rows = documents.select(
        F.struct(*[F.col(c) for c in documents.columns]).alias("row"),
        own_id().alias("own"),
        text_key().alias("own_key"),
    )
    same = (F.col("own") == F.col("kept_id")) & (F.col("own_key") == F.col("kept_key"))
    return (
        rows.join(wanted, same, "left_semi")
        .groupBy("own", "own_key")
        .agg(F.first("row").alias("row"))
        .select("row.*")
    )
