"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows of equal text form a group and go to one shard. Each group is a vector of its share of all
bytes, tokens (words) and rows; each shard has the same capacity in all three. Groups are placed
largest first, each in the shard where the dot product with the residual capacity is highest
among those it fits, or among all if it fits none; bytes, which the law is about, weigh most.

The greedy order is sequential, so the number of vectors it sees is bounded whatever the table:
a group above 1/`FINE` of the corpus in some measure is placed by itself (there are at most
3 x `FINE` such groups), and the others are hashed into `FINE` bundles that are placed whole.
A group above `LARGEST` of a shard's capacity is split into parts below that: kept whole it
would decide the balance alone, and a group with a third of all rows fits no shard.

The law is `bytes`: sizes come out nearly equal; tokens and rows are balanced beside them.
A null text has size 1 and the crc of the empty text, and is grouped with empty texts. Repeated
ids and rows are placed like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.llm.common import kept, numbered

FINE = 4_096
LARGEST = 0.25
LAW = "bytes"
MEASURES = ("size", "tokens", "one")
WEIGHTS = np.array([16.0, 1.0, 1.0])  # in the dot product; the law's measure counts for most


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens and a digest of the text, without the text."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"),
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector of shares, placed from the largest down."""
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    shard = np.zeros(len(vectors), dtype=int)
    for row in np.argsort(-vectors.max(axis=1), kind="stable"):
        item = vectors[row]
        fits = (residual >= item).all(axis=1)
        gain = residual @ (WEIGHTS * item)
        choice = int(np.argmax(np.where(fits, gain, -np.inf) if fits.any() else gain))
        shard[row] = choice
        residual[choice] -= item
    return shard


def assigned(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = documents.sparkSession
    counted = measured(documents).withColumn("one", F.lit(1).cast("long"))
    rows = kept(counted.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    totals = rows.agg(*[F.sum(m).cast("double").alias(m) for m in MEASURES]).first()
    if not totals["one"]:
        return rows.select(
            "doc_id", "size", "text_crc32",
            F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"),
        )
    share = F.greatest(*[F.col(f"all_{m}") / max(totals[m], 1.0) for m in MEASURES])
    large = (
        rows.groupBy(F.col("digest").alias("group"))
        .agg(*[F.sum(m).alias(f"all_{m}") for m in MEASURES])
        .withColumn("share", share)
        .filter(F.col("share") > 1.0 / FINE)
        .select("group", F.ceil(F.col("share") * shards / LARGEST).cast("long").alias("parts"))
    )
    # At most 3 x FINE rows: shares of a measure sum to one.
    large = spark.createDataFrame(large.collect(), "group binary, parts long")
    grouped = rows.join(F.broadcast(large), F.col("digest") == F.col("group"), "left")
    # Rows of equal id and text are alike but for their rank, which spreads them over the parts.
    alike = grouped.filter(F.col("parts").isNotNull()).withColumn(
        "alike", F.xxhash64("digest", "doc_id")
    )
    ranked = grouped.filter(F.col("parts").isNull()).withColumn(
        "rank", F.lit(0).cast("long")
    ).unionByName(numbered(alike, "alike", ("row",), "rank").drop("alike"))
    start = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts"))
    part = (start + F.col("rank")) % F.col("parts")
    bundle = F.pmod(F.xxhash64("digest"), F.lit(FINE))
    itemed = ranked.withColumn(
        "item",
        F.when(F.col("parts").isNull(), F.concat(F.lit("bundle "), bundle)).otherwise(
            F.concat(F.lower(F.hex("digest")), F.lit(" "), part)
        ),
    )
    items = (
        itemed.groupBy("item").agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy("item").collect()
    )
    vectors = np.array([[item[m] / max(totals[m], 1.0) for m in MEASURES] for item in items])
    plan = spark.createDataFrame(
        [(item["item"], int(s)) for item, s in zip(items, place(vectors, shards), strict=True)],
        "item string, shard int",
    )
    dealt = itemed.join(F.broadcast(plan), "item").select(
        "doc_id", "size", "text_crc32", "shard", "rank"
    )
    return numbered(dealt, "shard", ("doc_id", "text_crc32", "rank"), "slot").drop("rank")


def sharded(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Every row's shard and slot, with the law that the placement keeps."""
    return assigned(documents, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def most_items(shards: int) -> int:
    """The most vectors that the greedy placement can be given."""
    return FINE + len(MEASURES) * (FINE + math.ceil(shards / LARGEST))
