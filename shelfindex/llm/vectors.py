"""Vector tables cut into blocks: a stated set of queries against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.llm.common import kept

HIT = "query_row long, query_id long, vec_id long, score {score}"
NO_ID = 2**63 - 1  # stands for a missing id while searching, so that it comes last among ties


def usable(embeddings: DataFrame, zero_counts: bool) -> DataFrame:
    """row, vec_id, size and vec (array of double) of the vectors that take part; kept.

    Vectors that are null, empty, or hold null or non-finite components take none, nor do zero
    vectors unless `zero_counts`. `row` numbers the rows, for ids may repeat or be missing.
    """
    finite = F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    rows = embeddings.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    ).filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    if not zero_counts:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return kept(
        rows.select(
            F.monotonically_increasing_id().alias("row"), "vec_id", F.size("vec").alias("size"), "vec"
        ),
        "vectors",
    )


def stacked(vectors) -> np.ndarray:
    """The vectors of a pandas column as the rows of one matrix."""
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def search_blocks(
    base: DataFrame,
    queries: DataFrame,
    search: Callable,
    score: str,
    block_rows: int,
    query_rows: int,
) -> DataFrame:
    """Run `search(base block, query block)` on every pair of blocks of vectors of one size.

    Blocks are dealt by the hash of the row, so each holds about `block_rows` rows (`query_rows`
    queries) whatever the data are; a task holds one pair of blocks at a time.
    """
    blocks = max(1, -(-base.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // query_rows))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        )

    left = dealt(base, "block", blocks, "query_block", query_blocks)
    right = dealt(queries, "query_block", query_blocks, "block", blocks)
    keys = ["size", "block", "query_block"]
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(search, HIT.format(score=score))
    )


def nearest(hits: DataFrame, k: int) -> DataFrame:
    """The k highest scores of every query row, ties to the smaller id, ranked from 1."""
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(
        "query_row", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def shown(found: DataFrame) -> DataFrame:
    """The result's columns, missing ids as null again."""
    return found.select(
        "query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"
    )
