"""What several operators share: kept tables, numbering, hashing rules, bounded samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.session import scratch_path

# Cells that one group is numbered in, per shuffle partition.
CELLS_PER_PARTITION = 4


def kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet to the shared folder, and read from there."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id has remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % modulus


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of every group from 0 without gaps.

    A group may hold most rows, so it is cut into hashed cells: rows are numbered in their cell
    and moved up by the rows of the cells before, which are one count per cell.
    """
    cells = CELLS_PER_PARTITION * shuffle_partitions(df.sparkSession)
    celled = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    counts = celled.groupBy(group, "_cell").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(group).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("_group"),
        F.col("_cell").alias("_of_cell"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy(group, "_cell").orderBy(*order)) - 1
    ranked = celled.withColumn("_inside", inside)
    same = ranked[group].eqNullSafe(offsets["_group"]) & (ranked["_cell"] == offsets["_of_cell"])
    return ranked.join(offsets, same).select(
        *[ranked[c] for c in df.columns],
        (F.col("_before") + F.col("_inside")).cast("long").alias(name),
    )


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    modulus: int,
    held_out: int,
    limit: int,
) -> DataFrame:
    """text and label of at most `limit` labelled documents outside the held-out remainder.

    Documents are chosen by the hash of their id, so the choice is uniform and repeatable. The
    chosen ids are at most `limit` rows, which is what makes them fit for a broadcast. A document
    labelled more than once has its greatest label; rows without an id, label or text stay out.
    """
    chosen = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .filter(crc_remainder(F.col("doc_id"), modulus) != held_out)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(limit)
    )
    return (
        documents.filter(F.col("text").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", F.col("_label").alias("label"))
    )
