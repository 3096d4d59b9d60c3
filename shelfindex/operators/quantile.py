"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    bucket: float = 1.0,
) -> DataFrame:
    """One row per key with an exact quantile column for each named probability, as double.

    Equal values are counted in every task before anything is shuffled by key.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return quantiles_of_counts(counts, keys, probabilities, bucket)


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    probabilities: Mapping[str, float],
    bucket: float = 1.0,
) -> DataFrame:
    """Exact quantiles of `value` occurring `n` times, and the number `total` per key.

    Counts are summed into value ranges of width `bucket`; only the ranges that hold a wanted
    rank are looked into. So no task sees a whole group: one sees the ranges of a key,
    another the distinct values of one range (10,000 for four decimals and width 1).
    """
    counts = counts.select(
        *keys,
        F.col("value").alias("_v"),
        F.col("n").alias("_n"),
        F.floor(F.col("value") / F.lit(bucket)).alias("_range"),
    )
    by_key = W.partitionBy(*keys)
    upto = by_key.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(by_key))
    )
    holds = (F.col("_t.rank") < F.col("_end")) & (F.col("_t.rank") >= F.col("_end") - F.col("_n"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(side).alias("side"),
                (F.floor(position) if side == "low" else F.ceil(position)).alias("rank"),
            )
            for name, p in probabilities.items()
            for position in [F.lit(p) * (F.col("_total") - 1)]
            for side in ("low", "high")
        ]
    )
    targets = (
        ranges.withColumn("_t", F.explode(wanted))
        .filter(holds)
        .groupBy(*keys, "_range", (F.col("_end") - F.col("_n")).alias("_start"), "_total")
        .agg(F.collect_list("_t").alias("_targets"))
    )
    inside = W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    placed = (
        counts.join(targets, [*keys, "_range"])
        .withColumn("_end", F.col("_start") + F.sum("_n").over(inside))
        .withColumn("_t", F.explode("_targets"))
        .filter(holds)
    )
    results = []
    number = F.col("_v").cast("double")
    for name, p in probabilities.items():
        low = F.max(F.when((F.col("_t.name") == name) & (F.col("_t.side") == "low"), number))
        high = F.max(F.when((F.col("_t.name") == name) & (F.col("_t.side") == "high"), number))
        position = F.lit(p) * (F.max("_total") - 1)
        results.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return placed.groupBy(*keys).agg(*results, F.max("_total").alias("total"))
