"""Order-dependent operators that survive a key holding a large share of all rows.

A window partitioned by the key alone puts a key's whole history into one task. When the
order column is a unique integer id, cutting the ids into slices at counted values bounds
every (key, slice) group by the rows of a slice, however the ids are spread; only one summary
row per slice then crosses a slice boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

TARGET_SLICE_ROWS = 2_000_000
CELLS = 65_536  # by which rows per key are counted


def splitters(df: DataFrame, column: str, parts: int) -> list:
    """Values that cut the rows of `df` into about `parts` ranges of equal count, in order.

    They come from a mergeable sketch whose error is a tenth of a range, so sparse or clustered
    values give even ranges too. A value that fills several ranges stands there several times.
    """
    if parts < 2:
        return []
    shares = [n / parts for n in range(1, parts)]
    row = df.agg(F.percentile_approx(column, shares, 10 * parts).alias("at")).first()
    return sorted(row["at"] or [])


def range_number(column: Column, cuts: Sequence) -> Column:
    """How many of the sorted `cuts` are at most `column`: the number of the range it lies in."""
    if not cuts:
        return F.lit(0)
    kind = "decimal(38,0)" if isinstance(cuts[0], Decimal) else "bigint"
    listed = F.expr(f"cast(array({','.join(f"'{cut}'" for cut in cuts)}) as array<{kind}>)")
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    value = column.cast(kind)

    def further(at: Column, step: Column) -> Column:
        there = F.get(listed, at + step - 1)
        return F.when((at + step <= len(cuts)) & (there <= value), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def slice_cuts(df: DataFrame, order: str, rows: int, target: int = TARGET_SLICE_ROWS) -> list:
    """Ids that cut `rows` rows into slices of about `target` rows; none if one slice holds all."""
    return sorted(set(splitters(df, order, -(-rows // target))))


def cuts_if_needed(
    df: Callable[[], DataFrame], order: str, rows: int, target: int = TARGET_SLICE_ROWS
) -> Sequence | Callable[[], list]:
    """The `slice_cuts` of `df()`, found when somebody asks, once; none if one slice holds all rows.

    Only a crowded key is sliced, so a history without one is not read for its ids.
    """
    return cache(lambda: slice_cuts(df(), order, rows, target)) if rows > target else ()


def crowded(df: DataFrame, keys: Sequence[str], most: int) -> list[int]:
    """Numbers of the hashed cells of `keys` that hold more than `most` rows.

    A key outside these cells has at most `most` rows. Every task counts its cells before the
    shuffle, so only counts of `CELLS` cells cross it.
    """
    sized = df.groupBy(cell_of(keys).alias("cell")).agg(F.count("*").alias("rows"))
    return sorted(r["cell"] for r in sized.filter(F.col("rows") > most).collect())


def cell_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(CELLS))


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    ahead: bool = False,
    cuts: Sequence | Callable[[], Sequence] = (),
    most: int = TARGET_SLICE_ROWS,
) -> DataFrame:
    """Add, per key, the given columns of the previous (or next) row by `order`.

    `columns` maps new names to source columns. `cuts` are the ids at which slices begin, as
    `slice_cuts` finds them, or what finds them on request; without any, all rows are in one slice.
    Only keys that may have more than `most` rows are sliced; the others are put in order whole, by
    one shuffle.
    """
    if not cuts:
        return _whole_neighbour(df, keys, order, columns, ahead)
    cells = crowded(df, keys, most)
    if not cells:
        return _whole_neighbour(df, keys, order, columns, ahead)
    cuts = cuts() if callable(cuts) else cuts
    if not cuts:
        return _whole_neighbour(df, keys, order, columns, ahead)
    hot = cell_of(keys).isin(cells)
    return _whole_neighbour(df.filter(~hot), keys, order, columns, ahead).unionByName(
        _sliced_neighbour(df.filter(hot), keys, order, columns, ahead, cuts)
    )


def _whole_neighbour(df, keys, order, columns, ahead) -> DataFrame:
    step = F.lead if ahead else F.lag
    by_key = W.partitionBy(*keys).orderBy(order)
    return df.select(
        "*", *[step(source).over(by_key).alias(name) for name, source in columns.items()]
    )


def _sliced_neighbour(df, keys, order, columns, ahead, cuts) -> DataFrame:
    step = F.lead if ahead else F.lag
    neighbour = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
    sliced = df.withColumn("_slice", range_number(F.col(order), cuts))
    near = sliced.withColumn(
        "_near", step(neighbour).over(W.partitionBy(*keys, "_slice").orderBy(order))
    )
    edge = F.min_by if ahead else F.max_by
    carried = (
        sliced.groupBy(*keys, "_slice")
        .agg(edge(neighbour, F.col(order)).alias("_edge"))
        .select(
            *keys,
            "_slice",
            step("_edge").over(W.partitionBy(*keys).orderBy("_slice")).alias("_carried"),
        )
    )
    return (
        near.join(carried, [*keys, "_slice"], "left")
        .withColumn("_found", F.coalesce("_near", "_carried"))
        .select(*df.columns, *[F.col("_found")[name].alias(name) for name in columns])
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` per key, reduced in every task before the shuffle.

    Text joins the keys of a first reduction, whose other columns have a fixed width: so Spark
    reduces by hashing, and sorts only what is left, one row per key and combination of texts.
    """
    kept = [c for c in columns if c not in keys]
    newest = F.max_by(F.struct(*kept), F.col(order)).alias("_latest")
    texts = [c for c in kept if df.schema[c].dataType == T.StringType()]
    if texts and order not in texts:
        fixed = [c for c in dict.fromkeys([*kept, order]) if c not in texts]
        df = df.groupBy(*keys, *texts).agg(*[F.max_by(c, F.col(order)).alias(c) for c in fixed])
    return df.groupBy(*keys).agg(newest).select(*keys, "_latest.*")


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """At most `n` rows per key; each task sends at most `n` of a key to the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def islands(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Number contiguous runs of days per key; `day` is unique per key.

    Days in one run share `day - row_number`, so no running flag is needed.
    """
    position = F.row_number().over(W.partitionBy(*keys).orderBy(day))
    return df.withColumn("island", F.date_sub(F.col(day), position))
