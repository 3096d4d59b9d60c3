"""Carry the last known value forward, by id, as spans of days.

Spans are half-open, `[from_day, to_day)`, and hold one value. Work on them grows with the steps of
a history; only what is shown by the day is expanded to days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

STRETCH = 1024  # days that one task sweeps at a time


def value_spans(
    df: DataFrame, keys: Sequence[str], day: str, order: str, value: str, until: Column
) -> DataFrame:
    """Half-open day spans `[from_day, to_day)` in which each value is the one in effect.

    The row with the greatest `order` among those dated on or before a day is in effect, so a
    row that is dated later but ordered earlier never shows. Rows are first reduced to one per
    key and day, which bounds the windows by the length of the calendar.
    """
    daily = df.groupBy(*keys, day).agg(
        F.max(order).alias("_order"), F.max_by(value, order).alias(value)
    )
    by_day = W.partitionBy(*keys).orderBy(day)
    newest = F.max("_order").over(by_day.rowsBetween(W.unboundedPreceding, W.currentRow))
    in_effect = daily.withColumn("_newest", newest).filter(F.col("_order") == F.col("_newest"))
    return in_effect.select(
        *keys,
        F.col(day).alias("from_day"),
        F.coalesce(F.lead(day).over(by_day), F.date_add(until, 1)).alias("to_day"),
        value,
    )


def daily_values(spans: DataFrame) -> DataFrame:
    """One row per day of each span."""
    days = F.sequence(F.col("from_day"), F.date_sub("to_day", 1))
    nonempty = spans.filter(F.col("from_day") < F.col("to_day"))
    return nonempty.withColumn("d", F.explode(days)).drop("from_day", "to_day")


def outside_gaps(
    spans: DataFrame, gaps: DataFrame, keys: Sequence[str], by: Sequence[str], value: str
) -> DataFrame:
    """The parts of `spans`, disjoint per `keys`, outside any gap `[from_at, to_at)` of the same `by`.

    A gap without an end is open. Days at which a value starts or a gap starts or ends are put in
    order per key, so nothing is joined by range; there are at most two rows per day and key.
    """
    absences = (
        spans.select(*keys)
        .distinct()
        .join(gaps.select(*by, F.to_date("from_at").alias("f"), F.to_date("to_at").alias("t")), [*by])
        .filter(F.col("t").isNull() | (F.col("t") > F.col("f")))
    )
    closing = absences.filter(F.col("t").isNotNull())
    none = F.lit(None).cast(spans.schema[value].dataType)

    def marks(df: DataFrame, day: str, depth: int, held=none, holds: bool | None = None):
        return df.select(
            *keys, F.col(day).alias("day"), F.lit(depth).alias("depth"), held.alias("held"),
            F.lit(holds).cast("boolean").alias("holds"),
        )

    changes = (
        marks(spans, "from_day", 0, F.col(value), True)
        .unionByName(marks(spans, "to_day", 0, holds=False))
        .unionByName(marks(absences, "f", 1))
        .unionByName(marks(closing, "t", -1))
        .groupBy(*keys, "day")
        .agg(
            F.sum("depth").alias("depth"),
            F.max("held").alias("held"),
            F.max("holds").alias("holds"),  # a value that starts where another ends goes on
        )
    )
    in_order = W.partitionBy(*keys).orderBy("day")
    upto = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    state = changes.select(
        *keys,
        F.col("day").alias("from_day"),
        F.lead("day").over(in_order).alias("to_day"),
        F.sum("depth").over(upto).alias("depth"),
        F.last("held", ignorenulls=True).over(upto).alias(value),
        F.last("holds", ignorenulls=True).over(upto).alias("holds"),
    )
    inside = (F.col("depth") == 0) & F.col("holds") & F.col("to_day").isNotNull()
    return state.filter(inside).select(*keys, "from_day", "to_day", value)


def lowest(
    spans: DataFrame, keys: Sequence[str], value: str, stretch: int = STRETCH
) -> DataFrame:
    """The lowest value in effect among the spans of each of `keys`, as spans where it holds.

    A task sweeps the spans of one key and one stretch of days at a time; spans that cross stretches are cut. So a group has at most that many days of each of its members.
    """
    schema = spans.select(*keys, "from_day", "to_day", value).schema
    scale = schema[value].dataType.scale
    unscaled = (F.col(value) * F.lit(10**scale)).cast("decimal(38,0)").cast("bigint")
    first, last = F.unix_date("from_day"), F.unix_date("to_day") - 1
    pieces = (
        spans.filter(F.col("from_day") < F.col("to_day"))
        .select(*keys, first.alias("first"), last.alias("last"), unscaled.alias("value"))
        .withColumn("stretch", F.explode(F.sequence(
            F.floor(F.col("first") / stretch), F.floor(F.col("last") / stretch))))
        .withColumn("first", F.greatest("first", F.col("stretch") * stretch))
        .withColumn("last", F.least("last", F.col("stretch") * stretch + stretch - 1))
    )
    named = ", ".join(f"{k} {schema[k].dataType.simpleString()}" for k in keys)
    swept = pieces.groupBy(*keys, "stretch").applyInPandas(
        sweeper(stretch), f"{named}, first long, end long, value long"
    )
    number = F.col("value").cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")
    return swept.select(
        *keys,
        F.date_from_unix_date(F.col("first").cast("int")).alias("from_day"),
        F.date_from_unix_date(F.col("end").cast("int")).alias("to_day"),
        number.cast(schema[value].dataType).alias(value),
    )


def sweeper(stretch: int):
    """Runs of days with one lowest value, of the spans of a key within a stretch of days."""

    def sweep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        start = int(key[-1]) * stretch
        nothing = np.iinfo(np.int64).max
        low = np.full(stretch + 2, nothing)
        days = low[1:-1]
        rows = rows.sort_values("value", ascending=False)
        firsts, lasts = rows["first"] - start, rows["last"] - start
        for first, last, value in zip(firsts, lasts, rows["value"], strict=True):
            days[first : last + 1] = value
        edges = np.flatnonzero(np.diff(low))
        runs = pd.DataFrame(
            {"first": edges[:-1] + start, "end": edges[1:] + start, "value": days[edges[:-1]]}
        )
        runs = runs[runs["value"] != nothing]
        for at, name in enumerate(rows.columns[: len(key) - 1]):
            runs.insert(at, name, key[at])
        return runs

    return sweep


def running(spans: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Spans over which sums of what holds stay the same: each column's total, and `count`.

    What a span adds where it starts is taken off where it ends, so the rows are as many as the
    starts and ends, and the sums run over days at which something changes.
    """
    def change(day: str, sign: int) -> DataFrame:
        parts = [(F.lit(sign) * column).cast("decimal(38,12)").alias(n) for n, column in sums.items()]
        return spans.select(*keys, F.col(day).alias("from_day"), F.lit(sign).alias("count"), *parts)

    names = ["count", *sums]
    changes = (
        change("from_day", 1).unionByName(change("to_day", -1))
        .groupBy(*keys, "from_day")
        .agg(*[F.sum(n).alias(n) for n in names])
    )
    in_order = W.partitionBy(*keys).orderBy("from_day")
    upto = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    return changes.select(
        *keys,
        "from_day",
        F.lead("from_day").over(in_order).alias("to_day"),
        *[F.sum(n).over(upto).cast(changes.schema[n].dataType).alias(n) for n in names],
    ).filter(F.col("to_day").isNotNull())
