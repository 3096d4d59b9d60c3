"""Change-only history and latest prices, kept up to date from a stream of readings."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfindex.session import scratch_path
from shelfindex.streaming.sinks import Versions, run_available

PRODUCT = ["store_id", "product_key"]
LATEST = """
    store_id string, product_key string, id decimal(38,0), observed_at timestamp, price decimal(12,4)
"""
STEPS = f"{LATEST}, change string, previous_price decimal(12,4), delta decimal(12,4)"
LATE = f"{LATEST}, reason string"
# What Python gets and returns has no decimals and no times, only whole numbers: an id as two
# (see `halves`), a time in microseconds, a price in ten-thousandths. UNKNOWN stands for null.
NUMBERS = ["high", "low", "at", "price"]
FOUND = """
    kind int, store_id string, product_key string, high bigint, low bigint, at bigint,
    price bigint, previous bigint
"""
KNOWN = """
    store_id array<string>, product_key array<string>, high array<bigint>, low array<bigint>,
    price array<bigint>
"""
UNKNOWN = -(2**63)
STEP, NEWEST, OLD, REPEATED = range(4)  # kinds of FOUND
# Products share this many groups by hash. Python is called once per group, not once per product,
# and the state of a group is rewritten as one row: few groups make small batches dear.
SHELVES = 8192
COLUMNS = [*PRODUCT, "id", "observed_at", "price"]
# A key-value store on local disk with its log in the checkpoint: known products need no heap.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def halves(number: Column) -> tuple[Column, Column]:
    """A decimal(38,0) as two longs, floor(number / 2**64) and the rest - 2**63, in the same order."""
    base, half = F.lit(Decimal(2**64)), F.lit(Decimal(2**63))
    rest = number % base  # has the sign of the number
    high = F.call_function("div", number, base) - F.when(rest < 0, 1).otherwise(0)
    return high, (rest + F.when(rest < 0, half).otherwise(-half)).cast("bigint")


def whole(high: Column, low: Column) -> Column:
    """The decimal(38,0) whose `halves` these are; no step leaves the range of the result."""
    base, half = F.lit(Decimal(2**64)), F.lit(Decimal(2**63))
    above = (high + F.when(high < 0, 1).otherwise(0)).cast("decimal(19,0)") * base
    rest = low.cast("decimal(19,0)") + F.when(high < 0, -half).otherwise(half)
    return (above + rest).cast("decimal(38,0)")


def product_numbers(stores: np.ndarray, products: np.ndarray) -> np.ndarray:
    """The products numbered from 0 as they first appear; a null is a name like others."""
    store, _ = pd.factorize(stores, use_na_sentinel=False)
    name, names = pd.factorize(products, use_na_sentinel=False)
    return pd.factorize(store * len(names) + name)[0]


def group_changes(known: list, brought: list, steps: bool) -> tuple[list, list]:
    """Steps (if asked for), late and newest readings of a group's products, and what is known then.

    `known` holds one row per known product as columns: names, id in halves, price; `brought` the
    readings: names, id in halves, time, price. Found are columns as in FOUND. Known rows are put in
    order with the readings, by product and id, and before readings of the same id: so a reading
    before its product's known row is late, and one with the id of the row before it is repeated.
    """
    stores, products, high, low, price = (
        np.concatenate([old, new])
        for old, new in zip(known, [*brought[:4], brought[5]], strict=True)
    )
    told = len(known[0])
    at = np.concatenate([np.full(told, UNKNOWN), brought[4]])
    number = product_numbers(stores, products)
    order = np.lexsort((low, high, number))  # stable
    stores, products, high, low, at, price, number = (
        column[order] for column in (stores, products, high, low, at, price, number)
    )

    def as_before(*columns: np.ndarray) -> np.ndarray:
        same = np.zeros(len(columns[0]), dtype=bool)
        same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
        return same

    is_known = order < told
    place = np.full(len(order), -1)
    place[number[is_known]] = np.flatnonzero(is_known)
    old = np.arange(len(order)) < place[number]
    repeated = as_before(number, high, low) & ~old & ~is_known

    kept = np.flatnonzero(~old & ~repeated)  # known rows and the readings that are applied
    follows = as_before(number[kept])
    previous = np.full(len(order), UNKNOWN)
    previous[kept[follows]] = price[kept[np.flatnonzero(follows) - 1]]
    last = kept[np.append(~follows[1:], True)] if len(kept) else kept
    applied = kept[~is_known[kept]]
    before, now = previous[applied], price[applied]
    # A null price is no step down from a price; after it a price is new again, as in a batch.
    changed = (before == UNKNOWN) | ((now != before) & (now != UNKNOWN))

    rows = {
        STEP: applied[changed] if steps else applied[:0],
        NEWEST: last[~is_known[last]],
        OLD: np.flatnonzero(old),
        REPEATED: np.flatnonzero(repeated),
    }
    kind = np.repeat(list(rows), [len(at) for at in rows.values()])
    taken = np.concatenate(list(rows.values()))
    columns = (stores, products, high, low, at, price, previous)
    return [kind, *[c[taken] for c in columns]], [
        c[last] for c in (stores, products, high, low, price)
    ]


def advancer(steps: bool):
    """What a batch of readings changes among the products of one group, see `group_changes`."""
    names = [c.split()[0] for c in FOUND.split(",")]
    kinds = [object, object, np.int64, np.int64, np.int64]

    def advance(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else ([], [], [], [], [])
        known = [np.array(column, dtype=kind) for column, kind in zip(kept, kinds, strict=True)]
        parts = [[frame[c].to_numpy() for c in (*PRODUCT, *NUMBERS)] for frame in frames]
        brought = [np.concatenate(column) for column in zip(*parts, strict=True)]
        found, known = group_changes(known, brought, steps)
        state.update(tuple(column.tolist() for column in known))
        # Spark pads results of different lengths with nulls, which would make floats of int64.
        yield pd.DataFrame({
            name: column if column.dtype == object else pd.array(column, dtype="Int64")
            for name, column in zip(names, found, strict=True)
        })

    return advance


class PriceHistory:
    """Steps, late readings and latest prices under one folder, fed by micro-batches of readings.

    The newest id and price of every product are state that Spark keeps by group of products, so a
    batch costs the groups it touches, not the whole catalogue. Ids decide the order: a reading whose id is
    not above the newest known one of its product came late or twice; it changes nothing and is
    written to a table of its own, with the reason. So every reading delivered is either applied or
    found there. A batch that runs again starts from the same state and overwrites its own folders.

    The readings of one group of products in one batch are put in order in one task; the source's
    limits on a batch (files or bytes per trigger) bound them.
    """

    def __init__(self, spark: SparkSession, root: str, every: int = 20):
        self.spark = spark
        self.checkpoint = f"{root}/checkpoint"
        self.steps_path = f"{root}/steps"
        self.late_path = f"{root}/late"
        self.latest = Versions(spark, f"{root}/latest", LATEST, PRODUCT, "id", every)

    @classmethod
    def scratch(cls, spark: SparkSession, label: str, **options) -> PriceHistory:
        return cls(spark, scratch_path(spark, label), **options)

    def changes(self, readings: DataFrame, steps: bool = True) -> DataFrame:
        """What the readings of a stream change, by kind: step (if asked for), late or latest."""
        high, low = halves(F.col("id").cast("decimal(38,0)"))
        price = (F.col("price").cast("decimal(12,4)") * F.lit(10_000)).cast("bigint")
        at = F.unix_micros(F.col("observed_at").cast("timestamp"))
        shelf = F.pmod(F.xxhash64(*PRODUCT), F.lit(SHELVES))
        wanted = readings.filter(F.col("id").isNotNull()).select(
            shelf.alias("shelf"), *PRODUCT, high.alias("high"), low.alias("low"),
            F.coalesce(at, F.lit(UNKNOWN)).alias("at"),
            F.coalesce(price, F.lit(UNKNOWN)).alias("price"),
        )
        found = wanted.groupBy("shelf").applyInPandasWithState(
            advancer(steps), FOUND, KNOWN, "append", GroupStateTimeout.NoTimeout
        )
        kind, unknown = F.col("kind"), F.lit(UNKNOWN)

        def money(name: str) -> Column:
            cents = F.nullif(F.col(name), unknown).cast("decimal(12,0)")
            return (cents * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(12,4)")

        step = kind == STEP
        previous = F.when(step, money("previous"))
        return found.select(
            F.when(step, "step").when(kind == NEWEST, "latest").otherwise("late").alias("kind"),
            *PRODUCT,
            whole(F.col("high"), F.col("low")).alias("id"),
            F.timestamp_micros(F.nullif(F.col("at"), unknown)).alias("observed_at"),
            money("price").alias("price"),
            F.when(step & previous.isNull(), "new").when(step, "price").alias("change"),
            previous.alias("previous_price"),
            F.when(step, money("price") - money("previous")).cast("decimal(12,4)").alias("delta"),
            F.when(kind == OLD, "late").when(kind == REPEATED, "repeated").alias("reason"),
        )

    def record(self, changes: DataFrame, batch: int, steps: bool = True) -> None:
        """Write the changes of one batch into folders of its own."""

        def of(kind: str, *also: str) -> DataFrame:
            return changes.filter(F.col("kind") == kind).select(*COLUMNS, *also)

        changes = changes.persist()
        try:
            if steps:
                found = of("step", "change", "previous_price", "delta")
                found.write.mode("overwrite").parquet(f"{self.steps_path}/version={batch}")
            of("late", "reason").write.mode("overwrite").parquet(f"{self.late_path}/version={batch}")
            self.latest.apply(of("latest"), batch)
        finally:
            changes.unpersist()

    def run(self, readings: DataFrame, steps: bool = True) -> None:
        """Bring the history up to date with everything the stream holds."""
        unset = self.spark.conf.get(STATE_STORE, None) in (None, "") or "HDFSBacked" in (
            self.spark.conf.get(STATE_STORE)
        )
        if unset:
            self.spark.conf.set(STATE_STORE, ROCKS)
        run_available(
            self.changes(readings, steps),
            self.checkpoint,
            lambda changes, batch: self.record(changes, batch, steps),
        )

    def read_steps(self) -> DataFrame:
        return self.spark.read.schema(STEPS).parquet(self.steps_path)

    def read_late(self) -> DataFrame:
        """Readings that came too late or twice, each with its reason."""
        return self.spark.read.schema(LATE).parquet(self.late_path)
