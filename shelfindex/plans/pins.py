"""Pins: which product stands for a basket item at a store, with price, median and verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.functions.prices import basis_of
from shelfindex.functions.verdicts import COMPARABLE_PINS, with_verdicts
from shelfindex.operators.ordered import latest_by
from shelfindex.operators.restrict import only_keys
from shelfindex.sources.tables import Tables

# Usable pin states, and the pulls a pin may be missing from.
USABLE_STATUS = ("verified", "curated")
STALE_AFTER = 2

PRODUCT = ["store_id", "product_key"]
LATEST_COLUMNS = [
    "price", "currency", "unit_price", "unit_price_basis", "previous_price", "delta",
]


def latest_price(tables: Tables, among: DataFrame | None = None) -> DataFrame:
    """The newest observation of every product by id, optionally only of the given products.

    The restriction is a semi-join, so it reaches the scan before anything is grouped.
    """
    observations = tables.price_observations
    if among is not None:
        observations = observations.join(among.select(*PRODUCT), PRODUCT, "left_semi")
    return latest_by(
        observations, PRODUCT, "id", ["id", "observed_at", "change", *LATEST_COLUMNS]
    )


def pinned_products(tables: Tables, tiers: Sequence[str] = ("core",)) -> DataFrame:
    """The products that stand for an item of the given tiers at a store, whatever their status; kept."""

    def build() -> DataFrame:
        items = tables.items.filter(F.col("tier").isin(*tiers)).select(F.col("key").alias("item_key"))
        pins = tables.basket_map.filter(F.col("product_key").isNotNull())
        return pins.join(items, "item_key", "left_semi").select(*PRODUCT).distinct()

    return tables.keep(f"pinned_products-{sorted(tiers)}", build)


def pinned_days(tables: Tables, tiers: Sequence[str] = ("core",)) -> DataFrame:
    """The newest observation per product pinned to the tiers, day and basis, priced and unpriced apart.

    Everything about pins starts here: history is read once, reduced in every task to one row
    per product, day and basis, and kept, however many steps a single product holds.
    """

    def build() -> DataFrame:
        observations = only_keys(tables.price_observations, PRODUCT, pinned_products(tables, tiers))
        apart = [F.to_date("observed_at").alias("day"), F.col("unit_price_basis").alias("_basis"),
                 F.col("unit_price").isNotNull().alias("_priced")]
        days = observations.select(*PRODUCT, "id", *LATEST_COLUMNS, *apart)
        keys = [*PRODUCT, "day", "_basis", "_priced"]
        return latest_by(days, keys, "id", ["id", *LATEST_COLUMNS]).drop("_basis", "_priced")

    return tables.keep(f"pinned_days-{sorted(tiers)}", build)


def pinned(
    tables: Tables,
    tiers: tuple[str, ...] = ("core",),
    contributors_only: bool = True,
    country: str | None = None,
) -> DataFrame:
    """Usable pins of the given tiers at active stores, with item, store and product details."""
    stores = tables.stores.filter("active")
    if contributors_only:
        stores = stores.filter("index_contributor")
    if country is not None:
        stores = stores.filter(F.col("country") == country)
    items = tables.items.filter(F.col("tier").isin(*tiers))
    pins = tables.basket_map.filter(
        F.col("status").isin(*USABLE_STATUS) & F.col("product_key").isNotNull()
    )
    return (
        pins.join(
            stores.select(
                "store_id", "country", "index_contributor", F.col("name").alias("store_name")
            ),
            "store_id",
        )
        .join(
            items.select(
                F.col("key").alias("item_key"),
                "label",
                "tier",
                "index_quantity",
                "index_uom",
                F.col("target_size").alias("item_sizes"),
                basis_of(F.col("normal_unit")).alias("want_basis"),
            ),
            "item_key",
        )
        .join(
            tables.products.select(
                *PRODUCT,
                F.col("name").alias("product_name"),
                "size_quantity",
                "size_form",
                "size_approximate",
            ),
            PRODUCT,
        )
    )


def priced(
    tables: Tables, pins: DataFrame, skip_stale: bool = False, tiers: Sequence[str] = ("core",)
) -> DataFrame:
    """Pins of the given tiers with their latest price, unpriced ones kept; a stale pin keeps its
    row, not its price."""
    latest = latest_by(pinned_days(tables, tiers), PRODUCT, "id", LATEST_COLUMNS)
    joined = pins.join(latest, PRODUCT, "left")
    if not skip_stale:
        return joined
    fresh = F.col("missed_runs") < STALE_AFTER
    kept = [c for c in joined.columns if c not in LATEST_COLUMNS]
    return joined.select(*kept, *[F.when(fresh, F.col(c)).alias(c) for c in LATEST_COLUMNS])


def medians(pins: DataFrame) -> DataFrame:
    """Exact interpolated median unit price per country and item, and how many pins made it.

    A group holds at most one price per store and pin, so the exact aggregate stays small.
    """
    comparable = pins.filter(
        F.col("unit_price").isNotNull() & (F.col("unit_price_basis") == F.col("want_basis"))
    )
    return comparable.groupBy("country", "item_key").agg(
        F.percentile(F.col("unit_price").cast("double"), F.lit(0.5)).alias("median_unit_price"),
        F.count("unit_price").alias("priced"),
    )


def judged(pins: DataFrame) -> DataFrame:
    """Priced pins with median and verdict columns."""
    return with_verdicts(pins.join(medians(pins), ["country", "item_key"], "left"))


def index_pins(tables: Tables, country: str | None = None) -> DataFrame:
    """The pins of the published index with verdicts; missed pulls do not matter here.

    One row per item and store, judged once and kept: history, calendar and store lines all
    start from the same verdicts.
    """
    return tables.keep(
        f"index_pins-{country}", lambda: judged(priced(tables, pinned(tables, country=country)))
    )


def pins_core(tables: Tables) -> DataFrame:
    return pinned(tables).select("country", "item_key", *PRODUCT, "status", "want_basis")


def pin_medians(tables: Tables) -> DataFrame:
    return medians(index_pins(tables).drop("median_unit_price", "priced"))


def pin_verdicts(tables: Tables) -> DataFrame:
    return index_pins(tables).select(
        "country", "item_key", *PRODUCT, "unit_price", "unit_price_basis", "no_size",
        "basis_mismatch", "price_outlier", "suspect", "imprecise", "flag", "flag_reason",
    )


def thin_items(tables: Tables) -> DataFrame:
    """Items with too few comparable pins for the outlier test to run."""
    pins = priced(tables, pinned(tables, contributors_only=False), skip_stale=True)
    counts = pins.groupBy("country", "item_key").agg(
        F.count(F.when(F.col("unit_price_basis") == F.col("want_basis"), F.col("unit_price")))
        .alias("comparable"),
        F.count("unit_price").alias("priced_pins"),
    )
    return counts.filter(F.col("comparable") < COMPARABLE_PINS)
