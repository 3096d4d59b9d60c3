"""Data-quality rules over readings, pulls and the domain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.functions.prices import unit_price
from shelfindex.operators.quantile import exact_quantiles
from shelfindex.sources.tables import Tables

PRODUCT = ["store_id", "product_key"]

# A mass change, and the misses that open a pin gap.
MASS_CHANGE = 0.9
GAP_MISSES = 2

# Fields whose null rate is tracked, and the quantiles of the price envelope.
NULL_FIELDS = ("unit_price", "unit_price_basis", "previous_price")
ENVELOPE = {"p5": 0.05, "p95": 0.95}


def _present(column: str) -> Column:
    return F.coalesce(F.length(column), F.lit(0)) >= 1


def product_rules() -> dict[str, Column]:
    """Contract rules a product's own columns must meet."""
    url = F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^\s/]+")
    return {
        "product_key": _present("product_key"),
        "name": _present("name"),
        "unit": _present("unit"),
        "url": F.coalesce(url, F.lit(False)),
    }


def reading_rules() -> dict[str, Column]:
    """Contract rules a price reading must meet."""
    return {
        "price": F.coalesce(F.col("price") > 0, F.lit(False)),
        "currency": F.coalesce(F.length("currency") == 3, F.lit(False)),
        "observed_at": F.col("observed_at").isNotNull(),
    }


def _broken(rules: dict[str, Column]) -> Column:
    return ~reduce(lambda a, b: a & b, rules.values())


def dq_schema(tables: Tables) -> DataFrame:
    """Rows and rejected rows per store, over every observation with its product.

    Readings are judged and counted per product before products are joined, so a product with
    most of the history is one row by then.
    """
    counts = tables.price_observations.groupBy(*PRODUCT).agg(
        F.count("*").alias("records"),
        F.count(F.when(_broken(reading_rules()), 1)).alias("bad_readings"),
        F.count(F.when(~reading_rules()["price"], 1)).alias("bad_price"),
    )
    rules = product_rules()
    products = tables.products.select(
        *PRODUCT, _broken(rules).alias("bad_product"), (~rules["unit"]).alias("no_unit")
    )
    return (
        counts.join(products, PRODUCT)
        .groupBy("store_id")
        .agg(
            F.sum("records").alias("records"),
            F.sum(F.when(F.col("bad_product"), F.col("records")).otherwise(F.col("bad_readings")))
            .alias("rejected"),
            F.sum(F.when(F.col("no_unit"), F.col("records")).otherwise(0)).alias("bad_unit"),
            F.sum("bad_price").alias("bad_price"),
        )
    )


def null_rates(observations: DataFrame) -> DataFrame:
    """Share of nulls per store and tracked field."""
    rates = observations.groupBy("store_id").agg(
        F.count("*").alias("records"),
        *[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in NULL_FIELDS],
    )
    return rates.unpivot(["store_id", "records"], list(NULL_FIELDS), "field", "null_rate")


def build_baselines(observations: DataFrame) -> DataFrame:
    """Per store: row count, null rates and price envelope, as the baseline table holds them."""
    rates = observations.groupBy("store_id").agg(
        F.count("*").alias("expected_row_count"),
        F.to_json(
            F.struct(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in NULL_FIELDS])
        ).alias("field_null_rates"),
    )
    envelope = exact_quantiles(observations, ["store_id"], "price", ENVELOPE)
    ranges = envelope.select(
        "store_id",
        F.to_json(F.struct(F.array(*[F.col(name) for name in ENVELOPE]).alias("price")))
        .alias("value_ranges"),
    )
    return rates.join(ranges, "store_id", "left")


def dq_null_rates(tables: Tables, since, tolerance: float) -> DataFrame:
    """Null rates since a day against the store's baseline, and which of them spiked."""
    recent = null_rates(tables.price_observations.filter(F.col("observed_at") >= F.lit(since)))
    expected = F.from_json("field_null_rates", "map<string,double>")
    baseline = tables.baselines.select("store_id", F.explode(expected).alias("field", "baseline"))
    return recent.join(baseline, ["store_id", "field"], "left").withColumn(
        "spike", F.coalesce(F.col("null_rate") - F.col("baseline") > tolerance, F.lit(False))
    )


def dq_rowcount(tables: Tables, tolerance: float) -> DataFrame:
    """Runs per store that delivered fewer rows than the tolerated share of the expected."""
    runs = tables.runs.join(tables.baselines.select("store_id", "expected_row_count"), "store_id")
    short = F.col("rows") < F.col("expected_row_count") * tolerance
    return runs.groupBy("store_id").agg(
        F.count("*").alias("runs"),
        F.count(F.when(short, 1)).alias("short_runs"),
        F.min("rows").alias("fewest_rows"),
        F.max("expected_row_count").alias("expected_row_count"),
    )


def dq_value_ranges(tables: Tables, since) -> DataFrame:
    """The price envelope of each store and how many prices since a day fall outside it."""
    ranges = F.from_json("value_ranges", "struct<price:array<double>>")["price"]
    envelope = tables.baselines.select(
        "store_id", F.element_at(ranges, 1).alias("p5"), F.element_at(ranges, 2).alias("p95")
    )
    recent = tables.price_observations.filter(F.col("observed_at") >= F.lit(since)).select(
        "store_id", F.col("price").cast("double").alias("amount")
    )
    outside = (F.col("amount") < F.col("p5")) | (F.col("amount") > F.col("p95"))
    return recent.join(envelope, "store_id").groupBy("store_id", "p5", "p95").agg(
        F.count("*").alias("prices"), F.count(F.when(outside, 1)).alias("outside")
    )


def dq_mass_change(readings: DataFrame, observations: DataFrame, established: int) -> DataFrame:
    """Pulls in which more than nine tenths of an established catalogue changed price at once.

    `readings` are all products a pull saw, `observations` the steps it caused.
    """
    day = F.to_date("observed_at").alias("d")
    seen = readings.select("store_id", day, "product_key").distinct()
    changed = (
        observations.filter(F.col("change") == "price")
        .select("store_id", day, "product_key")
        .distinct()
    )
    counts = (
        seen.withColumn("seen", F.lit(1)).withColumn("changed", F.lit(0))
        .unionByName(changed.withColumn("seen", F.lit(0)).withColumn("changed", F.lit(1)))
        .groupBy("store_id", "d")
        .agg(F.sum("seen").alias("seen"), F.sum("changed").alias("changed"))
    )
    share = F.col("changed") / F.nullif("seen", F.lit(0))
    return counts.filter(F.col("seen") >= established).select(
        "store_id", "d", "seen", "changed",
        F.coalesce(share > MASS_CHANGE, F.lit(False)).alias("suppressed"),
    )


def numbered_pulls(readings: DataFrame) -> DataFrame:
    """A store's pull days in order, each with the day of the pull after it."""
    by_day = W.partitionBy("store_id").orderBy("d")
    return (
        readings.select("store_id", F.to_date("observed_at").alias("d"))
        .distinct()
        .select(
            "store_id",
            "d",
            F.row_number().over(by_day).alias("pull"),
            F.lead("d").over(by_day).alias("next_pull_day"),
        )
    )


def dq_pin_gaps(readings: DataFrame, pins: DataFrame) -> DataFrame:
    """Spans in which a pinned product was missing from two or more pulls in a row.

    A span starts with the first missed pull and ends with the next sight; null is open.
    Sightings are one row per product and day, so the windows are bounded by the calendar.
    """
    pulls = numbered_pulls(readings)
    last_pull = pulls.groupBy("store_id").agg(F.max("pull").alias("last_pull"))
    wanted = pins.filter(F.col("product_key").isNotNull()).select(*PRODUCT).distinct()
    sightings = (
        readings.join(wanted, PRODUCT, "left_semi")
        .select(*PRODUCT, F.to_date("observed_at").alias("d"))
        .distinct()
        .join(pulls, ["store_id", "d"])
    )
    by_pull = W.partitionBy(*PRODUCT).orderBy("pull")
    spans = sightings.select(
        *PRODUCT,
        "pull",
        F.col("next_pull_day").alias("from_day"),
        F.lead("pull").over(by_pull).alias("next_pull"),
        F.lead("d").over(by_pull).alias("to_day"),
    ).join(last_pull, "store_id")
    missed = F.coalesce(F.col("next_pull") - 1, F.col("last_pull")) - F.col("pull")
    return (
        spans.withColumn("missed", missed)
        .filter(F.col("missed") >= GAP_MISSES)
        .select(*PRODUCT, "from_day", "to_day", F.col("missed").cast("bigint").alias("missed"))
    )


def dq_coverage(tables: Tables, days: int, at_least: float) -> DataFrame:
    """Share of a store's pins that its last pulls saw, and whether it fell too low."""
    last = tables.products.groupBy("store_id").agg(F.max("last_seen").alias("last_pull"))
    pins = tables.basket_map.filter(F.col("product_key").isNotNull()).select(*PRODUCT)
    seen = (
        pins.join(tables.products.select(*PRODUCT, "last_seen"), PRODUCT, "left")
        .join(last, "store_id", "left")
        .withColumn(
            "seen",
            F.coalesce(
                F.col("last_seen") > F.col("last_pull") - F.expr(f"interval {int(days)} days"),
                F.lit(False),
            ),
        )
    )
    share = F.avg(F.col("seen").cast("double"))
    return seen.groupBy("store_id").agg(
        F.count("*").alias("pins"),
        F.count(F.when(F.col("seen"), 1)).alias("seen_pins"),
        (share < at_least).alias("dropped"),
    )


def dq_items(tables: Tables) -> DataFrame:
    """Items whose quantity and unit break the rule: both absent, or positive in the right unit."""
    quantity, uom = F.col("index_quantity"), F.col("index_uom")
    right = (
        F.when(F.col("normal_unit") == "g", "kg")
        .when(F.col("normal_unit") == "ml", "l")
        .otherwise("count")
    )
    absent = quantity.isNull() & uom.isNull()
    kept = F.coalesce(absent | ((quantity > 0) & (uom == right)), F.lit(False))
    return tables.items.filter(~kept).select(
        "key", "tier", "normal_unit", "index_quantity", "index_uom"
    )


def _duplicates(df: DataFrame, check: str, *keys: str) -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return repeated.agg(
        F.lit(check).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")
    )


def _orphans(df: DataFrame, parent: DataFrame, check: str, keys: list[str]) -> DataFrame:
    """Child rows without a parent; children are counted per key before the anti join."""
    present: Column = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    children = df.filter(present).groupBy(*keys).agg(F.count("*").alias("n"))
    lost = children.join(parent.select(*keys), keys, "left_anti")
    return lost.agg(
        F.lit(check).alias("check"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    )


def dq_orphans(tables: Tables) -> DataFrame:
    """Rows per integrity rule that break it."""
    series = tables.gov_series.select(F.col("id").alias("series_id"))
    items = tables.items.select(F.col("key").alias("item_key"))
    checks = [
        _duplicates(tables.price_observations, "price_observations primary key", "id"),
        _duplicates(tables.products, "products primary key", *PRODUCT),
        _duplicates(tables.basket_map, "basket_map primary key", "item_key", "store_id"),
        _duplicates(
            tables.gov_prices, "gov_prices primary key", "series_id", "period_start"
        ),
        _orphans(
            tables.price_observations, tables.products, "price_observations to products", PRODUCT
        ),
        _orphans(tables.basket_map, tables.products, "basket_map to products", PRODUCT),
        _orphans(tables.basket_map, items, "basket_map to items", ["item_key"]),
        _orphans(tables.runs, tables.stores, "runs to stores", ["store_id"]),
        _orphans(tables.incidents, tables.stores, "incidents to stores", ["store_id"]),
        _orphans(tables.gov_prices, series, "gov_prices to gov_series", ["series_id"]),
    ]
    return reduce(DataFrame.unionByName, checks)


def unit_prices(tables: Tables) -> DataFrame:
    """Every observation's price per kilogram, litre or item, computed from the product's size."""
    sizes = tables.products.select(*PRODUCT, "size_quantity", "size_base_uom")
    return tables.price_observations.join(sizes, PRODUCT).select(
        "id", *PRODUCT, "price",
        unit_price(F.col("price"), F.col("size_quantity"), F.col("size_base_uom"))
        .alias("unit_price"),
        "unit_price_basis",
    )
