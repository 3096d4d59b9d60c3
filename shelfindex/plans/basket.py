"""Today's basket: the cheapest shelf per item, the rails of every pin, and their readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.functions.prices import extended, move_pct
from shelfindex.functions.verdicts import COMPARABLE_PINS
from shelfindex.plans.index import basket_index
from shelfindex.plans.pins import STALE_AFTER, judged, pinned, priced
from shelfindex.sources.tables import Tables

RAIL = ["country", "item_key"]


def today(tables: Tables, country: str | None = None) -> DataFrame:
    """The cheapest trusted pin per country and item, by unit price, then store.

    Unpriced and stale pins leave before the median, so the verdicts here may differ from
    the index, which keeps them.
    """
    pins = pinned(tables, country=country).filter(F.col("missed_runs") < STALE_AFTER)
    flagged = judged(priced(tables, pins).filter(F.col("price").isNotNull()))
    best_first = W.partitionBy(*RAIL).orderBy("unit_price", "store_id")
    best = (
        flagged.filter("eligible")
        .withColumn("_place", F.row_number().over(best_first))
        .filter("_place = 1")
    )
    sizes = F.from_json("item_sizes", "map<string,string>")
    return best.filter(tables.priced_countries(F.col("country"))).select(
        "country",
        "item_key",
        "label",
        F.coalesce("target_size", sizes[F.col("country")], F.lit("")).alias("unit"),
        "store_id",
        "store_name",
        "product_name",
        "price",
        tables.currency(F.col("currency"), F.col("country")).alias("currency"),
        "unit_price",
        "unit_price_basis",
        "index_quantity",
        "index_uom",
        extended(F.col("unit_price"), F.col("index_quantity")).alias("contribution"),
        "imprecise",
        move_pct(F.col("delta"), F.col("previous_price")).alias("delta_pct"),
    )


def rails(
    tables: Tables, country: str | None = None, tiers: tuple[str, ...] = ("core",)
) -> DataFrame:
    """Every pin of every item with verdict, ranks and labels; nothing is left out.

    Cheapest and dearest are ranked among trusted, comparable prices, ties included.
    """
    pins = pinned(tables, tiers, contributors_only=False, country=country)
    pins = judged(priced(tables, pins, skip_stale=True, tiers=tiers))
    counted = F.when(F.col("eligible"), F.col("unit_price"))
    rail = W.partitionBy(*RAIL)
    ranked = (
        pins.withColumn("_counted", counted)
        .withColumn("cheap_rank", F.rank().over(rail.orderBy(F.col("_counted").asc_nulls_last())))
        .withColumn("dear_rank", F.rank().over(rail.orderBy(F.col("_counted").desc_nulls_last())))
    )
    comparable = F.coalesce("priced", F.lit(0))
    return ranked.filter(tables.priced_countries(F.col("country"))).select(
        *RAIL,
        "label",
        "tier",
        "index_quantity",
        "index_uom",
        "store_id",
        "store_name",
        "index_contributor",
        "product_key",
        "product_name",
        "price",
        tables.currency(F.col("currency"), F.col("country")).alias("currency"),
        "unit_price",
        "unit_price_basis",
        "median_unit_price",
        comparable.cast("bigint").alias("priced"),
        (comparable >= COMPARABLE_PINS).alias("comparable"),
        "suspect",
        "flag",
        "flag_reason",
        "cheap_rank",
        "dear_rank",
        (F.col("eligible") & (F.col("cheap_rank") == 1)).alias("cheapest"),
        (F.col("eligible") & (F.col("dear_rank") == 1) & (comparable >= 2)).alias("dearest"),
    )


def rail_order():
    """Trusted pins first, then by unit price with unpriced last, then by store."""
    return [F.col("suspect").asc(), F.col("unit_price").asc_nulls_last(), F.col("store_id").asc()]


def rails_nested(tables: Tables, country: str | None = None, tiers=("core",)) -> DataFrame:
    """One document per rail with its pins in order; a rail holds one pin per store."""
    flat = rails(tables, country, tiers).withColumn(
        "_at", F.row_number().over(W.partitionBy(*RAIL).orderBy(*rail_order()))
    )
    pin = F.struct(
        "_at", "store_id", "store_name", "index_contributor", "product_key", "product_name",
        "price", "unit_price", "unit_price_basis", "flag", "flag_reason", "cheapest", "dearest",
    )
    nested = flat.groupBy(*RAIL).agg(
        F.first("label").alias("label"),
        F.min_by("currency", "_at").alias("currency"),
        F.first("index_quantity").alias("index_quantity"),
        F.first("index_uom").alias("index_uom"),
        F.first("median_unit_price").alias("median_unit_price"),
        F.first("comparable").alias("comparable"),
        F.array_sort(F.collect_list(pin)).alias("pins"),
    )
    return nested.withColumn("pins", F.transform("pins", lambda p: p.dropFields("_at")))


def quality_worklist(tables: Tables, country: str | None = None, tiers=("core",)) -> DataFrame:
    """Pins that are flagged or unpriced, with their multiple of the median."""
    multiple = F.col("unit_price").cast("double") / F.nullif("median_unit_price", F.lit(0.0))
    return (
        rails(tables, country, tiers)
        .filter((F.col("flag") != "ok") | F.col("unit_price").isNull())
        .select(
            *RAIL, "store_id", "store_name", "product_name", "flag", "flag_reason",
            "unit_price", multiple.alias("times_median"),
        )
    )


def staple_bars(tables: Tables, country: str | None = None, tiers=("core",)) -> DataFrame:
    """Trusted priced pins of a rail in price order, with ratio to the lowest and bar share."""
    drawn = rails(tables, country, tiers).filter(
        ~F.col("suspect") & F.col("unit_price").isNotNull()
    )
    rail = W.partitionBy(*RAIL)
    amount = F.col("unit_price").cast("double")
    low, high = F.min(amount).over(rail), F.max(amount).over(rail)
    ratio = amount / F.nullif(low, F.lit(0.0))
    widest = F.greatest(high / F.nullif(low, F.lit(0.0)), F.lit(1.0))
    return drawn.select(
        *RAIL, "store_id", "unit_price",
        F.row_number().over(rail.orderBy("unit_price", "store_id")).alias("place"),
        ratio.alias("ratio"),
        (ratio / widest * 100).alias("bar"),
    )


def receipt(tables: Tables, country: str | None = None) -> DataFrame:
    """Today's lines, the basket items without one, and the latest index total as its own row."""
    lines = today(tables, country).select(
        "country", F.lit("line").alias("part"), "item_key", "product_name", "store_name",
        F.col("contribution").cast("decimal(38,12)").alias("amount"), "imprecise",
    )
    latest = (
        basket_index(tables, country)
        .groupBy("country")
        .agg(F.max_by(F.struct("total", "priced", "expected", "missing"), "d").alias("now"))
        .select("country", "now.*")
    )
    missing = (
        latest.select("country", F.explode("missing").alias("item_key"))
        .join(lines, RAIL, "left_anti")
        .select(
            "country", F.lit("missing").alias("part"), "item_key",
            F.lit(None).cast("string").alias("product_name"),
            F.lit(None).cast("string").alias("store_name"),
            F.lit(None).cast("decimal(38,12)").alias("amount"),
            F.lit(False).alias("imprecise"),
        )
    )
    total = latest.select(
        "country", F.lit("total").alias("part"),
        F.format_string("%d of %d", "priced", "expected").alias("item_key"),
        F.lit(None).cast("string").alias("product_name"),
        F.lit(None).cast("string").alias("store_name"),
        F.col("total").cast("decimal(38,12)").alias("amount"),
        F.lit(False).alias("imprecise"),
    )
    return lines.unionByName(missing).unionByName(total)
