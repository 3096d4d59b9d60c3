"""Store rankings over the rails: what the basket costs at each store, and the ratio grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.functions.prices import extended, spread_label
from shelfindex.plans.basket import RAIL, rails
from shelfindex.sources.tables import Tables

# Where the ratio scale ends and starts, and when the excluded share saturates.
RATIO_CAP = 8
AXIS_FLOOR = 1.5
EXCLUDED_GAIN = 0.35
NOT_COUNTED = "not counted by the index"
NOT_COMPARABLE = "no comparable price"


def usable(pins: DataFrame) -> DataFrame:
    """Pins that may be drawn: trusted and carrying a unit price."""
    return pins.filter((F.col("flag") != "suspect") & F.col("unit_price").isNotNull())


def staple_ratios(pins: DataFrame) -> DataFrame:
    """Usable pins of priceable items with their ratio to the cheapest counted shelf.

    An item is priceable when it carries a quantity and a counted store prices it above
    zero. Stores outside the index get a ratio too, against the counted yardstick.
    """
    counted = F.when(F.col("index_contributor"), F.col("unit_price"))
    yardstick = F.min(counted).over(W.partitionBy(*RAIL))
    return (
        usable(pins)
        .filter(F.col("index_quantity").isNotNull())
        .withColumn("_low", yardstick)
        .filter(F.col("_low") > 0)
        .withColumn("ratio", F.col("unit_price").cast("double") / F.col("_low").cast("double"))
        .drop("_low")
    )


def store_figures(pins: DataFrame) -> DataFrame:
    """One row per drawable store: ranked with total and mean ratio, or ignored with a reason.

    A store with no counted pin is ignored; its mean ratio, if any, never enters a total.
    """
    ratios = staple_ratios(pins)
    counted = F.col("index_contributor")
    figures = ratios.groupBy("country", "store_id").agg(
        F.count(F.when(counted, 1)).alias("covered"),
        F.sum(F.when(counted, extended(F.col("unit_price"), F.col("index_quantity"))))
        .alias("total"),
        F.avg(F.when(counted, F.col("ratio"))).alias("counted_ratio"),
        F.avg(F.when(~counted, F.col("ratio"))).alias("outside_ratio"),
    )
    priceable = ratios.groupBy("country").agg(
        F.count_distinct("item_key").alias("priceable")
    )
    drawable = (
        usable(pins)
        .groupBy("country", "store_id", "store_name")
        .agg(
            F.max(
                F.col("index_quantity").isNotNull() & ~F.col("index_contributor")
            ).alias("outsider")
        )
    )
    covered = F.coalesce("covered", F.lit(0))
    ranked = covered > 0
    expected = F.coalesce("priceable", F.lit(0))
    return (
        drawable.join(figures, ["country", "store_id"], "left")
        .join(priceable, "country", "left")
        .select(
            "country",
            "store_id",
            "store_name",
            ranked.alias("is_ranked"),
            covered.alias("covered"),
            expected.alias("priceable"),
            "total",
            F.when(ranked, F.col("counted_ratio")).otherwise(F.col("outside_ratio"))
            .alias("mean_ratio"),
            (ranked & (covered == expected)).alias("complete"),
            F.when(~ranked, F.when(F.col("outsider"), NOT_COUNTED).otherwise(NOT_COMPARABLE))
            .alias("reason"),
        )
    )


def store_ranking(pins: DataFrame) -> DataFrame:
    """Ranked stores, cheapest mean ratio first within their country."""
    ranked = store_figures(pins).filter("is_ranked")
    order = W.partitionBy("country").orderBy("mean_ratio", "store_name")
    return ranked.select(
        "country", F.row_number().over(order).alias("place"), "store_id", "store_name",
        "total", "covered", "priceable", "mean_ratio", "complete",
    )


def store_item_ratios(pins: DataFrame) -> DataFrame:
    """The price multiples that a ranked store's mean is made of, one per counted item."""
    return staple_ratios(pins).filter("index_contributor").select(
        "country", "store_id", "item_key", "ratio"
    )


def store_ignored(pins: DataFrame) -> DataFrame:
    return store_figures(pins).filter(~F.col("is_ranked")).select(
        "country", "store_id", "store_name", "reason", "mean_ratio"
    )


def store_order(pins: DataFrame) -> DataFrame:
    """Ranked and ignored stores in one order by mean ratio, those without one last."""
    order = W.partitionBy("country").orderBy(F.col("mean_ratio").asc_nulls_last(), "store_name")
    return store_figures(pins).select(
        "country", "store_id", "store_name", F.row_number().over(order).alias("place")
    )


def basket_spread(pins: DataFrame) -> DataFrame:
    """Cheapest and dearest complete basket per country; null below two of them."""
    complete = F.when(F.col("complete"), F.col("total"))
    several = F.count(complete) >= 2
    return (
        store_figures(pins)
        .groupBy("country")
        .agg(
            F.count(complete).alias("complete_stores"),
            F.when(several, F.min(complete)).alias("low"),
            F.when(several, F.max(complete)).alias("high"),
        )
    )


def terrain_grid(pins: DataFrame) -> DataFrame:
    """Cells of the item-by-store grid: ratio to the cheapest shelf of the row, and height.

    The row minimum is over every usable shelf, counted or not. A country with fewer than
    two stores or two filled rows has no grid.
    """
    amount = F.col("unit_price").cast("double")
    row_low = F.min(amount).over(W.partitionBy(*RAIL))
    cells = (
        usable(pins)
        .withColumn("_low", row_low)
        .filter(F.col("_low") > 0)
        .withColumn("ratio", amount / F.col("_low"))
    )
    drawable = usable(pins).groupBy("country").agg(F.count_distinct("store_id").alias("stores"))
    shape = (
        cells.groupBy("country")
        .agg(F.count_distinct("item_key").alias("rows"), F.max("ratio").alias("max_ratio"))
        .join(drawable, "country")
        .filter((F.col("stores") >= 2) & (F.col("rows") >= 2))
        .select("country", "max_ratio")
    )
    return (
        cells.join(shape, "country")
        .join(store_order(pins).select("country", "store_id", "place"), ["country", "store_id"])
        .select(
            *RAIL,
            "store_id",
            "place",
            "product_name",
            "ratio",
            F.least(F.lit(1.0), F.log(F.greatest(F.lit(1.0), F.col("ratio"))) / F.log(F.lit(8.0)))
            .alias("height"),
            (F.col("ratio") > RATIO_CAP).alias("capped"),
            "cheapest",
            "flag",
            F.greatest(F.lit(1.0), F.col("max_ratio")).alias("max_ratio"),
        )
    )


def grid_gaps(pins: DataFrame) -> DataFrame:
    """Item and store pairs of a grid where no comparable price stands.

    Each store of a grid is matched with the item list of its country, carried as one array.
    """
    cells = terrain_grid(pins)
    rows = pins.groupBy("country").agg(F.collect_set(F.struct("item_key", "label")).alias("rows"))
    columns = usable(pins).select("country", "store_id", "store_name").distinct()
    grids = cells.select("country").distinct()
    pairs = (
        columns.join(grids, "country", "left_semi")
        .join(rows, "country")
        .select("country", "store_id", "store_name", F.explode("rows").alias("row"))
        .select("country", "store_id", "store_name", "row.*")
    )
    return pairs.join(cells, [*RAIL, "store_id"], "left_anti").withColumn(
        "reading", F.lit(NOT_COMPARABLE)
    )


def excluded_fraction(pins: DataFrame) -> DataFrame:
    """Share of pins left out of the grid, scaled so that a broken fleet saturates at one."""
    out = (F.col("flag") == "suspect") | F.col("unit_price").isNull()
    share = F.count(F.when(out, 1)) / F.count("*") / F.lit(EXCLUDED_GAIN)
    return pins.groupBy("country").agg(
        F.count("*").alias("pins"),
        F.count(F.when(out, 1)).alias("excluded"),
        F.least(F.lit(1.0), share).alias("fraction"),
    )


def ratio_axis(pins: DataFrame) -> DataFrame:
    """End of the ratio axis: the dearest counted ratio under the cap, never below a floor."""
    counted = staple_ratios(pins).filter("index_contributor")
    inside = F.when(F.col("ratio") <= RATIO_CAP, F.col("ratio"))
    return counted.groupBy("country").agg(
        F.greatest(F.lit(AXIS_FLOOR), F.coalesce(F.max(inside), F.lit(AXIS_FLOOR)))
        .alias("axis_max"),
        F.bool_or(F.col("ratio") > RATIO_CAP).alias("any_capped"),
    )


def headline_counts(pins: DataFrame) -> DataFrame:
    """Stores and items per country, and the basket spread in words."""
    counts = pins.groupBy("country").agg(
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("item_key").alias("staples"),
    )
    spread = basket_spread(pins)
    return counts.join(spread, "country", "left").select(
        "country", "stores", "staples", "low", "high",
        F.coalesce(spread_label(F.col("low"), F.col("high")), F.lit("")).alias("spread"),
    )


def rail_pins(tables: Tables, country: str | None = None, tiers=("core",)) -> DataFrame:
    """The rails every ranking reads, computed once: at most one row per item and store."""
    return tables.keep(
        f"rails-{country}-{'-'.join(tiers)}", lambda: rails(tables, country, tiers)
    )
