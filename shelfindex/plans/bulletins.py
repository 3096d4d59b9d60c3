"""Public price bulletins: pump prices, LPG, wet markets and suggested retail prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.sources.tables import Tables

# The bulletin sources, the fuel families of the weekly adjustment, and the
# product prefixes that belong to each.
PUMP = "doe_pump"
ADJUSTMENT = "doe_oil_monitor"
LPG = "doe_lpg"
MARKETS = "bantay_presyo"
SRP = "dti_srp"
FAMILIES = {"RON": "gasoline", "DIESEL": "diesel", "KEROSENE": "kerosene"}
HISTORY_WEEKS = 12
RECENT_MONTHS = 6


def fuel_family(product: Column) -> Column:
    """The family the weekly adjustment is published for; blank when the product has none."""
    family = F.lit("")
    for prefix, name in reversed(FAMILIES.items()):
        family = F.when(F.upper(product).startswith(prefix), F.lit(name)).otherwise(family)
    return family


def series_prices(tables: Tables, source: str, **where: str | None) -> DataFrame:
    """Prices of one source's series; with a source-partitioned layout only its files are read.

    Both sides are cut by the source: prices whose files carry it are pruned before the join.
    """
    prices = tables.gov_prices
    if "source" in prices.columns:
        prices = prices.filter(F.col("source") == source).drop("source")
    series = tables.gov_series.filter(F.col("source") == source)
    for column, value in where.items():
        if value is not None:
            series = series.filter(F.col(column) == value)
    return prices.join(series.withColumnRenamed("id", "series_id"), "series_id")


def latest_period(prices: DataFrame) -> DataFrame:
    """Rows of the latest period, found by a one-row aggregate of the same prices."""
    latest = prices.agg(F.max("period_start"))
    return prices.filter(F.col("period_start") == latest.scalar())


def fuel_products(tables: Tables, region: str) -> DataFrame:
    week = latest_period(series_prices(tables, PUMP, region=region))
    return week.select("commodity").distinct()


def fuel_prices(tables: Tables, region: str, product: str) -> DataFrame:
    """Every brand's price range per city in the region's latest week, cheapest brand first."""
    week = latest_period(series_prices(tables, PUMP, region=region))
    rows = week.filter(F.col("commodity") == product)
    place = W.partitionBy("place").orderBy("price_min", "brand", "series_id")
    return rows.select(
        F.col("place").alias("city"), "brand", F.col("price_min").alias("low"),
        F.col("price_max").alias("high"), F.row_number().over(place).alias("place_rank"),
        "period_start", "period_end",
    )


def fuel_cities(tables: Tables, region: str, product: str) -> DataFrame:
    """Cities with their brands nested, cheapest first; a city has one row per brand."""
    brand = F.struct("place_rank", "brand", "low", "high")
    return (
        fuel_prices(tables, region, product)
        .groupBy("city")
        .agg(F.array_sort(F.collect_list(brand)).alias("brands"))
        .select(
            "city",
            F.transform("brands", lambda b: b.dropFields("place_rank")).alias("brands"),
        )
    )


def fuel_range(tables: Tables, region: str, product: str) -> DataFrame:
    """The region's latest week, and the product's lowest and highest price in it.

    The week ends with the last of its series. A product absent that week has no prices, but the
    week is there.
    """
    week = latest_period(series_prices(tables, PUMP, region=region))
    own = F.col("commodity") == product
    low, high = F.when(own, F.col("price_min")), F.when(own, F.col("price_max"))
    return week.groupBy("period_start").agg(
        F.max("period_end").alias("period_end"),
        F.least(F.min(low), F.min(high)).alias("low"),
        F.greatest(F.max(low), F.max(high)).alias("high"),
    )


def fuel_adjustment(tables: Tables, products: DataFrame) -> DataFrame:
    """The latest weekly adjustment for each product of a one-column DataFrame of names."""
    latest = (
        series_prices(tables, ADJUSTMENT, commodity="adjustment")
        .groupBy("variant")
        .agg(
            F.max_by(
                F.struct("period_start", "price_min", "price_max"),
                F.struct("period_start", "series_id"),
            ).alias("now")
        )
    )
    wanted = products.select("commodity", fuel_family(F.col("commodity")).alias("variant"))
    return wanted.join(latest, "variant").select(
        "commodity", "variant", F.col("now.price_min").alias("low"),
        F.col("now.price_max").alias("high"), F.col("now.period_start").alias("effective"),
    )


def fuel_history(tables: Tables, region: str, product: str) -> DataFrame:
    """Median of every brand's lowest price per week, over the last twelve weeks.

    A week holds one row per brand and city, so the exact aggregate is bounded by the two.
    """
    weekly = (
        series_prices(tables, PUMP, region=region, commodity=product)
        .groupBy("period_start")
        .agg(F.percentile(F.col("price_min").cast("double"), F.lit(0.5)).alias("median"))
    )
    return weekly.orderBy(F.col("period_start").desc()).limit(HISTORY_WEEKS)


def lpg(tables: Tables) -> DataFrame:
    """The cylinder price range per month and series."""
    return series_prices(tables, LPG).select(
        F.col("period_start").alias("month"), "unit", "series_id",
        F.col("price_min").alias("low"), F.col("price_max").alias("high"),
    )


def lpg_recent(tables: Tables) -> DataFrame:
    """The latest rows, newest month first, then by unit and series."""
    return lpg(tables).orderBy(F.col("month").desc(), "unit", "series_id").limit(RECENT_MONTHS)


def market_day(tables: Tables, commodity: str | None = None) -> DataFrame:
    day = latest_period(series_prices(tables, MARKETS))
    return day if commodity is None else day.filter(F.col("commodity") == commodity)


def market_commodities(tables: Tables) -> DataFrame:
    return market_day(tables).select("commodity").distinct()


def market_rows(tables: Tables, commodity: str | None = None) -> DataFrame:
    """Per item on the latest day: its markets cheapest first, the cheapest and the dearest."""
    market = F.struct(
        F.col("price_min").alias("price"), F.col("place").alias("market"), "series_id"
    )
    grouped = (
        market_day(tables, commodity)
        .groupBy("commodity", "variant", "unit")
        .agg(F.array_sort(F.collect_list(market)).alias("markets"))
    )
    first, last = F.element_at("markets", 1), F.element_at("markets", -1)
    return grouped.select(
        "commodity", "variant", "unit",
        F.transform("markets", lambda m: m.dropFields("series_id")).alias("markets"),
        first["price"].alias("cheapest"), first["market"].alias("cheapest_market"),
        last["price"].alias("dearest"), F.size("markets").cast("bigint").alias("market_count"),
    )


def srp_latest(tables: Tables) -> DataFrame:
    """Suggested retail prices of the latest bulletin."""
    return latest_period(series_prices(tables, SRP)).select(
        F.col("commodity").alias("category"), F.col("variant").alias("product"),
        F.col("unit").alias("size"), F.col("price_min").alias("price"),
        F.col("period_start").alias("effective"),
    )


def srp_search(tables: Tables, q: str | None = None) -> DataFrame:
    """The latest suggested prices whose product or category holds the text, taken literally."""
    rows = srp_latest(tables)
    if not q:
        return rows
    wanted = F.lit(q.lower())
    return rows.filter(
        F.contains(F.lower("product"), wanted) | F.contains(F.lower("category"), wanted)
    )
