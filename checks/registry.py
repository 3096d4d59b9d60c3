"""The registered queries: each runs over all rows of the tables under a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.oracle_base import INCIDENT
from shelfindex.functions.cursor import iso
from shelfindex.plans import basket, bulletins, catalog, health, index, pins, quality, ranking
from shelfindex.plans.catalog import Search
from shelfindex.session import configure, scratch_path
from shelfindex.sources.star import HISTORY_MIDDLE, StarSource, StarStream, product_key_of
from shelfindex.sources.tables import Tables
from shelfindex.streaming import events as streams
from shelfindex.streaming.history import PriceHistory

# Parameters of the registered queries.
TIERS = ("core", "stretch")
STORE, PRODUCT_KEY = "st13", "k014"
REGION, FUEL = "ASIA", "RON 95"
NULL_TOLERANCE = 0.01
ROW_TOLERANCE = 0.5
ESTABLISHED = 2
COVERAGE_DAYS, COVERAGE = 60, 0.5

MONEY_SUMS = {"total", "contribution", "amount"}


def shown(df: DataFrame) -> DataFrame:
    """Plain columns for comparison: money and ratios as doubles, times and dates as text."""

    def plain(field: T.StructField) -> Column:
        column = F.col(field.name)
        kind = field.dataType
        if isinstance(kind, T.DecimalType):
            whole = kind.scale == 0 and kind.precision == 38
            column = column.cast("string" if whole else "double")
        elif isinstance(kind, T.DoubleType):
            column = F.round(column, 8)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType):
            column = iso(column)
        elif isinstance(kind, T.IntegerType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def joined(items: str, *fields: str, between: str = "|") -> Column:
    """An array of structs as text: fields by '|', elements by ';'."""
    return F.array_join(
        F.transform(
            items,
            lambda s: F.concat_ws(
                between, *[F.coalesce(s[f].cast("string"), F.lit("-")) for f in fields]
            ),
        ),
        ";",
    )


def spark_text(df: DataFrame) -> DataFrame:
    return df.withColumn("spark", joined("spark", "d", "p", between="="))


def missing_text(df: DataFrame) -> DataFrame:
    return df.withColumn("missing", F.array_join("missing", ","))


def hits(df: DataFrame, *extra: str) -> DataFrame:
    kept = [c for c in df.columns if c not in ("sort_rank", "sort_value") or c in extra]
    return spark_text(df.select(*kept))


def rails_text(t: Tables) -> DataFrame:
    nested = basket.rails_nested(t)
    label = lambda pin, name: F.when(pin[name], name).otherwise("")
    text = F.array_join(
        F.transform(
            "pins",
            lambda p: F.concat_ws(
                "|", p["store_id"], p["product_key"],
                F.coalesce(p["price"].cast("string"), F.lit("-")),
                F.coalesce(p["unit_price"].cast("string"), F.lit("-")),
                p["flag"], label(p, "cheapest"), label(p, "dearest"),
            ),
        ),
        ";",
    )
    return nested.withColumn("pins", text).drop("currency")


def readings(source: StarSource) -> DataFrame:
    """Every reading with its product key, as a collector would deliver them."""
    return source.readings().withColumn("product_key", product_key_of(F.col("sku"))).drop("sku")


def page_two_by_price(t: Tables) -> DataFrame:
    first = Search(sort="unit_price", limit=40)
    cursor = catalog.search_cursor(t, first)
    if cursor is None:
        return catalog.search(t, first).limit(0)
    return catalog.search(t, Search(sort="unit_price", limit=40, cursor=cursor))


def feed_page_two(t: Tables) -> DataFrame:
    cursor = health.feed_page(t, 50).next_cursor
    return health.feed(t, 50).limit(0) if cursor is None else health.feed(t, 50, cursor)


def incidents_page_two(t: Tables) -> DataFrame:
    cursor = health.incident_cursor(t, "open", 50)
    if cursor is None:
        return health.incidents_page(t, "open", 50).limit(0)
    return health.incidents_page(t, "open", 50, cursor)


def gaps_text(t: Tables) -> DataFrame:
    return index.index_gaps(t).withColumn("incident_id", F.coalesce("incident_id", F.lit("")))


def cart(t: Tables) -> DataFrame:
    return ranking.rail_pins(t)


def stream_feed(t: Tables, s: StarSource) -> DataFrame:
    live = StarStream(s.spark, s.folder, ("events",))
    events = streams.feed_stream(live.runs(), live.incidents(), live.alerts(), t.stores)
    return streams.write_feed(events, scratch_path(s.spark, "feed"))


def stream_change_only(t: Tables, s: StarSource) -> DataFrame:
    """Steps found by the stream, with the columns the batch history carries."""
    history = PriceHistory.scratch(s.spark, "changes")
    history.run(readings(StarStream(s.spark, s.folder, ("lineitem",))))
    sku = F.substring("product_key", 2, 18).cast("bigint")
    return s.with_unit_prices(history.read_steps().withColumn("sku", sku).drop("product_key"))


def stream_latest(t: Tables, s: StarSource) -> DataFrame:
    history = PriceHistory.scratch(s.spark, "latest")
    history.run(readings(StarStream(s.spark, s.folder, ("lineitem",))), steps=False)
    return history.latest.current()


def stream_dedup(t: Tables, s: StarSource) -> DataFrame:
    """Every run delivered twice, applied once."""
    live = StarStream(s.spark, s.folder, ("events",))
    twice = live.runs().unionByName(live.runs())
    once = streams.unique_runs(twice).select("id", "store_id", "at", "status", "rows")
    return streams.write_feed(once, scratch_path(s.spark, "runs"))


def stream_runs_daily(t: Tables, s: StarSource) -> DataFrame:
    live = StarStream(s.spark, s.folder, ("events",))
    return streams.write_daily(
        s.spark, streams.daily_runs(live.runs()), scratch_path(s.spark, "daily")
    )


QUERIES: dict[str, Callable[[Tables, StarSource], DataFrame]] = {
    # base
    "latest_price": lambda t, s: pins.latest_price(t),
    "unit_price": lambda t, s: quality.unit_prices(t),
    "change_only": lambda t, s: s.price_observations(),
    "price_intervals": lambda t, s: index.price_intervals(t),
    "calendar": lambda t, s: index.calendar(t),
    # pins
    "pins_core": lambda t, s: pins.pins_core(t),
    "pin_medians": lambda t, s: pins.pin_medians(t),
    "pin_verdicts": lambda t, s: pins.pin_verdicts(t),
    "thin_items": lambda t, s: pins.thin_items(t),
    "quality_worklist": lambda t, s: basket.quality_worklist(t, tiers=TIERS),
    # index
    "index_asof": lambda t, s: index.index_asof(t),
    "index_cheapest": lambda t, s: index.index_cheapest(t),
    "basket_index": lambda t, s: missing_text(index.basket_index(t)),
    "store_days": lambda t, s: index.store_days(t),
    "store_series": lambda t, s: index.store_series(t),
    "index_and_stores": lambda t, s: missing_text(index.index_and_stores(t)),
    "index_annotated": lambda t, s: missing_text(index.index_annotated(t)),
    "index_gaps": lambda t, s: gaps_text(t),
    "index_poles": lambda t, s: index.index_poles(t),
    "store_worst_ratio": lambda t, s: index.store_worst_ratio(t),
    "value_extent": lambda t, s: index.value_extent(t),
    "store_latest_total": lambda t, s: index.store_latest_total(t),
    # basket
    "today": lambda t, s: basket.today(t),
    "rails": lambda t, s: basket.rails(t, tiers=TIERS),
    "rails_nested": lambda t, s: rails_text(t),
    "staple_bars": lambda t, s: basket.staple_bars(t),
    "receipt": lambda t, s: basket.receipt(t),
    # rankings
    "store_ranking": lambda t, s: ranking.store_ranking(cart(t)),
    "store_item_ratios": lambda t, s: ranking.store_item_ratios(cart(t)),
    "store_ignored": lambda t, s: ranking.store_ignored(cart(t)),
    "store_order": lambda t, s: ranking.store_order(cart(t)),
    "basket_spread": lambda t, s: ranking.basket_spread(cart(t)),
    "terrain_grid": lambda t, s: ranking.terrain_grid(cart(t)),
    "grid_gaps": lambda t, s: ranking.grid_gaps(cart(t)),
    "excluded_fraction": lambda t, s: ranking.excluded_fraction(cart(t)),
    "ratio_axis": lambda t, s: ranking.ratio_axis(cart(t)),
    "headline_counts": lambda t, s: ranking.headline_counts(cart(t)),
    # catalogue
    "sparkline": lambda t, s: spark_text(catalog.sparkline(t)),
    "median30": lambda t, s: catalog.median_price(t),
    "drops": lambda t, s: hits(catalog.drops(t)),
    "product_detail": lambda t, s: catalog.product(t, STORE, PRODUCT_KEY),
    "product_history": lambda t, s: catalog.product_history(t, STORE, PRODUCT_KEY),
    "product_stats": lambda t, s: catalog.product_stats(t),
    "same_size": lambda t, s: catalog.same_size(t, STORE, PRODUCT_KEY).select(
        "store_id", "product_key", "name", "price", "similarity"
    ),
    "same_size_all": lambda t, s: catalog.same_size_all(t),
    "search_browse": lambda t, s: hits(catalog.search(t, Search(limit=40))),
    "search_tokens": lambda t, s: hits(
        catalog.search(t, Search(q="Small ring", limit=200))
    ),
    "search_relevance": lambda t, s: hits(
        catalog.search(t, Search(q="red widget", limit=25)), "sort_value"
    ),
    "search_price": lambda t, s: hits(catalog.search(t, Search(sort="unit_price", limit=40))),
    "search_price_page2": lambda t, s: hits(page_two_by_price(t)),
    "search_filtered": lambda t, s: hits(
        catalog.search(
            t, Search(q="small", category="pharmacy", basis="per_kg", sort="unit_price")
        )
    ),
    "search_tokens_col": lambda t, s: catalog.search_words(t).withColumn(
        "tokens", F.array_join("tokens", " ")
    ),
    "collapse_listings": lambda t, s: catalog.collapse_listings(
        catalog.with_latest(catalog.catalogue(t), t).select(
            "store_id", "product_key", "name", "price"
        )
    ),
    "srp_reference": lambda t, s: catalog.srp_reference(t, "blue"),
    "over_srp": lambda t, s: catalog.over_srp(t, Search(q="blue")),
    # bulletins
    "fuel_products": lambda t, s: bulletins.fuel_products(t, REGION),
    "fuel_cities": lambda t, s: bulletins.fuel_cities(t, REGION, FUEL).withColumn(
        "brands", joined("brands", "brand", "low", "high")
    ),
    "fuel_range": lambda t, s: bulletins.fuel_range(t, REGION, FUEL),
    "fuel_adjustment": lambda t, s: bulletins.fuel_adjustment(
        t,
        t.gov_series.filter(F.col("source") == bulletins.PUMP).select("commodity").distinct(),
    ),
    "fuel_history": lambda t, s: bulletins.fuel_history(t, REGION, FUEL),
    "lpg": lambda t, s: bulletins.lpg(t),
    "lpg_recent": lambda t, s: bulletins.lpg_recent(t),
    "market_commodities": lambda t, s: bulletins.market_commodities(t),
    "market_rows": lambda t, s: bulletins.market_rows(t).withColumn(
        "markets", joined("markets", "market", "price")
    ),
    "srp_latest": lambda t, s: bulletins.srp_latest(t),
    "srp_search": lambda t, s: bulletins.srp_search(t, "ring"),
    # health
    "fleet": lambda t, s: health.fleet(t),
    "fleet_totals": lambda t, s: health.fleet_totals(t),
    "feed": lambda t, s: health.feed(t, 50),
    "feed_page2": lambda t, s: feed_page_two(t),
    "incidents_page": lambda t, s: health.incidents_page(t, state="open", limit=50),
    "incidents_page2": lambda t, s: incidents_page_two(t),
    "incident_by_id": lambda t, s: health.incident(t, INCIDENT),
    "incident_summaries": lambda t, s: health.incident_summaries(t),
    # quality
    "dq_schema": lambda t, s: quality.dq_schema(t),
    "dq_null_rates": lambda t, s: quality.dq_null_rates(t, HISTORY_MIDDLE, NULL_TOLERANCE),
    "dq_rowcount": lambda t, s: quality.dq_rowcount(t, ROW_TOLERANCE),
    "dq_value_ranges": lambda t, s: quality.dq_value_ranges(t, HISTORY_MIDDLE),
    "dq_mass_change": lambda t, s: quality.dq_mass_change(
        readings(s), t.price_observations, ESTABLISHED
    ),
    "dq_pin_gaps": lambda t, s: quality.dq_pin_gaps(readings(s), t.basket_map),
    "dq_coverage": lambda t, s: quality.dq_coverage(t, COVERAGE_DAYS, COVERAGE),
    "dq_items": lambda t, s: quality.dq_items(t),
    "dq_orphans": lambda t, s: quality.dq_orphans(t),
    # streams
    "stream_feed": stream_feed,
    "stream_change_only": stream_change_only,
    "stream_latest": stream_latest,
    "stream_dedup": stream_dedup,
    "stream_runs_daily": stream_runs_daily,
}


_SOURCES: dict[tuple[str, str], tuple[Tables, StarSource]] = {}


def opened(spark: SparkSession, folder: str) -> tuple[Tables, StarSource]:
    """The tables of a folder, built once per application; DataFrames stay lazy."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SOURCES:
        source = StarSource(configure(spark), folder)
        _SOURCES[key] = (source.tables(), source)
    return _SOURCES[key]


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Tables, StarSource], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shown(build(*opened(spark, folder)))

        return run

    return {name: bound(build) for name, build in QUERIES.items()}
