"""The basket price index: fixed quantities, as-of prices, and days that say they are incomplete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfindex.functions.prices import extended
from shelfindex.operators.asof import daily_values, lowest, outside_gaps, running, value_spans
from shelfindex.operators.ordered import islands, with_neighbour
from shelfindex.plans.pins import PRODUCT, index_pins, pinned_days
from shelfindex.sources.tables import Tables

# A store above this multiple of the index leaves the chart, and the least
# spread and distance at which the highest and lowest days are worth naming.
CHART_CAP = 4
POLE_SPREAD = 0.005
POLE_DAYS = 2

LINE = ["country", "item_key", *PRODUCT]


def index_observations(tables: Tables, country: str | None = None) -> DataFrame:
    """Priced observations of trusted pins, in the basis the item is tracked in.

    A pin's verdict is taken on its latest price and applied to all of its history.
    """
    good = index_pins(tables, country).filter(~F.col("suspect")).select(*LINE, "want_basis")
    observations = pinned_days(tables).select(
        *PRODUCT, "id", "unit_price", "unit_price_basis", "day"
    ).filter(F.col("unit_price").isNotNull())
    return (
        observations.join(good, PRODUCT)
        .filter(F.col("unit_price_basis") == F.col("want_basis"))
        .select(*LINE, "id", "day", "unit_price")
    )


def last_day(tables: Tables) -> Column:
    return F.lit(tables.as_of)


def first_days(observations: DataFrame) -> DataFrame:
    """The first observed day of each country: nothing is claimed before it."""
    return observations.groupBy("country").agg(F.min("day").alias("first_day"))


def calendar_from(starts: DataFrame, tables: Tables) -> DataFrame:
    """Every day from `first_day` to the reading day, for each row of `starts`."""
    open_ended = starts.filter(F.col("first_day") <= last_day(tables))
    days = F.sequence(F.col("first_day"), last_day(tables))
    return open_ended.withColumn("d", F.explode(days)).drop("first_day")


def calendar(tables: Tables, country: str | None = None) -> DataFrame:
    return calendar_from(index_starts(tables, country), tables)


def price_spans(tables: Tables, country: str | None = None) -> DataFrame:
    """Spans over which each pin's unit price is in effect, outside its gaps; kept.

    Index and store lines all start from these, at most one pin per item and store.
    """

    def build() -> DataFrame:
        until = last_day(tables)
        past = index_observations(tables, country).filter(F.col("day") <= until)
        steps = value_spans(past, LINE, "day", "id", "unit_price", until)
        return outside_gaps(steps, tables.pin_gaps, LINE, PRODUCT, "unit_price")

    return tables.keep(f"price_spans-{country}", build)


def item_spans(tables: Tables, country: str | None = None) -> DataFrame:
    """Spans over which an item's cheapest price in a country stays the same; kept."""
    return tables.keep(
        f"item_spans-{country}",
        lambda: lowest(price_spans(tables, country), ["country", "item_key"], "unit_price"),
    )


def index_asof(tables: Tables, country: str | None = None) -> DataFrame:
    """The unit price in effect per day and pin, outside the pin's gaps."""
    return daily_values(price_spans(tables, country))


def index_cheapest(tables: Tables, country: str | None = None) -> DataFrame:
    return daily_values(item_spans(tables, country))


def core_items(tables: Tables) -> DataFrame:
    return tables.items.filter(F.col("tier") == "core").select(
        F.col("key").alias("item_key"), "index_quantity"
    )


def with_core_keys(df: DataFrame, tables: Tables) -> DataFrame:
    """Add `core_keys`, the sorted keys of the fixed basket, from a one-row subquery."""
    keys = core_items(tables).agg(F.array_sort(F.collect_list("item_key")))
    return df.withColumn("core_keys", keys.scalar())


def basket_lines(spans: DataFrame, tables: Tables) -> DataFrame:
    """Spans of basket items with a quantity, and what the quantity costs."""
    items = core_items(tables).filter(F.col("index_quantity").isNotNull())
    cost = extended(F.col("unit_price"), F.col("index_quantity"))
    return spans.join(items, "item_key").withColumn("cost", cost)


def uncovered(lines: DataFrame, starts: DataFrame, tables: Tables) -> DataFrame:
    """The days on which a basket item has no price, as one sorted array per country and day.

    Only missing days are expanded: what lies before, between and after an item's spans.
    """
    end = F.date_add(last_day(tables), 1)
    items = with_core_keys(starts, tables).select(
        "country", "first_day", F.explode("core_keys").alias("item_key")
    )
    marks = lines.select("country", "item_key", "from_day", "to_day").unionByName(
        items.select("country", "item_key", end.alias("from_day"), end.alias("to_day"))
    )
    before = F.lag("to_day").over(W.partitionBy("country", "item_key").orderBy("from_day", "to_day"))
    missing = (
        marks.withColumn("before", before)
        .join(starts, "country")
        .select(
            "country", "item_key", F.coalesce("before", "first_day").alias("from_day"),
            F.col("from_day").alias("to_day"),
        )
    )
    return daily_values(missing).groupBy("country", "d").agg(
        F.array_sort(F.collect_list("item_key")).alias("missing")
    )


def basket_days(lines: DataFrame, starts: DataFrame, tables: Tables) -> DataFrame:
    """One row per country and day; the total is null unless every core item is priced."""
    sums = running(lines, ["country"], {"total": F.col("cost")})
    totals = daily_values(sums.select("country", "from_day", "to_day", "total"))
    absent = uncovered(lines, starts, tables)
    days = with_core_keys(calendar_from(starts, tables), tables)
    none = F.array().cast("array<string>")
    return (
        days.join(totals, ["country", "d"], "left")
        .join(absent, ["country", "d"], "left")
        .withColumn("missing", F.coalesce("missing", none))
        .select(
            "country",
            "d",
            (F.size("core_keys") - F.size("missing")).cast("bigint").alias("priced"),
            F.size("core_keys").cast("bigint").alias("expected"),
            "missing",
            F.when(F.size("missing") == 0, F.col("total")).alias("total"),
        )
    )


def index_starts(tables: Tables, country: str | None = None) -> DataFrame:
    return tables.keep(
        f"index_starts-{country}", lambda: first_days(index_observations(tables, country))
    )


def basket_index(tables: Tables, country: str | None = None) -> DataFrame:
    lines = basket_lines(item_spans(tables, country), tables)
    return basket_days(lines, index_starts(tables, country), tables)


def store_spans(tables: Tables, country: str | None = None) -> DataFrame:
    """Spans over which a store's priced items and their total stay the same."""
    lines = basket_lines(price_spans(tables, country), tables)
    return running(lines, ["country", "store_id"], {"total": F.col("cost")}).filter(
        F.col("count") > 0
    )


def store_days(tables: Tables, country: str | None = None) -> DataFrame:
    """What each store charged per day for the items it priced; a partial day still totals."""
    names = tables.stores.select("store_id", F.col("name").alias("store_name"))
    days = daily_values(store_spans(tables, country))
    return days.join(names, "store_id").select(
        "country", "d", "store_id", F.col("count").alias("priced"), "total", "store_name",
        core_items(tables).agg(F.count("*")).scalar().alias("expected"),
    )


def dense_store_days(days: DataFrame, starts: DataFrame, tables: Tables) -> DataFrame:
    """Every store that was ever priced, on every day of its country; absent means null."""
    stores = days.groupBy("country", "store_id", "store_name").agg(
        F.max("expected").alias("expected")
    )
    grid = calendar_from(stores.join(starts, "country"), tables)
    return grid.join(
        days.select("country", "d", "store_id", "priced", "total"),
        ["country", "d", "store_id"],
        "left",
    ).select(
        "country",
        "d",
        "store_id",
        "store_name",
        F.coalesce("priced", F.lit(0)).cast("bigint").alias("priced"),
        "expected",
        "total",
        F.coalesce(
            F.col("total").isNotNull() & (F.col("priced") < F.col("expected")), F.lit(False)
        ).alias("partial"),
    )


def store_series(tables: Tables, country: str | None = None) -> DataFrame:
    return dense_store_days(store_days(tables, country), index_starts(tables, country), tables)


def index_and_stores(tables: Tables, country: str | None = None) -> DataFrame:
    """Index rows (null store) and dense store rows in one result, as the published series."""
    basket = basket_index(tables, country)
    own = store_series(tables, country)
    return basket.select(
        "country", "d", F.lit(None).cast("string").alias("store_id"),
        F.lit(None).cast("string").alias("store_name"), "priced", "expected", "missing", "total",
    ).unionByName(
        own.select(
            "country", "d", "store_id", "store_name", "priced", "expected",
            F.array().cast("array<string>").alias("missing"), "total",
        )
    )


def incident_on_day(tables: Tables, country: str | None = None) -> DataFrame:
    """Per country and day, the covering incident that opened last (ties by id).

    Only one incident matters per country, opening day and closing day, so spans are reduced
    to that before closed ones are expanded; unresolved ones need a running maximum only.
    No range join is involved.
    """
    stores = tables.stores.filter("active and index_contributor")
    if country is not None:
        stores = stores.filter(F.col("country") == country)
    opened = (
        tables.incidents.join(stores.select("store_id", "country"), "store_id")
        .select(
            "country",
            F.to_date("opened_at").alias("opened"),
            F.to_date("resolved_at").alias("resolved"),
            F.struct("opened_at", "id").alias("incident"),
        )
        .groupBy("country", "opened", "resolved")
        .agg(F.max("incident").alias("incident"))
    )
    closed = (
        opened.filter(F.col("resolved") >= F.col("opened"))
        .withColumn("d", F.explode(F.sequence("opened", F.col("resolved"))))
        .groupBy("country", "d")
        .agg(F.max("incident").alias("incident"))
    )
    still_open = opened.filter(F.col("resolved").isNull()).select(
        "country", F.col("opened").alias("d"), "incident"
    )
    return closed.withColumn("open", F.lit(False)).unionByName(
        still_open.withColumn("open", F.lit(True))
    )


def annotated(days: DataFrame, incidents: DataFrame) -> DataFrame:
    """Add `incident_id` to days without a total, where an incident covers them."""
    at_day = incidents.groupBy("country", "d").agg(
        F.max(F.when(F.col("open"), F.col("incident"))).alias("opening"),
        F.max(F.when(~F.col("open"), F.col("incident"))).alias("closing"),
    )
    merged = days.withColumn("_day", F.lit(True)).join(at_day, ["country", "d"], "full")
    history = W.partitionBy("country").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    covering = F.greatest(F.max("opening").over(history), F.col("closing"))
    return (
        merged.withColumn("_covering", covering)
        .filter("_day")
        .select(
            *days.columns,
            F.when(F.col("total").isNull(), F.col("_covering.id")).alias("incident_id"),
        )
    )


def index_annotated(tables: Tables, country: str | None = None) -> DataFrame:
    return annotated(basket_index(tables, country), incident_on_day(tables, country))


def index_gaps(tables: Tables, country: str | None = None) -> DataFrame:
    """Contiguous days without a total, with the incident that covers the first of them."""
    nulls = index_annotated(tables, country).filter(F.col("total").isNull())
    return (
        islands(nulls.select("country", "d", "incident_id"), ["country"], "d")
        .groupBy("country", "island")
        .agg(
            F.min("d").alias("from_day"),
            F.max("d").alias("to_day"),
            F.min_by("incident_id", "d").alias("incident_id"),
        )
        .drop("island")
    )


def index_poles(tables: Tables, country: str | None = None) -> DataFrame:
    """The lowest and the highest day of each series, when they are far enough apart to name."""
    totals = basket_index(tables, country).filter(F.col("total").isNotNull())
    early = F.struct(F.col("total"), F.col("d"))
    late_first = F.struct(F.col("total"), -F.unix_date("d"), F.col("d").alias("d"))
    poles = totals.groupBy("country").agg(
        F.count("*").alias("readings"), F.min(early).alias("low"), F.max(late_first).alias("high")
    )
    return poles.select(
        "country",
        "readings",
        F.col("low.d").alias("lowest_day"),
        F.col("low.total").alias("lowest"),
        F.col("high.d").alias("highest_day"),
        F.col("high.total").alias("highest"),
        (
            (F.col("readings") > 1)
            & (F.col("high.total") - F.col("low.total") >= F.col("high.total") * F.lit(POLE_SPREAD))
            & (F.abs(F.datediff("high.d", "low.d")) >= POLE_DAYS)
        ).alias("named"),
    )


def _own_against_index(tables: Tables, country: str | None) -> tuple[DataFrame, DataFrame]:
    return basket_index(tables, country), store_days(tables, country)


def worst_ratios(basket: DataFrame, stores: DataFrame) -> DataFrame:
    index = basket.filter(F.col("total").isNotNull() & (F.col("total") != 0)).select(
        "country", "d", F.col("total").alias("index_total")
    )
    ratio = F.col("total").cast("double") / F.col("index_total").cast("double")
    return (
        stores.join(index, ["country", "d"], "left")
        .groupBy("country", "store_id", "store_name")
        .agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("worst_ratio"))
        .withColumn("drawn", F.col("worst_ratio") <= CHART_CAP)
    )


def store_worst_ratio(tables: Tables, country: str | None = None) -> DataFrame:
    """Each store's worst multiple of the index, and whether it stays on the chart."""
    return worst_ratios(*_own_against_index(tables, country))


def value_extent(tables: Tables, country: str | None = None) -> DataFrame:
    """Lowest and highest total among the index and the stores that stay on the chart."""
    basket, stores = _own_against_index(tables, country)
    drawn = worst_ratios(basket, stores).filter("drawn").select("store_id")
    shown = basket.select("country", "total").unionByName(
        stores.join(drawn, "store_id", "left_semi").select("country", "total")
    )
    return shown.groupBy("country").agg(
        F.min("total").alias("low"), F.max("total").alias("high")
    )


def store_latest_total(tables: Tables, country: str | None = None) -> DataFrame:
    """The last day with a total, per store and (null store) for the index."""
    basket, stores = _own_against_index(tables, country)
    both = basket.select(
        "country", F.lit(None).cast("string").alias("store_id"), "d", "total", "priced"
    ).unionByName(stores.select("country", "store_id", "d", "total", "priced"))
    return (
        both.filter(F.col("total").isNotNull())
        .groupBy("country", "store_id")
        .agg(F.max(F.struct("d", "total", "priced")).alias("last"))
        .select("country", "store_id", "last.*")
    )


def price_intervals(tables: Tables) -> DataFrame:
    """Every price step with the span it holds: until the next step, the last until today."""
    steps = tables.price_observations.select(
        *PRODUCT, "id", "price", F.to_date("observed_at").alias("from_day")
    )
    held = with_neighbour(
        steps, PRODUCT, "id", {"next_day": "from_day"}, ahead=True, cuts=tables.id_cuts
    )
    return held.select(
        *PRODUCT, "id", "price", "from_day",
        F.coalesce("next_day", last_day(tables)).alias("to_day"),
    )
