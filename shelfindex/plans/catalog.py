"""The catalogue: search, price drops, and one product in full."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfindex.functions import cursor as cursors
from shelfindex.functions.prices import known_basis, pct_below
from shelfindex.functions.text import (
    SIMILAR_FROM,
    compact,
    contains_all,
    search_text,
    similarity,
    tokens,
    tokens_column,
    word_similarity,
)
from shelfindex.functions.verdicts import imprecise_size
from shelfindex.operators.ordered import latest_by, top_by
from shelfindex.operators.paging import Page, after, fetched, probe, take_page
from shelfindex.operators.quantile import quantiles_of_counts
from shelfindex.operators.restrict import only_keys
from shelfindex.operators.similar import similar_names
from shelfindex.plans.bulletins import srp_latest
from shelfindex.plans.pins import PRODUCT
from shelfindex.sources.tables import Tables

# Fixed values of the catalogue.
LISTED_DAYS = 7
SPARK_POINTS = 30
MEDIAN_DAYS = 30
LOW_DAYS = 90
DROP_DAYS = 7
DROP_LISTED_DAYS = 2
DROP_THRESHOLD = Decimal("0.1")
DROP_STEPS = 2
DROPS_DEFAULT, DROPS_MOST = 30, 60
SAME_SIZE_ROWS = 10
SRP_ROWS = 3

LATEST = ["price", "currency", "unit_price", "unit_price_basis", "observed_at"]


def listed(tables: Tables, days: int = LISTED_DAYS) -> Column:
    """Seen in the store's catalogue within the last `days` days."""
    return F.col("last_seen") > tables.days_ago(days)


def catalogue(tables: Tables) -> DataFrame:
    """Products with their store's name, country, category and state."""
    stores = tables.stores.select(
        "store_id", F.col("name").alias("store_name"), "country", "category", "active",
        F.col("currency").alias("store_currency"),
    ).filter(tables.priced_countries(F.col("country")))
    return tables.products.join(stores, "store_id").withColumn("imprecise", imprecise_size())


def history_of(tables: Tables, products: DataFrame | None = None) -> DataFrame:
    """Price observations, only of the given products if any are given."""
    observations = tables.price_observations
    if products is None:
        return observations
    return only_keys(observations, PRODUCT, products)


def sparkline(tables: Tables, among: DataFrame | None = None) -> DataFrame:
    """Per product its newest 30 price steps, oldest first, and whether the last one fell."""
    steps = history_of(tables, among).select(*PRODUCT, "id", "observed_at", "price")
    newest = top_by(steps, PRODUCT, [F.col("id").desc()], SPARK_POINTS)
    point = F.struct("id", F.date_format("observed_at", "yyyy-MM-dd").alias("d"),
                     F.col("price").alias("p"))
    series = newest.groupBy(*PRODUCT).agg(F.array_sort(F.collect_list(point)).alias("steps"))
    last, before = F.element_at("steps", -1), F.try_element_at("steps", F.lit(-2))
    return series.select(
        *PRODUCT,
        F.transform("steps", lambda s: F.struct(s["d"].alias("d"), s["p"].alias("p")))
        .alias("spark"),
        F.coalesce(last["p"] < before["p"], F.lit(False)).alias("falling"),
    )


def with_latest(products: DataFrame, tables: Tables) -> DataFrame:
    """Add the latest observation of each product; only their history is read."""
    history = history_of(tables, products)
    return products.join(latest_by(history, PRODUCT, "id", LATEST), PRODUCT, "left")


def as_hits(found: DataFrame, tables: Tables) -> DataFrame:
    """Catalogue rows with latest prices, in the published hit shape."""
    sparks = sparkline(tables, found)
    extra = [c for c in ("sort_rank", "sort_value", "median30", "pct_below") if c in found.columns]
    empty = F.array().cast("array<struct<d:string,p:decimal(12,4)>>")
    return found.join(sparks, PRODUCT, "left").select(
        "store_id", "store_name", "country", "product_key", "name", "url", "price",
        tables.currency(F.col("currency"), F.col("country")).alias("currency"),
        "unit_price", known_basis(F.col("unit_price_basis")).alias("unit_price_basis"),
        "size_quantity", "size_base_uom", "imprecise", "observed_at", "category", "last_seen",
        F.coalesce("spark", empty).alias("spark"), *extra,
    )


@dataclass(frozen=True)
class Search:
    """Parameters of a catalogue search, validated on construction."""

    q: str | None = None
    country: str | None = None
    store_id: str | None = None
    category: str | None = None
    basis: str | None = None
    sort: str = "relevance"
    limit: int = 50
    cursor: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "q", search_text(self.q))
        if self.sort not in ("relevance", "unit_price"):
            raise ValueError("sort is relevance or unit_price")
        if not 1 <= self.limit <= 200:
            raise ValueError("limit is 1 to 200")

    @property
    def order(self) -> str:
        return "browse" if self.q is None and self.sort != "unit_price" else self.sort


def matches(tables: Tables, search: Search) -> DataFrame:
    """Listed products of active stores that pass the filters and hold every search word."""
    found = catalogue(tables).filter(F.col("active") & listed(tables))
    if search.q is not None:
        condition = contains_all(F.col("name"), tokens(search.q))
        if condition is not None:
            found = found.filter(condition)
    for column, value in (
        ("category", search.category),
        ("country", search.country),
        ("store_id", search.store_id),
    ):
        if value is not None:
            found = found.filter(F.col(column) == value)
    return found


def search_keys(tables: Tables, search: Search) -> tuple[DataFrame, list[Column]]:
    """Matches past the cursor with their sort key, and the order to take them in.

    Prices are looked up before paging only if the order or the basis filter needs them.
    """
    found = matches(tables, search)
    if search.sort == "unit_price" or search.basis is not None:
        found = with_latest(found, tables)
    if search.basis is not None:
        found = found.filter(F.col("unit_price_basis") == search.basis)

    seen = cursors.decode_search(search.cursor, search.order)
    if search.order == "browse":
        found = found.withColumn("sort_value", F.col("name"))
        key = [F.col("name")]
        values = [F.lit(seen["v"] or "")] if seen else []
    elif search.order == "unit_price":
        found = found.withColumn(
            "sort_rank", F.when(F.col("unit_price").isNull(), 1).otherwise(0)
        ).withColumn(
            "sort_value",
            F.coalesce("unit_price", F.lit(0).cast("decimal(16,6)")),
        )
        key = [F.col("sort_rank"), F.col("sort_value")]
        if seen:
            value = F.lit(Decimal(seen["v"] or "0")).cast("decimal(16,6)")
            values = [F.lit(1 if seen["v"] is None else 0), value]
    else:
        score = word_similarity(F.lit(search.q), F.col("name"))
        found = found.withColumn("sort_value", (-score).cast("decimal(18,12)"))
        key = [F.col("sort_value")]
        if seen:
            values = [F.lit(Decimal(seen["v"] or "0")).cast("decimal(18,12)")]
    key = [*key, F.col("store_id"), F.col("product_key")]
    if seen:
        values = [*values, F.lit(seen["s"]), F.lit(seen["k"])]
        found = found.filter(after(list(zip(key, values))))
    return found, key


def search(tables: Tables, params: Search) -> DataFrame:
    """One page of hits and a probe row: at most `limit` + 1 rows, in sort order.

    Latest price and sparkline are joined to the page's rows, not to every match.
    """
    found, key = search_keys(tables, params)
    most = params.limit + 1
    page = fetched(probe(found, key, params.limit), most)
    if "price" not in page.columns:
        page = with_latest(page, tables)
    return as_hits(page, tables).orderBy(*key)


def search_page(tables: Tables, params: Search) -> Page:
    """The page of `search` as rows with the cursor of the next one.

    The first page of a typed search carries the suggested prices for the same text, three rows
    at most; later pages do not.
    """

    def cursor_of(row) -> str:
        tail = params.order == "unit_price" and row["unit_price"] is None
        value = None if tail else str(row["sort_value"])
        return cursors.encode(
            {"o": params.order, "v": value, "s": row["store_id"], "k": row["product_key"]}
        )

    page = take_page(search(tables, params), params.limit, cursor_of)
    if not params.q or params.cursor:
        return page
    return replace(page, reference=tuple(srp_reference(tables, params.q).collect()))


def search_cursor(tables: Tables, params: Search) -> str | None:
    """The cursor that follows this page, without fetching prices or sparklines it does not need."""
    found, key = search_keys(tables, params)
    columns = [c for c in ("sort_rank", "sort_value") if c in found.columns]
    rows = probe(found.select(*PRODUCT, *columns), key, params.limit).take(params.limit + 1)
    if len(rows) <= params.limit:
        return None
    last = rows[params.limit - 1]
    tail = params.order == "unit_price" and last["sort_rank"] == 1
    return cursors.encode(
        {
            "o": params.order,
            "v": None if tail else str(last["sort_value"]),
            "s": last["store_id"],
            "k": last["product_key"],
        }
    )


def search_words(tables: Tables) -> DataFrame:
    """Search words of every product name, as a query for the product would use them."""
    return tables.products.select(*PRODUCT, tokens_column(F.col("name")).alias("tokens"))


def srp_reference(tables: Tables, q: str) -> DataFrame:
    """The three cheapest suggested retail prices of the latest bulletin that hold every word."""
    words = tokens(q)
    condition = contains_all(F.concat_ws(" ", "product", "category"), words)
    rows = srp_latest(tables)
    rows = rows.filter(condition) if condition is not None else rows.limit(0)
    return rows.orderBy("price", "category", "product", "size").limit(SRP_ROWS)


def over_srp(tables: Tables, params: Search) -> DataFrame:
    """Hits priced over the suggested price of the same brand and size.

    The at most three suggested prices travel as one array; the first whose brand word and
    compact size both occur in the name decides.
    """
    order = F.struct(F.col("price").alias("at"), "category", "product", "size",
                     F.col("price").alias("srp"))
    reference = srp_reference(tables, params.q or "").agg(F.array_sort(F.collect_list(order)))
    found = with_latest(matches(tables, params), tables)
    name, squeezed = F.lower("name"), compact(F.col("name"))

    def same(row: Column) -> Column:
        brand = F.element_at(F.split(F.lower(row["product"]), r"\s+"), 1)
        return (
            (F.length(brand) > 1)
            & F.contains(name, brand)
            & F.contains(squeezed, compact(row["size"]))
        )

    first = F.try_element_at(F.filter("references", same), F.lit(1))
    over = F.round(F.col("price") - F.col("srp"), 2)
    return (
        found.withColumn("references", reference.scalar())
        .withColumn("srp", first["srp"])
        .withColumn("over", over)
        .filter(F.col("over") > 0)
        .select(*PRODUCT, "name", "price", "srp", "over")
    )


def collapse_listings(hits: DataFrame, order: Sequence[str] = ("product_key",)) -> DataFrame:
    """Fold hits that agree on store, name and price into the first, with their number."""
    rest = [c for c in hits.columns if c not in ("store_id", "price")]
    return (
        hits.groupBy("store_id", F.lower("name").alias("_name"), "price")
        .agg(
            F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
            F.count("*").alias("listings"),
        )
        .select("store_id", "price", "_first.*", "listings")
    )


def window_price_counts(
    tables: Tables,
    days: int = MEDIAN_DAYS,
    among: DataFrame | None = None,
) -> DataFrame:
    """How often each price was stepped to in the last `days` days, per product.

    The step in effect when the window opened counts once. One pass: recent steps are counted
    by price, older ones reduce to their newest, both before the shuffle.
    """
    recent = F.col("observed_at") > tables.days_ago(days)
    steps = history_of(tables, among).select(
        *PRODUCT, "id", "price", recent.alias("recent"), F.when(recent, F.col("price")).alias("at")
    )
    return (
        steps.groupBy(*PRODUCT, "recent", "at")
        .agg(F.count("*").alias("times"), F.max_by("price", "id").alias("value"))
        .select(*PRODUCT, "value", F.when(F.col("recent"), F.col("times")).otherwise(1).alias("n"))
    )


def median_price(
    tables: Tables,
    days: int = MEDIAN_DAYS,
    among: DataFrame | None = None,
) -> DataFrame:
    """Exact median and number of the window's price steps per product."""
    counts = window_price_counts(tables, days, among)
    medians = quantiles_of_counts(counts, PRODUCT, {"median30": 0.5})
    return medians.withColumnRenamed("total", "steps")


def drop_candidates(tables: Tables) -> DataFrame:
    """Products priced down within the last week."""
    down = (
        (F.col("observed_at") > tables.days_ago(DROP_DAYS))
        & (F.col("change") == "price")
        & (F.col("delta") < 0)
    )
    return tables.price_observations.filter(down).select(*PRODUCT).distinct()


def drops(
    tables: Tables,
    category: str | None = None,
    limit: int = DROPS_DEFAULT,
    listed_days: int = DROP_LISTED_DAYS,
) -> DataFrame:
    """Products at least 10% under their own 30-day median, deepest first.

    Only products priced down within the week enter the median.
    """
    if not 1 <= limit <= DROPS_MOST:
        raise ValueError(f"limit is 1 to {DROPS_MOST}")
    candidates = drop_candidates(tables)
    products = catalogue(tables).filter(F.col("active") & listed(tables, listed_days))
    if category is not None:
        products = products.filter(F.col("category") == category)
    shown = products.join(candidates, PRODUCT, "left_semi")
    medians = median_price(tables, among=shown).filter(F.col("steps") >= DROP_STEPS)
    priced = with_latest(shown, tables).join(medians, PRODUCT)
    price = F.col("price").cast("double")
    ceiling = F.lit(float(1 - DROP_THRESHOLD)) * F.col("median30")
    depth = (F.col("median30") - price) / F.nullif("median30", F.lit(0.0))
    deepest = (
        priced.filter(price <= ceiling)
        .withColumn("pct_below", pct_below(F.col("price"), F.col("median30")))
        .orderBy(depth.desc_nulls_last(), "store_id", "product_key")
        .limit(limit)
    )
    return as_hits(fetched(deepest, limit), tables)


def product(tables: Tables, store_id: str, product_key: str) -> DataFrame:
    """One product as a hit, with its unit, first day and whether it is still listed."""
    mine = (F.col("store_id") == store_id) & (F.col("product_key") == product_key)
    row = fetched(catalogue(tables).filter(mine), 1)
    hit = as_hits(with_latest(row, tables), tables).drop("spark")
    rest = row.select(*PRODUCT, "unit", "first_seen", listed(tables).alias("listed"))
    return hit.join(rest, PRODUCT)


def product_history(tables: Tables, store_id: str, product_key: str) -> DataFrame:
    """Every price step of one product; order by id to read it."""
    mine = (F.col("store_id") == store_id) & (F.col("product_key") == product_key)
    return tables.price_observations.filter(mine).select(
        *PRODUCT, "id", "observed_at", "price", "unit_price"
    )


def product_stats(tables: Tables, among: DataFrame | None = None) -> DataFrame:
    """The 90-day low and 30-day median of products; null where the window holds nothing."""
    recent = F.col("observed_at") > tables.days_ago(LOW_DAYS)
    lows = (
        history_of(tables, among).filter(recent).groupBy(*PRODUCT)
        .agg(F.min("price").alias("low90"))
    )
    medians = median_price(tables, among=among).select(*PRODUCT, "median30")
    return medians.join(lows, PRODUCT, "left").select(*PRODUCT, "low90", "median30")


def same_size(tables: Tables, store_id: str, product_key: str) -> DataFrame:
    """Listed products of other stores with the same size and a similar name, most similar first.

    The one product compared with is looked up by key, so the join side it forms is one row.
    """
    target = (
        tables.products.filter(
            (F.col("store_id") == store_id) & (F.col("product_key") == product_key)
        )
        .select(
            F.col("name").alias("_name"), "size_quantity", "size_base_uom",
        )
        .limit(1)
    )
    others = catalogue(tables).filter(
        (F.col("store_id") != store_id) & F.col("active") & listed(tables)
    )
    alike = (
        others.join(F.broadcast(target), ["size_quantity", "size_base_uom"])
        .withColumn("similarity", similarity(F.col("name"), F.col("_name")))
        .filter(F.col("similarity") >= SIMILAR_FROM)
    )
    return (
        with_latest(alike, tables)
        .orderBy(
            F.col("similarity").desc(), F.col("price").asc_nulls_last(), "store_id", "product_key"
        )
        .limit(SAME_SIZE_ROWS)
    )


def first_elsewhere(
    df: DataFrame, keys: list[str], store: str, order: list[Column], limit: int
) -> DataFrame:
    """Rows that hold, for any one store passed over, the first `limit` per key of all others."""
    return top_by(top_by(df, [*keys, store], order, limit), keys, order, 2 * limit)


def same_size_all(tables: Tables, limit: int = SAME_SIZE_ROWS) -> DataFrame:
    """For every listed product the `limit` most similar listed products of its size elsewhere.

    Names are compared once each. Of the products under one name, and again of those under all names
    similar to one, only the first that could reach a place go on: at most `limit` of a store and
    twice that in all, since only the asking store's own are passed over. So neither a name that
    every store carries nor a name like many others gives all pairs of products.
    """
    size = ["size_quantity", "size_base_uom"]
    shown = (
        catalogue(tables)
        .filter(F.col("active") & listed(tables) & F.col("size_quantity").isNotNull())
        .select(*PRODUCT, "name", *size)
    )
    priced = with_latest(shown, tables).select(*PRODUCT, "name", *size, "price")
    order = [F.col("price").asc_nulls_last(), F.col("store_id"), F.col("product_key")]
    first = first_elsewhere(priced, [*size, "name"], "store_id", order, limit)
    offers = first.select(
        *size, F.col("name").alias("other"), F.col("store_id").alias("other_store"),
        F.col("product_key").alias("other_key"), "price",
    )
    best = [F.col("similarity").desc(), F.col("price").asc_nulls_last(), "other_store", "other_key"]
    alike = similar_names(shown, size, SIMILAR_FROM).join(offers, [*size, "other"])
    places = first_elsewhere(alike, [*size, "name"], "other_store", best, limit)
    met = shown.join(places, [*size, "name"]).filter(F.col("other_store") != F.col("store_id"))
    return top_by(met, PRODUCT, best, limit).select(
        *PRODUCT, "other_store", "other_key", "price", "similarity"
    )
