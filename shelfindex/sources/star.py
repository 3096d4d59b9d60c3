"""The domain tables, derived from a star schema of orders, line items and events.

Histories and catalogues are ingested once per application: derived, written as Parquet to
the shared folder, and read from there by every query, as a collector's tables would be.

Every rule is integer arithmetic on the given columns, so the same table can be stated
in any SQL dialect; `checks/oracle_base.py` does that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfindex.functions.prices import basis_of, unit_price
from shelfindex.operators.changes import change_only
from shelfindex.operators.ordered import cuts_if_needed
from shelfindex.plans import quality
from shelfindex.session import checkpointed, scratch_path, size_shuffles
from shelfindex.sources.sinks import write_table
from shelfindex.sources.tables import Tables, conform, file_schema

# Fixed values of the derived data set.
AS_OF = date(2001, 11, 4)
HISTORY_MIDDLE = date(1998, 6, 5)
CURRENCIES = {
    "AFRICA": "AFR",
    "AMERICA": "AME",
    "ASIA": "ASI",
    "EUROPE": "EUR",
    "MIDDLE EAST": "MID",
}
CATEGORIES = ["grocery", "pharmacy", "electronics", "home"]
UOMS = ["g", "ml", "count"]
INDEX_UOMS = ["kg", "l", "count"]
RUN_STATUS = {
    "click": "ok",
    "view": "ok",
    "signup": "anomalous",
    "error": "error",
    "purchase": "blocked",
}
INCIDENT_KINDS = ["schema", "nulls", "rowcount", "drift", "pull_failed", "mystery"]
ALERT_KINDS = ["price_drop", "escalation", "unknown"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SOURCES = ["doe_pump", "doe_oil_monitor", "doe_lpg", "bantay_presyo", "dti_srp"]
FUELS = ["RON 95", "DIESEL", "KEROSENE"]
FUEL_FAMILIES = ["gasoline", "diesel", "kerosene"]
MARKET_GROUPS = ["Rice", "Fish", "Vegetables"]
SRP_GROUPS = ["Canned goods", "Noodles", "Milk"]
SRP_ADJECTIVES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
SRP_NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
# Columns read from each input table.
INPUT = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "orders": """
        o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string
    """,
    "lineitem": """
        l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz
    """,
    "events": """
        event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string
    """,
}
# Tables written out on first use; the others are cheap projections of an input table.
INGESTED = {
    "price_observations", "products", "basket_map", "gov_series", "gov_prices", "baselines",
}
# Parts with even keys are sold as one of the staples, ten others together as a line of their own.
STAPLES = 20
PARTS_PER_LINE = 10
# Suppliers that are sent to the tasks which read line items; two numbers each.
MOST_SENT = 1_000_000
# A reading's id: day, order (12 digits), line (2), part (10) and supplier (8).
ID = "decimal(38,0)"


def placed(high: Column, low: Column, digits: int) -> Column:
    """`high` followed by `low` in `digits` decimal digits."""
    power = F.lit(10**digits).cast(ID)
    return (high.cast(ID) * power + low.cast(ID)).cast(ID)


def _pick(values: list[str], index: Column) -> Column:
    """values[index], zero-based."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def line_of(part: str) -> Column:
    """The product line of a part, by its key column."""
    return F.expr(
        f"if({part} % 2 = 0, ({part} div 2) % {STAPLES}, {STAPLES} + {part} div {PARTS_PER_LINE})"
    )


def _store_id(nation: Column) -> Column:
    return F.concat(F.lit("st"), nation.cast("string"))


def product_key_of(sku: Column) -> Column:
    return F.concat(F.lit("k"), padded(sku, 3))


def _item_key(i: Column) -> Column:
    return F.concat(F.lit("item"), padded(i, 2))


def padded(number: Column, width: int) -> Column:
    """The number with zeros before it up to `width` digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


class StarSource:
    """Reads `<folder>/<table>.parquet` and derives each domain table on request."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._cuts: Sequence | Callable[[], list] | None = None
        self._few_suppliers: bool | None = None
        self._root: str | None = None
        self._bulletins: DataFrame | None = None
        self._derived: dict[str, DataFrame] = {}

    def tables(self) -> Tables:
        return Tables(
            self.spark,
            self.table,
            AS_OF,
            CURRENCIES,
            id_cuts=self.id_cuts(),
        )

    def table(self, name: str) -> DataFrame:
        """A domain table, derived and, where it takes work to derive, written out once."""
        if name not in self._derived:
            derived = conform(getattr(self, name)(), name)
            self._derived[name] = self._ingested(derived, name) if name in INGESTED else derived
        return self._derived[name]

    def _ingested(self, derived: DataFrame, name: str) -> DataFrame:
        if self._root is None:
            self._root = scratch_path(self.spark, "star")
        write_table(derived, self._root, name)
        return self.spark.read.schema(file_schema(name)).parquet(f"{self._root}/{name}")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(INPUT[name]).parquet(f"{self.folder}/{name}.parquet")

    def id_cuts(self) -> Sequence | Callable[[], list]:
        """Where slices of the readings begin, by their counted ids; found when a key needs it."""
        if self._cuts is None:
            rows = self.raw("lineitem").count()
            size_shuffles(self.spark, rows)
            self._cuts = cuts_if_needed(self.readings, "id", rows)
        return self._cuts

    def suppliers(self) -> DataFrame:
        """The nation of every supplier, sent to the line items if it is counted to be small.

        Left to the size of the file, line items would be shuffled and sorted by supplier at every
        reading once that file is above the threshold, which is long before the pairs are many.
        """
        supplier = self.raw("supplier")
        if supplier.isStreaming:
            return supplier
        if self._few_suppliers is None:
            self._few_suppliers = supplier.count() <= MOST_SENT
        return F.broadcast(supplier) if self._few_suppliers else supplier

    def stores(self) -> DataFrame:
        n = F.col("n_nationkey")
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                _store_id(n).alias("store_id"),
                F.col("n_name").alias("name"),
                F.col("r_name").alias("country"),
                F.upper(F.substring("r_name", 1, 3)).alias("currency"),
                F.when(n % 6 == 5, F.lit("none")).otherwise(F.lit("api")).alias("method"),
                _pick(CATEGORIES, n % 4).alias("category"),
                (n % 4 != 3).alias("index_contributor"),
                (n % 7 != 6).alias("active"),
            )
        )

    def readings(self) -> DataFrame:
        """Every shelf reading: one per line item, with an id that follows the day.

        The id strings day, order, line, part and supplier together, each in digits of its own,
        so two lines have equal ids only if they agree in all five.
        """
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        keep = 100 - F.round(F.col("l_discount") * 100).cast("bigint")
        day = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
        order_line = placed(placed(day, F.col("l_orderkey"), 12), F.col("l_linenumber"), 2)
        part_supplier = placed(F.col("l_partkey"), F.col("l_suppkey"), 8)
        line = self.raw("lineitem").select(
            placed(order_line, part_supplier, 18).alias("id"),
            line_of("l_partkey").alias("sku"),
            F.col("l_suppkey").alias("s_suppkey"),
            F.col("l_shipdate").cast("timestamp").alias("observed_at"),
            cents.alias("cents"),
            keep.alias("keep"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
        )
        whole = F.expr("(2 * cents * keep + 100 * quantity) div (200 * quantity)")
        return line.join(self.suppliers(), "s_suppkey").select(
            "id",
            _store_id(F.col("s_nationkey")).alias("store_id"),
            "sku",
            "observed_at",
            (whole.cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)"))
            .cast("decimal(12,4)")
            .alias("price"),
        )

    def lines(self) -> DataFrame:
        """Product lines: parts sold under the name and size of the one with the lowest key."""
        first = [F.min_by(c, "p_partkey").alias(c) for c in ("p_name", "p_type", "p_size")]
        part = self.raw("part").groupBy(line_of("p_partkey").alias("sku"))
        return part.agg(*first, F.count("*").alias("parts"))

    def _labelled(self, products: DataFrame) -> DataFrame:
        """`products`, with store_id and sku, and the label and size they show at that store.

        Some stores leave the size off a label or measure the product otherwise.
        """
        return self._label(products.join(self.lines(), "sku"), products.columns)

    def _label(self, products: DataFrame, kept: list[str]) -> DataFrame:
        """The `kept` columns of products joined with their lines, with label and size."""
        sku, n = F.col("sku"), F.substring("store_id", 3, 9).cast("int")
        unsized = (7 * sku + 3 * n) % 41 == 0
        uom = _pick(UOMS, ((sku % 20) % 3 + F.when((5 * sku + 2 * n) % 37 == 1, 1).otherwise(0)) % 3)
        shown = products.withColumn("size_base_uom", uom)
        size = F.when(F.col("size_base_uom") == "count", F.col("p_size")).otherwise(
            F.col("p_size") * 100
        )
        return shown.select(
            *kept,
            "size_base_uom",
            F.when(~unsized, size).cast("double").alias("size_quantity"),
            F.concat_ws(" ", "p_name", "p_type", "p_size").alias("name"),
            F.when(~unsized, F.concat_ws(" ", "p_size", "size_base_uom")).alias("unit"),
        )

    def price_observations(self) -> DataFrame:
        steps = change_only(self.readings(), ["store_id", "sku"], cuts=self.id_cuts())
        return self.with_unit_prices(steps)

    def with_unit_prices(self, steps: DataFrame) -> DataFrame:
        """Price steps with their store's currency and the unit price by the product's size.

        Sizes meet the steps by store and product, as change detection has laid them out, and not
        by product line: half of all steps are of few lines.
        """
        shops = self.stores().agg(F.collect_list(F.struct("store_id", "currency"))).scalar()
        shelves = self.lines().withColumn("shop", F.explode(shops)).select("*", "shop.*")
        sizes = self._label(shelves, ["store_id", "sku", "currency"])
        quantity, uom = F.col("size_quantity"), F.col("size_base_uom")
        return (
            steps.join(sizes, ["store_id", "sku"])
            .select(
                "id",
                "store_id",
                product_key_of(F.col("sku")).alias("product_key"),
                "observed_at",
                "price",
                "currency",
                unit_price(F.col("price"), quantity, uom).alias("unit_price"),
                F.when(quantity.isNotNull(), basis_of(uom)).alias("unit_price_basis"),
                "change",
                "previous_price",
                "delta",
            )
        )

    def products(self) -> DataFrame:
        seen = (
            self.readings()
            .groupBy("store_id", "sku")
            .agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))
        )
        sku = F.col("sku")
        key = product_key_of(sku)
        return self._labelled(seen).select(
            "store_id",
            key.alias("product_key"),
            "name",
            F.concat(F.lit("https://shop.example/"), "store_id", F.lit("/"), key).alias("url"),
            "unit",
            "size_quantity",
            "size_base_uom",
            F.when(sku % 5 == 0, "multipack").when(sku % 7 == 0, "range").otherwise("plain")
            .alias("size_form"),
            (sku % 11 == 0).alias("size_approximate"),
            "first_seen",
            "last_seen",
        )

    def items(self) -> DataFrame:
        """Every product line is a tracked item; fifteen of the staples are the fixed basket.

        Half of all readings are of staples, so the basket's history grows with the input.
        """
        i = F.col("sku")
        core = i < 15
        uom = _pick(INDEX_UOMS, i % 3)
        sizes = {c: f"{n + 1} pack" for n, c in enumerate(CURRENCIES) if n % 2 == 0}
        return self.lines().select(
            _item_key(i).alias("key"),
            F.col("p_name").alias("label"),
            F.when(core, "core").when(i < 18, "stretch").otherwise("registered").alias("tier"),
            _pick(UOMS, i % 3).alias("normal_unit"),
            F.when(i % 4 != 3, F.lit(json.dumps(sizes))).alias("target_size"),
            F.when(core | (i % 53 == 20), 1 + i % 5).cast("double").alias("index_quantity"),
            F.when(core, uom)
            .when(i % 53 == 20, _pick(INDEX_UOMS, (i + i % 2) % 3))
            .alias("index_uom"),
        )

    def _pinned(self) -> DataFrame:
        """Pins: i is an item's product line, n the nation of a store that has shown it."""
        lines = self.raw("lineitem").select(
            line_of("l_partkey").alias("i"), F.col("l_suppkey").alias("s_suppkey")
        )
        pins = lines.join(self.suppliers(), "s_suppkey")
        return pins.select("i", F.col("s_nationkey").alias("n")).distinct()

    def basket_map(self) -> DataFrame:
        i, n = F.col("i"), F.col("n")
        missing = (i + n) % 11 == 0
        return self._pinned().select(
            _item_key(i).alias("item_key"),
            _store_id(n).alias("store_id"),
            F.when(~missing, product_key_of(i)).alias("product_key"),
            F.when(missing, "not_stocked")
            .when((i + n) % 3 == 0, "curated")
            .otherwise("verified")
            .alias("status"),
            F.when((i + n) % 4 == 0, F.concat(i.cast("string"), F.lit(" units")))
            .alias("target_size"),
            F.when((i * n) % 13 == 1, 2).otherwise(0).alias("missed_runs"),
        )

    def pin_gaps(self) -> DataFrame:
        i, n = F.col("i"), F.col("n")
        start = F.date_add(F.lit(date(1997, 1, 1)), ((31 * i + 17 * n) % 900).cast("int"))
        return self._pinned().select(
            _store_id(n).alias("store_id"),
            product_key_of(i).alias("product_key"),
            start.cast("timestamp").alias("from_at"),
            F.when((i + n) % 9 != 0, F.date_add(start, (20 + (i + n) % 60).cast("int")))
            .cast("timestamp")
            .alias("to_at"),
        )

    def _events(self, *types: str) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        events = self.raw("events").select("event_id", "ts", "user_id", "event_type", k.alias("k"))
        return events.filter(F.col("event_type").isin(*types)) if types else events

    def runs(self) -> DataFrame:
        status = F.lit(None).cast("string")
        for event_type, name in RUN_STATUS.items():
            status = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(status)
        return self._events().select(
            F.col("event_id").alias("id"),
            _store_id(F.col("user_id") % 25).alias("store_id"),
            F.col("ts").cast("timestamp").alias("at"),
            status.alias("status"),
            (F.col("k") * 10).cast("int").alias("rows"),
            (F.col("k").cast("decimal(5,2)") * F.lit(0.25).cast("decimal(3,2)"))
            .cast("decimal(5,2)")
            .alias("null_rate_pct"),
        )

    def incidents(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        kind = _pick(INCIDENT_KINDS, k % 6)
        opened = F.date_add(F.lit(date(1995, 1, 1)), ((7 * e) % 2500).cast("int"))
        resolved = F.when(e % 4 != 0, F.date_add(opened, (k % 30).cast("int")))
        full = F.concat(
            F.lit('{"kind":"'), kind,
            F.lit('","failedChecks":[{"check":"nulls","severity":"hard","detail":"d"}],'
                  '"sampleBadRows":[],"sampleGoodRows":[],"fieldNullRates":{"price":0.25},'
                  '"baselineNullRates":{},"rowCount":'), k.cast("string"),
            F.lit(',"expectedRowCount":'), (k * 2).cast("string"), F.lit("}"),
        )
        loose = F.concat(F.lit('{"rows":'), k.cast("string"), F.lit(',"reason":"'),
                         F.when(e % 2 == 0, "r").otherwise(""), F.lit('"}'))
        return self._events("error").select(
            F.concat(F.lit("inc"), F.lpad(e.cast("string"), 12, "0")).alias("id"),
            _store_id(F.col("user_id") % 25).alias("store_id"),
            kind.alias("kind"),
            F.when(e % 3 == 0, full).when(e % 3 == 1, loose).otherwise("42").alias("evidence"),
            F.when(resolved.isNotNull(), "resolved").when(e % 8 == 0, "manual").otherwise("open")
            .alias("state"),
            opened.cast("timestamp").alias("opened_at"),
            resolved.cast("timestamp").alias("resolved_at"),
        )

    def alerts(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        return self._events("purchase").select(
            F.concat(F.lit("al"), F.lpad(e.cast("string"), 12, "0")).alias("id"),
            _pick(ALERT_KINDS, k % 3).alias("kind"),
            F.when(k % 2 == 0, "email").otherwise("chat").alias("channel"),
            F.col("ts").cast("timestamp").alias("sent_at"),
        )

    def bulletins(self) -> DataFrame:
        """One row per series and period with the series attributes, computed once."""
        if self._bulletins is None:
            self._bulletins = checkpointed(self._grouped_bulletins())
        return self._bulletins

    def _grouped_bulletins(self) -> DataFrame:
        src, com, srp = F.col("src"), F.col("com"), F.col("srp")
        keyed = (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("src", F.substring("o_orderpriority", 1, 1).cast("int"))
            .withColumn(
                "com",
                F.when(src == 3, 1)
                .when(F.col("o_orderstatus") == "F", 1)
                .when(F.col("o_orderstatus") == "O", 2)
                .otherwise(3),
            )
            .withColumn(
                "seg",
                F.when(src.isin(1, 4), F.array_position(
                    F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
                ).otherwise(0).cast("int"),
            )
            .withColumn("nat", F.when(src.isin(1, 4), F.col("n_nationkey") + 1).otherwise(0))
            .withColumn("srp", F.when(src == 5, F.col("o_custkey") % 4800).otherwise(0))
            .withColumn("place", F.when(F.col("nat") > 0, F.col("n_name")).otherwise(""))
            .withColumn("region", F.when(F.col("nat") > 0, F.col("r_name")).otherwise(""))
            .withColumn("day", F.to_date("o_orderdate"))
            .withColumn(
                "period_start",
                F.when(src <= 2, F.trunc("day", "week"))
                .when(src == 4, F.col("day"))
                .otherwise(F.trunc("day", "month")),
            )
            .withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
        )
        grouped = keyed.groupBy(
            "src", "com", "seg", "nat", "srp", "place", "region", "period_start"
        ).agg(F.min("cents").alias("low"), F.max("cents").alias("high"))

        def money(cents: str) -> Column:
            whole = F.expr(
                f"(2 * {cents} + if(src = 5, 100, 1000)) div (2 * if(src = 5, 100, 1000))"
            )
            return (whole.cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(
                "decimal(12,2)"
            )

        series_id = (
            ((src.cast("bigint") * 10 + com) * 10 + F.col("seg")) * 100 + F.col("nat")
        ) * 10_000 + srp
        start = F.col("period_start")
        return grouped.select(
            series_id.alias("series_id"),
            _pick(SOURCES, src - 1).alias("source"),
            F.when(src == 1, _pick(FUELS, com - 1))
            .when(src == 2, "adjustment")
            .when(src == 3, "lpg")
            .when(src == 4, _pick(MARKET_GROUPS, com - 1))
            .otherwise(_pick(SRP_GROUPS, com - 1))
            .alias("commodity"),
            F.when(src == 2, _pick(FUEL_FAMILIES, com - 1))
            .when(src == 4, F.lower(_pick(["", *SEGMENTS], F.col("seg"))))
            .when(src == 5, F.concat_ws(
                " ", _pick(SRP_ADJECTIVES, srp % 8),
                _pick(SRP_NOUNS, F.floor(srp / 8) % 8)))
            .otherwise("")
            .alias("variant"),
            F.when(src == 1, _pick(["", *SEGMENTS], F.col("seg"))).otherwise("").alias("brand"),
            "region",
            "place",
            F.when(src <= 2, "litre")
            .when(src == 3, "11-kg cylinder")
            .when(src == 4, "kg")
            .otherwise((1 + srp % 50).cast("string"))
            .alias("unit"),
            start.alias("period_start"),
            F.when(src <= 2, F.date_add(start, 6))
            .when(src == 4, start)
            .otherwise(F.last_day(start))
            .alias("period_end"),
            money("low").alias("price_min"),
            money("high").alias("price_max"),
        )

    def gov_series(self) -> DataFrame:
        return self.bulletins().select(
            F.col("series_id").alias("id"),
            "source", "commodity", "variant", "brand", "region", "place", "unit",
        ).distinct()

    def gov_prices(self) -> DataFrame:
        return self.bulletins().select(
            "series_id", "period_start", "period_end", "price_min", "price_max", "source"
        )

    def gov_documents(self) -> DataFrame:
        """The bulletins read so far: one per source and period."""
        source, start = F.col("source"), F.col("period_start")
        url = F.concat_ws("/", F.lit("https://bulletins.example"), source, start.cast("string"))
        return (
            self.bulletins()
            .groupBy("source", "period_start", "period_end")
            .agg(F.count("*").cast("int").alias("rows"))
            .select(
                "source", url.alias("url"), F.concat_ws(" ", source, start.cast("string"))
                .alias("title"), "period_start", "period_end",
                F.col("period_end").cast("timestamp").alias("fetched_at"), "rows",
            )
        )

    def baselines(self) -> DataFrame:
        before = self.table("price_observations").filter(F.col("observed_at") < F.lit(HISTORY_MIDDLE))
        return quality.build_baselines(before)


class StarStream(StarSource):
    """The same derivations with chosen tables read as streams of files."""

    def __init__(self, spark: SparkSession, folder: str, streamed: tuple[str, ...]):
        super().__init__(spark, folder)
        self.streamed = streamed

    def raw(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().raw(name)
        return (
            self.spark.readStream.schema(INPUT[name])
            .option("pathGlobFilter", f"{name}*.parquet")
            .parquet(self.folder)
        )
