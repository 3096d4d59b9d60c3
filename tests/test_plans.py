"""Whole plans on small hand-made tables: ties, pages, gaps, drops, data-quality spans."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfindex.functions import cursor
from shelfindex.plans import basket, bulletins, catalog, health, index, pins, quality
from shelfindex.plans.catalog import Search
from tests.conftest import at


def store(store_id, **more):
    return dict(store_id=store_id, name=store_id.upper(), country="PH", currency="PHP",
                method="api", category="grocery", index_contributor=True, active=True) | more


def item(key, quantity=1.0, **more):
    return dict(key=key, label=key, tier="core", normal_unit="g", index_quantity=quantity,
                index_uom="kg") | more


def pin(item_key, store_id, product_key, **more):
    return dict(item_key=item_key, store_id=store_id, product_key=product_key, status="verified",
                missed_runs=0) | more


def product(store_id, product_key, name="Rice 1kg", **more):
    return dict(store_id=store_id, product_key=product_key, name=name, url="https://x/y",
                unit="1 kg", size_quantity=1000, size_base_uom="g", size_form="plain",
                size_approximate=False, first_seen=at(1), last_seen=at(31)) | more


def price(id, store_id, product_key, day, amount, **more):
    return dict(id=id, store_id=store_id, product_key=product_key, observed_at=at(day),
                price=amount, currency="PHP", unit_price=amount, unit_price_basis="per_kg",
                change="price", previous_price=None, delta=None) | more


@pytest.fixture(scope="module")
def shop(tiny):
    """Two stores, two items, a gap, an unpriced pin and an outlier-free median."""
    return tiny(
        as_of=date(2024, 1, 6),
        stores=[store("a"), store("b"), store("c", active=False),
                store("d", index_contributor=False)],
        items=[item("rice", 2.0), item("salt", 1.0), item("tea", None, tier="stretch")],
        basket_map=[pin("rice", "a", "r"), pin("rice", "b", "r"), pin("salt", "a", "s"),
                    pin("salt", "b", "s", missed_runs=2), pin("rice", "c", "r"),
                    pin("rice", "d", "r"), pin("salt", "d", "none")],
        products=[product(s, k) for s in "abcd" for k in "rs"],
        price_observations=[
            price(1, "a", "r", 1, 10), price(2, "b", "r", 2, 10), price(3, "a", "s", 2, 3),
            price(4, "b", "s", 2, 4), price(5, "a", "r", 4, 9), price(6, "d", "r", 1, 1),
            price(7, "c", "r", 1, 1)],
        pin_gaps=[dict(store_id="a", product_key="s", from_at=at(3), to_at=at(5)),
                  dict(store_id="b", product_key="s", from_at=at(3), to_at=None)],
        incidents=[dict(id="i1", store_id="a", kind="drift", state="resolved", opened_at=at(2),
                        resolved_at=at(3)),
                   dict(id="i2", store_id="b", kind="drift", state="open", opened_at=at(4)),
                   dict(id="i3", store_id="c", kind="drift", state="open", opened_at=at(1))],
    )


def test_index(shop):
    rows = index.basket_index(shop).orderBy("d").collect()
    assert [(r.d.day, r.priced, r.missing, None if r.total is None else float(r.total))
            for r in rows] == [
        (1, 1, ["salt"], None), (2, 2, [], 23.0), (3, 1, ["salt"], None), (4, 1, ["salt"], None),
        (5, 2, [], 21.0), (6, 2, [], 21.0)]
    for r in rows:
        assert (r.total is None) == bool(r.missing)


def test_gaps_take_the_incident_of_their_first_day(shop):
    rows = index.index_gaps(shop).orderBy("from_day").collect()
    assert [(r.from_day.day, r.to_day.day, r.incident_id) for r in rows] == [
        (1, 1, None), (3, 4, "i1")]
    explained = {r.d.day: r.incident_id for r in index.index_annotated(shop).collect()}
    assert explained == {1: None, 2: None, 3: "i1", 4: "i2", 5: None, 6: None}


def test_every_store_has_every_day(shop):
    series = index.store_series(shop)
    assert series.groupBy("store_id").count().filter("count <> 6").count() == 0
    totals = {(r.store_id, r.d.day): r for r in series.collect()}
    assert float(totals["b", 3].total) == 20.0 and totals["b", 3].partial
    assert totals["b", 1].total is None and not totals["b", 1].partial


def test_item_without_a_quantity_nulls_every_day(tiny):
    tables = tiny(
        as_of=date(2024, 1, 2), stores=[store("a")],
        items=[item("rice"), item("salt", None, index_uom=None)],
        basket_map=[pin("rice", "a", "r"), pin("salt", "a", "s")],
        products=[product("a", "r"), product("a", "s")],
        price_observations=[price(1, "a", "r", 1, 10), price(2, "a", "s", 1, 3)])
    rows = index.basket_index(tables).collect()
    assert {(tuple(r.missing), r.total, r.expected) for r in rows} == {(("salt",), None, 2)}


def test_rails_label_ties_and_keep_unpriced_pins(tiny):
    stores = "abce"
    tables = tiny(
        stores=[store(s) for s in stores], items=[item("rice")],
        basket_map=[pin("rice", s, "r") for s in stores] ,
        products=[product(s, "r") for s in stores],
        price_observations=[price(1, "a", "r", 1, 10), price(2, "b", "r", 1, 10),
                            price(3, "c", "r", 1, 101)])
    rows = {r.store_id: r for r in basket.rails(tables).collect()}
    assert rows["a"].cheapest and rows["b"].cheapest
    assert rows["c"].suspect and rows["c"].flag_reason.startswith("more than 10x")
    assert rows["a"].dearest and rows["b"].dearest and not rows["c"].dearest
    assert rows["e"].unit_price is None and rows["e"].flag == "ok" and not rows["e"].cheapest
    nested = basket.rails_nested(tables).first()
    assert [p.store_id for p in nested.pins] == ["a", "b", "e", "c"]
    assert basket.quality_worklist(tables).count() == 2
    assert pins.thin_items(tables).count() == 0


def test_stale_pins(shop):
    rails = {(r.item_key, r.store_id): r for r in basket.rails(shop).collect()}
    assert rails["salt", "b"].unit_price is None
    assert ("salt", "b") not in {(r.item_key, r.store_id) for r in basket.today(shop).collect()}
    today = {r.item_key: (r.store_id, float(r.contribution)) for r in basket.today(shop).collect()}
    assert today == {"rice": ("a", 18.0), "salt": ("a", 3.0)}


@pytest.fixture(scope="module")
def shelf(tiny):
    """Thirteen listed products, some unpriced, one unlisted."""
    names = ["Red widget", "red ring", "Blue widget 5kg", "widget red", "Old rod"]
    products = [product("a", f"k{i:02}", names[i % 5], last_seen=at(31)) for i in range(13)]
    products.append(product("a", "old", "Red widget", last_seen=at(20)))
    prices = [price(i + 1, "a", f"k{i:02}", 20, 5 + i % 4) for i in range(10)]
    return tiny(stores=[store("a"), store("z", active=False)], products=products,
                price_observations=prices)


@pytest.mark.parametrize("search", [
    dict(), dict(sort="unit_price"), dict(q="red widget"), dict(q="red widget", sort="unit_price"),
])
def test_pages_join_up(shelf, search):
    whole = catalog.search_page(shelf, Search(limit=200, **search))
    assert whole.next_cursor is None
    rows, seen, keys = [], None, []
    while True:
        page = catalog.search_page(shelf, Search(limit=3, cursor=seen, **search))
        rows += page.items
        assert page.next_cursor == catalog.search_cursor(
            shelf, Search(limit=3, cursor=seen, **search))
        if page.next_cursor is None:
            break
        seen = page.next_cursor
    keys = [r.product_key for r in rows]
    assert keys == [r.product_key for r in whole.items]
    assert "old" not in keys
    if search.get("sort") == "unit_price" and "q" not in search:
        assert keys[-3:] == ["k10", "k11", "k12"]


def test_foreign_cursor_starts_over(shelf):
    priced = catalog.search_page(shelf, Search(sort="unit_price", limit=3)).next_cursor
    first = catalog.search_page(shelf, Search(limit=3))
    again = catalog.search_page(shelf, Search(limit=3, cursor=priced))
    assert [r.product_key for r in first.items] == [r.product_key for r in again.items]


def test_drops(tiny):
    stores = [store("a")]
    steps = [price(1, "a", "deep", 1, 100), price(2, "a", "deep", 10, 100),
             price(3, "a", "deep", 28, 80, delta=-20, previous_price=100),
             price(4, "a", "thin", 28, 80, delta=-20, previous_price=100),
             price(5, "a", "mild", 10, 100), price(6, "a", "mild", 28, 95, delta=-5),
             price(7, "a", "early", 2, 100), price(8, "a", "early", 20, 50, delta=-50)]
    tables = tiny(stores=stores, price_observations=steps,
                  products=[product("a", k, k) for k in ("deep", "thin", "mild", "early")])
    rows = catalog.drops(tables).collect()
    assert [(r.product_key, r.median30, r.pct_below) for r in rows] == [("deep", 100.0, 0.2)]
    assert [s.d for s in rows[0].spark] == ["2024-01-01", "2024-01-10", "2024-01-28"]
    medians = {r.product_key: (r.median30, r.steps)
               for r in catalog.median_price(tables).collect()}
    assert medians["deep"] == (100.0, 3) and medians["early"] == (75.0, 2)


def test_opening_step_counts_once(tiny):
    steps = [price(i, "a", "k", 1, 10 * i) for i in range(1, 4)]
    late = [price(9, "a", "k", 20, 50)]
    tables = tiny(as_of=date(2024, 2, 10), price_observations=steps + late)
    row = catalog.median_price(tables).first()
    assert (row.median30, row.steps) == (40.0, 2)


def test_sparkline_keeps_the_newest_thirty(tiny):
    steps = [price(i, "a", "k", 1 + i % 28, i) for i in range(1, 41)]
    row = catalog.sparkline(tiny(price_observations=steps)).first()
    assert [int(s.p) for s in row.spark] == list(range(11, 41))
    assert not row.falling


def test_same_size(tiny):
    tables = tiny(
        stores=[store("a"), store("b"), store("c", active=False)],
        products=[product("a", "k", "Jasmine rice"), product("b", "k", "Jasmine rice 1kg"),
                  product("b", "m", "Engine oil"), product("c", "k", "Jasmine rice"),
                  product("b", "n", "Jasmine rice", size_quantity=500)])
    assert [r.product_key for r in catalog.same_size(tables, "a", "k").collect()] == ["k"]


def test_same_size_of_all_products(tiny):
    """A store with many listings of one name never crowds out the others' matches."""
    crowd = [product("a", f"k{n}", "Jasmine rice") for n in range(9)]
    tables = tiny(
        stores=[store("a"), store("b"), store("c"), store("d", active=False)],
        products=[*crowd, product("b", "k", "Jasmine rice"), product("c", "k", "Jasmine rice 1kg"),
                  product("d", "k", "Jasmine rice"), product("c", "m", "Engine oil")])
    found = {}
    for r in catalog.same_size_all(tables, limit=2).collect():
        found.setdefault((r.store_id, r.product_key), []).append((r.other_store, r.other_key))
    assert {k: sorted(v) for k, v in found.items()} == {
        **{("a", f"k{n}"): [("b", "k"), ("c", "k")] for n in range(9)},
        ("b", "k"): [("a", "k0"), ("a", "k1")],
        ("c", "k"): [("a", "k0"), ("a", "k1")],
    }


def test_same_size_keeps_few_places_per_name(tiny):
    """However many names are alike, a name's places are twice the limit, and any store finds its own."""
    listed = [product(s, f"k{n:02}", f"Jasmine rice premium long grain {n:02}")
              for s in "abc" for n in range(12)]
    tables = tiny(stores=[store(s) for s in "abc"], products=listed)
    alike = tables.products.select(
        F.lit("any").alias("name"), F.col("store_id").alias("other"), "product_key")
    kept = catalog.first_elsewhere(alike, ["name"], "other", [F.col("product_key")], 3)
    assert kept.count() == 6 and kept.groupBy("other").count().agg(F.max("count")).first()[0] <= 3
    found = catalog.same_size_all(tables, limit=3).groupBy("store_id", "product_key").count()
    assert {r["count"] for r in found.collect()} == {3} and found.count() == 36


def test_only_products_of_the_tiers_are_reduced(tiny):
    tables = tiny(
        stores=[store("a")], items=[item("rice"), item("soap", tier="registered")],
        basket_map=[pin("rice", "a", "r"), pin("soap", "a", "s"), pin("rice", "a", None)],
        products=[product("a", "r"), product("a", "s")],
        price_observations=[price(1, "a", "r", 1, 10), price(2, "a", "s", 1, 10),
                            price(3, "a", "r", 1, 12), price(4, "a", "other", 1, 1)])
    assert [(r.product_key, int(r.id)) for r in pins.pinned_days(tables).collect()] == [("r", 3)]
    both = pins.pinned_days(tables, ("core", "registered")).collect()
    assert sorted((r.product_key, int(r.id)) for r in both) == [("r", 3), ("s", 2)]


def series(id, source, **more):
    return dict(id=id, source=source, commodity="c", variant="", brand="", region="", place="",
                unit="u") | more


def test_bulletin_search_takes_text_literally(tiny):
    tables = tiny(
        gov_series=[series(1, "dti_srp", commodity="Fish", variant="100% tuna"),
                    series(2, "dti_srp", commodity="Fish", variant="1000 tuna"),
                    series(3, "dti_srp", commodity="Milk", variant="Fresh")],
        gov_prices=[dict(series_id=i, period_start=date(2024, 1, 1),
                         period_end=date(2024, 1, 31), price_min=i, price_max=i)
                    for i in (1, 2, 3)]
        + [dict(series_id=3, period_start=date(2023, 12, 1), period_end=date(2023, 12, 31),
                price_min=9, price_max=9)])
    names = lambda q: {r["product"] for r in bulletins.srp_search(tables, q).collect()}
    assert names("0% T") == {"100% tuna"}
    assert names("fish") == {"100% tuna", "1000 tuna"}
    assert names(None) == {"100% tuna", "1000 tuna", "Fresh"}
    top = catalog.srp_reference(tables, "fish tuna").collect()
    assert [float(r.price) for r in top] == [1.0, 2.0]
    assert catalog.srp_reference(tables, "%").count() == 0


def test_feed_pages_join_up(tiny):
    tables = tiny(
        stores=[store("a")],
        runs=[dict(id=i, store_id="a", at=at(1 + i // 3), status="error", rows=i)
              for i in range(8)] + [dict(id=99, store_id="a", at=at(9), status="ok", rows=1)],
        incidents=[dict(id="i", store_id="a", kind="drift", state="resolved", opened_at=at(1),
                        resolved_at=at(3))],
        alerts=[dict(id="x", kind="unknown", channel="email", sent_at=at(2))])
    whole = health.feed_page(tables, 200)
    assert len(whole.items) == 11 and whole.next_cursor is None
    seen, ids = None, []
    while True:
        page = health.feed_page(tables, 2, seen)
        ids += [r.event_id for r in page.items]
        seen = page.next_cursor
        if seen is None:
            break
    assert ids == [r.event_id for r in whole.items]
    assert cursor.decode_feed(ids[0])["t"] == "2024-01-03T00:00:00.000000Z"
    by_id = {r.id: r for r in whole.items}
    assert by_id["i:resolved"].summary == "A recovered: drift incident closed"
    assert by_id["i:opened"].feed_kind == "breakage"
    assert by_id["x"].store_name == "fleet"


def test_pin_gaps_from_pulls(spark):
    days = {"r": [1, 2, 5, 6], "s": [1, 2, 3, 4, 5, 6], "t": [1, 3, 5]}
    rows = [("a", k, at(d)) for k, ds in days.items() for d in ds]
    readings = spark.createDataFrame(
        rows, "store_id string, product_key string, observed_at timestamp")
    wanted = spark.createDataFrame([("a", "r"), ("a", "t")], "store_id string, product_key string")
    found = quality.dq_pin_gaps(readings, wanted).collect()
    assert [(r.product_key, r.from_day.day, r.to_day.day, r.missed) for r in found] == [
        ("r", 3, 5, 2)]
    trailing = quality.dq_pin_gaps(readings.filter("product_key <> 'r' or observed_at < '2024-01-04'"),
                                   wanted).filter("product_key = 'r'").first()
    assert (trailing.from_day.day, trailing.to_day, trailing.missed) == (3, None, 4)


def test_mass_change(spark):
    seen = [("a", f"k{i}", at(d)) for d in (1, 2) for i in range(20)]
    readings = spark.createDataFrame(
        seen, "store_id string, product_key string, observed_at timestamp")
    changes = readings.filter("day(observed_at) = 2 and product_key <> 'k0'").withColumn(
        "change", F.lit("price"))
    rows = {r.d.day: (r.seen, r.changed, r.suppressed)
            for r in quality.dq_mass_change(readings, changes, 10).collect()}
    assert rows == {1: (20, 0, False), 2: (20, 19, True)}
    assert quality.dq_mass_change(readings, changes, 21).count() == 0


def test_integrity(tiny):
    tables = tiny(
        stores=[store("a")], items=[item("rice"), item("bad", 1.0, index_uom="l")],
        products=[product("a", "k"), product("a", "k")],
        price_observations=[price(1, "a", "k", 1, 1), price(1, "a", "gone", 1, 1)],
        runs=[dict(id=1, store_id="nowhere", at=at(1), status="ok", rows=1)])
    found = {r.check: r.rows for r in quality.dq_orphans(tables).collect()}
    assert found["price_observations primary key"] == 1
    assert found["products primary key"] == 1
    assert found["price_observations to products"] == 1
    assert found["runs to stores"] == 1
    assert found["basket_map to items"] == 0
    assert [r.key for r in quality.dq_items(tables).collect()] == ["bad"]


def test_schema_rules(tiny):
    tables = tiny(
        products=[product("a", "k"), product("a", "m", url="nope")],
        price_observations=[price(1, "a", "k", 1, 1), price(2, "a", "k", 1, 0),
                            price(3, "a", "m", 1, 1), price(4, "a", "m", 1, -1)])
    row = quality.dq_schema(tables).first()
    assert (row.records, row.rejected, row.bad_price, row.bad_unit) == (4, 3, 2, 0)


def test_restricted_history(tiny, spark):
    tables = tiny(price_observations=[price(i, "a", f"k{i % 4}", 30, i) for i in range(1, 13)])
    among = spark.createDataFrame([("a", "k1"), ("a", "k2")], "store_id string, product_key string")
    stats = catalog.product_stats(tables, among).collect()
    assert {(r.product_key, float(r.low90), r.median30) for r in stats} == {
        ("k1", 1.0, 5.0), ("k2", 2.0, 6.0)}
    products = among.withColumn("name", F.lit("x"))
    latest = {r.product_key: r.price for r in catalog.with_latest(products, tables).collect()}
    assert latest == {"k1": 9, "k2": 10}


def test_clocks_do_not_follow_the_drivers_zone(tiny, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "Asia/Manila")
    time.tzset()
    try:
        row = tiny().spark.range(1).select(
            tiny(as_of=date(2024, 1, 31)).now.cast("string").alias("now"),
            health._moment("2024-01-31T00:00:00Z").cast("string").alias("z"),
            health._moment("2024-01-31T08:00:00+08:00").cast("string").alias("offset"),
        ).first()
    finally:
        monkeypatch.undo()
        time.tzset()
    assert tuple(row) == ("2024-01-31 00:00:00",) * 3


def test_fuel_week_with_two_ends_and_an_absent_product(tiny):
    def series(n, commodity):
        return {"id": n, "source": bulletins.PUMP, "commodity": commodity, "region": "R",
                "place": "p", "brand": "b", "variant": "", "unit": "litre"}

    def week(n, end, low):
        return {"series_id": n, "period_start": date(2024, 1, 1), "period_end": date(2024, 1, end),
                "price_min": low, "price_max": low + 1}

    tables = tiny(gov_series=[series(1, "RON 95"), series(2, "RON 95")],
                  gov_prices=[week(1, 6, 50), week(2, 7, 40)])
    (row,) = bulletins.fuel_range(tables, "R", "RON 95").collect()
    assert (row.period_end, row.low, row.high) == (date(2024, 1, 7), 40, 51)
    (row,) = bulletins.fuel_range(tables, "R", "DIESEL").collect()
    assert (row.period_end, row.low) == (date(2024, 1, 7), None)


def test_recent_lpg_months_break_ties_by_series(tiny):
    tables = tiny(
        gov_series=[{"id": n, "source": bulletins.LPG, "unit": "u"} for n in range(1, 10)],
        gov_prices=[{"series_id": n, "period_start": date(2024, 1, 1),
                     "period_end": date(2024, 1, 31), "price_min": n, "price_max": n}
                    for n in (9, 3, 7, 1, 5, 8, 2, 6, 4)],
    )
    assert [r.series_id for r in bulletins.lpg_recent(tables).collect()] == [1, 2, 3, 4, 5, 6]


def test_junk_numbers_in_a_cursor_fall_back_to_page_one():
    for value in ("abc", "NaN", "Infinity", "1e999", "--1", ""):
        raw = cursor.encode({"o": "unit_price", "v": value, "s": "a", "k": "b"})
        assert cursor.decode_search(raw, "unit_price") is None
    raw = cursor.encode({"o": "relevance", "v": "-0.5", "s": "a", "k": "b"})
    assert cursor.decode_search(raw, "relevance")["v"] == "-0.5"


def test_ids_differ_at_any_size(spark):
    from shelfindex.sources.star import placed

    n = 300_000
    ids = spark.range(n).select(
        placed(
            placed(placed(F.lit(10_000), F.col("id") % 299_993, 12), F.col("id") % 7, 2),
            placed(F.col("id") % 49_999, F.col("id") % 1_000_003, 8), 18,
        ).alias("reading")
    )
    assert ids.distinct().count() == n


def test_a_change_log_gives_one_event_per_record(tiny):
    opened = {"id": "i1", "store_id": "a", "kind": "nulls", "state": "open", "opened_at": at(1)}
    closed = {**opened, "state": "resolved", "resolved_at": at(2)}
    table = tiny(incidents=[opened, closed]).incidents
    log = table.withColumn("phase", F.when(F.col("state") == "open", "opened").otherwise("resolved"))
    assert sorted(r.id for r in health.incident_events(log).collect()) == ["i1:opened", "i1:resolved"]
    once = tiny(incidents=[closed]).incidents
    assert sorted(r.id for r in health.incident_events(once).collect()) == ["i1:opened", "i1:resolved"]
