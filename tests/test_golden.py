"""Hand-worked cases with known answers."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from shelfindex.functions import cursor
from shelfindex.functions.incidents import evidence_reason, incident_summary, salvaged_evidence
from shelfindex.functions.prices import move_pct, pct_below, spread_label, unit_price
from shelfindex.functions.text import search_text, similarity, tokens, tokens_column, word_similarity
from shelfindex.operators.paging import take_page
from shelfindex.plans import health, ranking
from shelfindex.plans.bulletins import fuel_family
from shelfindex.plans.catalog import Search, collapse_listings, drops
from shelfindex.plans.index import dense_store_days
from tests.conftest import at

PINS = """country string, item_key string, label string, index_quantity double, store_id string,
    store_name string, index_contributor boolean, product_name string, unit_price decimal(16,6),
    flag string, cheapest boolean"""


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.fixture(scope="module")
def pins(spark):
    def pin(item, quantity, store, price, contributor=True, flag="ok"):
        return ("PH", item, item, quantity, store, store, contributor, f"{item} at {store}",
                price, flag, False)

    from decimal import Decimal as D

    rows = [
        pin("rice", 5.0, "alpha", D("1")),
        pin("rice", 5.0, "bravo", D("2")),
        pin("rice", 5.0, "costless", D("0.5"), contributor=False),
        pin("rice", 5.0, "sus", D("0.1"), flag="suspect"),
        pin("eggs", 12.0, "alpha", D("3")),
        pin("eggs", 12.0, "bravo", D("2")),
        pin("coffee", None, "delta", D("3")),
    ]
    return spark.createDataFrame(rows, PINS)


def test_store_ranking(pins):
    rows = ranking.store_ranking(pins).orderBy("place").collect()
    assert [(r.store_id, float(r.total), r.mean_ratio, r.covered, r.priceable) for r in rows] == [
        ("alpha", 41.0, 1.25, 2, 2),
        ("bravo", 34.0, 1.5, 2, 2),
    ]
    assert all(r.complete for r in rows)


def test_ignored_and_order(pins):
    ignored = {r.store_id: (r.reason, r.mean_ratio) for r in ranking.store_ignored(pins).collect()}
    assert ignored == {
        "costless": ("not counted by the index", 0.5),
        "delta": ("no comparable price", None),
    }
    order = [r.store_id for r in ranking.store_order(pins).orderBy("place").collect()]
    assert order == ["costless", "alpha", "bravo", "delta"]


def test_basket_spread(pins):
    row = ranking.basket_spread(pins).first()
    assert (float(row.low), float(row.high)) == (34.0, 41.0)
    alone = ranking.basket_spread(pins.filter("store_id <> 'bravo'")).first()
    assert alone.low is None and alone.high is None


def test_grid(spark, pins):
    from decimal import Decimal as D

    def pin(item, store, price, flag="ok"):
        return ("PH", item, item, 1.0, store, store, True, item, D(str(price)), flag, False)

    grid = spark.createDataFrame(
        [pin("rice", "a", 1), pin("rice", "b", 2), pin("rice", "c", 4),
         pin("eggs", "b", 3), pin("eggs", "c", 2), pin("eggs", "d", 9, "suspect")],
        PINS,
    )
    cells = {(r.item_key, r.store_id): r for r in ranking.terrain_grid(grid).collect()}
    assert {k: r.ratio for k, r in cells.items()} == {
        ("rice", "a"): 1.0, ("rice", "b"): 2.0, ("rice", "c"): 4.0,
        ("eggs", "b"): 1.5, ("eggs", "c"): 1.0,
    }
    assert {r.max_ratio for r in cells.values()} == {4.0}
    assert cells["rice", "a"].height == 0
    assert math.isclose(cells["rice", "c"].height, math.log(4) / math.log(8))
    gaps = [(r.item_key, r.store_id) for r in ranking.grid_gaps(grid).collect()]
    assert gaps == [("eggs", "a")]
    one_store = grid.filter("store_id = 'b'")
    assert ranking.terrain_grid(one_store).count() == 0
    assert ranking.terrain_grid(grid.filter("false")).count() == 0


def test_height_cap(spark):
    from decimal import Decimal as D

    rows = [("PH", item, item, 1.0, store, store, True, item, D(price), "ok", False)
            for item, store, price in [("x", "a", "1"), ("x", "b", "8"), ("x", "c", "32"),
                                       ("y", "a", "1"), ("y", "b", "1")]]
    grid = ranking.terrain_grid(spark.createDataFrame(rows, PINS)).collect()
    cells = {(r.item_key, r.store_id): (r.height, r.capped) for r in grid}
    assert cells["x", "b"] == (1.0, False)
    assert cells["x", "c"] == (1.0, True)


def test_excluded_fraction(spark, pins):
    row = ranking.excluded_fraction(pins).first()
    assert math.isclose(row.fraction, 1 / 7 / 0.35)
    assert ranking.excluded_fraction(pins.filter("flag = 'suspect'")).first().fraction == 1
    assert ranking.excluded_fraction(pins.filter("false")).count() == 0


def test_dense_store_days(spark, tiny):
    from decimal import Decimal as D

    tables = tiny(as_of=date(2024, 1, 3))
    days = spark.createDataFrame(
        [("PH", date(2024, 1, 1), "s", "Store", 15, 15, D("40")),
         ("PH", date(2024, 1, 3), "s", "Store", 9, 15, D("31.25"))],
        "country string, d date, store_id string, store_name string, priced bigint, "
        "expected bigint, total decimal(38,12)",
    )
    starts = spark.createDataFrame([("PH", date(2024, 1, 1))], "country string, first_day date")
    rows = dense_store_days(days, starts, tables).orderBy("d").collect()
    assert [(r.priced, r.expected, None if r.total is None else float(r.total), r.partial)
            for r in rows] == [(15, 15, 40.0, False), (0, 15, None, False), (9, 15, 31.25, True)]


def test_tokens(spark):
    assert tokens("Alaska  evap 370ml x") == ["alaska", "evap", "370ml"]
    assert tokens("50% off_") == ["50", "off"]
    assert tokens("rice rice") == ["rice"]
    assert len(tokens(" ".join(f"word{i}" for i in range(10)))) == 8
    for text in ("Alaska  evap 370ml x", "50% off_", "rice rice"):
        assert one(spark, tokens_column(F.lit(text))).c0 == tokens(text)


def test_query_rules():
    assert Search(q=None).order == Search(q="  ").order == "browse"
    assert Search(q="rice").order == "relevance"
    assert Search(sort="unit_price").order == "unit_price"
    for bad in ("r", "r" * 101):
        with pytest.raises(ValueError):
            search_text(bad)
    for limit in (0, 201):
        with pytest.raises(ValueError):
            Search(limit=limit)


def test_drop_limits(tiny):
    for limit in (0, 61):
        with pytest.raises(ValueError):
            drops(tiny(), limit=limit)


def test_percentages(spark):
    row = one(
        spark,
        pct_below(F.lit(82), F.lit(100)), pct_below(F.lit(299.5), F.lit(345)),
        pct_below(F.lit(10), F.lit(0)), move_pct(F.lit(1), F.lit(4)),
        move_pct(F.lit(1), F.lit(0)), move_pct(F.lit(None), F.lit(4)),
    )
    assert list(row) == [0.18, 0.132, 0.0, 25.0, 0.0, 0.0]


def test_spread_labels(spark):
    pairs = [(10, 15), (10, 20), (10, 25), (0, 5), (None, None)]
    row = one(spark, *[spread_label(F.lit(a).cast("double"), F.lit(b).cast("double"))
                       for a, b in pairs])
    assert list(row) == ["50%", "2.0x", "2.5x", "", ""]


def test_fuel_families(spark):
    names = ["RON 95", "RON 100", "DIESEL PLUS", "KEROSENE", "AUTO-LPG", "ron 91"]
    row = one(spark, *[fuel_family(F.lit(n)) for n in names])
    assert list(row) == ["gasoline", "gasoline", "diesel", "kerosene", "", "gasoline"]


def test_unit_price(spark):
    def of(price, size, uom):
        return unit_price(F.lit(price).cast("decimal(12,4)"), F.lit(size).cast("double"), F.lit(uom))

    row = one(spark, of("51.95", 50, "g"), of("12", 1500, "ml"), of("9", 12, "count"),
              of("9", None, "g"), of("9", 0, "g"))
    assert [None if v is None else float(v) for v in row] == [1039.0, 8.0, 0.75, None, None]


EVIDENCE = [
    ('{"rows": 250, "reason": "x"}', False, 250, "x"),
    (None, False, 0, None),
    ("some text", False, 0, None),
    ("42", False, 0, None),
    ("[1, 2]", False, 0, None),
    ('{"rowCount": "17.9", "reason": 5}', False, 17, None),
    ('{"kind":"rowcount","failedChecks":[],"sampleBadRows":[],"sampleGoodRows":[],'
     '"fieldNullRates":{},"baselineNullRates":{},"rowCount":0,"expectedRowCount":2641}',
     True, 0, None),
]


def test_evidence(spark):
    for text, complete, rows, reason in EVIDENCE:
        literal = F.lit(text).cast("string")
        row = one(spark, salvaged_evidence(literal), evidence_reason(literal))
        assert (row.c0.complete, row.c0.row_count, row.c1) == (complete, rows, reason), text


def test_incident_summaries(spark):
    full = EVIDENCE[-1][0]
    nothing = F.lit(None).cast("string")

    def summary(kind, text, reason=nothing):
        return incident_summary(F.lit(kind), salvaged_evidence(F.lit(text).cast("string")), reason)

    row = one(
        spark, summary("rowcount", full), summary("nulls", full), summary("drift", None),
        summary("error", None), summary("mass_change_suppressed", '{"rows": 7}'),
        summary("drift", None, F.lit("said so")),
    )
    assert list(row) == [
        "Row count 0, expected 2641",
        "Null rate spike on an unnamed field",
        "Prices moved outside the expected envelope",
        "Run failed",
        "Nearly every price moved at once (7 rows); the run was recorded but not applied",
        "said so",
    ]


def test_feed_cursor(spark):
    fields = {"t": "2024-01-02T03:04:05.000006Z", "s": "incident", "i": "inc1:opened~ü?>"}
    coded = cursor.encode(fields)
    assert cursor.decode_feed(coded) == fields
    for junk in (None, "", "%%%", coded[:-7], cursor.encode({"t": "x", "s": "run", "i": "1"}),
                 cursor.encode({**fields, "s": "other"}), cursor.encode({**fields, "i": 7})):
        assert cursor.decode_feed(junk) is None
    column = cursor.encoded(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))
    assert one(spark, column).c0 == coded


def test_search_cursor():
    tail = {"o": "unit_price", "v": None, "s": "st1", "k": "k1"}
    assert cursor.decode_search(cursor.encode(tail), "unit_price") == tail
    assert cursor.decode_search(cursor.encode(tail), "browse") is None
    assert cursor.decode_search("junk", "unit_price") is None
    del tail["v"]
    assert cursor.decode_search(cursor.encode(tail), "unit_price") is None


def test_probe_row(spark):
    rows = spark.range(4)
    assert take_page(rows, 3, lambda r: str(r.id)).next_cursor == "2"
    assert take_page(rows, 4, lambda r: str(r.id)).next_cursor is None
    assert take_page(rows.filter("false"), 3, lambda r: str(r.id)).next_cursor is None


def test_similarity(spark):
    row = one(
        spark, word_similarity(F.lit("word"), F.lit("two words")),
        similarity(F.lit("word"), F.lit("two words")), similarity(F.lit("a"), F.lit("a")),
        word_similarity(F.lit("rice"), F.lit("---")), similarity(F.lit(""), F.lit("")),
    )
    assert row.c0 == 0.8
    assert math.isclose(row.c1, 4 / 11)
    assert (row.c2, row.c3, row.c4) == (1.0, 0.0, 0.0)


def test_collapse_listings(spark):
    hits = spark.createDataFrame(
        [("s", "b", "Rice 5kg", 10.0), ("s", "a", "rice 5KG", 10.0), ("s", "c", "Rice 5kg", 11.0),
         ("t", "d", "Rice 5kg", None), ("t", "e", "rice 5kg", None)],
        "store_id string, product_key string, name string, price double",
    )
    rows = {(r.store_id, r.product_key): r.listings for r in collapse_listings(hits).collect()}
    assert rows == {("s", "a"): 2, ("s", "c"): 1, ("t", "d"): 2}


def test_store_states(spark, tiny):
    stores = [dict(store_id=s, name=s, country="PH", method="api", active=True) for s in "abcdef"]
    runs = [
        dict(id=i, store_id=s, at=at(day), status=status, rows=10, null_rate_pct=1)
        for i, (s, day, status) in enumerate(
            [("a", 1, "ok"), ("b", 1, "error"), ("c", 1, "blocked"), ("d", 1, "ok"),
             ("e", 1, "broken"), ("e", 2, "ok")])
    ]
    incidents = [
        dict(id="1", store_id="d", kind="drift", state="open", opened_at=at(1)),
        dict(id="2", store_id="b", kind="drift", state="manual", opened_at=at(1)),
        dict(id="3", store_id="a", kind="drift", state="resolved", opened_at=at(1)),
    ]
    board = health.fleet(tiny(stores=stores, runs=runs, incidents=incidents)).collect()
    assert {r.store_id: r.status for r in board} == {
        "a": "healthy", "b": "manual_attention", "c": "suspect", "d": "suspect", "e": "healthy",
        "f": "healthy",
    }
