"""Operators against brute force on small tables, skewed and sliced ones included."""

import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfindex.operators.asof import daily_values, lowest, outside_gaps, running, value_spans
from shelfindex.operators.changes import change_only
from shelfindex.operators import ordered
from shelfindex.operators.ordered import (
    latest_by, range_number, slice_cuts, top_by, with_neighbour,
)
from shelfindex.operators.quantile import exact_quantiles
from shelfindex.operators.similar import similar_names
from tests.conftest import at

KEYS = ["store_id", "product_key"]


def history(spark, rows):
    return spark.createDataFrame(
        [("s", k, i, at(d), Decimal(str(p))) for k, i, d, p in rows],
        "store_id string, product_key string, id bigint, observed_at timestamp, "
        "price decimal(12,4)",
    )


def skewed(spark, rows=600, seed=3):
    """One key holds most of the rows, and prices repeat."""
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, 1 + i * 28 // rows,
             rng.choice([1, 2, 3])) for i in range(rows)]
    rng.shuffle(data)
    return history(spark, data)


def every(width):
    """Slices of that many ids."""
    return [] if width is None else list(range(width, 700, width))


def brute_changes(rows):
    last, out = {}, []
    for r in sorted(rows, key=lambda r: r.id):
        before = last.get(r.product_key)
        if before is None or before != r.price:
            out.append((r.product_key, r.id, before))
        last[r.product_key] = r.price
    return sorted(out)


def test_repeated_prices_are_not_steps(spark):
    df = history(spark, [("a", i, i, p) for i, p in enumerate([10, 10, 9, 9, 10], start=1)])
    rows = change_only(df, KEYS).orderBy("id").collect()
    assert [(r.id, r.change, r.delta) for r in rows] == [
        (1, "new", None), (3, "price", Decimal("-1.0000")), (5, "price", Decimal("1.0000"))]


@pytest.mark.parametrize("width", [None, 1, 7, 50, 10_000])
def test_changes_in_slices(spark, width):
    df = skewed(spark)
    found = change_only(df, KEYS, cuts=every(width)).collect()
    assert sorted((r.product_key, r.id, r.previous_price) for r in found) == brute_changes(
        df.collect())


@pytest.mark.parametrize("width", [None, 1, 13, 10_000])
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbours_in_slices(spark, width, ahead):
    df = skewed(spark, 300)
    found = with_neighbour(df, KEYS, "id", {"near": "id"}, ahead=ahead, cuts=every(width)).collect()
    by_key = {}
    for r in sorted(df.collect(), key=lambda r: r.id, reverse=ahead):
        by_key.setdefault(r.product_key, [None]).append(r.id)
    expected = {b: a for ids in by_key.values() for a, b in zip(ids, ids[1:])}
    assert {r.id: r.near for r in found} == expected


@pytest.mark.parametrize("most", [1, 20, 100])
@pytest.mark.parametrize("ahead", [False, True])
def test_only_crowded_keys_are_sliced(spark, most, ahead):
    df = skewed(spark, 300)
    found = with_neighbour(
        df, KEYS, "id", {"near": "id"}, ahead=ahead, cuts=every(13), most=most).collect()
    by_key = {}
    for r in sorted(df.collect(), key=lambda r: r.id, reverse=ahead):
        by_key.setdefault(r.product_key, [None]).append(r.id)
    expected = {b: a for ids in by_key.values() for a, b in zip(ids, ids[1:])}
    assert {r.id: r.near for r in found} == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_uncrowded_keys_take_one_shuffle(spark):
    df = skewed(spark).repartition(3)
    whole = with_neighbour(df, KEYS, "id", {"near": "id"}, cuts=every(50))
    assert plan_of(whole).count("Exchange hashpartitioning") == 1
    sliced = with_neighbour(df, KEYS, "id", {"near": "id"}, cuts=every(50), most=100)
    assert plan_of(sliced).count("Exchange hashpartitioning") > 1


def test_ids_are_cut_only_for_crowded_keys(spark, monkeypatch):
    asked = []
    cut = ordered.slice_cuts
    monkeypatch.setattr(ordered, "slice_cuts", lambda *a: asked.append(a) or cut(*a))
    df = skewed(spark, 300)
    cuts = ordered.cuts_if_needed(lambda: df, "id", 300, 50)
    whole = with_neighbour(df, KEYS, "id", {"near": "id"}, cuts=cuts)
    assert asked == [] and plan_of(whole).count("Exchange hashpartitioning") == 1
    sliced = [with_neighbour(df, KEYS, "id", {"near": "id"}, cuts=cuts, most=20) for _ in range(2)]
    assert len(asked) == 1 and len(cuts()) == 5
    for found in sliced:
        assert sorted(found.collect()) == sorted(whole.collect())
    assert ordered.cuts_if_needed(lambda: df, "id", 300, 300) == ()


def test_latest_reduces_by_hash_before_the_shuffle(spark):
    """Texts and nulls go with the newest row, and the whole input is not sorted for it."""
    rows = [("s", f"k{i % 5}", i, "new" if i % 3 else None, None if i % 4 else Decimal(i))
            for i in range(1, 101)]
    df = spark.createDataFrame(
        rows, "store_id string, product_key string, id bigint, change string, price decimal(12,4)")
    newest = latest_by(df, KEYS, "id", ["change", "price"])
    assert {(r.product_key, r.change, r.price) for r in newest.collect()} == {
        (r[1], r[3], r[4]) for r in rows[-5:]}
    assert "HashAggregate" in plan_of(newest)


def test_a_stray_id_leaves_slices_even(spark):
    far = spark.range(1, 20_001).unionByName(spark.createDataFrame([(10**17,), (-(10**17),)], "id long"))
    cuts = slice_cuts(far, "id", 20_002, target=1_000)
    rows = far.groupBy(range_number(F.col("id"), cuts).alias("slice")).count().collect()
    sizes = [r["count"] for r in rows]
    assert len(sizes) == 21 and max(sizes) <= 2 * min(sizes)
    assert slice_cuts(far, "id", 20_002, target=30_000) == []


def test_range_numbers_of_long_ids(spark):
    ids = [Decimal(10**36 + n) for n in range(5)]
    df = spark.createDataFrame([(i,) for i in ids], "id decimal(38,0)")
    found = df.select("id", range_number(F.col("id"), [ids[1], ids[3]]).alias("n")).collect()
    assert sorted((r.id, r.n) for r in found) == list(zip(ids, [0, 1, 1, 2, 2], strict=True))


def test_latest_and_top(spark):
    df = skewed(spark)
    newest = {r.product_key: r.id for r in latest_by(df, KEYS, "id", ["id", "price"]).collect()}
    ids = {}
    for r in df.collect():
        ids.setdefault(r.product_key, []).append(r.id)
    assert newest == {k: max(v) for k, v in ids.items()}
    top = {}
    for r in top_by(df, KEYS, [F.col("id").desc()], 3).collect():
        top.setdefault(r.product_key, []).append(r.id)
    assert {k: sorted(v) for k, v in top.items()} == {k: sorted(v)[-3:] for k, v in ids.items()}


def spans_of(spark, rows, until):
    df = history(spark, rows).withColumn("day", F.to_date("observed_at"))
    return value_spans(df, KEYS, "day", "id", "price", F.lit(date(2024, 1, until)))


def carried(spark, rows, until=6):
    return daily_values(spans_of(spark, rows, until))


def shown(df):
    return sorted((r.product_key, r.d.day, float(r.price)) for r in df.collect())


def test_id_beats_date(spark):
    days = shown(carried(spark, [("a", 1, 1, 1), ("a", 3, 2, 3), ("a", 2, 3, 2)], until=4))
    assert days == [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 3.0), ("a", 4, 3.0)]


def test_asof_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), i, rng.randrange(1, 7), i) for i in rng.sample(range(1, 99), 40)]
    expected = []
    for key in "abc":
        for day in range(1, 7):
            known = [r for r in rows if r[0] == key and r[2] <= day]
            if known:
                expected.append((key, day, float(max(known, key=lambda r: r[1])[3])))
    assert shown(carried(spark, rows)) == sorted(expected)


GAPS = "store_id string, product_key string, from_at timestamp, to_at timestamp"


def test_gaps_are_half_open(spark):
    spans = spans_of(spark, [("a", 1, 1, 1), ("b", 2, 1, 2)], until=5)
    gaps = spark.createDataFrame(
        [("s", "a", at(2), at(4)), ("s", "b", at(4), None), ("other", "a", at(1), None)], GAPS)
    left = [(k, d) for k, d, _ in shown(daily_values(outside_gaps(spans, gaps, KEYS, KEYS, "price")))]
    assert left == [("a", 1), ("a", 4), ("a", 5), ("b", 1), ("b", 2), ("b", 3)]


def random_spans(spark, seed, days=28):
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), i, rng.randrange(1, days), rng.randrange(1, 9))
            for i in rng.sample(range(1, 99), 40)]
    return spans_of(spark, rows, days)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlapping_gaps_against_days(spark, seed):
    rng = random.Random(seed)
    spans = random_spans(spark, seed)
    gaps = []
    for _ in range(9):
        start = rng.randrange(1, 28)
        end = rng.choice([None, rng.randrange(1, 28)])
        gaps.append(("s", rng.choice("abcd"), at(start), end and at(end)))
    expected = [
        (k, d, p) for k, d, p in shown(daily_values(spans))
        if not any(k == g[1] and g[2].day <= d and (g[3] is None or d < g[3].day) for g in gaps)
    ]
    found = outside_gaps(spans, spark.createDataFrame(gaps, GAPS), KEYS, KEYS, "price")
    assert shown(daily_values(found)) == expected


@pytest.mark.parametrize("stretch", [3, 1024])
def test_lowest_and_running_against_days(spark, stretch):
    spans = random_spans(spark, 7)
    daily = {}
    for _, d, price in shown(daily_values(spans)):
        daily.setdefault(d, []).append(price)
    low = lowest(spans, ["store_id"], "price", stretch)
    assert {r.d.day: float(r.price) for r in daily_values(low).collect()} == {
        d: min(v) for d, v in daily.items()}
    sums = daily_values(running(spans, ["store_id"], {"total": F.col("price") * 2})).collect()
    assert {r.d.day: (r["count"], float(r.total)) for r in sums if r["count"]} == {
        d: (len(v), 2 * sum(v)) for d, v in daily.items()}
    if stretch == 1024:  # as few spans as the lowest price has steps
        steps = [min(daily[d]) for d in sorted(daily)]
        assert low.count() == 1 + sum(a != b for a, b in zip(steps, steps[1:], strict=False))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(-30_000, 90_000)),
                min_size=1, max_size=60), st.sampled_from([0.5, 1.0, 1000.0]))
def test_exact_quantiles(spark, values, bucket):
    df = spark.createDataFrame(
        [(k, Decimal(v).scaleb(-4)) for k, v in values], "k string, v decimal(12,4)")
    found = {r.k: r for r in exact_quantiles(
        df, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, bucket).collect()}
    for key in {k for k, _ in values}:
        numbers = [v / 1e4 for k, v in values if k == key]
        expected = np.quantile(numbers, [0.05, 0.5, 0.95])
        assert np.allclose([found[key].p5, found[key].p50, found[key].p95], expected)
        assert found[key].total == len(numbers)


def test_quantiles_of_a_hot_group(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("k"),
        (F.col("id") * 37 % 5003 / 100).cast("decimal(12,4)").alias("v"))
    found = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    plain = df.groupBy("k").agg(F.percentile(F.col("v").cast("double"), F.lit(0.5)).alias("m"))
    assert found == pytest.approx({r.k: r.m for r in plain.collect()})


def test_calendar_length(spark):
    days = shown(carried(spark, [("a", 1, 2, 1)], until=31))
    first = date(2024, 1, 2)
    assert len(days) == (date(2024, 1, 31) - first + timedelta(1)).days


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["red", "rice", "riced", "bolt", "bolts", "small", "smaller", "x", "jasmine"]
    rows = {(rng.choice([1.0, 2.0]), " ".join(rng.sample(words, rng.randint(1, 4)))) for _ in range(120)}
    rows |= {(1.0, ""), (1.0, "!!")}

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.split() if w.isalnum() for i in range(len(w) + 1)}

    def share(a, b):
        either = grams(a) | grams(b)
        return len(grams(a) & grams(b)) / len(either) if either else 0.0

    for at_least in (0.3, 0.5, 0.8):
        df = spark.createDataFrame(sorted(rows), "size double, name string")
        found = similar_names(df, ["size"], at_least).collect()
        assert sorted((r.size, r.name, r.other) for r in found) == sorted(
            (s, a, b) for s, a in rows for t, b in rows if s == t and share(a, b) >= at_least)
