"""Streams give the batch answer, whatever the micro-batches, repeats and late rows."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from shelfindex.operators.changes import change_only
from shelfindex.streaming import events as streams
from shelfindex.streaming import history as price_history
from shelfindex.streaming.history import PriceHistory
from shelfindex.streaming.sinks import run_available
from tests.conftest import at

READING = """store_id string, product_key string, id bigint, observed_at timestamp,
    price decimal(12,4)"""
KEYS = ["store_id", "product_key"]


def readings(spark, n=200, seed=5):
    rng = random.Random(seed)
    rows = [("s", "hot" if rng.random() < 0.5 else f"k{i % 7}", i, at(1 + i * 27 // n),
             Decimal(rng.choice([1, 2, 3]))) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, READING)


def in_files(spark, df, folder, cuts):
    """A stream of one micro-batch per id range."""
    for low, high in zip(cuts, cuts[1:]):
        df.filter((F.col("id") > low) & (F.col("id") <= high)).coalesce(1).write.mode(
            "append").parquet(folder)
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
            .option("latestFirst", False).parquet(folder))


def rows_of(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


STEP = [*KEYS, "id", "price", "change", "previous_price", "delta"]


def test_steps_equal_the_batch(spark, tmp_path):
    df = readings(spark)
    stream = in_files(spark, df, f"{tmp_path}/in", [0, 40, 41, 120, 200])
    history = PriceHistory(spark, f"{tmp_path}/out", every=2)
    history.run(stream)
    assert rows_of(history.read_steps(), *STEP) == rows_of(change_only(df, KEYS), *STEP)
    newest = df.groupBy(*KEYS).agg(F.max("id").alias("id"))
    assert rows_of(history.latest.current(), *KEYS, "id") == rows_of(newest, *KEYS, "id")
    assert history.read_late().count() == 0
    versions = [r.version for r in spark.read.parquet(f"{tmp_path}/out/latest").select(
        "version").distinct().collect()]
    assert len(versions) == 4  # micro-batches


def test_restart_continues_from_the_kept_state(spark, tmp_path):
    df = readings(spark)
    first = in_files(spark, df, f"{tmp_path}/in", [0, 70])
    PriceHistory(spark, f"{tmp_path}/out").run(first)
    second = in_files(spark, df, f"{tmp_path}/in", [70, 150, 200])
    history = PriceHistory(spark, f"{tmp_path}/out")
    history.run(second)
    assert rows_of(history.read_steps(), *STEP) == rows_of(change_only(df, KEYS), *STEP)


def test_late_and_repeated_readings_are_kept_apart(spark, tmp_path):
    """Three micro-batches: each brings again some readings, and some it should have had before."""
    df = readings(spark)
    late = df.filter("id % 10 = 3 and id <= 110")
    on_time = df.join(late.select("id"), "id", "left_anti").select(*df.columns)
    parts = [
        on_time.filter("id <= 80").unionByName(on_time.filter("id <= 5")),
        on_time.filter("id > 80 and id <= 140").unionByName(late.filter("id <= 60")),
        on_time.filter("id > 130").unionByName(late.filter("id > 60")),
    ]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    history = PriceHistory(spark, f"{tmp_path}/out")
    history.run(stream)

    applied, passed = {}, []
    for part in parts:  # the same, reading by reading
        for r in sorted(part.collect(), key=lambda r: r.id):
            if r.id > applied.get(r.product_key, [0])[-1]:
                applied.setdefault(r.product_key, []).append(r.id)
            else:
                passed.append((r.product_key, r.id))
    ids = [i for found in applied.values() for i in found]
    expected = change_only(df.filter(F.col("id").isin(ids)), KEYS)
    assert rows_of(history.read_steps(), *STEP) == rows_of(expected, *STEP)
    kept = history.read_late().collect()
    assert sorted((r.product_key, int(r.id)) for r in kept) == sorted(passed)
    assert {r.reason for r in kept} == {"late", "repeated"}
    delivered = sum(part.count() for part in parts)
    assert len(ids) + len(kept) == delivered  # nothing is lost untold
    newest = [(k, str(max(v))) for k, v in applied.items()]
    assert rows_of(history.latest.current(), "product_key", "id") == sorted(newest)


def test_batch_recorded_again_changes_nothing(spark, tmp_path):
    df = readings(spark)
    stream = in_files(spark, df, f"{tmp_path}/in", [0, 90, 200])
    history = PriceHistory(spark, f"{tmp_path}/out", every=2)
    twice = lambda changes, batch: [history.record(changes, batch) for _ in range(2)]
    run_available(history.changes(stream), f"{tmp_path}/log", twice)
    assert rows_of(history.read_steps(), *STEP) == rows_of(change_only(df, KEYS), *STEP)


def test_runs_once_and_daily(spark, tmp_path):
    rows = [(i, f"s{i % 3}", at(1 + i // 10, i % 24), "error" if i % 4 == 0 else "ok", i)
            for i in range(60)]
    runs = spark.createDataFrame(
        rows, "id bigint, store_id string, at timestamp, status string, rows int")
    for part in (runs.filter("id < 30"), runs.filter("id >= 20")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = (spark.readStream.schema(runs.schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{tmp_path}/in"))
    once = streams.write_feed(streams.unique_runs(stream), f"{tmp_path}/once")
    assert rows_of(once, "id", "rows") == rows_of(runs, "id", "rows")

    whole = spark.readStream.schema(runs.schema).parquet(f"{tmp_path}/once/events")
    daily = streams.write_daily(spark, streams.daily_runs(whole, "30 days"), f"{tmp_path}/daily")
    expected = runs.groupBy("store_id", F.to_date("at").alias("d")).agg(
        F.count("*").alias("runs"), F.sum("rows").alias("rows"))
    assert rows_of(daily, "store_id", "d", "runs", "rows") == rows_of(
        expected, "store_id", "d", "runs", "rows")


def test_resume_after(spark):
    events = spark.createDataFrame(
        [(at(1), "run", "1"), (at(1), "run", "2"), (at(2), "alert", "1")],
        "at timestamp, source string, id string")
    left = streams.resume_after(events, at(1), "run", "1").orderBy("at", "source", "id").collect()
    assert [(r.source, r.id) for r in left] == [("run", "2"), ("alert", "1")]


def test_products_share_rows_of_state(spark, tmp_path, monkeypatch):
    """State and calls follow groups of products; each product still has its own steps."""
    monkeypatch.setattr(price_history, "SHELVES", 3)
    rows = [("s" if i % 2 else None, f"k{i % 40}", i, at(1 + i // 20), Decimal(i % 3 + 1))
            for i in range(1, 400)]
    df = spark.createDataFrame(rows, READING)
    stream = in_files(spark, df, f"{tmp_path}/in", [0, 150, 399])
    history = PriceHistory(spark, f"{tmp_path}/out")
    spark.conf.set(price_history.STATE_STORE, price_history.ROCKS)
    query = run_available(history.changes(stream), history.checkpoint, history.record)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert rows_of(history.read_steps(), *STEP) == rows_of(change_only(df, KEYS), *STEP)


def test_steps_that_nobody_keeps_are_not_made(spark, tmp_path):
    df = readings(spark, 60)
    stream = in_files(spark, df.unionByName(df.filter("id <= 5")), f"{tmp_path}/in", [0, 60])
    kinds = []
    run_available(
        PriceHistory(spark, f"{tmp_path}/out").changes(stream, steps=False), f"{tmp_path}/log",
        lambda changes, batch: kinds.extend(r.kind for r in changes.select("kind").collect()))
    assert kinds.count("late") == 5 and set(kinds) == {"late", "latest"}


def test_ids_of_38_digits_survive_padded_batches(spark, tmp_path):
    """Python gets ids as longs; where Spark pads its batches of results no digit is lost."""
    high = 10**38 - 1
    ids = [-high, 1 - high, -(2**64), -1, 0, 2**63, 2**64, 2**64 + 1, high - 1, high]
    rows = [(f"s{k}", "k", Decimal(i), at(1 + n), Decimal(n)) for k in range(12) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, READING.replace("id bigint", "id decimal(38,0)"))
    for n in range(len(ids)):  # every group brings one reading per batch
        df.filter(F.col("price") == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 3)
    try:
        history = PriceHistory(spark, f"{tmp_path}/out")
        history.run(stream)
    finally:
        spark.conf.set(size, before)
    assert rows_of(history.read_steps(), *STEP) == rows_of(change_only(df, KEYS), *STEP)
    assert history.read_late().count() == 0
    assert {int(r.id) for r in history.latest.current().collect()} == {high}


def test_null_prices_and_times_equal_the_batch(spark, tmp_path):
    """A price that is null after one that is not is no step; the next one is new again."""
    prices = [1, None, 1, 1, None, None, 2, 3, None]
    rows = [(s, p, 10 * n + k, None if n % 2 else at(1 + n), None if c is None else Decimal(c))
            for k, (s, p) in enumerate([("s", None), (None, "p"), (None, None), ("s", "p")])
            for n, c in enumerate(prices)]
    df = spark.createDataFrame(rows, READING)
    stream = in_files(spark, df, f"{tmp_path}/in", [-1, 35, 90])
    history = PriceHistory(spark, f"{tmp_path}/out")
    history.run(stream)
    wanted = [*STEP, "observed_at"]
    assert rows_of(history.read_steps(), *wanted) == rows_of(change_only(df, KEYS), *wanted)
    assert {(int(r.id), r.price) for r in history.latest.current().collect()} == {
        (80 + k, None) for k in range(4)}


def test_python_gets_no_object_per_number(spark, tmp_path):
    """A decimal or a time is a Python object per reading; whole numbers come and go as arrays."""
    stream = in_files(spark, readings(spark, 20), f"{tmp_path}/in", [0, 20])
    plan = PriceHistory(spark, f"{tmp_path}/out").changes(stream)._jdf.queryExecution().analyzed()
    while "FlatMapGroupsInPandasWithState" not in plan.nodeName():
        plan = plan.children().head()
    for schema in (plan.schema(), plan.children().head().schema()):
        assert "decimal" not in schema.simpleString() and "timestamp" not in schema.simpleString()
