"""Every registered query against its SQL, and the shape of the plans."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import compare, connect
from checks.registry import registered
from shelfindex.plans import bulletins, catalog
from shelfindex.plans.catalog import Search
from shelfindex.session import shared_folder, size_shuffles
from shelfindex.sources import star
from shelfindex.sources.sinks import as_documents, with_source, write_documents, write_table
from shelfindex.sources.star import StarSource, product_key_of
from shelfindex.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"
PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registered()))
def test_against_sql(spark, connection, name):
    problem, _ = compare(spark, connection, FOLDER, queries()[name], oracle_sql()[name])
    assert problem is None


def test_documents_cover_every_bulletin(spark):
    tables = StarSource(spark, FOLDER).tables()
    documents = tables.gov_documents
    assert documents.count() == documents.select("source", "url").distinct().count()
    assert documents.agg({"rows": "sum"}).first()[0] == tables.gov_prices.count()


def test_shuffles_grow_with_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows, expected in ((10, least), (10**9, 500), (10**12, 500_000)):
        size_shuffles(spark, rows)
        assert int(spark.conf.get(key)) == expected
    size_shuffles(spark, 1)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        conf = {}

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_every_part_line_and_event_takes_part(spark):
    source = StarSource(spark, FOLDER)
    tables = source.tables()
    parts = source.lines().agg({"parts": "sum"}).first()[0]
    assert parts == source.raw("part").count()
    readings = source.readings()
    assert readings.count() == source.raw("lineitem").count()
    assert readings.select("id").distinct().count() == source.raw("lineitem").distinct().count()
    kinds = {r[0]: r[1] for r in source.raw("events").groupBy("event_type").count().collect()}
    assert tables.incidents.count() == kinds["error"] and tables.alerts.count() == kinds["purchase"]


def test_the_basket_grows_with_the_input_and_is_complete_on_most_days(spark):
    def core_readings(folder):
        source = StarSource(spark, folder)
        tables = source.tables()
        core = tables.items.filter("tier = 'core'").select(F.col("key").alias("item_key"))
        pins = source.basket_map().join(core, "item_key").filter("product_key is not null")
        keyed = source.readings().withColumn("product_key", product_key_of(F.col("sku")))
        return keyed.join(pins, ["store_id", "product_key"], "left_semi").count()

    assert core_readings("/root/testdata/sf0.01") > 9 * core_readings(FOLDER)
    assert core_readings("/root/testdata/sf0.1") > 9 * core_readings("/root/testdata/sf0.01")
    days = queries()["basket_index"](spark, "/root/testdata/sf0.01")
    assert days.filter("total is not null").count() > 0.8 * days.count()


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registered() if not n.startswith("stream")])
def test_no_pairwise_joins(spark, name):
    plan = plan_of(queries()[name](spark, FOLDER))
    assert not any(operator in plan for operator in PAIRWISE)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The domain tables written out and read back with their declared schemas."""
    root = str(tmp_path_factory.mktemp("tables"))
    source = StarSource(spark, FOLDER)
    tables = source.tables()
    for name in ("stores", "products", "price_observations", "gov_series", "gov_prices"):
        write_table(getattr(tables, name), root, name)
    return Tables.from_parquet(spark, root, currencies=tables.currencies), tables, root


def test_round_trip(stored):
    read, derived, _ = stored
    assert read.as_of == derived.as_of
    for name in ("products", "price_observations", "gov_series"):
        a, b = getattr(read, name), getattr(derived, name)
        assert a.schema.simpleString() != "" and a.count() == b.count()
        assert a.select(*b.columns).exceptAll(b).count() == 0


def test_bulletins_prune_partitions(stored):
    read, _, _ = stored
    plan = plan_of(bulletins.lpg(read))
    assert "doe_lpg" in plan
    scans = [line for line in plan.split("FileScan") if "/gov_" in line]
    assert len(scans) >= 2 and all("PartitionFilters: [isnotnull(source" in scan for scan in scans)


def test_bulletin_prices_take_the_source_of_their_series(stored):
    read, derived, _ = stored
    bare = derived.gov_prices.drop("source")
    assert with_source(bare, derived.gov_series).exceptAll(derived.gov_prices).count() == 0
    whole = Tables(read.spark, lambda name: bare if name == "gov_prices" else getattr(derived, name),
                   derived.as_of, derived.currencies)
    assert bulletins.lpg(whole).exceptAll(bulletins.lpg(read)).count() == 0


def test_history_is_read_narrowly(stored):
    """Filters reach the scan and only needed columns are read."""
    read, _, _ = stored
    plan = plan_of(catalog.product_history(read, "st13", "k014"))
    assert "EqualTo(store_id,st13)" in plan and "EqualTo(product_key,k014)" in plan
    assert "previous_price" not in plan
    spark_plan = plan_of(catalog.sparkline(read))
    assert "WindowGroupLimit" in spark_plan and "currency" not in spark_plan


def test_pages_take_the_top_only(stored):
    read, _, _ = stored
    found, key = catalog.search_keys(read, Search(limit=5))
    assert "TakeOrderedAndProject" in plan_of(found.orderBy(*key).limit(6))


def test_documents(spark, stored, tmp_path):
    read, _, _ = stored
    nested = bulletins.market_rows(read)
    documents = as_documents(nested, "commodity")
    assert documents.first().document.startswith('{"commodity":')
    write_documents(nested, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == nested.count()


def test_line_items_stay_where_they_are_read_while_suppliers_are_few(spark, tmp_path, monkeypatch):
    day = datetime(1998, 1, 5)
    lines = [(n, 2 + n % 3, 1 + n % 4, 1, 1.0, 5.0 + n, 0.0, day) for n in range(40)]
    suppliers = [(1, 3), (2, 4), (2, 4), (3, None), (None, 5)]
    for name, rows in ("lineitem", lines), ("supplier", suppliers):
        made = spark.createDataFrame(rows, star.INPUT[name])
        made.write.parquet(f"{tmp_path}/{name}.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = []
    try:
        for most in (star.MOST_SENT, 2):
            monkeypatch.setattr(star, "MOST_SENT", most)
            source = StarSource(spark, str(tmp_path))
            for df in (source.readings(), source._pinned()):
                plan = df._jdf.queryExecution().executedPlan().toString()
                assert ("SortMergeJoin" in plan) == (most == 2)
                found.append(sorted(map(str, df.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found[:2] == found[2:] and len(found[0]) == 40
