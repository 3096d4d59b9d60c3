"""The event feed, replay-safe runs, and daily run figures as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfindex.functions.incidents import BAD_RUNS
from shelfindex.plans.health import merged_events, named_events
from shelfindex.streaming.sinks import Versions, run_available

DAILY = "store_id string, d date, runs bigint, rows bigint, bad_runs bigint, version_id bigint"


def feed_stream(
    runs: DataFrame,
    incidents: DataFrame,
    alerts: DataFrame,
    stores: DataFrame,
    delay: str | None = None,
) -> DataFrame:
    """The batch feed over streams, joined with the static store names.

    Incidents that are delivered once, closed or not, give both their events. Where an opening
    and a resolution are delivered separately, `incidents` is a change log: its column `phase`
    says what a record reports. With `delay`, an event delivered again within that time is left
    out; events that come later than `delay` behind the newest are then left out too.
    """
    events = merged_events(runs, incidents, alerts)
    if delay is not None:
        events = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["source", "id"])
    return named_events(events, stores)


def write_feed(events: DataFrame, root: str) -> DataFrame:
    """Append every event once; the file sink's log makes a repeated batch harmless."""
    query = (
        events.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{root}/events")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return events.sparkSession.read.schema(events.schema).parquet(f"{root}/events")


def resume_after(events: DataFrame, cursor_time, source: str, event_id: str) -> DataFrame:
    """Events after the last one a client saw, in stream order."""
    at = F.lit(cursor_time).cast("timestamp")
    later = F.struct("at", "source", "id") > F.struct(
        at.alias("at"), F.lit(source).alias("source"), F.lit(event_id).alias("id")
    )
    return events.filter(later)


def unique_runs(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each run id once, although a source may deliver it again within `delay`."""
    return runs.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def daily_runs(runs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Runs, rows and bad runs per store and day; days past the delay are closed."""
    return (
        runs.withWatermark("at", delay)
        .groupBy("store_id", F.window("at", "1 day").alias("day"))
        .agg(
            F.count("*").alias("runs"),
            F.sum("rows").alias("rows"),
            F.count(F.when(F.col("status").isin(*BAD_RUNS), 1)).alias("bad_runs"),
        )
        .select("store_id", F.to_date("day.start").alias("d"), "runs", "rows", "bad_runs")
    )


def write_daily(spark: SparkSession, figures: DataFrame, root: str) -> DataFrame:
    """Keep the newest figures per store and day from a stream in update mode."""
    store = Versions(spark, f"{root}/daily", DAILY, ["store_id", "d"], "version_id")

    def per_batch(rows: DataFrame, batch: int) -> None:
        store.apply(rows.withColumn("version_id", F.lit(batch).cast("bigint")), batch)

    run_available(figures, f"{root}/checkpoint", per_batch, mode="update")
    return store.current().drop("version_id")
