"""Fleet health, incidents, and the merged event feed."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfindex.functions import cursor as cursors
from shelfindex.functions.incidents import (
    BAD_RUNS,
    FLEET,
    evidence_reason,
    feed_kind,
    feed_summary,
    incident_kind,
    incident_state,
    incident_summary,
    run_status,
    salvaged_evidence,
    store_state,
)
from shelfindex.operators.paging import Page, after, probe, take_page
from shelfindex.sources.tables import Tables

FEED_COLUMNS = ["source", "id", "at", "store_id", "incident_id", "kind", "detail", "phase"]


def fleet(tables: Tables) -> DataFrame:
    """One row per store: its last run, its newest unresolved incident and the state they give."""
    last_run = tables.runs.groupBy("store_id").agg(
        F.max_by(F.struct("at", "rows", "status", "null_rate_pct"), F.struct("at", "id"))
        .alias("run")
    )
    unresolved = (
        tables.incidents.filter(F.col("state") != "resolved")
        .groupBy("store_id")
        .agg(F.max_by(F.struct("id", "state"), F.struct("opened_at", "id")).alias("incident"))
    )
    state = store_state(F.col("incident.state"), run_status(F.col("run.status")))
    pullable = F.col("active") & F.coalesce(F.col("method") != "none", F.lit(False))
    return (
        tables.stores.filter(tables.priced_countries(F.col("country")))
        .join(last_run, "store_id", "left")
        .join(unresolved, "store_id", "left")
        .select(
            "store_id",
            "name",
            "country",
            state.alias("status"),
            F.col("run.at").alias("last_run_at"),
            F.coalesce(F.col("run.rows"), F.lit(0)).alias("last_run_rows"),
            F.coalesce(F.col("run.null_rate_pct"), F.lit(0).cast("decimal(5,2)"))
            .alias("null_rate_pct"),
            F.when(state != "healthy", F.col("incident.id")).alias("open_incident_id"),
            pullable.alias("is_pullable"),
        )
    )


def fleet_totals(tables: Tables) -> DataFrame:
    """Stores and rows of their last pulls, per country."""
    return fleet(tables).groupBy("country").agg(
        F.count("*").alias("stores"), F.sum("last_run_rows").alias("rows_last_pull")
    )


def run_events(runs: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return runs.filter(F.col("status").isin(*BAD_RUNS)).select(
        F.lit("run").alias("source"), F.col("id").cast("string").alias("id"), "at", "store_id",
        none.alias("incident_id"), F.col("status").alias("kind"),
        F.col("rows").cast("string").alias("detail"), none.alias("phase"),
    )


def incident_events(incidents: DataFrame) -> DataFrame:
    """An incident's opening and, once it closed, its resolution: two events of one row.

    A change log has a column `phase`; each of its records is one change and gives one event.
    """
    moments = F.array(
        F.struct(
            F.lit("opened").alias("phase"), F.col("opened_at").alias("at"),
            F.col("state").alias("detail"),
        ),
        F.struct(
            F.lit("resolved").alias("phase"), F.col("resolved_at").alias("at"),
            F.lit("resolved").alias("detail"),
        ),
    )
    return (
        incidents.withColumn("moment", F.explode(moments))
        .filter(
            F.col("moment.phase") == F.col("phase") if "phase" in incidents.columns
            else (F.col("moment.phase") == "opened") | F.col("moment.at").isNotNull()
        )
        .select(
            F.lit("incident").alias("source"),
            F.concat_ws(":", "id", "moment.phase").alias("id"),
            F.col("moment.at").alias("at"),
            "store_id",
            F.col("id").alias("incident_id"),
            "kind",
            F.col("moment.detail").alias("detail"),
            F.col("moment.phase").alias("phase"),
        )
    )


def alert_events(alerts: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return alerts.select(
        F.lit("alert").alias("source"), "id", F.col("sent_at").alias("at"),
        none.alias("store_id"), none.alias("incident_id"), "kind",
        F.col("channel").alias("detail"), none.alias("phase"),
    )


def merged_events(runs: DataFrame, incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Runs that went wrong, both halves of incidents, and alerts, in one shape.

    Works alike on batch and streaming DataFrames.
    """
    return (
        run_events(runs)
        .unionByName(incident_events(incidents))
        .unionByName(alert_events(alerts))
    )


def named_events(events: DataFrame, stores: DataFrame) -> DataFrame:
    """Events with store name, feed kind, summary and a cursor that doubles as the event id."""
    names = stores.select("store_id", F.col("name").alias("store_name"))
    source, phase, kind = F.col("source"), F.col("phase"), F.col("kind")
    shown = F.coalesce("store_name", "store_id", F.lit("the fleet"))
    return events.join(names, "store_id", "left").select(
        cursors.encoded(
            F.struct(cursors.iso(F.col("at")).alias("t"), source.alias("s"), F.col("id").alias("i"))
        ).alias("event_id"),
        "source",
        "id",
        "at",
        "store_id",
        F.coalesce("store_name", F.lit(FLEET)).alias("store_name"),
        feed_kind(source, phase, kind).alias("feed_kind"),
        feed_summary(source, shown, phase, kind, F.col("detail")).alias("summary"),
        "incident_id",
    )


def _moment(text: str) -> Column:
    """A cursor's time as a timestamp literal; a time without an offset is UTC."""
    moment = datetime.fromisoformat(text)
    return F.lit(moment if moment.tzinfo else moment.replace(tzinfo=UTC))


def feed(tables: Tables, limit: int = 50, cursor: str | None = None) -> DataFrame:
    """Newest events first, one page and a probe row; names are joined after the cut."""
    events = merged_events(tables.runs, tables.incidents, tables.alerts)
    key = [F.col("at"), F.col("source"), F.col("id")]
    seen = cursors.decode_feed(cursor)
    if seen:
        values = [_moment(seen["t"]), F.lit(seen["s"]), F.lit(seen["i"])]
        events = events.filter(after(list(zip(key, values)), descending=True))
    page = probe(events, [c.desc() for c in key], limit)
    return named_events(page, tables.stores)


def feed_page(tables: Tables, limit: int = 50, cursor: str | None = None) -> Page:
    """A page of the feed as rows, in order, with the cursor of the next one."""
    ordered = feed(tables, limit, cursor).orderBy(
        F.col("at").desc(), F.col("source").desc(), F.col("id").desc()
    )
    return take_page(ordered, limit, lambda row: row["event_id"])


def described(incidents: DataFrame, stores: DataFrame) -> DataFrame:
    """Incidents with known vocabularies, a store name, salvaged evidence and a summary."""
    names = stores.select("store_id", F.col("name").alias("store_name"))
    evidence = salvaged_evidence(F.col("evidence"))
    return (
        incidents.join(names, "store_id", "left")
        .withColumn("kind", incident_kind(F.col("kind")))
        .withColumn("facts", evidence)
        .select(
            "id",
            "store_id",
            F.coalesce("store_name", F.lit(FLEET)).alias("store_name"),
            "kind",
            incident_state(F.col("state")).alias("state"),
            "opened_at",
            "resolved_at",
            incident_summary(F.col("kind"), F.col("facts"), evidence_reason(F.col("evidence")))
            .alias("summary"),
            F.col("facts.complete").alias("complete"),
            F.col("facts.row_count").alias("row_count"),
            F.col("facts.expected_row_count").alias("expected_row_count"),
        )
    )


def incident_summaries(tables: Tables) -> DataFrame:
    return described(tables.incidents, tables.stores)


def incidents_page(
    tables: Tables, state: str | None = None, limit: int = 50, cursor: str | None = None
) -> DataFrame:
    """Incidents, newest opening first: one page and a probe row, described after the cut."""
    rows = tables.incidents
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    key = [F.col("opened_at"), F.col("id")]
    seen = cursors.decode_feed(cursor)
    if seen:
        values = [_moment(seen["t"]), F.lit(seen["i"])]
        rows = rows.filter(after(list(zip(key, values)), descending=True))
    return described(probe(rows, [c.desc() for c in key], limit), tables.stores)


def incident_cursor(tables: Tables, state: str | None, limit: int, cursor: str | None = None):
    """The cursor of the page after this one, or None if it is the last."""
    rows = incidents_page(tables, state, limit, cursor).select("opened_at", "id")
    ordered = rows.withColumn("t", cursors.iso(F.col("opened_at"))).orderBy(
        F.col("opened_at").desc(), F.col("id").desc()
    )
    return take_page(
        ordered, limit, lambda row: cursors.encode({"t": row["t"], "s": "incident", "i": row["id"]})
    ).next_cursor


def incident(tables: Tables, incident_id: str) -> DataFrame:
    """One incident by id; empty when unknown."""
    return described(tables.incidents.filter(F.col("id") == incident_id), tables.stores)
