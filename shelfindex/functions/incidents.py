"""Run states, incident evidence and the texts of the feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies.
RUN_STATUS = {
    "ok": "ok",
    "anomalous": "suspect",
    "suspect": "suspect",
    "error": "broken",
    "broken": "broken",
    "blocked": "blocked",
}
BAD_RUNS = ("anomalous", "error", "suspect", "broken")
INCIDENT_STATES = ("open", "resolved", "manual")
INCIDENT_KINDS = (
    "schema", "nulls", "rowcount", "drift", "freshness", "error", "pull_failed",
    "coverage_drop", "studio_failed", "studio_broken", "studio_timeout", "studio_empty",
    "sitemap_error", "provisioning_error", "studio_error", "mass_change_suppressed",
)
CHECK_NAMES = ("schema", "rowcount", "nulls", "drift", "freshness", "error")
SEVERITIES = ("hard", "soft")
FEED_KINDS = ("breakage", "recovery", "price_drop", "escalation")
FLEET = "fleet"

# One-line summaries of incident kinds that need no figures.
SUMMARIES = {
    "schema": "Delivered rows no longer match the output contract",
    "drift": "Prices moved outside the expected envelope",
    "freshness": "Expected delivery did not arrive",
    "pull_failed": "The pull returned nothing usable",
    "coverage_drop": "Too few of the store's basket staples came back in the pull",
    "sitemap_error": "No URLs to submit: catalogue discovery came back empty",
}

EVIDENCE = """
    kind string,
    failedChecks array<struct<check string, severity string, detail string>>,
    sampleBadRows array<string>,
    sampleGoodRows array<string>,
    fieldNullRates map<string,double>,
    baselineNullRates map<string,double>,
    rowCount double,
    expectedRowCount double
"""


def run_status(status: Column) -> Column:
    """A stored run status in the board's vocabulary; null when unknown."""
    mapped = F.lit(None).cast("string")
    for stored, shown in RUN_STATUS.items():
        mapped = F.when(status == stored, F.lit(shown)).otherwise(mapped)
    return mapped


def incident_kind(kind: Column) -> Column:
    return F.when(kind.isin(*INCIDENT_KINDS), kind).otherwise("error")


def incident_state(state: Column) -> Column:
    return F.when(state.isin(*INCIDENT_STATES), state).otherwise("open")


def store_state(incident: Column, status: Column) -> Column:
    """Manual attention, then the last run, then any open incident decides."""
    return (
        F.when(incident == "manual", "manual_attention")
        .when(status == "broken", "broken")
        .when(status.isin("suspect", "blocked"), "suspect")
        .when(incident.isNotNull(), "suspect")
        .otherwise("healthy")
    )


def parsed_evidence(text: Column) -> Column:
    return F.from_json(text, EVIDENCE)


def evidence_is_complete(parsed: Column) -> Column:
    """True when every field is there in its declared shape, so the document is taken as is."""
    whole = lambda n: F.coalesce(n == F.floor(n), F.lit(False))
    checks = F.forall(
        parsed["failedChecks"],
        lambda c: F.coalesce(
            c["check"].isin(*CHECK_NAMES)
            & c["severity"].isin(*SEVERITIES)
            & c["detail"].isNotNull(),
            F.lit(False),
        ),
    )
    rates = [
        F.forall(F.map_values(parsed[field]), lambda rate: rate.isNotNull())
        for field in ("fieldNullRates", "baselineNullRates")
    ]
    complete = (
        parsed["kind"].isin(*INCIDENT_KINDS)
        & checks
        & rates[0]
        & rates[1]
        & parsed["sampleBadRows"].isNotNull()
        & parsed["sampleGoodRows"].isNotNull()
        & whole(parsed["rowCount"])
        & whole(parsed["expectedRowCount"])
    )
    return F.coalesce(complete, F.lit(False))


def _count(variant: Column, *paths: str) -> Column:
    """The first of the paths as a whole number; zero when absent or not a number."""
    text = F.coalesce(*[F.try_variant_get(variant, f"$.{p}", "string") for p in paths])
    number = text.try_cast("double")
    finite = (F.abs(number) < F.lit(9.0e15)) & ~F.isnan(number)
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    return F.coalesce(F.when(finite, whole.cast("bigint")), F.lit(0)).cast("bigint")


def salvaged_evidence(text: Column) -> Column:
    """The evidence fields that matter, from a complete document or what is left of one."""
    parsed = parsed_evidence(text)
    loose = F.try_parse_json(text)
    complete = evidence_is_complete(parsed)
    none = F.array().cast("array<string>")
    return F.struct(
        complete.alias("complete"),
        F.when(complete, F.transform(parsed["failedChecks"], lambda c: c["check"]))
        .otherwise(none)
        .alias("failed_checks"),
        F.when(complete, F.array_sort(F.map_keys(parsed["fieldNullRates"])))
        .otherwise(none)
        .alias("null_fields"),
        _count(loose, "rowCount", "rows").alias("row_count"),
        _count(loose, "expectedRowCount", "expected_row_count").alias("expected_row_count"),
    )


def evidence_reason(text: Column) -> Column:
    """The reason a document gives for itself, when it is a non-empty string."""
    document = F.try_parse_json(text)
    reason = F.try_variant_get(document, "$.reason", "string")
    quoted = F.schema_of_variant(F.try_variant_get(document, "$.reason", "variant")) == "STRING"
    return F.when(quoted & (reason != ""), reason)


def incident_summary(kind: Column, evidence: Column, reason: Column) -> Column:
    """One line naming what went wrong: the given reason, else a text for the kind."""
    failed = F.array_join(evidence["failed_checks"], ", ")
    fields = F.array_join(evidence["null_fields"], ", ")
    rows = evidence["row_count"].cast("string")
    text = F.when(failed != "", failed).otherwise("Validation failed")
    for name, line in SUMMARIES.items():
        text = F.when(kind == name, F.lit(line)).otherwise(text)
    by_figures = (
        F.when(
            kind == "rowcount",
            F.concat(
                F.lit("Row count "), rows, F.lit(", expected "),
                evidence["expected_row_count"].cast("string"),
            ),
        )
        .when(
            kind == "nulls",
            F.concat(
                F.lit("Null rate spike on "),
                F.when(fields != "", fields).otherwise("an unnamed field"),
            ),
        )
        .when(
            kind == "mass_change_suppressed",
            F.concat(
                F.lit("Nearly every price moved at once ("), rows,
                F.lit(" rows); the run was recorded but not applied"),
            ),
        )
        .when(
            kind == "error",
            F.when(failed != "", F.concat(F.lit("Run failed: "), failed)).otherwise("Run failed"),
        )
    )
    return F.coalesce(reason, by_figures, text)


def feed_kind(source: Column, phase: Column, kind: Column) -> Column:
    """Breakage or recovery by source and phase; an alert keeps its own known kind."""
    return (
        F.when((source == "incident") & (phase == "resolved"), "recovery")
        .when((source == "alert") & kind.isin(*FEED_KINDS), kind)
        .otherwise("breakage")
    )


def feed_summary(
    source: Column, store: Column, phase: Column, kind: Column, detail: Column
) -> Column:
    """The line a feed event shows."""
    status = F.coalesce(run_status(kind), F.lit("suspect"))
    return (
        F.when(
            source == "run",
            F.concat(
                store, F.lit(" run came back "), status, F.lit(" with "),
                F.coalesce(detail, F.lit("0")), F.lit(" rows"),
            ),
        )
        .when(
            (source == "incident") & (phase == "resolved"),
            F.concat(store, F.lit(" recovered: "), kind, F.lit(" incident closed")),
        )
        .when(
            source == "incident",
            F.concat(store, F.lit(" opened a "), kind, F.lit(" incident")),
        )
        .otherwise(F.concat(kind, F.lit(" alert sent to "), detail))
    )
