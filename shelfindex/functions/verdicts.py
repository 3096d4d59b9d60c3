"""What is wrong with a pin, if anything.

Every test is false rather than null when a price or a median is absent, because a pin
must never vanish from a result for lack of a price.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# When a price is an outlier, and when a median is worth comparing with.
OUTLIER_MULTIPLE = 10
COMPARABLE_PINS = 3

# Reasons as shown to readers, most serious first.
REASONS = {
    "no_size": "no size on the label, so no unit price",
    "basis_mismatch": "priced per a different unit than this item is tracked in",
    "price_outlier": "more than 10x the typical unit price for this item",
    "size_range": "the label gives a size range, so the unit price is a midpoint",
    "multipack": "a multipack, so the unit price assumes the pack total",
    "approximate": "the label says approximate, so the unit price is too",
}


def _certain(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def no_size() -> Column:
    return F.col("size_quantity").isNull()


def basis_mismatch() -> Column:
    priced = F.col("unit_price").isNotNull()
    return _certain(priced & (F.col("unit_price_basis") != F.col("want_basis")))


def price_outlier() -> Column:
    beyond = F.col("unit_price").cast("double") > OUTLIER_MULTIPLE * F.col("median_unit_price")
    return _certain((F.col("priced") >= COMPARABLE_PINS) & beyond)


def imprecise_size() -> Column:
    return _certain(
        F.coalesce("size_approximate", F.lit(False))
        | F.col("size_form").isin("multipack", "range")
    )


def with_verdicts(pins):
    """Add the verdict columns to pins that carry a median and a wanted basis."""
    judged = pins.select(
        "*",
        no_size().alias("no_size"),
        basis_mismatch().alias("basis_mismatch"),
        price_outlier().alias("price_outlier"),
        imprecise_size().alias("imprecise"),
    )
    suspect = F.col("no_size") | F.col("basis_mismatch") | F.col("price_outlier")
    comparable = _certain(
        F.col("unit_price").isNotNull() & (F.col("unit_price_basis") == F.col("want_basis"))
    )
    return judged.select(
        "*",
        suspect.alias("suspect"),
        (~suspect & comparable).alias("eligible"),
        F.when(suspect, "suspect").when(F.col("imprecise"), "imprecise").otherwise("ok")
        .alias("flag"),
        F.when(F.col("no_size"), REASONS["no_size"])
        .when(F.col("basis_mismatch"), REASONS["basis_mismatch"])
        .when(F.col("price_outlier"), REASONS["price_outlier"])
        .when(F.col("size_form") == "range", REASONS["size_range"])
        .when(F.col("size_form") == "multipack", REASONS["multipack"])
        .when(F.col("size_approximate"), REASONS["approximate"])
        .alias("flag_reason"),
    )
