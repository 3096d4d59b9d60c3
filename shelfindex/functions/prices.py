"""Price, unit and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit-price bases, by the unit a size is measured in.
BASES = {"g": "per_kg", "ml": "per_litre"}
EACH = "per_item"


def basis_of(uom: Column) -> Column:
    """The basis prices in this unit are compared on; anything uncounted is per item."""
    return (
        F.when(uom == "g", BASES["g"]).when(uom == "ml", BASES["ml"]).otherwise(EACH)
    )


def known_basis(basis: Column) -> Column:
    """The basis, or null when it is none of the three comparable ones."""
    return F.when(basis.isin(*BASES.values(), EACH), basis)


def unit_price(price: Column, size: Column, uom: Column) -> Column:
    """Price per kilogram, litre or item; null without a positive size, never guessed."""
    per = F.when(uom.isin(*BASES), F.lit(1000)).otherwise(F.lit(1)).cast("decimal(5,0)")
    exact = size.cast("decimal(18,6)")
    return F.when(size > 0, price * per / F.nullif(exact, F.lit(0))).cast("decimal(16,6)")


def extended(price: Column, quantity: Column) -> Column:
    """Unit price times a basket quantity, exact: the quantity leaves floating point first."""
    return price * quantity.cast("decimal(18,6)")


def move_pct(delta: Column, previous: Column) -> Column:
    """Percent move against the previous price; zero when there is nothing to compare."""
    moved = delta.cast("double") / F.nullif(previous.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(moved, F.lit(0.0))


def pct_below(price: Column, median: Column) -> Column:
    """Share by which a price sits under a median, to three places."""
    price, median = price.cast("double"), median.cast("double")
    below = F.floor((median - price) / F.nullif(median, F.lit(0.0)) * 1000 + 0.5) / 1000
    return F.when(median > 0, below).otherwise(0.0)


def spread_label(low: Column, high: Column) -> Column:
    """A low-high span in words: '2.4x' from a doubling on, '36%' under it."""
    times = high.cast("double") / F.nullif(low.cast("double"), F.lit(0.0))
    return (
        F.when(~(low > 0) | low.isNull(), "")
        .when(times >= 2, F.format_string("%.1fx", times))
        .otherwise(F.concat(F.floor((times - 1) * 100 + 0.5).cast("string"), F.lit("%")))
    )
