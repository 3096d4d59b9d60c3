"""Change-only history: keep a reading only when it is the first or differs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.operators.ordered import with_neighbour


def change_only(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "id",
    cuts: Sequence | Callable[[], Sequence] = (),
) -> DataFrame:
    """Readings with `price` reduced to steps, with change, previous_price and delta."""
    seen = with_neighbour(df, keys, order, {"previous_price": "price"}, cuts=cuts)
    first = F.col("previous_price").isNull()
    return seen.filter(first | (F.col("price") != F.col("previous_price"))).select(
        *df.columns,
        F.when(first, F.lit("new")).otherwise(F.lit("price")).alias("change"),
        "previous_price",
        (F.col("price") - F.col("previous_price")).cast("decimal(12,4)").alias("delta"),
    )
