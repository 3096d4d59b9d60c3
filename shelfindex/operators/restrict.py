"""Restricting a long history to the keys of a shorter result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def only_keys(df: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows of `df` whose key is in `wanted`.

    Always a semi-join: Spark broadcasts `wanted` if its measured bytes allow it, so that the
    history is filtered where it is read, and otherwise shuffles both sides.
    """
    return df.join(wanted.select(*keys), keys, "left_semi")
