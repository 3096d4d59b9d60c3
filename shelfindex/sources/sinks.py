"""Writers for domain tables and for published documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tables whose files are laid out by a column that reads are scoped to.
PARTITIONED = {"gov_series": ["source"], "gov_prices": ["source"]}


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """A domain table as Parquet under `root/name`, bulletins by source for partition pruning.

    Bulletin prices carry the source of their series for that; see `with_source`.
    """
    writer = df.write.mode(mode)
    columns = [c for c in PARTITIONED.get(name, []) if c in df.columns]
    if columns:
        writer = writer.partitionBy(*columns)
    writer.parquet(f"{root}/{name}")


def with_source(prices: DataFrame, series: DataFrame) -> DataFrame:
    """Bulletin prices with the source of their series; prices without a series keep none."""
    sources = series.select(F.col("id").alias("series_id"), "source")
    return prices.join(sources, "series_id", "left").select(*prices.columns, "source")


def as_documents(df: DataFrame, *keys: str) -> DataFrame:
    """Each row as one JSON document, nulls kept, next to its key columns."""
    document = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(*keys, document.alias("document"))


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested rows as JSON lines."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
