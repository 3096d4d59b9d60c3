"""Access to the domain tables: Parquet, JDBC, or anything that yields DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfindex.operators.ordered import cuts_if_needed
from shelfindex.session import filed, size_shuffles
from shelfindex.sources.schemas import LAYOUT, TABLES

# Currency codes used where neither the observation nor the store carries one.
DEFAULT_CURRENCY = {"PH": "PHP"}


class Tables:
    """The domain tables, resolved by name on first use.

    `as_of` is the reading clock of every rule that says "in the last N days";
    it is explicit so that a historical extract gives the answer of its own day.
    `id_cuts` are the ids at which slices of the history begin that one task may order on its own,
    or what finds them on request, see `shelfindex.operators.ordered`; none means that one slice
    holds it.
    """

    def __init__(
        self,
        spark: SparkSession,
        load: Callable[[str], DataFrame],
        as_of: date,
        currencies: Mapping[str, str] = DEFAULT_CURRENCY,
        id_cuts: Sequence | Callable[[], Sequence] = (),
    ):
        self.spark = spark
        self.as_of = as_of
        self.currencies = dict(currencies)
        self.id_cuts = id_cuts if callable(id_cuts) else tuple(id_cuts)
        self._load = load
        self._loaded: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._loaded:
            self._loaded[name] = self._load(name)
        return self._loaded[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A reduction several plans start from, computed once and kept in the shared folder."""
        if name not in self._kept:
            self._kept[name] = filed(build(), "kept")
        return self._kept[name]

    @property
    def now(self) -> Column:
        """`as_of` as a timestamp column: midnight in the session's zone, whatever the driver's."""
        return F.lit(self.as_of).cast("timestamp")

    def days_ago(self, days: int) -> Column:
        return self.now - F.expr(f"interval {int(days)} days")

    def currency(self, currency: Column, country: Column) -> Column:
        """The given currency, or the country's default when it is null or blank."""
        default = F.lit(None).cast("string")
        for name, code in self.currencies.items():
            default = F.when(country == name, F.lit(code)).otherwise(default)
        return F.coalesce(F.nullif(currency, F.lit("")), default)

    def priced_countries(self, country: Column) -> Column:
        """True for countries the catalogue serves; the rest are left out before any limit."""
        return country.isin(*self.currencies)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, as_of: date | None = None, **options):
        """Tables laid out as `write_table` does, with bulletins partitioned by source."""

        def load(name: str) -> DataFrame:
            return spark.read.schema(file_schema(name)).parquet(f"{root}/{name}")

        return cls._measured(spark, load, as_of, options)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        as_of: date | None = None,
        partitioning: Mapping[str, Mapping[str, str]] | None = None,
        properties: Mapping[str, str] | None = None,
        **options,
    ):
        """Tables of a live relational database.

        `partitioning` gives per table the JDBC options `partitionColumn`, `lowerBound`,
        `upperBound` and `numPartitions`, so that a large table is read by many tasks.
        """

        def load(name: str) -> DataFrame:
            reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
            for settings in (properties or {}), (partitioning or {}).get(name, {}):
                reader = reader.options(**settings)
            return conform(reader.load(), name)

        return cls._measured(spark, load, as_of, options)

    @classmethod
    def _measured(cls, spark, load, as_of: date | None, options: dict):
        """Fill in the reading day and the id cuts from the history where they are not given."""
        if as_of is None or "id_cuts" not in options:
            history = load("price_observations")
            rows, latest = history.agg(F.count("*"), F.max(F.to_date("observed_at"))).first()
            if as_of is None and latest is None:
                raise ValueError("no observations: give as_of explicitly")
            as_of = as_of or latest
            if "id_cuts" not in options:
                options = {"id_cuts": cuts_if_needed(lambda: history, "id", rows), **options}
            size_shuffles(spark, rows)
        return cls(spark, load, as_of, **options)


def file_schema(table: str) -> str:
    """The declared columns of a table and those that its files are laid out by."""
    return ", ".join(part for part in (TABLES[table], LAYOUT.get(table)) if part)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the declared columns of `table` from `df`, in the declared types.

    A layout column is kept where `df` has it.
    """
    laid_out = [f for f in StructType.fromDDL(LAYOUT.get(table, "")).fields if f.name in df.columns]
    fields = StructType.fromDDL(TABLES[table]).fields + [
        f for f in laid_out if f.name not in StructType.fromDDL(TABLES[table]).names
    ]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
