import os
import sys
from datetime import date, datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import types as T  # noqa: E402

from shelfindex.session import local_session  # noqa: E402
from shelfindex.sources.schemas import TABLES  # noqa: E402
from shelfindex.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


def at(day: int, hour: int = 0) -> datetime:
    """A moment in January 2024, day 1 being the first."""
    return datetime(2024, 1, day, hour)


def coerced(value, kind):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value))
    if isinstance(kind, T.DoubleType):
        return float(value)
    return value


@pytest.fixture(scope="session")
def tiny(spark):
    """Build Tables from lists of dicts; columns left out are null, tables left out empty."""

    def build(as_of=date(2024, 1, 31), id_cuts=(), **rows) -> Tables:
        def load(name):
            schema = T.StructType.fromDDL(TABLES[name])
            data = [
                tuple(coerced(row.get(f.name), f.dataType) for f in schema.fields)
                for row in rows.get(name, [])
            ]
            return spark.createDataFrame(data, schema)

        return Tables(spark, load, as_of, {"PH": "PHP", "US": "USD"}, id_cuts)

    return build
