"""Keyset paging: a total order, a seek past the last row seen, and one probe row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row


def after(key: Sequence[tuple[Column, Column]], descending: bool = False) -> Column:
    """Lexicographic `key > values` (or `<` when descending) over columns without nulls."""
    steps = []
    for at, (column, value) in enumerate(key):
        beyond = column < value if descending else column > value
        steps.append(reduce(lambda a, b: a & b, [c == v for c, v in key[:at]] + [beyond]))
    return reduce(lambda a, b: a | b, steps)


def probe(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The page and one row more, which tells whether another page follows."""
    if limit < 1:
        raise ValueError("a page holds at least one row")
    return df.orderBy(*order).limit(limit + 1)


def fetched(page: DataFrame, rows: int) -> DataFrame:
    """A result of at most `rows` rows, computed once, for joining details to it.

    Only for results whose size is a parameter of the request, such as a page.
    """
    return page.sparkSession.createDataFrame(page.take(rows), page.schema)


@dataclass(frozen=True)
class Page:
    items: list[Row]
    next_cursor: str | None
    reference: tuple[Row, ...] = ()  # official prices shown beside a first page


def take_page(probed: DataFrame, limit: int, to_cursor) -> Page:
    """Fetch a probed page, at most `limit` + 1 rows, and name the cursor of the next one."""
    rows = probed.take(limit + 1)
    more = len(rows) > limit
    items = rows[:limit]
    return Page(items, to_cursor(items[-1]) if more and items else None)
