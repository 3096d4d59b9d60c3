"""Opaque page cursors: URL-safe base64 of a small JSON document. Decoding never raises."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The feed's sources and the search orders a cursor may belong to.
FEED_SOURCES = ("run", "incident", "alert")
SEARCH_ORDERS = ("relevance", "unit_price", "browse")


def encode(fields: dict) -> str:
    text = json.dumps(fields, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def _decode(raw: str | None) -> dict | None:
    if not raw:
        return None
    try:
        padded = raw + "=" * (-len(raw) % 4)
        fields = json.loads(base64.urlsafe_b64decode(padded.encode()).decode())
    except (ValueError, UnicodeError):
        return None
    return fields if isinstance(fields, dict) else None


def decode_feed(raw: str | None) -> dict | None:
    """`{t, s, i}`: time, source and id of the last event seen; None when unusable."""
    fields = _decode(raw)
    if fields is None or not all(isinstance(fields.get(f), str) for f in "tsi"):
        return None
    if fields["s"] not in FEED_SOURCES:
        return None
    try:
        datetime.fromisoformat(fields["t"])
    except ValueError:
        return None
    return {f: fields[f] for f in "tsi"}


def decode_search(raw: str | None, order: str) -> dict | None:
    """`{o, v, s, k}`: order, sort value, store and product; None for another order's cursor."""
    fields = _decode(raw)
    if fields is None or fields.get("o") != order or order not in SEARCH_ORDERS:
        return None
    if not all(isinstance(fields.get(f), str) for f in "sk"):
        return None
    value = fields.get("v", False)
    if value is not None and not isinstance(value, str):
        return None
    if order != "browse" and value is not None and not _is_number(value):
        return None
    return {f: fields[f] for f in "ovsk"}


NUMBER = re.compile(r"-?[0-9]{1,20}(\.[0-9]*)?(E-?[0-9]{1,2})?")


def _is_number(text: str) -> bool:
    """A plain decimal number that a sort value can be compared with."""
    return len(text) <= 40 and NUMBER.fullmatch(text) is not None


def iso(at: Column) -> Column:
    """UTC text with microseconds, so that cursors never skip rows of one millisecond."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def encoded(fields: Column) -> Column:
    """`encode` for a struct column."""
    wrapped = F.base64(F.encode(F.to_json(fields), "UTF-8"))
    # base64 breaks lines after 76 characters; translate drops what has no counterpart.
    return F.translate(wrapped, "+/=\r\n", "-_")
