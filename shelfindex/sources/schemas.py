"""Explicit schemas of the domain tables; readers never infer."""

from __future__ import annotations

STORES = """
    store_id string, name string, country string, currency string, method string,
    category string, index_contributor boolean, active boolean
"""

PRODUCTS = """
    store_id string, product_key string, name string, url string, unit string,
    size_quantity double, size_base_uom string, size_form string, size_approximate boolean,
    first_seen timestamp, last_seen timestamp
"""

RUNS = """
    id bigint, store_id string, at timestamp, status string, rows int,
    null_rate_pct decimal(5,2)
"""

PRICE_OBSERVATIONS = """
    id decimal(38,0), store_id string, product_key string, observed_at timestamp,
    price decimal(12,4), currency string, unit_price decimal(16,6), unit_price_basis string,
    change string, previous_price decimal(12,4), delta decimal(12,4)
"""

ITEMS = """
    key string, label string, tier string, normal_unit string, target_size string,
    index_quantity double, index_uom string
"""

BASKET_MAP = """
    item_key string, store_id string, product_key string, status string,
    target_size string, missed_runs int
"""

PIN_GAPS = "store_id string, product_key string, from_at timestamp, to_at timestamp"

BASELINES = """
    store_id string, field_null_rates string, expected_row_count bigint, value_ranges string
"""

INCIDENTS = """
    id string, store_id string, kind string, evidence string, state string,
    opened_at timestamp, resolved_at timestamp
"""

ALERTS = "id string, kind string, channel string, sent_at timestamp"

GOV_SERIES = """
    id bigint, source string, commodity string, variant string, brand string,
    region string, place string, unit string
"""

GOV_PRICES = """
    series_id bigint, period_start date, period_end date,
    price_min decimal(12,2), price_max decimal(12,2)
"""

GOV_DOCUMENTS = """
    source string, url string, title string, period_start date, period_end date,
    fetched_at timestamp, rows int
"""

TABLES = {
    "stores": STORES,
    "products": PRODUCTS,
    "runs": RUNS,
    "price_observations": PRICE_OBSERVATIONS,
    "items": ITEMS,
    "basket_map": BASKET_MAP,
    "pin_gaps": PIN_GAPS,
    "baselines": BASELINES,
    "incidents": INCIDENTS,
    "alerts": ALERTS,
    "gov_series": GOV_SERIES,
    "gov_prices": GOV_PRICES,
    "gov_documents": GOV_DOCUMENTS,
}

# Columns beyond the declared ones that files of a table are laid out by, where they have them.
LAYOUT = {"gov_prices": "source string"}
