"""Reusable relational operators: ordered neighbours, as-of, quantiles, paging."""
