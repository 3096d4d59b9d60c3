"""Operators for preparing text and vectors at corpus size."""
