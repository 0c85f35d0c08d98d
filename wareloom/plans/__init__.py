"""Registered queries, their inputs derived from the given tables, and the check SQL."""

import importlib

from .registry import CHECKS, QUERIES

for _module in ["class_queries", "price_queries", "option_queries", "color_queries", "url_queries", "site_queries", "catalog_queries", "memory_queries"]:
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["CHECKS", "QUERIES"]
