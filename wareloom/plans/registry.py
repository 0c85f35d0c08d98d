"""Registry of queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs
from .inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

CTES = {
    "product_pages": inputs.PRODUCT_PAGES_SQL,
    "detail_pages": inputs.DETAIL_PAGES_SQL,
    "config_pages": inputs.CONFIG_PAGES_SQL,
    "form_pages": inputs.FORM_PAGES_SQL,
    "visits": inputs.VISITS_SQL,
    "page_visits": inputs.PAGE_VISITS_SQL,
    "pixels": inputs.PIXELS_CHECK_SQL,
    "decisions": inputs.DECISIONS_SQL,
    "catalog": inputs.CATALOG_SQL,
    "raw_catalog": inputs.RAW_CATALOG_SQL,
    "jobs": inputs.JOBS_SQL,
    "states": inputs.STATES_SQL,
    "elements": inputs.ELEMENTS_SQL,
    "guided_options": inputs.GUIDED_OPTIONS_SQL,
    "explored": inputs.EXPLORED_SQL,
    "continue_log": inputs.CONTINUE_LOG_SQL,
}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, sql: str, needs: str = "") -> None:
    """Name a check-SQL fragment; `needs` lists the fragments it reads."""
    CTES[name] = sql
    NEEDS[name] = needs.split()


def with_ctes(sql: str, needs: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return sql
    head = "WITH RECURSIVE " if recursive else "WITH "
    kind = "AS" if recursive else "AS MATERIALIZED"  # a fragment that several read is worked out once
    return head + ",\n".join(f"{n} {kind} ({CTES[n]})" for n in order) + "\n" + sql


def query(name: str, check: str | None = None, needs: str = "", recursive: bool = False):
    """Register fn(inputs) under a name, with its check SQL if it has one."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if check is not None:
            CHECKS[name] = with_ctes(check, needs, recursive)
        return fn

    return register
