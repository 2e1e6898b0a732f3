"""Every registered query by name, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import budget_plans, licence_plans, page_plans, receipt_plans, review_plans, screen_plans, store_plans, stream_plans

_PARTS = (budget_plans, licence_plans, page_plans, receipt_plans, review_plans, screen_plans, store_plans, stream_plans)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
