"""Registered queries of the core, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list[str] = ["engine_queries", "scan_queries", "validator_queries", "findings_queries", "text_queries", "source_queries", "enrich_queries", "report_queries"]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= import_module(f"veilframe.plans.{name}").queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"veilframe.plans.{name}").oracle_sql()
    return out
