"""All registered queries of the analytics operators with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "position_gaps"
#: Modules that define QUERIES and ORACLES.
MODULES: tuple[str, ...] = (
    *(f"trackloom.operators.{m}" for m in ("windows", "topk", "aggregates", "joins", "predicates", "dedupe", "incidents", "upserts", "scalars", "gazetteer", "nameindex", "products", "monitor", "fusion", "polygons", "labels", "sky", "placing", "viewport", "readings", "exposure")),
    "trackloom.sources.landed", "trackloom.sources.feeds", "trackloom.sources.slots", "trackloom.streaming.rolling", "trackloom.streaming.alerts",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(m).ORACLES.items()}
