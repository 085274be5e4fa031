"""Ordered limits: decayed scores, nulls last, flags first, per-group ranks, pages, caps and work queues.

Where a limit is the feature, orderBy + limit plans as TakeOrderedAndProject; all orders end in a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.sources.standins import oracle, positions, reports

TODAY = 11_500  # epoch day
HALF_LIFE = 6.0


def decayed(df: DataFrame, mass, age_hours, key: str, k: int, half_life: float = HALF_LIFE) -> DataFrame:
    """The k rows of greatest mass halved every half_life hours; ties by key, greatest first."""
    return df.withColumn("score", F.round(mass * F.pow(F.lit(0.5), age_hours / half_life), 9)).orderBy(F.desc("score"), F.desc(key)).limit(k)


def newest_first(df: DataFrame, condition, order: str, key: str, k: int) -> DataFrame:
    return df.where(condition).orderBy(F.desc(order), F.desc(key)).limit(k)


def page(df: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """One page of a cursor scan; the predicate reaches the files' statistics."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def capped(df: DataFrame, by: list[str], order: list, cap: int, spared) -> DataFrame:
    """The first `cap` rows of each group, and all that are spared."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_n", n).where((F.col("_n") <= cap) | spared).drop("_n")


def _news(s, d):
    return reports(s, d).withColumn("age", (F.lit(TODAY) - F.col("day")).cast("double")).where("age >= 0")


QUERIES = {
    "top_decayed": lambda s, d: decayed(_news(s, d), F.col("mentions") + 1, F.col("age"), "report_id", 50).select("report_id", "mentions", "score"),
    "top_by_days": lambda s, d: _news(s, d).withColumn("score", F.round(F.col("severity") / (1 + 0.35 * F.col("age")), 6)).orderBy(F.desc("score"), F.desc("report_id")).limit(40).select("report_id", "score"),
    "top_nulls_last": lambda s, d: reports(s, d).withColumn("sev", F.expr("nullif(mentions, 0)")).orderBy(F.desc_nulls_last("sev"), F.desc("day"), "report_id").limit(100).select("report_id", "sev", "day"),
    "flags_first": lambda s, d: reports(s, d).orderBy(F.desc(F.col("status") == "F"), F.desc(F.col("category") == "1-URGENT"), F.desc("severity"), "report_id").limit(120).select("report_id", "status", "category", "severity"),
    "top_types_per_field": lambda s, d: per_group(positions(s, d).groupBy("entity_id", "kind").count().withColumnRenamed("count", "n"), ["entity_id"], [F.desc("n"), "kind"], 3),
    "lookup_newest": lambda s, d: newest_first(positions(s, d), F.col("entity_id") == 7, "ts", "event_id", 25).select("event_id", "ts", "speed"),
    "cursor_page": lambda s, d: page(positions(s, d), "event_id", 500, 200).select("event_id", "entity_id", "ts"),
    "table_sort_sentinel": lambda s, d: reports(s, d).withColumn("sort_key", F.coalesce(F.expr("nullif(mentions, 0)"), F.lit(-1))).orderBy("sort_key", F.desc("severity"), "report_id").limit(60).select("report_id", "sort_key"),
    "cap_eviction": lambda s, d: capped(positions(s, d), ["entity_id"], [F.desc("ts"), F.desc("event_id")], 5, F.coalesce(F.col("on_ground"), F.lit(False)) & (F.col("altitude") > 3500)).select("entity_id", "event_id"),
    "work_queue": lambda s, d: reports(s, d).withColumn("imprecise", F.col("status") == "P").orderBy(F.desc("imprecise"), F.desc("mentions"), F.desc("severity"), "report_id").limit(400).select("report_id", "imprecise", "mentions"),
}

_AGE = f"news AS (SELECT *, CAST({TODAY} - day AS DOUBLE) AS age FROM reports WHERE {TODAY} - day >= 0)"
ORACLES = {
    "top_decayed": oracle("reports", "SELECT report_id, mentions, round((mentions + 1) * power(0.5, age / 6), 9) AS score FROM news ORDER BY score DESC, report_id DESC LIMIT 50", _AGE),
    "top_by_days": oracle("reports", "SELECT report_id, round(severity / (1 + 0.35 * age), 6) AS score FROM news ORDER BY score DESC, report_id DESC LIMIT 40", _AGE),
    "top_nulls_last": oracle("reports", "SELECT report_id, nullif(mentions, 0) AS sev, day FROM reports ORDER BY sev DESC NULLS LAST, day DESC, report_id LIMIT 100"),
    "flags_first": oracle("reports", "SELECT report_id, status, category, severity FROM reports ORDER BY (status = 'F') DESC, (category = '1-URGENT') DESC, severity DESC, report_id LIMIT 120"),
    "top_types_per_field": oracle("positions", "SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, kind) AS INT) AS rank FROM (SELECT entity_id, kind, count(*) AS n FROM positions GROUP BY ALL) QUALIFY rank <= 3"),
    "lookup_newest": oracle("positions", "SELECT event_id, ts, speed FROM positions WHERE entity_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 25"),
    "cursor_page": oracle("positions", "SELECT event_id, entity_id, ts FROM positions WHERE event_id > 500 ORDER BY event_id LIMIT 200"),
    "table_sort_sentinel": oracle("reports", "SELECT report_id, coalesce(nullif(mentions, 0), -1) AS sort_key FROM reports ORDER BY sort_key, severity DESC, report_id LIMIT 60"),
    "cap_eviction": oracle("positions", "SELECT entity_id, event_id FROM positions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) <= 5 OR (coalesce(on_ground, false) AND altitude > 3500)"),
    "work_queue": oracle("reports", "SELECT report_id, status = 'P' AS imprecise, mentions FROM reports ORDER BY imprecise DESC, mentions DESC, severity DESC, report_id LIMIT 400"),
}
