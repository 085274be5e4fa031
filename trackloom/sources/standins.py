"""Deterministic stand-ins for position logs, sites and reports over the star-schema tables, each with its DuckDB CTE.

Both sides use the same integer arithmetic, so results can be compared value by value. Times are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Epoch seconds (double) of a zoneless timestamp, whatever the session's zone."""
    micros = f"cast(cast(({column} - timestamp_ntz'1970-01-01 00:00:00') as interval second) as decimal(20,6))"
    return F.expr(f"cast({micros} as double)")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position log: one fix per event; users are moving entities around a base of their own."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("entity_id"),
        epoch("ts").alias("ts"),
        F.expr("((user_id * 37) % 120) - 60 + (event_id % 50) / 100.0D").alias("lat"),
        F.expr("((user_id * 91) % 360) - 180 + (event_id % 70) / 100.0D").alias("lon"),
        (F.col("value") / 4).alias("speed"),
        F.expr("cast((event_id * 7) % 361 as int)").alias("course"),
        F.expr("cast(30 + user_id % 60 as int)").alias("ship_type"),
        F.expr("case when event_id % 10 = 0 then null else event_id % 10 < 3 end").alias("on_ground"),
        F.expr("cast(((event_id * 13) % 40) * 100 as double)").alias("altitude"),
        F.expr("cast((event_id * 3) % 20 as double)").alias("draught"),
        F.col("event_type").alias("kind"),
        "value", "props",
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("site_name"), F.col("s_nationkey").alias("country"),
        F.expr("((s_suppkey * 37) % 120) - 60 + 0.25D").alias("site_lat"), F.expr("((s_suppkey * 91) % 360) - 180 + 0.3D").alias("site_lon"),
        F.col("s_acctbal").alias("weight"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident reports: orders as coded reports with a date, a severity and a place."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("actor"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("severity"), F.col("o_orderpriority").alias("category"),
        (F.expr("datediff(o_orderdate, date'1970-01-01')")).cast("int").alias("day"),
        F.expr("((o_custkey * 29) % 100) - 50 + (o_orderkey % 40) / 50.0D").alias("lat"),
        F.expr("((o_custkey * 53) % 300) - 150 + (o_orderkey % 30) / 50.0D").alias("lon"),
        F.expr("cast(o_orderkey % 9 as int)").alias("mentions"),
    )


CTES = {
    "positions": """positions AS (SELECT event_id, user_id AS entity_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts,
  ((user_id * 37) % 120) - 60 + (event_id % 50) / 100.0::DOUBLE AS lat, ((user_id * 91) % 360) - 180 + (event_id % 70) / 100.0::DOUBLE AS lon,
  value / 4 AS speed, CAST((event_id * 7) % 361 AS INT) AS course, CAST(30 + user_id % 60 AS INT) AS ship_type,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 10 < 3 END AS on_ground, CAST(((event_id * 13) % 40) * 100 AS DOUBLE) AS altitude,
  CAST((event_id * 3) % 20 AS DOUBLE) AS draught, event_type AS kind, value, props FROM events)""",
    "sites": """sites AS (SELECT s_suppkey AS site_id, s_name AS site_name, s_nationkey AS country,
  ((s_suppkey * 37) % 120) - 60 + 0.25::DOUBLE AS site_lat, ((s_suppkey * 91) % 360) - 180 + 0.3::DOUBLE AS site_lon, s_acctbal AS weight FROM supplier)""",
    "reports": """reports AS (SELECT o_orderkey AS report_id, o_custkey AS actor, o_orderstatus AS status, o_totalprice AS severity, o_orderpriority AS category,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS day, ((o_custkey * 29) % 100) - 50 + (o_orderkey % 40) / 50.0::DOUBLE AS lat,
  ((o_custkey * 53) % 300) - 150 + (o_orderkey % 30) / 50.0::DOUBLE AS lon, CAST(o_orderkey % 9 AS INT) AS mentions FROM orders)""",
}


def oracle(names: str, body: str, *more: str) -> str:
    """A DuckDB statement over stand-ins, further CTEs and a body."""
    parts = [*(CTES[n] for n in names.split()), *more]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


#: Great-circle kilometres in DuckDB, for columns given by name.
def km_sql(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))"
    )
