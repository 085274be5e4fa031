"""Alerts over a stream: rules read anew for each micro-batch, met with the latest state, each alert with a life of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.monitor import RULES, evaluate_rules
from trackloom.operators.upserts import alerts
from trackloom.session import fresh_path, remove
from trackloom.sources.standins import oracle, positions

#: What every fix must have; numeric fields of rules come on top.
FIX = "entity_id long, ts double, event_id long, layer string, lat double, lon double, country string, squawk string"
ALERT = "rule string, subject string, first_seen int, occurrences int, resolved_at int"


def latest_of(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The newest row of each entity, by (ts, event_id); a repeated row changes nothing, rows without an entity go."""
    cols = [c for c in state.columns if c != "entity_id"]
    both = state.unionByName(batch.select(*state.columns)).where("entity_id is not null")
    last = both.groupBy("entity_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("r"))
    return last.select("entity_id", "r.*").select(*state.columns)


def alerts_after(firing: DataFrame, stored: DataFrame, now: int) -> DataFrame:
    """Alerts (rule, subject) after a check, by the lifecycle of upserts.alerts(): those of rules that are gone or off are resolved."""
    key = F.to_json(F.struct("rule", "subject"))
    fire = firing.select(key.alias("subject")).distinct()
    kept = stored.select(key.alias("subject"), "first_seen", "occurrences", "resolved_at")
    parsed = F.from_json("subject", "rule string, subject string")
    return alerts(fire, kept, now).select(parsed.alias("k"), "first_seen", "occurrences", "resolved_at").selectExpr("k.rule", "k.subject", "first_seen", "cast(occurrences as int) as occurrences", "resolved_at")


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a batch changed: (rule, subject, change), change being opened, again (open after it was resolved) or resolved."""
    old = before.select("rule", "subject", F.lit(True).alias("known"), F.col("resolved_at").isNull().alias("was"))
    j = after.join(old, ["rule", "subject"], "left")
    is_open = F.col("resolved_at").isNull()
    change = F.when(F.col("known").isNull(), "opened").when(is_open & ~F.col("was"), "again").when(~is_open & F.col("was"), "resolved")
    return j.select("rule", "subject", change.alias("change")).where("change is not null")


def alert_sink(path: str, rules: Callable[[int], list[tuple]], fields: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps latest state, alerts and their changes under path, one folder of each per batch.

    rules(number) gives the rules of batch `number` (monitor.RULE_SCHEMA); it must give the same ones when that batch is
    replayed. The time of a check is the newest ts of the state, so a replay gives the same rows. Each batch is made
    from the folders of the one before it and overwrites its own, so a batch that failed half way is simply made again, and
    no alert is counted twice. State and alerts of batches before the last two are removed; changes stay.

    A check reads the whole state, one row an entity, as any rule may have changed; a batch without rows and with an empty state
    leaves everything as it was. read() gives the alerts, changes() all changes.
    """
    schema = ", ".join([FIX, *(f"{f} double" for f in fields if f not in ("lat", "lon", "ts"))])

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _table(spark, f"{path}/state/{number - 1}", schema)
        latest_of(before, batch).write.mode("overwrite").parquet(f"{path}/state/{number}")
        state = spark.read.schema(schema).parquet(f"{path}/state/{number}")
        newest = state.agg(F.max("ts").alias("ts")).first()["ts"]
        stored = _table(spark, f"{path}/alerts/{number - 1}", ALERT)
        checked = stored if newest is None else alerts_after(evaluate_rules(state, rules(number), fields), stored, int(newest))
        checked.write.mode("overwrite").parquet(f"{path}/alerts/{number}")
        transitions(stored, read(spark, path, number)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/changes/{number}")
        for kind in ("state", "alerts"):
            remove(spark, f"{path}/{kind}/{number - 2}")

    return merge


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The alerts after batch `number`."""
    return _table(spark, f"{path}/alerts/{number}", ALERT)


def changes(spark: SparkSession, path: str) -> DataFrame:
    """All changes so far: rule, subject, change, batch."""
    return spark.read.schema("rule string, subject string, change string, batch int").parquet(f"{path}/changes/*")


def _fixes(s: SparkSession, d: str) -> DataFrame:
    p = positions(s, d)
    return p.select("entity_id", "ts", "event_id", F.col("kind").alias("layer"), "lat", "lon", (F.col("entity_id") % 5).cast("string").alias("country"), F.when(F.col("event_id") % 3 == 0, "7700").otherwise("1200").alias("squawk"), "speed", "altitude")


#: Ends of the three batches in which the query takes the log in, in seconds.
ENDS = (1_704_960_000.0, 1_705_824_000.0, float("inf"))


def _followed(s: SparkSession, d: str) -> DataFrame:
    """Three batches of the log by time; the rule `fast` is off in the second, so its alerts are resolved and fire anew."""
    path, log, start = fresh_path(s, "alerts"), _fixes(s, d), float("-inf")
    sink = alert_sink(path, lambda n: [r for r in RULES if n != 1 or r[0] != "fast"], ("speed", "altitude"))
    for number, end in enumerate(ENDS):
        sink(log.where((F.col("ts") >= start) & (F.col("ts") < end)), number)
        start = end
    return read(s, path, len(ENDS) - 1)


def _fires(n: int, end: float) -> str:
    """One batch's CTEs in DuckDB: the state up to its end, and what fires."""
    upto = f"ts < {end}" if end != float("inf") else "true"
    fast = "" if n == 1 else f"UNION ALL SELECT 'fast', CAST(entity_id AS VARCHAR) FROM l{n} WHERE kind = 'error' AND speed > 60"
    return f"""l{n} AS (SELECT * FROM positions WHERE {upto} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1),
    f{n} AS (SELECT 'north' AS rule, CAST(entity_id AS VARCHAR) AS subject FROM l{n} WHERE kind = 'view' AND lat BETWEEN 30 AND 90 AND lon BETWEEN -180 AND 180
        UNION ALL SELECT 'pacific', '*' FROM l{n} WHERE kind = 'click' AND lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon <= -120) HAVING count(*) > 1 {fast}
        UNION ALL SELECT 'low', CAST(entity_id AS VARCHAR) FROM l{n} WHERE kind = 'view' AND altitude > 1500 AND entity_id % 5 = 3
        UNION ALL SELECT 'code', CAST(entity_id AS VARCHAR) FROM l{n} WHERE kind = 'click' AND event_id % 3 = 0),
    t{n} AS (SELECT CAST(floor(max(ts)) AS INT) AS t FROM l{n})"""


QUERIES = {"alert_stream": _followed}
_ON = [f"bool_or(b = {n}) AS on{n}" for n in range(3)]
ORACLES = {
    "alert_stream": oracle(
        "positions",
        """SELECT rule, subject, CAST(on0 AS INT) + CAST(on1 AS INT) + CAST(on2 AS INT) AS occurrences,
        CASE WHEN on2 AND NOT on1 THEN t2.t WHEN on1 AND NOT on0 THEN t1.t WHEN on0 THEN t0.t END AS first_seen,
        CASE WHEN on2 THEN NULL WHEN on1 THEN t2.t ELSE t1.t END AS resolved_at FROM a, t0, t1, t2""",
        *(_fires(n, end) for n, end in enumerate(ENDS)),
        f"a AS (SELECT rule, subject, {', '.join(_ON)} FROM (SELECT 0 AS b, * FROM f0 UNION ALL SELECT 1, * FROM f1 UNION ALL SELECT 2, * FROM f2) GROUP BY ALL)",
    ),
}
