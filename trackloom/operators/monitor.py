"""Rules over latest state, emergencies, trails, arrivals, replay status, layer status and counter quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import in_box, in_box_wrapped
from trackloom.operators.joins import BOXES
from trackloom.operators.tracks import running_sum, with_previous
from trackloom.operators.windows import state_at
from trackloom.sources.standins import oracle, positions

T0 = 1_704_067_200.0
RULE_SCHEMA = "rule string, layer string, enabled boolean, test string, n long, field string, threshold double, code string, south double, west double, north double, east double, country string"
#: Rules are rows: enter, count_exceeds (n), score_above (field, threshold) or squawk_equals (code), in a box, a country or anywhere.
RULES = [
    ("north", "view", True, "enter", None, None, None, None, 30.0, -180.0, 90.0, 180.0, None), ("pacific", "click", True, "count_exceeds", 1, None, None, None, -60.0, 150.0, 60.0, -120.0, None),
    ("many", "view", True, "count_exceeds", 1_000_000, None, None, None, None, None, None, None, None), ("fast", "error", True, "score_above", None, "speed", 60.0, None, None, None, None, None, None),
    ("low", "view", True, "score_above", None, "altitude", 1500.0, None, None, None, None, None, "3"), ("code", "click", True, "squawk_equals", None, None, None, "7700", None, None, None, None, None),
    ("off", "view", False, "enter", None, None, None, None, None, None, None, None, None),
]
#: Rules are broadcast; more than this many are refused.
MOST_RULES = 10_000


def evaluate_rules(latest: DataFrame, rules: list[tuple], fields: tuple[str, ...]) -> DataFrame:
    """What fires now: (rule, subject, n), subject `*` for counts. latest: entity_id, layer, lat, lon, country, squawk and the numeric fields.

    Enabled rules meet the entities of their layer; one without a fence takes all, one with a fence only those placed in
    it (a box may span the antimeridian). count_exceeds fires above n, score_above above the threshold; null values never fire.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    r = latest.sparkSession.createDataFrame(rules, RULE_SCHEMA).where("enabled")
    boxed = F.col("south").isNotNull()
    fenced = F.when(boxed, F.coalesce(in_box_wrapped("lat", "lon", tuple(F.col(c) for c in ("south", "west", "north", "east"))), F.lit(False))).when(r["country"].isNotNull(), F.coalesce(latest["country"] == r["country"], F.lit(False))).otherwise(True)
    inside = latest.join(F.broadcast(r), "layer").where(fenced)
    value = F.coalesce(*[F.when(F.col("field") == f, F.col(f).cast("double")) for f in fields], F.lit(None).cast("double"))
    fires = F.when(F.col("test") == "enter", True).when(F.col("test") == "score_above", value > F.col("threshold")).when(F.col("test") == "squawk_equals", F.col("squawk") == F.col("code")).otherwise(False)
    each = inside.where(F.coalesce(fires, F.lit(False))).select("rule", F.col("entity_id").cast("string").alias("subject"), F.lit(1).cast("long").alias("n"))
    counts = inside.where("test = 'count_exceeds'").groupBy("rule").agg(F.count("*").alias("k"), F.max("n").alias("most")).where("k > most").select("rule", F.lit("*").alias("subject"), F.col("k").alias("n"))
    return each.unionByName(counts)


def emergencies(log: DataFrame) -> DataFrame:
    """Spells of an unchanged signature: when each was first and last seen, by gaps and islands."""
    sig = F.when(F.col("kind") == "error", F.concat(F.lit("e"), F.floor(F.col("value") / 40).cast("string")))
    marked = with_previous(log.select("entity_id", "event_id", "ts", sig.alias("sig")), ["sig"])
    spells = running_sum(marked, ~F.col("sig").eqNullSafe(F.col("b.sig")) & F.col("sig").isNotNull(), "spell").where("sig is not null")
    return spells.groupBy("entity_id", "spell", "sig").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


def trails(log: DataFrame, keep: int) -> DataFrame:
    """The last `keep` fixes of each entity at which it had moved, newest first."""
    placed = log.select("entity_id", "event_id", "ts", F.floor("lat").alias("y"), F.floor("lon").alias("x"))
    moved = with_previous(placed, ["y", "x"]).where(F.col("b").isNull() | (F.col("b.y") != F.col("y")) | (F.col("b.x") != F.col("x")))
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return moved.withColumn("n", n).where(F.col("n") <= keep).select("entity_id", "n", "event_id")


def arrivals(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    return now.join(before.select(key), key, "left_anti")


def replay_status(log: DataFrame, at: float, window: float, kinds: list[str]) -> DataFrame:
    """Per kind: ok with a count at that time, no_history, or unavailable where the kind isn't kept at all."""
    wanted = log.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    ever = log.groupBy("kind").agg(F.min("ts").alias("since"))
    then = state_at(log, at, window).groupBy("kind").agg(F.count("*").alias("n"))
    j = wanted.join(ever, "kind", "left").join(then, "kind", "left")
    status = F.when(F.col("since").isNull(), "unavailable").when(F.col("n").isNull(), "no_history").otherwise("ok")
    return j.select("kind", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def layer_status(log: DataFrame, box: tuple, now: float, stale: float) -> DataFrame:
    """Per kind: unhealthy, empty, partial or included, by its total, what a view holds and its age."""
    g = log.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(in_box("lat", "lon", box)).alias("viewed"), F.max("ts").alias("newest"))
    s = F.when(F.lit(now) - F.col("newest") > stale, "unhealthy").when(F.col("viewed") == 0, "empty").when(F.col("viewed") < F.col("total") / 20, "partial").otherwise("included")
    return g.select("kind", "total", "viewed", s.alias("status"))


def histogram_quantile(log: DataFrame, q: float, bounds: list[float]) -> DataFrame:
    """A quantile per kind from bucket counts, interpolated inside its bucket."""
    le = F.coalesce(*[F.when(F.col("value") <= b, F.lit(float(b))) for b in bounds])
    counts = log.withColumn("le", le).where("le is not null").groupBy("kind", "le").agg(F.count("*").alias("n"))
    w = Window.partitionBy("kind").orderBy("le")  # over buckets, not rows
    c = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("kind")))
    lower = F.coalesce(*[F.when(F.col("le") == b, F.lit(float(a))) for a, b in zip([0.0, *bounds], bounds)])
    rank = F.col("total") * q
    hit = c.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return hit.select("kind", F.round(lower + (F.col("le") - lower) * (rank - (F.col("upto") - F.col("n"))) / F.col("n"), 6).alias("quantile"))


def _latest(s, d):
    p = positions(s, d)
    last = p.groupBy("entity_id").agg(F.max_by(F.struct("kind", "lat", "lon", "speed", "altitude", "event_id"), F.struct("ts", "event_id")).alias("r")).select("entity_id", "r.*")
    return last.withColumnRenamed("kind", "layer").withColumn("country", (F.col("entity_id") % 5).cast("string")).withColumn("squawk", F.when(F.col("event_id") % 3 == 0, "7700").otherwise("1200"))


_BOX = BOXES["middle"]
QUERIES = {
    "alert_rules": lambda s, d: evaluate_rules(_latest(s, d), RULES, ("speed", "altitude")),
    "alert_emergencies": lambda s, d: emergencies(positions(s, d)),
    "trail_tail": lambda s, d: trails(positions(s, d).withColumn("lat", F.col("lat") + F.col("event_id") % 3), 8),
    "trail_arrivals": lambda s, d: arrivals(positions(s, d).where(F.col("ts") >= T0 + 28 * 86_400).select("entity_id", "kind").distinct(), positions(s, d).where((F.col("ts") < T0 + 5 * 86_400) & (F.col("kind") == "view")).select("entity_id").distinct(), "entity_id"),
    "replay_status": lambda s, d: replay_status(positions(s, d), T0 + 86_400 / 2, 3_600.0, ["view", "click", "error", "absent"]),
    "layer_status": lambda s, d: layer_status(positions(s, d), _BOX, T0 + 30 * 86_400, 3_600.0),
    "monitor_quantile": lambda s, d: histogram_quantile(positions(s, d), 0.9, [5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]),
}
_L = "l AS (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)"
ORACLES = {
    "alert_rules": oracle(
        "positions",
        """SELECT 'north' AS rule, CAST(entity_id AS VARCHAR) AS subject, 1 AS n FROM l WHERE kind = 'view' AND lat BETWEEN 30 AND 90 AND lon BETWEEN -180 AND 180
        UNION ALL SELECT 'pacific', '*', count(*) FROM l WHERE kind = 'click' AND lat BETWEEN -60 AND 60 AND (lon >= 150 OR lon <= -120) HAVING count(*) > 1
        UNION ALL SELECT 'fast', CAST(entity_id AS VARCHAR), 1 FROM l WHERE kind = 'error' AND speed > 60
        UNION ALL SELECT 'low', CAST(entity_id AS VARCHAR), 1 FROM l WHERE kind = 'view' AND altitude > 1500 AND entity_id % 5 = 3
        UNION ALL SELECT 'code', CAST(entity_id AS VARCHAR), 1 FROM l WHERE kind = 'click' AND event_id % 3 = 0""", _L,
    ),
    "alert_emergencies": oracle(
        "positions", "SELECT entity_id, spell, sig, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM (SELECT *, CAST(sum(CAST(sig IS DISTINCT FROM b AND sig IS NOT NULL AS INT)) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS BIGINT) AS spell FROM b) WHERE sig IS NOT NULL GROUP BY ALL",
        "s AS (SELECT *, CASE WHEN kind = 'error' THEN 'e' || CAST(floor(value / 40) AS BIGINT) END AS sig FROM positions)", "b AS (SELECT *, lag(sig) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS b FROM s)",
    ),
    "trail_tail": oracle(
        "positions", "SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS INT) AS n, event_id FROM m WHERE y IS NULL OR y <> floor(la) OR x <> floor(lon) QUALIFY n <= 8",
        "p AS (SELECT *, lat + event_id % 3 AS la FROM positions)", "m AS (SELECT *, lag(floor(la)) OVER w AS y, lag(floor(lon)) OVER w AS x FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))",
    ),
    "trail_arrivals": oracle("positions", f"SELECT DISTINCT entity_id, kind FROM positions WHERE ts >= {T0 + 28 * 86400} AND entity_id NOT IN (SELECT entity_id FROM positions WHERE kind = 'view' AND ts < {T0 + 5 * 86400})"),
    "replay_status": oracle(
        "positions", "SELECT k.kind, CASE WHEN since IS NULL THEN 'unavailable' WHEN n IS NULL THEN 'no_history' ELSE 'ok' END AS status, coalesce(n, 0) AS n FROM (VALUES ('view'), ('click'), ('error'), ('absent')) k(kind) LEFT JOIN e ON e.kind = k.kind LEFT JOIN t ON t.kind = k.kind",
        f"a AS (SELECT max(ts) AS anchor FROM positions WHERE ts > {T0 + 43200 - 3600} AND ts <= {T0 + 43200})", "e AS (SELECT kind, min(ts) AS since FROM positions GROUP BY 1)",
        "t AS (SELECT kind, count(*) AS n FROM (SELECT p.* FROM positions p, a WHERE ts <= anchor AND ts >= anchor - 3600 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1)",
    ),
    "layer_status": oracle("positions", f"SELECT kind, total, viewed, CASE WHEN {T0 + 30 * 86400} - newest > 3600 THEN 'unhealthy' WHEN viewed = 0 THEN 'empty' WHEN viewed < total / 20 THEN 'partial' ELSE 'included' END AS status FROM (SELECT kind, count(*) AS total, count(*) FILTER (lat BETWEEN {_BOX[0]} AND {_BOX[2]} AND lon BETWEEN {_BOX[1]} AND {_BOX[3]}) AS viewed, max(ts) AS newest FROM positions GROUP BY 1)"),
    "monitor_quantile": oracle(
        "positions", "SELECT kind, round(lo + (le - lo) * (0.9::DOUBLE * total - (upto - n)) / n, 6) AS quantile FROM u WHERE upto >= 0.9::DOUBLE * total AND upto - n < 0.9::DOUBLE * total",
        "b(lo, le) AS (VALUES (0.0::DOUBLE, 5.0::DOUBLE), (5, 10), (10, 25), (25, 50), (50, 100), (100, 250), (250, 500))",
        "c AS (SELECT kind, lo, le, count(*) AS n FROM positions JOIN b ON value > lo AND value <= le GROUP BY ALL)",
        "u AS (SELECT *, sum(n) OVER (PARTITION BY kind ORDER BY le) AS upto, sum(n) OVER (PARTITION BY kind) AS total FROM c)",
    ),
}
