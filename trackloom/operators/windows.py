"""Window operators over position logs: gaps, point-in-time state, downsampling, step classification, ranks and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import haversine_km, initial_bearing, turn
from trackloom.operators.tracks import with_previous
from trackloom.session import materialize
from trackloom.sources.standins import km_sql, oracle, positions, reports, table

AT = 1_705_000_000.0  # a fixed "now" for the registered queries


def position_gaps(log: DataFrame, least: float = 14_400.0) -> DataFrame:
    """Silences of `least` seconds or more between an entity's successive fixes, in no order. Equal times order by event_id."""
    steps = with_previous(log.select("entity_id", "event_id", "ts", "lat", "lon"), ["ts", "lat", "lon", "event_id"])
    gaps = steps.where("b is not null").withColumn("gap_seconds", F.col("ts") - F.col("b.ts")).where(F.col("gap_seconds") >= least)
    return gaps.select(
        "entity_id", F.col("b.event_id").alias("from_event"), F.col("event_id").alias("to_event"), F.round("gap_seconds", 3).alias("gap_seconds"),
        F.col("b.lat").alias("from_lat"), F.col("b.lon").alias("from_lon"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"),
    )


def state_at(log: DataFrame, at: float, window: float) -> DataFrame:
    """Newest fix of each entity within `window` of the newest fix of all in (at - window, at].

    The anchor is a one-row aggregate, and each entity's fix comes from a max_by that combines before the shuffle.
    """
    anchor = log.where((F.col("ts") > at - window) & (F.col("ts") <= at)).agg(F.max("ts").alias("anchor"))
    # the anchor is later than at - window, so nothing older than two windows can count: a bound that prunes files
    near = log.where((F.col("ts") <= at) & (F.col("ts") > at - 2 * window)).join(F.broadcast(anchor), (F.col("ts") >= F.col("anchor") - window) & (F.col("ts") <= F.col("anchor")))
    last = near.groupBy("entity_id").agg(F.max_by(F.struct("event_id", "ts", "lat", "lon", "kind"), F.struct("ts", "event_id")).alias("r"))
    return last.select("entity_id", "r.*")


def frames(log: DataFrame, start: float, step: float, count: int, window: float) -> DataFrame:
    """state_at() of `count` moments, `step` seconds apart from `start` on, in one pass over the log: a column frame from 0 on, and the fixes.

    A fix belongs to the first moment that isn't before it. One row per entity and moment is left of the log, its newest
    fix by then; it stands for all moments up to the entity's next one, as long as it is within reach of their anchors.
    The anchors, the newest fix of all by each moment, are one row per moment.
    """
    if step <= 0 or count < 1:
        raise ValueError("step is over 0, count 1 at least")
    last = start + step * (count - 1)
    near = log.where((F.col("ts") <= last) & (F.col("ts") > start - 2 * window))
    # dividing may round a fix on a moment to the next one: the moments themselves decide
    k = F.ceil((F.col("ts") - start) / step).cast("int")
    first = F.greatest(F.lit(0), F.when(start + (k - 1) * F.lit(step) >= F.col("ts"), k - 1).when(start + k * F.lit(step) < F.col("ts"), k + 1).otherwise(k))
    slots = near.withColumn("slot", first).where(F.col("slot") < count).groupBy("entity_id", "slot").agg(F.max_by(F.struct("event_id", "ts", "lat", "lon", "kind"), F.struct("ts", "event_id")).alias("r"))
    slots = materialize(slots, "frames")
    moment = F.col("frame") * F.lit(step) + start
    # at most one row a moment, so one task is enough
    newest = slots.groupBy("slot").agg(F.max("r.ts").alias("newest"))
    every = log.sparkSession.range(count).select(F.col("id").cast("int").alias("frame")).join(newest, F.col("frame") == F.col("slot"), "left")
    anchors = every.select("frame", F.max("newest").over(Window.partitionBy(F.lit(0)).orderBy("frame")).alias("anchor")).where(F.col("anchor") > moment - window)
    until = F.least(F.lead("slot").over(Window.partitionBy("entity_id").orderBy("slot")) - 1, F.lit(count - 1), F.floor((F.col("r.ts") - start + 2 * window) / step).cast("int"))
    shown = slots.select("entity_id", "slot", "r", until.alias("until")).where("until >= slot").select("entity_id", "r", F.explode(F.sequence("slot", "until")).alias("frame"))
    return shown.join(F.broadcast(anchors), "frame").where(F.col("r.ts") >= F.col("anchor") - window).select("frame", "entity_id", "r.*")


def downsample(log: DataFrame, budget: int) -> DataFrame:
    """First fix of each of about `budget` equal time buckets of each entity's track; whole seconds wide, at least one."""
    budget = min(2000, max(2, budget))
    span = log.groupBy("entity_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    width = F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0")) / budget))
    placed = log.join(span, "entity_id").withColumn("bucket", F.floor((F.col("ts") - F.col("t0")) / width))
    first = placed.groupBy("entity_id", "bucket").agg(F.min_by(F.struct("event_id", "ts", "lat", "lon"), F.struct("ts", "event_id")).alias("r"))
    return first.select("entity_id", "bucket", "r.*")


def classify_steps(log: DataFrame, most_gap=1_800.0, most_kmh=2_200.0, least_km=5.0, most_turn=150.0) -> DataFrame:
    """Successive fixes of an entity, up to most_gap seconds apart and not on the ground, that are `speed` or `reversal` anomalies or `ok`."""
    steps = with_previous(log, ["ts", "lat", "lon", "on_ground", "course"]).where("b is not null").withColumn("dt", F.col("ts") - F.col("b.ts"))
    valid = steps.where((F.col("dt") > 0) & (F.col("dt") <= most_gap) & ~F.coalesce(F.col("on_ground"), F.lit(False)) & ~F.coalesce(F.col("b.on_ground"), F.lit(False)))
    km = haversine_km("b.lat", "b.lon", "lat", "lon")
    heading = F.when(F.col("b.course") < 360, F.col("b.course").cast("double"))
    measured = valid.withColumn("km", km).withColumn("kmh", F.col("km") / F.col("dt") * 3600).withColumn("off", turn(initial_bearing("b.lat", "b.lon", "lat", "lon"), heading))
    verdict = F.when(F.col("kmh") > most_kmh, "speed").when((F.col("km") >= least_km) & (F.col("off") > most_turn), "reversal").otherwise("ok")
    return measured.select("entity_id", "event_id", F.round("km", 6).alias("km"), verdict.alias("verdict"))


def top_one(df: DataFrame, by: list[str], order: Column, *keep: str) -> DataFrame:
    """The row of each group with the greatest order value, by a max_by instead of a rank over sorted groups."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("r")).select(*by, "r.*")


def duplicate_suffix(df: DataFrame, base: str, order: str, out: str = "unique_name") -> DataFrame:
    """Base names made unique: the nth duplicate in order gets #n."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("#"), F.col("_n").cast("string")))).drop("_n")


def half_trend(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """up, down or flat: the sum of the second half of each series against that of its first."""
    w = Window.partitionBy(key)
    placed = df.withColumn("_k", F.row_number().over(w.orderBy(order, value))).withColumn("_n", F.count("*").over(w))
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    total = lambda part: F.round(F.coalesce(F.sum(F.when(part, F.col(value))), F.lit(0.0)), 4)
    sums = placed.groupBy(key).agg(total(early).alias("first_sum"), total(~early).alias("second_sum"))
    return sums.withColumn("trend", F.when(F.col("second_sum") > F.col("first_sum"), "up").when(F.col("second_sum") < F.col("first_sum"), "down").otherwise("flat"))


QUERIES = {
    "position_gaps": lambda s, d: position_gaps(positions(s, d)),
    "state_as_of": lambda s, d: state_at(positions(s, d), AT, 86_400.0),
    "replay_frames": lambda s, d: frames(positions(s, d), AT - 47 * 3_600.0, 3_600.0, 48, 7_200.0),
    "track_downsample": lambda s, d: downsample(positions(s, d), 20),
    "step_verdicts": lambda s, d: classify_steps(positions(s, d), most_gap=86_400.0),
    "capital_per_country": lambda s, d: top_one(table(s, d, "customer"), ["c_nationkey"], F.struct("c_acctbal", -F.col("c_custkey")), "c_custkey", "c_name", "c_acctbal"),
    "duplicate_suffix": lambda s, d: duplicate_suffix(table(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey"),
    "half_trend": lambda s, d: half_trend(reports(s, d).groupBy("actor", "day").agg(F.sum("severity").alias("v")), "actor", "day", "v"),
    "last_value_carry": lambda s, d: top_one(positions(s, d), ["entity_id", "kind"], F.struct("ts", "event_id"), "event_id", "speed"),
}

_LAST = "arg_max({'event_id': event_id, 'ts': ts, 'lat': lat, 'lon': lon, 'kind': kind}, {'ts': ts, 'event_id': event_id})"
ORACLES = {
    "position_gaps": oracle(
        "positions",
        """SELECT entity_id, pe AS from_event, event_id AS to_event, round(ts - pt, 3) AS gap_seconds, pla AS from_lat, plo AS from_lon, lat AS to_lat, lon AS to_lon
        FROM (SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lag(event_id) OVER w AS pe FROM positions WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))
        WHERE pt IS NOT NULL AND ts - pt >= 14400""",
    ),
    "state_as_of": oracle(
        "positions",
        f"""SELECT entity_id, r.event_id, r.ts, r.lat, r.lon, r.kind FROM (SELECT entity_id, {_LAST} AS r FROM positions, a WHERE ts <= {AT} AND ts >= anchor - 86400 AND ts <= anchor GROUP BY entity_id)""",
        f"a AS (SELECT max(ts) AS anchor FROM positions WHERE ts > {AT} - 86400 AND ts <= {AT})",
    ),
    "replay_frames": oracle(
        "positions", "SELECT frame, entity_id, event_id, ts, lat, lon, kind FROM p JOIN a ON ts <= m AND ts >= anchor - 7200 QUALIFY row_number() OVER (PARTITION BY frame, entity_id ORDER BY ts DESC, event_id DESC) = 1",
        f"m AS (SELECT CAST(i AS INT) AS frame, {AT} - 47 * 3600 + i * 3600 AS m FROM range(48) t(i))", f"p AS (SELECT * FROM positions WHERE ts > {AT} - 60 * 3600 AND ts <= {AT})",
        "a AS (SELECT frame, m, max(ts) AS anchor FROM m JOIN p ON ts <= m AND ts > m - 7200 GROUP BY ALL)",
    ),
    "track_downsample": oracle(
        "positions",
        """SELECT entity_id, bucket, event_id, ts, lat, lon FROM (SELECT p.entity_id, CAST(floor((ts - t0) / greatest(1, ceil((t1 - t0) / 20))) AS BIGINT) AS bucket, event_id, ts, lat, lon FROM positions p JOIN s USING (entity_id))
        QUALIFY row_number() OVER (PARTITION BY entity_id, bucket ORDER BY ts, event_id) = 1""",
        "s AS (SELECT entity_id, min(ts) AS t0, max(ts) AS t1 FROM positions GROUP BY entity_id)",
    ),
    "step_verdicts": oracle(
        "positions",
        """SELECT entity_id, event_id, round(km, 6) AS km, CASE WHEN km / dt * 3600 > 2200 THEN 'speed' WHEN km >= 5 AND least(d, 360 - d) > 150 THEN 'reversal' ELSE 'ok' END AS verdict
        FROM (SELECT *, (((brg - CASE WHEN pc < 360 THEN pc END) % 360) + 360) % 360 AS d FROM m)""",
        """b AS (SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lag(on_ground) OVER w AS pg, lag(course) OVER w AS pc FROM positions WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))""",
        f"""m AS (SELECT *, ts - pt AS dt, {km_sql('pla', 'plo', 'lat', 'lon')} AS km,
          degrees(atan2(sin(radians(lon) - radians(plo)) * cos(radians(lat)), cos(radians(pla)) * sin(radians(lat)) - sin(radians(pla)) * cos(radians(lat)) * cos(radians(lon) - radians(plo)))) AS brg
          FROM b WHERE pt IS NOT NULL AND ts - pt > 0 AND ts - pt <= 86400 AND NOT coalesce(on_ground, false) AND NOT coalesce(pg, false))""",
    ),
    "capital_per_country": "SELECT c_nationkey, c_custkey, c_name, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1",
    "duplicate_suffix": """SELECT p_partkey, p_name, CASE WHEN n = 1 THEN p_name ELSE p_name || '#' || n END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""",
    "half_trend": oracle(
        "reports",
        """SELECT actor, first_sum, second_sum, CASE WHEN second_sum > first_sum THEN 'up' WHEN second_sum < first_sum THEN 'down' ELSE 'flat' END AS trend
        FROM (SELECT actor, round(coalesce(sum(v) FILTER (k <= n // 2), 0), 4) AS first_sum, round(coalesce(sum(v) FILTER (k > n // 2), 0), 4) AS second_sum FROM h GROUP BY actor)""",
        "g AS (SELECT actor, day, sum(severity) AS v FROM reports GROUP BY ALL)",
        "h AS (SELECT actor, v, row_number() OVER (PARTITION BY actor ORDER BY day, v) AS k, count(*) OVER (PARTITION BY actor) AS n FROM g)",
    ),
    "last_value_carry": oracle("positions", "SELECT entity_id, kind, event_id, speed FROM positions QUALIFY row_number() OVER (PARTITION BY entity_id, kind ORDER BY ts DESC, event_id DESC) = 1"),
}
