"""Rolling state of entities over streams: the last day's interference samples and the draughts of the last days.

A stream's rows come in any order. Each key holds its rows until the watermark has passed them and then takes them in the
order of (ts, event_id), so a row that is late by less than the watermark's delay is placed where it belongs; later ones
are dropped by Spark. What a row gives depends on rows before it only, so the batch forms beside them, which are windows
and groups over the whole log, give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import atan2, cos, degrees, radians, sin

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackloom.functions.geo import haversine_km, initial_bearing, turn
from trackloom.functions.hexgrid import cell_of
from trackloom.operators.tracks import with_previous
from trackloom.session import ship
from trackloom.sources.standins import oracle, positions
from trackloom.streaming.sessions import _km, _rows

#: Seconds of the sample window and of a comparable step, kept samples of an aircraft in a cell, and the
#: anomalies' limits in km/h, km and degrees.
WINDOW_S, GAP_S, MOST, KMH, TURN_KM, TURN_DEG = 86_400.0, 1_800.0, 1_000, 2_200.0, 5.0, 150.0
#: Seconds that a draught counts, readings that a verdict needs, and shares of the deepest one.
KEEP_S, LEAST, LADEN, BALLAST = 259_200.0, 5, 0.85, 0.55
#: Watched cells are the worst hundred of a day, so they are broadcast; more than this are refused.
CELLS = 10_000

SAMPLE_SCHEMA = "entity_id long, event_id long, ts double, cell string, flag string, samples long, flags long"
PROFILE_SCHEMA = "entity_id long, event_id long, ts double, readings long, latest double, low double, high double, state string"


def watched(fixes: DataFrame, cells: DataFrame) -> DataFrame:
    """Fixes (entity_id, event_id, ts, lat, lon, on_ground, course) with the watched cell (column cell of cells) they are in, null outside."""
    if cells.limit(CELLS + 1).count() > CELLS:
        raise ValueError(f"over {CELLS} watched cells")
    ship(fixes.sparkSession)
    return fixes.withColumn("_at", cell_of(F.col("lat"), F.col("lon"))).join(F.broadcast(cells.select("cell").distinct()), F.col("_at") == F.col("cell"), "left").drop("_at")


def interference_samples(fixes: DataFrame, cells: DataFrame, most: int = MOST) -> DataFrame:
    """Every step of an aircraft in the air that ends in a watched cell, and what the cell has of it in the day up to then.

    A step is two successive fixes up to GAP_S apart, neither on the ground. flag is `speed` over KMH, `heading_reversal`
    if it runs over TURN_DEG off the reported course on TURN_KM or more, null otherwise. samples and flags count this
    aircraft's in this cell within WINDOW_S, the newest `most` of either.
    """
    log = watched(fixes.where("entity_id is not null and ts is not null"), cells)
    steps = with_previous(log.select("entity_id", "event_id", "ts", "lat", "lon", "on_ground", "course", "cell"), ["ts", "lat", "lon", "on_ground"])
    air = ~F.coalesce(F.col("on_ground"), F.lit(False)) & ~F.coalesce(F.col("b.on_ground"), F.lit(False))
    dt = F.col("ts") - F.col("b.ts")
    taken = steps.where(F.col("b").isNotNull() & (dt > 0) & (dt <= GAP_S) & air & F.col("cell").isNotNull())
    km = haversine_km("b.lat", "b.lon", "lat", "lon")
    off = turn(initial_bearing("b.lat", "b.lon", "lat", "lon"), F.col("course").cast("double"))
    flag = F.when(km / (dt / 3600) > KMH, "speed").when((km >= TURN_KM) & (off > TURN_DEG), "heading_reversal")
    day = Window.partitionBy("entity_id", "cell").orderBy("ts").rangeBetween(-int(WINDOW_S), 0)
    counted = taken.withColumn("flag", flag).withColumns({"samples": F.least(F.count("*").over(day), F.lit(most)), "flags": F.least(F.count("flag").over(day), F.lit(most))})
    return counted.select("entity_id", "event_id", "ts", "cell", "flag", "samples", "flags")


def cross_check(samples: DataFrame, cells: DataFrame, now: float, least: int = 2, share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The watched cells and the aircraft at a moment, from samples up to then and within WINDOW_S of it.

    A cell is flagged if `share` of its aircraft have flags, clean with aircraft, no_traffic without. An aircraft is flagged
    with a flag, checked_clean with `least` samples, insufficient_samples else.
    """
    recent = samples.where((F.col("ts") <= now) & (F.col("ts") >= now - WINDOW_S))
    per = recent.groupBy("cell", "entity_id").agg(F.least(F.count("*"), F.lit(MOST)).alias("samples"), F.least(F.count("flag"), F.lit(MOST)).alias("flags"))
    of_cell = per.groupBy("cell").agg(F.count("*").alias("observed"), F.count_if(F.col("flags") > 0).alias("flagged"))
    verdict = F.when(F.col("observed").isNull(), "no_traffic").when(F.col("flagged") / F.col("observed") >= share, "flagged").otherwise("clean")
    by_cell = cells.select("cell").distinct().join(of_cell, "cell", "left").select("cell", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("flagged", F.lit(0)).alias("flagged"), verdict.alias("status"))
    craft = per.groupBy("entity_id").agg(F.sum("samples").alias("samples"), F.sum("flags").alias("flags"), F.count("*").alias("cells"))
    return by_cell, craft.withColumn("status", F.when(F.col("flags") > 0, "flagged").when(F.col("samples") >= least, "checked_clean").otherwise("insufficient_samples"))


class InOrder(StatefulProcessor):
    """Takes a key's rows in the order of (ts, event_id) once the watermark has passed them; forgets the key `keep` seconds after its last."""

    fields: list[str]
    kinds: str
    columns: list[str]
    keep: float

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.kinds)
        self.newest = handle.getValueState("newest", "ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r.values()) for f in rows for r in _rows(f, self.fields)]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(int(min(r[0] for r in new) * 1000) + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        out = [(key[0], *x) for r in due for x in self.step(dict(zip(self.fields, r)))]
        if rest:
            self.held.put(rest)
            self.handle.registerTimer(int(rest[0][0] * 1000) + 1)
        else:
            self.held.clear()
        if due:
            self.newest.update((due[-1][0],))
            self.handle.registerTimer(int((due[-1][0] + self.keep) * 1000) + 1)
        elif not rest and self.newest.exists() and self.newest.get()[0] + self.keep < mark:
            self.newest.clear()
            self.forget()
        yield pd.DataFrame(out, columns=self.columns)

    def step(self, row: dict) -> list[tuple]:
        """What the row gives, without the key."""
        raise NotImplementedError

    def forget(self) -> None:
        """Clears what step() keeps."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Interference(InOrder):
    """interference_samples() over keyed state: the last fix, and the kept samples of the aircraft, a list of (cell, ts, flag)."""

    fields = ["ts", "event_id", "lat", "lon", "on_ground", "course", "cell"]
    kinds = "ts double, event_id long, lat double, lon double, on_ground boolean, course double, cell string"
    columns, keep = _names(SAMPLE_SCHEMA), WINDOW_S

    def __init__(self, most: int = MOST):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts double, lat double, lon double, on_ground boolean")
        self.samples = handle.getListState("samples", "cell string, ts double, flag string")

    def step(self, row: dict) -> list[tuple]:
        last = self.last.get() if self.last.exists() else None
        self.last.update((row["ts"], row["lat"], row["lon"], row["on_ground"]))
        if last is None or row["cell"] is None or last[3] is True or row["on_ground"] is True or not 0 < row["ts"] - last[0] <= GAP_S:
            return []
        flag = self.anomaly(last, row)
        kept = [s for s in self.samples.get() if s[1] >= row["ts"] - WINDOW_S] + [(row["cell"], row["ts"], flag)]
        here = [s for s in kept if s[0] == row["cell"]]
        if len(here) > self.most:  # the newest of the samples, and of the flags
            stay = {*map(id, here[-self.most :]), *map(id, [s for s in here if s[2] is not None][-self.most :])}
            kept = [s for s in kept if s[0] != row["cell"] or id(s) in stay]
        self.samples.put(kept)
        return [(row["event_id"], row["ts"], row["cell"], flag, min(len(here), self.most), min(sum(s[2] is not None for s in here), self.most))]

    @staticmethod
    def anomaly(last, row: dict) -> str | None:
        km = _km(last[1], last[2], row["lat"], row["lon"])
        if km / ((row["ts"] - last[0]) / 3600) > KMH:
            return "speed"
        if km < TURN_KM or row["course"] is None:
            return None
        a, b, dlon = radians(last[1]), radians(row["lat"]), radians(row["lon"] - last[2])
        bearing = degrees(atan2(sin(dlon) * cos(b), cos(a) * sin(b) - sin(a) * cos(b) * cos(dlon)))
        off = abs(bearing - row["course"]) % 360
        return "heading_reversal" if min(off, 360 - off) > TURN_DEG else None

    def forget(self) -> None:
        self.last.clear()
        self.samples.clear()


class Draughts(InOrder):
    """draught_rows() over keyed state: a map of each reading, to a tenth of a metre, to when it was last seen."""

    fields, kinds = ["ts", "event_id", "draught"], "ts double, event_id long, draught double"
    columns, keep = _names(PROFILE_SCHEMA), KEEP_S

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "reading double", "ts double")
        self.latest = handle.getValueState("latest", "reading double, ts double")

    def step(self, row: dict) -> list[tuple]:
        if row["draught"] is not None:
            self.seen.updateValue((row["draught"],), (row["ts"],))
            self.latest.update((row["draught"], row["ts"]))
        old = [k for k, (ts,) in self.seen.iterator() if ts < row["ts"] - KEEP_S]
        for k in old:
            self.seen.removeKey(k)
        readings = [k[0] for k in self.seen.keys()]
        latest = self.latest.get() if self.latest.exists() else None
        now = latest[0] if latest and row["ts"] - latest[1] <= KEEP_S else None
        low, high = (min(readings), max(readings)) if readings else (None, None)
        state = "unknown"
        if len(readings) >= LEAST and now is not None and high:
            state = "laden" if now / high > LADEN else "ballast" if now / high < BALLAST else "unknown"
        return [(row["event_id"], row["ts"], len(readings), now, low, high, state)]

    def forget(self) -> None:
        self.seen.clear()
        self.latest.clear()


def _stream(fixes: DataFrame, fields: list[str], processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """fixes has the event time in `time`; rows without a key or a time are left out."""
    ship(fixes.sparkSession)
    marked = fixes.where("entity_id is not null and ts is not null and time is not null").select("entity_id", "time", *fields).withWatermark("time", delay)
    return marked.groupBy("entity_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def interference_stream(fixes: DataFrame, cells: DataFrame, delay: str = "15 minutes", most: int = MOST) -> DataFrame:
    """interference_samples() of an unbounded log (with a timestamp column time beside ts). Needs the RocksDB state store."""
    placed = watched(fixes, cells).withColumn("course", F.col("course").cast("double"))
    return _stream(placed, Interference.fields, Interference(most), SAMPLE_SCHEMA, delay)


def draught_stream(fixes: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """draught_rows() of an unbounded log (with a timestamp column time beside ts). Needs the RocksDB state store."""
    return _stream(_readings(fixes), Draughts.fields, Draughts(), PROFILE_SCHEMA, delay)


def _readings(fixes: DataFrame) -> DataFrame:
    return fixes.withColumn("draught", F.round(F.col("draught").cast("double"), 1))


def draught_rows(fixes: DataFrame) -> DataFrame:
    """Per fix (entity_id, event_id, ts, draught): the distinct draughts of its vessel in the KEEP_S up to it, and what the latest says.

    laden over LADEN of the deepest, ballast under BALLAST, unknown between, with fewer than LEAST readings, or where the
    latest is older than KEEP_S.
    """
    log = _readings(fixes.where("entity_id is not null and ts is not null")).select("entity_id", "event_id", "ts", "draught")
    # equal times: a row doesn't know of rows after it in (ts, event_id)
    near = Window.partitionBy("entity_id").orderBy("ts").rangeBetween(-int(KEEP_S), 0)
    seen = F.filter(F.collect_list(F.when(F.col("draught").isNotNull(), F.struct("ts", "event_id", "draught"))).over(near), lambda r: (r["ts"] < F.col("ts")) | (r["event_id"] <= F.col("event_id")))
    rows = log.withColumn("r", seen).withColumn("d", F.array_distinct(F.transform("r", lambda r: r["draught"])))
    latest = F.array_max("r")["draught"]
    return _verdict(rows.select("entity_id", "event_id", "ts", F.size("d").cast("long").alias("readings"), latest.alias("latest"), F.array_min("d").alias("low"), F.array_max("d").alias("high")))


def draughts_at(fixes: DataFrame, now: float) -> DataFrame:
    """Each vessel's profile at a moment, from its fixes in the KEEP_S up to then: one grouping that combines before the shuffle."""
    log = _readings(fixes.where((F.col("ts") <= now) & (F.col("ts") >= now - KEEP_S) & F.col("entity_id").isNotNull()))
    per = log.groupBy("entity_id").agg(
        F.countDistinct("draught").alias("readings"), F.max_by("draught", F.when(F.col("draught").isNotNull(), F.struct("ts", "event_id"))).alias("latest"),
        F.min("draught").alias("low"), F.max("draught").alias("high"),
    )
    return _verdict(per)


def _verdict(profile: DataFrame) -> DataFrame:
    share = F.col("latest") / F.nullif(F.col("high"), F.lit(0.0))
    return profile.withColumn("state", F.when(F.col("readings") < LEAST, "unknown").when(share > LADEN, "laden").when(share < BALLAST, "ballast").otherwise("unknown"))


NOW = 1_705_000_000.0


def _log(s, d):
    """The stand-in log ninety times as fast, so that steps join."""
    return positions(s, d).withColumn("ts", NOW - 86_400 * 9 + (F.col("ts") - (NOW - 86_400 * 9)) / 90)


def _busy(s, d):
    """Cells where every third entity was seen to start: what a day's feed would name."""
    ship(s)
    first = positions(s, d).groupBy("entity_id").agg(F.min_by(F.struct("lat", "lon"), F.struct("ts", "event_id")).alias("p")).where("entity_id % 3 = 0")
    return first.select(cell_of(F.col("p.lat"), F.col("p.lon")).alias("cell")).distinct()


QUERIES = {
    "roll_interference": lambda s, d: interference_samples(_log(s, d), _busy(s, d).orderBy("cell").limit(100)),
    "roll_draughts": lambda s, d: draughts_at(positions(s, d), NOW),
}
ORACLES = {
    "roll_draughts": oracle(
        "positions",
        """SELECT *, CASE WHEN readings < 5 THEN 'unknown' WHEN latest / nullif(high, 0) > 0.85 THEN 'laden' WHEN latest / nullif(high, 0) < 0.55 THEN 'ballast' ELSE 'unknown' END AS state FROM g""",
        f"""g AS (SELECT entity_id, count(DISTINCT round(draught, 1)) AS readings, arg_max(round(draught, 1), {{'t': ts, 'e': event_id}}) FILTER (draught IS NOT NULL) AS latest, min(round(draught, 1)) AS low, max(round(draught, 1)) AS high
        FROM positions WHERE ts <= {NOW} AND ts >= {NOW} - 259200 GROUP BY 1)""",
    ),
}
