"""Sessions of entities: port calls and flight legs over batches and over streams, day counts, latest state.

Port calls are one step function, run over sorted partitions in batch and over keyed state in streams; each task holds one
entity's state at a time. Flight legs are gaps and islands over built-in windows in batch, and the same rules as a step
function in streams; tests hold the two equal.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.functions.geo import haversine_km
from trackloom.operators.tracks import running_sum, with_previous

#: Knots and seconds that open and close a port call, and the kilometres of its match classes.
DWELL_KN, DWELL_S, LEAVE_KN, LEAVE_S = 0.5, 3_600.0, 1.0, 1_800.0
EXACT_KM, NEAR_KM, REACH_KM = 3.0, 15.0, 50.0
#: Silence that ends a leg, the altitude that parts ground from air, its slack, and the reach of an airfield.
LEG_GAP_S, CLIMB_FT, SLACK_FT, FIELD_KM = 1_800.0, 1_500.0, 150.0, 10.0
#: Fixes of a vessel are cut into blocks of this many seconds; see port_calls().
CALL_BLOCK_S = 21_600.0

CALL_SCHEMA = "entity_id long, place_id long, match string, arrived_at double, departed_at double, draught_in double, draught_out double"
LEG_SCHEMA = "entity_id long, departed_at double, arrived_at double, origin string, dest string, confidence string, km double, top long, last_seen_at double, fixes long"


def call_step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
    """One fix (ts, speed, draught, place_id, place_km of the nearest place in reach) into a port-call machine; gives the call that it closes.

    Fixes of DWELL_KN or less for DWELL_S open a call, dated from the first of them, at that fix's place. Without a place
    in reach the dwell is dropped, and the next fix may begin another. draught_in is the draught of the fix before the
    dwell, its first one's where there is none. A null speed drops a candidate, but in an open call only forgets when
    moving began. Over LEAVE_KN for LEAVE_S closes it, dated from the first moving fix; draught_out is that of the
    last fix of DWELL_KN or less.
    """
    s = state or {"run": None, "last": None}
    run, before = s["run"], s["last"]
    ts, speed, draught = row["ts"], row["speed"], row["draught"]
    if run is None or not run["open"]:
        if speed is None or speed > DWELL_KN:
            return {"run": None, "last": [draught]}, None
        if run is None:
            run = {"open": False, "since": ts, "place": row["place_id"], "km": row["place_km"], "in": before[0] if before else draught, "moving": None}
        run = run | {"out": draught}
        if ts - run["since"] >= DWELL_S:
            run = run | {"open": True} if run["place"] is not None else None
        return {"run": run, "last": [draught]}, None
    done = None
    if speed is None or speed <= LEAVE_KN:
        run = run | {"moving": None, "out": draught if speed is not None and speed <= DWELL_KN else run["out"]}
    else:
        run = run | {"moving": ts if run["moving"] is None else run["moving"]}
        if ts - run["moving"] >= LEAVE_S:
            done, run = _call(run, run["moving"], run["out"]), None
    return {"run": run, "last": [draught]}, done


def _call(run: dict, departed: float | None, out: float | None) -> dict:
    match = "exact" if run["km"] <= EXACT_KM else "proximity" if run["km"] <= NEAR_KM else "inferred"
    return {"place_id": run["place"], "match": match, "arrived_at": run["since"], "departed_at": departed, "draught_in": run["in"], "draught_out": out}


def call_end(state: dict | None) -> dict | None:
    """The call still open when the log ends, without a departure."""
    return _call(state["run"], None, None) if state and state["run"] and state["run"]["open"] else None


def leg_step(state: dict | None, row: dict) -> tuple[dict, dict | None]:
    """One fix (ts, lat, lon, on_ground, altitude, field, field_km) into a flight-leg machine; gives the leg that ends here.

    A leg starts on the fix that shows a departure: off the ground after on it, or above the altitude line after below it
    within FIELD_KM of an airfield; it ends on the like arrival. After a silence of over LEG_GAP_S nothing is known: a leg
    still open is given up as it stands, without an arrival, and a fix known to be off the ground starts one whose
    departure wasn't seen. The altitude line has SLACK_FT either way once a side is known.
    """
    s = state or {"ts": None, "ground": None, "high": None, "leg": None}
    ts, ground, alt = row["ts"], row["on_ground"], row["altitude"]
    joined = s["ts"] is not None and ts - s["ts"] <= LEG_GAP_S
    was_ground, was_high = (s["ground"], s["high"]) if joined else (None, None)
    leg, out = s["leg"], None
    if leg and not joined:
        leg, out = None, _leg(leg)
    high = was_high if alt is None else alt >= CLIMB_FT if was_high is None else alt >= CLIMB_FT - SLACK_FT if was_high else alt > CLIMB_FT + SLACK_FT
    up = down = False
    if was_ground is not None and ground is not None and was_ground != ground:
        up, down = was_ground, ground
    elif was_high is not None and row["field_km"] is not None and row["field_km"] <= FIELD_KM:
        up, down = high and not was_high, was_high and not high
    if leg is None:
        if up or (not joined and ground is False):
            leg = {"from": ts, "to": None, "origin": row["field"], "dest": None, "seen": up, "km": 0.0, "top": alt, "last": ts, "fixes": 1, "lat": row["lat"], "lon": row["lon"]}
    else:
        top = alt if leg["top"] is None else leg["top"] if alt is None else max(alt, leg["top"])
        leg = leg | {"km": leg["km"] + _km(leg["lat"], leg["lon"], row["lat"], row["lon"]), "top": top, "last": ts, "fixes": leg["fixes"] + 1, "lat": row["lat"], "lon": row["lon"]}
        if down:
            out, leg = _leg(leg | {"to": ts, "dest": row["field"]}), None
    return {"ts": ts, "ground": ground, "high": high, "leg": leg}, out


def _km(a: float, b: float, c: float, d: float) -> float:
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * asin(sqrt(min(1.0, h)))


def _leg(leg: dict) -> dict:
    ends = int(leg["seen"]) + int(leg["to"] is not None)
    return {
        "departed_at": leg["from"], "arrived_at": leg["to"], "origin": leg["origin"], "dest": leg["dest"], "confidence": ("inferred", "observed_one", "observed_both")[ends],
        "km": round(leg["km"], 1), "top": None if leg["top"] is None else round(leg["top"]), "last_seen_at": leg["last"], "fixes": leg["fixes"],
    }


def leg_end(state: dict | None) -> dict | None:
    return _leg(state["leg"]) if state and state["leg"] else None


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _rows(frame: pd.DataFrame, fields: list[str]) -> Iterator[dict]:
    columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in fields]
    for values in zip(*columns):
        yield dict(zip(fields, values))


def port_calls(log: DataFrame) -> DataFrame:
    """Port calls of a log (entity_id, event_id, ts, speed, draught, place_id, place_km), closed ones and those still open at its end.

    A block of time in which a vessel sails all along, for LEAVE_S at least, leaves no call open and no dwell begun, so
    the track is cut after each such block and its parts are walked by different tasks. A vessel that never sails is one part.
    """
    log = log.where("entity_id is not null and ts is not null").withColumn("_block", F.floor(F.col("ts") / CALL_BLOCK_S).cast("long"))
    sails = F.coalesce(F.min(F.coalesce(F.col("speed"), F.lit(-1.0))) > LEAVE_KN, F.lit(False)) & (F.max("ts") - F.min("ts") >= LEAVE_S)
    blocks = log.groupBy("entity_id", "_block").agg(sails.cast("int").alias("sails"), F.max_by(F.struct("draught"), F.struct("ts", "event_id")).alias("last"))
    w = Window.partitionBy("entity_id").orderBy("_block")
    parts = blocks.select("entity_id", "_block", F.coalesce(F.sum("sails").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part"), F.lag("last").over(w).alias("before"))
    fields = ["ts", "speed", "draught", "place_id", "place_km"]
    columns = ["entity_id", "part", *fields]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            out = []
            begun = f["begun"].tolist()
            before = f["before"].astype(object).where(f["before"].notna(), None).tolist()
            keys = list(zip(f["entity_id"].tolist(), f["part"].tolist()))
            for k, row in enumerate(_rows(f, fields)):
                if keys[k] != now:
                    out += [c | {"entity_id": now[0]} for c in [call_end(state)] if c]
                    now, state = keys[k], {"run": None, "last": [before[k]] if begun[k] else None}
                state, done = call_step(state, row)
                if done:
                    out.append(done | {"entity_id": now[0]})
            yield pd.DataFrame(out, columns=_names(CALL_SCHEMA))
        yield pd.DataFrame([c | {"entity_id": now[0]} for c in [call_end(state)] if c], columns=_names(CALL_SCHEMA))

    dealt = log.join(parts, ["entity_id", "_block"]).select(*columns, "event_id", F.col("before").isNotNull().alias("begun"), F.col("before.draught").alias("before"))
    return dealt.repartition("entity_id", "part").sortWithinPartitions("entity_id", "part", "ts", "event_id").mapInPandas(walk, CALL_SCHEMA)


def flight_legs(log: DataFrame) -> DataFrame:
    """Flight legs of a log (entity_id, event_id, ts, lat, lon, on_ground, altitude, field, field_km) by the rules of leg_step().

    Silences cut a track into segments, found block by block; all else is windows over one segment. So an aircraft's
    track is spread over as many tasks as it has segments.
    """
    log = log.where("entity_id is not null and ts is not null").select("entity_id", "event_id", "ts", "lat", "lon", "on_ground", "altitude", "field", "field_km")
    known = with_previous(log, ["ts"], "b")
    broken = F.coalesce(F.col("ts") - F.col("b.ts") > LEG_GAP_S, F.lit(True))
    seg = running_sum(known.withColumn("broken", broken).drop("b"), F.col("broken"), "seg")
    w = Window.partitionBy("entity_id", "seg").orderBy("ts", "event_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    alt = F.col("altitude")
    # a reading decides the side if it is the segment's first, or clears the far side of the slack
    first = alt.isNotNull() & (F.count("altitude").over(before) == 0)
    side = F.when(first, alt >= CLIMB_FT).when(alt < CLIMB_FT - SLACK_FT, False).when(alt > CLIMB_FT + SLACK_FT, True)
    s = seg.withColumn("side", side).withColumn("high", F.last("side", ignorenulls=True).over(upto))
    s = s.withColumn("was_high", F.lag("high").over(w)).withColumn("was_ground", F.lag("on_ground").over(w))
    turned = F.coalesce(F.col("was_ground") != F.col("on_ground"), F.lit(False))
    by_line = ~turned & F.col("was_high").isNotNull() & F.coalesce(F.col("field_km") <= FIELD_KM, F.lit(False)) & (F.col("high") != F.col("was_high"))
    up = (turned & F.col("was_ground")) | (by_line & F.col("high"))
    down = (turned & F.col("on_ground")) | (by_line & F.col("was_high"))
    blind = F.col("broken") & F.coalesce(~F.col("on_ground"), F.lit(False))
    # True opens a leg, False closes one; in a leg a departure is nothing new, and out of one an arrival isn't either
    s = s.withColumn("up", F.coalesce(up, F.lit(False))).withColumn("event", F.when(F.col("up") | blind, True).when(down, False))
    s = s.withColumn("aloft", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False)))
    s = s.withColumn("opens", ~F.col("aloft") & F.coalesce("event", F.lit(False))).withColumn("leg", F.sum(F.col("opens").cast("int")).over(upto))
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    s = s.withColumn("step", F.when(F.col("aloft"), step)).where("aloft or opens")
    closes = F.col("aloft") & ~F.coalesce("event", F.lit(True))
    legs = s.groupBy("entity_id", "seg", "leg").agg(
        F.min("ts").alias("departed_at"), F.max(F.when(closes, F.col("ts"))).alias("arrived_at"), F.max(F.when(F.col("opens"), F.col("field"))).alias("origin"),
        F.max(F.when(closes, F.col("field"))).alias("dest"), F.bool_or(F.col("opens") & F.col("up")).alias("seen"), F.bround(F.coalesce(F.sum("step"), F.lit(0.0)), 1).alias("km"),
        F.rint(F.max("altitude")).cast("long").alias("top"), F.max("ts").alias("last_seen_at"), F.count("*").alias("fixes"),
    )
    ends = F.col("seen").cast("int") + F.col("arrived_at").isNotNull().cast("int")
    confidence = F.when(ends == 2, "observed_both").when(ends == 1, "observed_one").otherwise("inferred")
    return legs.withColumn("confidence", confidence).select(*_names(LEG_SCHEMA))


def _stream(stream: DataFrame, fields: list[str], step: Callable, schema: str, ttl_ms: int) -> DataFrame:
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = json.loads(state.get[0]) if state.exists else None, []
        for row in _rows(pd.concat(list(frames)).sort_values(["ts", "event_id"]), fields):
            held, done = step(held, row)
            if done:
                out.append(done | {"entity_id": key[0]})
        state.update((json.dumps(held),))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=_names(schema))

    return stream.groupBy("entity_id").applyInPandasWithState(update, schema, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def port_calls_stream(stream: DataFrame, ttl_ms: int = 3 * 86_400_000) -> DataFrame:
    """Closed port calls of an unbounded log, appended as they close; a key without fixes for ttl_ms of processing time is dropped."""
    return _stream(stream, ["ts", "speed", "draught", "place_id", "place_km"], call_step, CALL_SCHEMA, ttl_ms)


def flight_legs_stream(stream: DataFrame, ttl_ms: int = 21_600_000) -> DataFrame:
    """Legs of an unbounded log, appended as they end by an arrival or are given up after a silence."""
    return _stream(stream, ["ts", "lat", "lon", "on_ground", "altitude", "field", "field_km"], leg_step, LEG_SCHEMA, ttl_ms)


def daily_distinct_stream(stream: DataFrame, grace: str = "1 day") -> DataFrame:
    """Distinct entities a day; a day closes a grace period after it ends, and later rows are dropped."""
    first = stream.withWatermark("time", grace).withColumn("day", F.window("time", "1 day").start).dropDuplicatesWithinWatermark(["entity_id", "day"])
    return first.groupBy(F.window("time", "1 day").alias("w")).agg(F.count("*").alias("entities")).select(F.col("w.start").alias("day"), "entities")


def enriched_positions_stream(messages: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """Positions of a message stream (entity_id, seq, kind, ts, lat, lon, name, ship_type), each with the newest static facts before it.

    A static message updates the entity's facts, field by field where it has one, and emits nothing; a position emits one row.
    """
    schema = "entity_id long, seq long, ts double, lat double, lon double, name string, ship_type int"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        name, kind, out = (*state.get, None)[:3] if state.exists else (None, None, None)
        out = []
        for r in _rows(pd.concat(list(frames)).sort_values("seq"), ["seq", "kind", "ts", "lat", "lon", "name", "ship_type"]):
            if r["kind"] == "static":
                name, kind = r["name"] if r["name"] is not None else name, int(r["ship_type"]) if r["ship_type"] is not None else kind
            else:
                out.append((key[0], r["seq"], r["ts"], r["lat"], r["lon"], name, kind))
        state.update((name, kind))
        state.setTimeoutDuration(ttl_ms)
        frame = pd.DataFrame(out, columns=_names(schema))
        yield frame.astype({"ship_type": "Int32"})

    return messages.groupBy("entity_id").applyInPandasWithState(update, schema, "name string, ship_type int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def enriched_positions(messages: DataFrame) -> DataFrame:
    """Batch form of enriched_positions_stream(): the last known value of each static field before every position, by windows."""
    w = Window.partitionBy("entity_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fact = lambda c: F.last(F.when(F.col("kind") == "static", F.col(c)), ignorenulls=True).over(w)
    known = messages.withColumn("_name", fact("name")).withColumn("_type", fact("ship_type"))
    return known.where("kind <> 'static'").select("entity_id", "seq", "ts", "lat", "lon", F.col("_name").alias("name"), F.col("_type").alias("ship_type"))


def latest_state_sink(path: str, ttl: float | None = None, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest fix of each entity under path/<batch>, by buckets of the entity.

    Only the buckets that a batch touches are rewritten; the others are taken over by name in the batch's list of live
    folders, path/live-<batch>. A replayed batch overwrites its own. Folders that neither this list nor the one before it
    names are removed, so the space doesn't grow with the batches. With ttl, entities whose fix is older than the newest
    by more are dropped from the buckets that are rewritten. read_latest() gives the state.
    """
    from trackloom.operators.upserts import upsert_latest
    from trackloom.session import remove

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("entity_id"), F.lit(buckets)).cast("int")
        cols = batch.select("entity_id", "ts", "event_id", "lat", "lon").withColumn("bucket", bucket)
        live = _live(spark, path, number - 1)
        touched = [r["bucket"] for r in cols.select("bucket").distinct().collect()]  # at most `buckets`
        old = [live[b] for b in touched if b in live]
        schema = "entity_id long, ts double, event_id long, lat double, lon double, moved_at double"
        state = spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in old]) if old else spark.createDataFrame([], schema)
        new = upsert_latest(state, cols.drop("bucket")).withColumn("bucket", bucket)
        if ttl is not None:
            newest = batch.agg(F.max("ts").alias("newest"))
            new = new.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - ttl).drop("newest")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{number}")
        now = {b: f for b, f in live.items() if b not in touched} | {b: f"{number}/bucket={b}" for b in touched if _exists(spark, f"{path}/{number}/bucket={b}")}
        rows = spark.createDataFrame(sorted(now.items()), "bucket int, folder string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/live-{number}")
        named = {f.split("/")[0] for f in (*now.values(), *live.values())}
        for n in {f.split("/")[0] for f in _live(spark, path, number - 2).values()} - named:
            remove(spark, f"{path}/{n}")
        remove(spark, f"{path}/live-{number - 2}")

    return merge


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _live(spark, path: str, number: int) -> dict[int, str]:
    if number < 0 or not _exists(spark, f"{path}/live-{number}/_SUCCESS"):
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{path}/live-{number}").collect()}


def read_latest(spark, path: str, number: int) -> DataFrame:
    """The state after batch `number`."""
    live = _live(spark, path, number)
    schema = "entity_id long, ts double, event_id long, lat double, lon double, moved_at double"
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in live.values()]) if live else spark.createDataFrame([], schema)
