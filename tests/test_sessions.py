"""The session machines at their thresholds, on hand-worked logs, in batch and as a stream."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.streaming import sessions as S


def walk(step, end, rows):
    state, out = None, []
    for r in rows:
        state, done = step(state, r)
        out += [done] if done else []
    last = end(state)
    return out + ([last] if last else [])


def fix(ts, speed, draught=5.0, place=9, km=2.0):
    return {"ts": float(ts), "speed": speed, "draught": draught, "place_id": place, "place_km": km}


def calls(*rows):
    return walk(S.call_step, S.call_end, rows)


def test_dwell_of_exactly_an_hour_opens_and_less_does_not():
    assert len(calls(fix(0, 0.1), fix(3600, 0.2))) == 1
    assert calls(fix(0, 0.1), fix(3540, 0.2)) == []


def test_null_speed_drops_a_candidate_but_not_a_call():
    assert calls(fix(0, 0.1), fix(1800, None), fix(3600, 0.1)) == []
    assert len(calls(fix(0, 0.1), fix(3600, 0.1), fix(4000, None))) == 1


def test_departure_needs_half_an_hour_of_moving():
    calm = [fix(0, 0.1), fix(3600, 0.1)]
    assert calls(*calm, fix(4000, 5.0), fix(4500, 0.2), fix(6000, 5.0), fix(7799, 5.0))[0]["departed_at"] is None
    assert calls(*calm, fix(4000, 5.0), fix(5800, 5.0))[0]["departed_at"] == 4000.0


def test_draughts_are_those_before_the_dwell_and_of_the_last_still_fix():
    # under way at 7.0; stops at 6.5; last still fix at 6.0; drifts at 0.8 kn with 5.5; leaves with 5.0
    got = calls(fix(0, 12.0, 7.0), fix(600, 0.3, 6.5), fix(4500, 0.2, 6.0), fix(5000, 0.8, 5.5), fix(6000, 9.0, 5.0), fix(8000, 9.0, 5.0))
    assert [(c["arrived_at"], c["departed_at"], c["draught_in"], c["draught_out"]) for c in got] == [(600.0, 6000.0, 7.0, 6.0)]
    assert calls(fix(0, 0.1, 4.0), fix(3600, 0.1, 3.0))[0]["draught_in"] == 4.0  # nothing before it


def test_match_by_distance_and_no_call_without_a_place():
    assert [calls(fix(0, 0.1, km=k), fix(3600, 0.1))[0]["match"] for k in (3.0, 3.1, 15.0, 15.1, 50.0)] == ["exact", "proximity", "proximity", "inferred", "inferred"]
    # the dwell at sea is dropped after an hour; the next fix begins another, near a place
    got = calls(fix(0, 0.1, place=None, km=None), fix(3600, 0.1, place=None, km=None), fix(4000, 0.1, place=3), fix(7600, 0.1))
    assert [(c["place_id"], c["arrived_at"]) for c in got] == [(3, 4000.0)]


def leg(ts, ground, alt=None, km=1.0, lat=0.0, lon=0.0):
    return {"ts": float(ts), "on_ground": ground, "altitude": alt, "lat": lat, "lon": lon, "field": f"f{int(ts)}", "field_km": km}


def legs(*rows):
    return walk(S.leg_step, S.leg_end, rows)


def test_a_leg_starts_on_the_fix_that_shows_it_and_ends_on_the_landing():
    got = legs(leg(0, True), leg(60, False, 2000.0), leg(600, False, 9000.0, lat=1.0), leg(1200, True, 0.0, lat=2.0))
    assert got == [{"departed_at": 60.0, "arrived_at": 1200.0, "origin": "f60", "dest": "f1200", "confidence": "observed_both", "km": 222.4, "top": 9000, "last_seen_at": 1200.0, "fixes": 3}]


def test_a_silence_leaves_the_leg_as_it_stands():
    got = legs(leg(0, True), leg(1000, False), leg(5000, None), leg(5060, True))
    assert [(x["departed_at"], x["arrived_at"], x["confidence"], x["last_seen_at"]) for x in got] == [(1000.0, None, "observed_one", 1000.0)]
    assert legs(leg(0, True), leg(1000, False), leg(2800, True))[0]["arrived_at"] == 2800.0  # exactly the gap still joins


def test_altitude_decides_near_a_field_only_with_slack_and_forgets_over_a_gap():
    near = [leg(0, None, 1000.0), leg(60, None, 1600.0), leg(120, None, 1700.0), leg(180, None, 1400.0), leg(240, None, 1300.0)]
    assert [(x["departed_at"], x["arrived_at"]) for x in legs(*near)] == [(120.0, 240.0)]
    assert legs(*[r | {"field_km": 10.1} for r in near]) == []
    assert legs(leg(0, None, 1000.0), leg(4000, None, 9000.0), leg(4060, None, 9100.0)) == []


def test_a_departure_not_seen_needs_a_known_flight():
    assert legs(leg(0, None, 9000.0)) == []
    assert legs(leg(0, False, 9000.0))[0]["confidence"] == "inferred"


def random_log(n, seed):
    r, rows = random.Random(seed), []
    for e in range(12):
        t = 0.0
        for k in range(n):
            t += r.choice([60, 300, 900, 1800, 1801, 4000])
            rows.append((e, k, t, r.uniform(0, 1), r.uniform(0, 1), r.choice([0.1, 0.3, 0.5, 0.8, 1.0, 5.0, 5.0, None]), r.choice([4.0, 5.0, None]), r.choice([None, 7, 8]), r.choice([1.0, 9.0, 30.0]), r.choice([True, False, False, None]), r.choice([None, 500.0, 1400.0, 1500.0, 1600.0, 1700.0, 8000.0])))
    return rows


SCHEMA = "entity_id long, event_id long, ts double, lat double, lon double, speed double, draught double, place_id long, place_km double, on_ground boolean, altitude double"


def by_entity(rows):
    out = {}
    for row in rows:
        d = dict(zip([c.split()[0] for c in SCHEMA.split(", ")], row))
        out.setdefault(d["entity_id"], []).append(d | {"place_km": d["place_km"] if d["place_id"] else None, "field": str(d["place_id"]), "field_km": d["place_km"]})
    return out


def test_legs_by_windows_equal_the_machine(spark):
    rows = random_log(150, 1)
    log = spark.createDataFrame(rows, SCHEMA).withColumn("field", F.coalesce(F.col("place_id").cast("string"), F.lit("None"))).withColumn("field_km", F.col("place_km"))
    got = {(r.entity_id, r.departed_at): r.asDict() for r in S.flight_legs(log).collect()}
    want = {(e, x["departed_at"]): x | {"entity_id": e} for e, fixes in by_entity(rows).items() for x in walk(S.leg_step, S.leg_end, fixes)}
    assert set(got) == set(want) and len(want) > 100
    for k, w in want.items():
        assert got[k] == w | {"km": got[k]["km"]} and abs(got[k]["km"] - w["km"]) <= 0.11


def test_calls_in_parts_equal_one_walk(spark, monkeypatch):
    rows = random_log(300, 2)
    log = spark.createDataFrame(rows, SCHEMA).withColumn("place_km", F.when(F.col("place_id").isNotNull(), F.col("place_km")))
    monkeypatch.setattr(S, "CALL_BLOCK_S", 2_000.0)
    key = lambda x: tuple(-1 if v is None else v for v in (x["entity_id"], x["arrived_at"], x["departed_at"], x["place_id"], x["draught_in"], x["draught_out"]))
    got = sorted(key(r.asDict()) for r in S.port_calls(log).collect())
    want = sorted(key(x | {"entity_id": e}) for e, fixes in by_entity(rows).items() for x in walk(S.call_step, S.call_end, fixes))
    assert got == want and len(want) > 20


@pytest.fixture
def log(spark):
    rows = [(e, k, float(t), 1.0, 2.0, v, 5.0, 9, 1.0) for e in (1, 2) for k, (t, v) in enumerate([(0, 0.1), (3600, 0.1), (7000, 4.0), (9000, 4.0), (9100, 0.1)])]
    return spark.createDataFrame(rows, "entity_id long, event_id long, ts double, lat double, lon double, speed double, draught double, place_id long, place_km double")


def run_stream(spark, tmp_path, df, fn, name):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = fn(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_batch_and_stream_close_the_same_calls(spark, log, tmp_path):
    batch = S.port_calls(log).where("departed_at is not null").toPandas()
    stream = run_stream(spark, tmp_path, log, S.port_calls_stream, "calls").toPandas()
    key = ["entity_id", "arrived_at", "departed_at"]
    pd.testing.assert_frame_equal(batch[key].sort_values(key).reset_index(drop=True), stream[key].sort_values(key).reset_index(drop=True))
    assert len(batch) == 2


def test_batch_and_stream_end_the_same_legs(spark, tmp_path):
    rows = random_log(60, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("field", F.col("place_id").cast("string")).withColumn("field_km", F.col("place_km"))
    stream = run_stream(spark, tmp_path, df, S.flight_legs_stream, "legs")
    got = {(r.entity_id, r.departed_at, r.arrived_at, r.confidence) for r in stream.collect()}
    batch = {(r.entity_id, r.departed_at, r.arrived_at, r.confidence) for r in S.flight_legs(df).collect()}
    assert got <= batch and len(batch - got) <= 12  # the stream holds back what may still go on


def test_positions_take_static_facts_from_before_them(spark, tmp_path):
    rows = [(1, 1, "position", 1.0, 1.0, 1.0, None, None), (1, 2, "static", 2.0, None, None, "A", 70), (1, 3, "position", 3.0, 1.0, 1.0, None, None), (1, 4, "static", 4.0, None, None, "B", None), (1, 5, "position", 5.0, 1.0, 1.0, "x", 1), (2, 6, "position", 6.0, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, kind string, ts double, lat double, lon double, name string, ship_type int")
    want = [(1, None, None), (3, "A", 70), (5, "B", 70), (6, None, None)]
    assert sorted((r.seq, r.name, r.ship_type) for r in S.enriched_positions(df).collect()) == want
    assert sorted((r.seq, r.name, r.ship_type) for r in run_stream(spark, tmp_path, df, S.enriched_positions_stream, "merged").collect()) == want


def test_latest_state_sink_is_replayable_and_bounded(spark, log, tmp_path):
    path = str(tmp_path / "state")
    sink = S.latest_state_sink(path, buckets=4)
    sink(log.where("event_id < 3"), 0)
    for _ in range(2):
        sink(log.where("event_id >= 3"), 1)
    got = S.read_latest(spark, path, 1).orderBy("entity_id").collect()
    assert [(r.entity_id, r.ts, r.moved_at) for r in got] == [(1, 9100.0, 7000.0), (2, 9100.0, 7000.0)]
    for k in range(2, 7):
        sink(log.where("entity_id = 1 and event_id = 4").withColumn("ts", F.col("ts") + k), k)
    assert {r.entity_id: r.ts for r in S.read_latest(spark, path, 6).collect()} == {1: 9106.0, 2: 9100.0}
    folders = {p.name for p in (tmp_path / "state").iterdir()}
    assert "2" not in folders and "3" not in folders and "live-3" not in folders


def test_latest_state_drops_the_old(spark, log, tmp_path):
    path = str(tmp_path / "state")
    sink = S.latest_state_sink(path, ttl=100.0, buckets=1)
    sink(log.where("entity_id = 1"), 0)
    sink(log.where("entity_id = 2").withColumn("ts", F.col("ts") + 10_000), 1)
    assert [r.entity_id for r in S.read_latest(spark, path, 1).collect()] == [2]


def test_daily_distinct_stream_counts_closed_days(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 01:00:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 06:00:00"), (1, "2024-01-02 01:00:00"), (9, "2024-01-09 01:00:00")], "entity_id long, t string").select("entity_id", F.to_timestamp("t").alias("time"))
    out = run_stream(spark, tmp_path, df, S.daily_distinct_stream, "days")
    assert {(str(r.day)[:10], r.entities) for r in out.collect()} >= {("2024-01-01", 2), ("2024-01-02", 1)}
