"""Incidents kept between runs against one run over all reports, and what a batch reads and writes; frames against single moments."""

import random

from pyspark.sql import functions as F

from trackloom.operators import dedupe, windows
from trackloom.operators.incidents import Incidents
from trackloom.sources.standins import positions

KINDS = "report_id long, category string, lat double, lon double, day int"


def test_batches_equal_one_run_and_touch_their_blocks_only(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), 10 + rng.random() * 3, 179.5 + rng.random(), rng.randrange(40)) for i in rng.sample(range(1000), 160)]
    rows += [(2000 + d, "c", 0.0, 0.0, d) for d in range(0, 60, 2)]  # one long incident, whose blocks come out of order
    early, bridge, late = [r for r in rows if r[0] % 4 == 0 and r[4] < 30], [r for r in rows if r[4] == 30], [r for r in rows if r[4] > 30]
    rest = [r for r in rows if r not in early and r not in bridge and r not in late]
    rng.shuffle(rest)
    batches = [late, early, rest[:40], rest[40:], bridge + rest[:5] + [(None, "a", 1.0, 1.0, 1), (5000, None, 1.0, 1.0, 1)], [(6000, "a", -50.0, 5.0, 200)], []]
    store = Incidents(spark, str(tmp_path / "store"))
    for k, part in enumerate(batches):
        did = store.add(k, spark.createDataFrame(part, KINDS))
        if k == 5:
            assert did == {"read": 0, "written": 1}
    want = {tuple(r) for r in dedupe.incident_clusters(spark.createDataFrame([*rows, batches[5][0]], KINDS)).collect()}
    assert {(r.report_id, r.incident) for r in store.read(6).collect()} == want and store.read(6).count() == len(want)
    before, after = store.live(4), store.live(5)
    assert {b: v for b, v in after.items() if b != 100} == before and store.live(6) == after
    gone = {r.id for k in range(7) for r in store.superseded(k).collect()}
    assert gone and not gone & {i for _, i in want}
    again = store.add(6, spark.createDataFrame([], KINDS))  # a batch that is run again
    assert again["written"] == 0 and {(r.report_id, r.incident) for r in store.read(6).collect()} == want
    store.drop_before(6)
    assert {(r.report_id, r.incident) for r in store.read(6).collect()} == want


def test_frames_equal_single_moments(spark, small):
    log = positions(spark, small)
    start, step, window = windows.AT - 6 * 5_000.0, 5_000.0, 9_000.0
    log = log.unionByName(log.limit(3).withColumn("ts", F.lit(start + 2 * step)))  # fixes on a moment, ties
    got = {}
    for r in windows.frames(log, start, step, 8, window).collect():
        got.setdefault(r.frame, set()).add((r.entity_id, r.event_id, r.ts, r.lat, r.lon, r.kind))
    for k in range(8):
        assert got.get(k, set()) == {tuple(r) for r in windows.state_at(log, start + k * step, window).select("entity_id", "event_id", "ts", "lat", "lon", "kind").collect()}
    assert len(got) > 3 and windows.frames(log.limit(0), start, step, 3, window).count() == 0
