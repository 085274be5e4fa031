"""The hexagonal grid over the globe, and rolling state over shuffled streams against batch and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import hexgrid
from trackloom.plans import registry
from trackloom.streaming import rolling


def test_published_ids_and_centres():
    at = lambda lat, lon, res: f"{hexgrid.cells(np.array([lat]), np.array([lon]), res)[0]:x}"
    assert at(37.775938728915946, -122.41795063018799, 9) == "8928308280fffff"
    assert at(37.3615593, -122.0553238, 7) == "87283472bffffff"
    lat, lon = hexgrid.centres(np.array([0x85283473FFFFFFF], np.uint64), 5)
    assert abs(lat[0] - 37.345793375368) < 1e-9 and abs(lon[0] + 121.976375972551) < 1e-9
    faces = hexgrid._faces()
    assert np.flatnonzero(faces.pentagon).tolist() == [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]
    assert (np.diff(faces.place[:, 2]) < 0).all()  # base cells are numbered from north to south


@pytest.mark.parametrize("res", [0, 1, 2, 3])
def test_all_cells_round_trip_and_have_mutual_neighbours(res):
    base = np.repeat(np.arange(122), 7**res)
    digits = np.tile(np.array(list(itertools.product(range(7), repeat=res)), int).reshape(7**res, res), (122, 1))
    ids = hexgrid._packed(base, digits, res)
    ids = ids[hexgrid.valid(ids, res)]
    assert len(ids) == 2 + 120 * 7**res
    assert (hexgrid.cells(*hexgrid.centres(ids, res), res) == ids).all()
    around = hexgrid.neighbours(ids, res)
    counts = [len({*row} - {i}) for row, i in zip(around.tolist(), ids.tolist())]
    assert sorted(counts)[:13] == [5] * 12 + [6] and max(counts) == 6
    links = {(i, n) for i, row in zip(ids.tolist(), around.tolist()) for n in row if n != i}
    assert all((b, a) in links for a, b in links)


def test_positions_lie_in_the_cell_whose_centre_is_near(spark):
    rng = np.random.default_rng(1)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 20_000))), rng.uniform(-180, 180, 20_000)
    ids = hexgrid.cells(lat, lon, 4)
    a, b = hexgrid.centres(ids, 4)
    p, q = (hexgrid._unit(np.radians(x), np.radians(y)) for x, y in ((lat, lon), (a, b)))
    own = (p * q).sum(1)
    assert np.degrees(np.arccos(own.min())) < 0.35  # a cell of resolution 4 is about 0.24 degrees from centre to corner
    for k in range(6):  # no neighbour's centre is nearer, but for the little that the face's plane distorts
        x, y = hexgrid.centres(hexgrid.neighbours(ids, 4)[:, k], 4)
        other = (p * hexgrid._unit(np.radians(x), np.radians(y))).sum(1)
        assert (np.arccos(np.minimum(own, 1)) < np.arccos(np.minimum(other, 1)) * 1.25 + 1e-6).all()
    rows = [(0.0, 0.0), (90.0, 12.0), (-90.0, 0.0), (None, 1.0), (91.0, 0.0), (5.0, 185.0), (5.0, -175.0)]
    got = spark.createDataFrame(rows, "lat double, lon double").select(hexgrid.cell_of(F.col("lat"), F.col("lon")).alias("c")).select("c", hexgrid.centre_of(F.col("c")).alias("p")).collect()
    assert [r.c is None for r in got] == [False, False, False, True, True, False, False] and got[5].c == got[6].c and got[3].p is None
    bad = spark.createDataFrame([("zz",), ("85283473fffffff",), ("84fffffffffffff",), (None,)], "c string").select(hexgrid.centre_of(F.col("c")).alias("p")).collect()
    assert [r.p for r in bad] == [None] * 4


def fixes(seed, entities=4, n=120, step=400.0):
    """Tracks that sometimes jump, turn back, land and fall silent, around one place each."""
    rng = random.Random(seed)
    rows, event = [], 0
    for e in range(entities):
        ts, lat, lon = 0.0, 10.0 * e, 20.0 * e
        for _ in range(n):
            ts += rng.choice([60.0, step, step, 1800.0, 5000.0])
            lat, lon = (lat + rng.choice([0.02, 0.1, 3.0]) * rng.choice([-1, 1]), lon + 0.01) if rng.random() < 0.8 else (10.0 * e, 20.0 * e)
            rows.append((e, event, ts, lat, lon, rng.choice([None, False, False, True]), rng.choice([None, 0.0, 90.0, 180.0]), rng.choice([None, 4.0, 5.04, 5.1, 9.0, 9.9, 10.0, 0.0])))
            event += 1
    rows += [(0, event, rows[3][2], 1.0, 1.0, False, 0.0, 7.0), (None, event + 1, 5.0, 0.0, 0.0, False, 0.0, 7.0)]
    return rows


KINDS = "entity_id long, event_id long, ts double, lat double, lon double, on_ground boolean, course double, draught double"


def watched_cells(rows):
    lat, lon = (np.array([r[k] for r in rows if r[0] is not None]) for k in (3, 4))
    ids, counts = np.unique(hexgrid.cells(lat, lon, 4), return_counts=True)
    return [f"{x:x}" for x in ids[np.argsort(-counts)][:20].tolist()]


def by_hand(rows, cells, most=rolling.MOST):
    out, last, kept = [], {}, {}
    for e, event, ts, lat, lon, ground, course, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2], r[1])):
        b = last.get(e)
        last[e] = (ts, lat, lon, ground)
        cell = f"{hexgrid.cells(np.array([lat]), np.array([lon]), 4)[0]:x}"
        if b and cell in cells and 0 < ts - b[0] <= 1800 and True not in (b[3], ground):
            flag = rolling.Interference.anomaly(b, {"ts": ts, "lat": lat, "lon": lon, "course": course})
            kept.setdefault((e, cell), []).append((ts, flag))
            near = [f for t, f in kept[e, cell] if t >= ts - 86_400]
            out.append((e, event, ts, cell, flag, min(len(near), most), min(sum(f is not None for f in near), most)))
    return sorted(out)


def streamed(spark, tmp_path, rows, make, batches=5, seed=0):
    """The rows, out of order by less than the delay, in files of a batch each; a last row far on lets the watermark pass all."""
    rng = random.Random(seed)
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 5000))
    end = max(r[2] for r in rows) + 10 * 86_400
    size = -(-len(shuffled) // batches)
    source = str(tmp_path / "in")
    for k in range(batches):
        part = shuffled[k * size : (k + 1) * size]
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([(99, -1, end, 0.0, 0.0, None, None, None)], KINDS).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(source).withColumn("time", F.timestamp_seconds("ts"))
    q = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("entity_id <> 99").collect())


def test_interference_stream_equals_batch_and_brute_force(spark, tmp_path):
    rows = fixes(2)
    cells = watched_cells(rows)
    of = spark.createDataFrame([(c,) for c in [*cells, cells[0], None]], "cell string")
    want = by_hand(rows, cells, 4)
    assert len(want) > 60 and {"speed", "heading_reversal", None} == {w[4] for w in want} and max(w[5] for w in want) == 4
    batch = rolling.interference_samples(spark.createDataFrame(rows, KINDS).repartition(3), of, most=4)
    assert sorted(map(tuple, batch.collect())) == want
    assert streamed(spark, tmp_path, rows, lambda s: rolling.interference_stream(s, of, "2 hours", most=4)) == want


def test_cross_check_verdicts(spark):
    rows = [(1, 1, 100.0, "a", None, 1, 0), (1, 2, 200.0, "a", None, 2, 0), (2, 3, 100.0, "a", "speed", 1, 1), (3, 4, 100.0, "b", None, 1, 0), (4, 5, 90_000.0, "b", "speed", 1, 1), (5, 6, -90_000.0, "b", "speed", 1, 1)]
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    by_cell, craft = rolling.cross_check(spark.createDataFrame(rows, rolling.SAMPLE_SCHEMA), cells, 300.0)
    assert {tuple(r) for r in by_cell.collect()} == {("a", 2, 1, "flagged"), ("b", 1, 0, "clean"), ("c", 0, 0, "no_traffic")}
    assert {(r.entity_id, r.status) for r in craft.collect()} == {(1, "checked_clean"), (2, "flagged"), (3, "insufficient_samples")}


def test_draught_stream_equals_batch_and_brute_force(spark, tmp_path):
    rows = fixes(3, n=60, step=20_000.0)
    out, seen = [], {}
    for e, event, ts, *_, draught in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2], r[1])):
        if draught is not None:
            seen.setdefault(e, []).append((ts, round(draught + 1e-9, 1)))
        near = [d for t, d in seen.get(e, []) if t >= ts - 259_200]
        latest, high = (near[-1], max(near)) if near else (None, None)
        share = latest / high if near and high else None
        state = "unknown" if share is None or len(set(near)) < 5 else "laden" if share > 0.85 else "ballast" if share < 0.55 else "unknown"
        out.append((e, event, ts, len(set(near)), latest, min(near, default=None), high, state))
    want = sorted(out)
    assert {"laden", "ballast", "unknown"} == {w[-1] for w in want}
    df = spark.createDataFrame(rows, KINDS).repartition(3)
    assert sorted(map(tuple, rolling.draught_rows(df).collect())) == want
    now = want[-1][2]
    at = {r.entity_id: r for r in rolling.draughts_at(df.where("entity_id = 3"), now).collect()}
    assert tuple(at[3])[1:] == want[-1][3:]
    assert streamed(spark, tmp_path, rows, lambda s: rolling.draught_stream(s, "2 hours")) == want


def test_roll_interference_query(spark, small):
    got = registry.queries()["roll_interference"](spark, small).collect()
    log = [tuple(r) for r in rolling._log(spark, small).selectExpr("entity_id", "event_id", "ts", "lat", "lon", "on_ground", "cast(course as double)", "draught").collect()]
    cells = [r.cell for r in rolling._busy(spark, small).orderBy("cell").limit(100).collect()]
    assert sorted(map(tuple, got)) == by_hand(log, cells) and got


def test_centres_of_landed_cells(spark, small):
    got = registry.queries()["scan_jam_centres"](spark, small).collect()
    lat, lon = hexgrid.centres(np.array([int(r.cell, 16) for r in got], np.uint64), 4)
    assert got and np.allclose([r.lat for r in got], lat) and np.allclose([r.lon for r in got], lon)
    assert [f"{x:x}" for x in hexgrid.cells(lat, lon, 4)] == [r.cell for r in got]
