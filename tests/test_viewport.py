"""Views of rows kept in curve order: the same rows as the plain test, and what is opened for them."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.functions.geo import in_box_wrapped
from trackloom.operators import viewport as V

BOXES = [(-20.0, -100.0, 40.0, 60.0), (-50.0, 150.0, 50.0, -120.0), (10.0, 10.0, 10.0, 10.0), (-90.0, -180.0, 90.0, 180.0), (40.0, 5.0, 41.0, 6.0), (5.0, 0.0, -5.0, 1.0), (89.0, 170.0, 90.0, 180.0)]
SCHEMA = "id long, lat double, lon double"


def interleaved(lat, lon):
    y = min(max(int((lat + 90) / 180 * 65536), 0), 65535)
    x = min(max(int((lon + 180) / 360 * 65536), 0), 65535)
    return int("".join(a + b for a, b in zip(f"{y:016b}", f"{x:016b}")), 2)


def test_keys_are_the_bits_in_turn(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(500)] + [(900, 90.0, 180.0), (901, -90.0, -180.0), (902, 0.0, 0.0)]
    got = spark.createDataFrame(rows, SCHEMA).withColumn("k", V.curve_key(F.col("lat"), F.col("lon"))).collect()
    assert all(g.k == interleaved(g.lat, g.lon) for g in got)


@pytest.mark.parametrize("box", BOXES)
@pytest.mark.parametrize("most", [1, 5, 32])
def test_ranges_cover_the_box(box, most):
    ranges = V.key_ranges(box, most)
    assert len(ranges) <= most and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:])) and all(a <= b for a, b in ranges)
    r, (s, w, n, e) = random.Random(3), box
    if s > n:
        assert not ranges
        return
    east = e if e >= w else e + 360
    for i in range(400):
        lat = (s, n)[i] if i < 2 else r.uniform(s, n)
        lon = (w, east)[i] if i < 2 else r.uniform(w, east)
        key = interleaved(lat, lon - 360 if lon > 180 else lon)
        assert any(a <= key <= b for a, b in ranges)


def test_narrow_views_have_narrow_ranges():
    share = lambda box, most: sum(b - a + 1 for a, b in V.key_ranges(box, most)) / 2**32
    assert share((40.0, 5.0, 41.0, 6.0), 32) < 5 / 64_800 and share(BOXES[0], 32) < 1.3 * (60 * 160) / 64_800


def scanned(df):
    """Rows, and the files and rows that its scan took in."""
    rows = df.collect()
    m = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    return rows, *(m.apply(k).value() if m.contains(k) else 0 for k in ("numFiles", "numOutputRows"))


def test_views_equal_the_plain_test_and_open_little(spark, tmp_path):
    n = 60_000
    df = spark.range(n).selectExpr("id", "-90 + 180 * rand(1) as lat", "-180 + 360 * rand(2) as lon")
    odd = [(n, None, 3.0), (n + 1, 4.0, None), (n + 2, float("nan"), 3.0), (n + 3, 3.0, float("nan")), (n + 4, 90.0, 180.0), (n + 5, 10.0, 10.0), (n + 6, 10.0, 10.0), (n + 7, None, None)]
    df = df.unionByName(spark.createDataFrame(odd, SCHEMA)).cache()
    path = str(tmp_path / "layout")
    V.write_layout(df, path, "id", 16)
    layout = spark.read.parquet(path)
    assert layout.count() == n + len(odd)
    whole = None
    for box in BOXES:
        got, files, took = scanned(V.in_view(layout, box))
        want = df.where(in_box_wrapped("lat", "lon", box) & ~F.isnan("lat") & ~F.isnan("lon")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
        if box == BOXES[3]:
            whole = files
        if box == BOXES[4]:
            small = files
            assert len(got) > 0 and took < n / 50
    assert small <= 8 and whole >= 200
    df.unpersist()


def test_a_crowded_place_is_split(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 10.0D, -90 + 180 * rand(1)) as lat", "if(id % 3 = 0, 10.0D, -180 + 360 * rand(2)) as lon")
    path = str(tmp_path / "crowded")
    V.write_layout(df, path, "id", 12)
    per = spark.read.parquet(path).where("lat = 10 and lon = 10").groupBy(F.input_file_name()).count().collect()
    assert len(per) >= 3 and sum(r["count"] for r in per) >= 6_666 and max(r["count"] for r in per) < 4_000


def test_empty_tables_clashing_names_and_feeds(spark, tmp_path):
    path = str(tmp_path / "empty")
    V.write_layout(spark.createDataFrame([], SCHEMA), path, "id", 4)
    with pytest.raises(ValueError, match="curve_key"):
        V.write_layout(spark.range(1).withColumn("Curve_Key", F.lit(1)), path, "id", 4)
    rows = [(i, 1.0, 1.0, float(i // 2)) for i in range(10)] + [(10, 1.0, 1.0, None), (11, 80.0, 1.0, 99.0)]
    path = str(tmp_path / "feed")
    V.write_layout(spark.createDataFrame(rows, SCHEMA + ", ts double"), path, "id", 4)
    layout = spark.read.parquet(path)
    got = [(r.place, r.id, r.capped) for r in V.feed(layout, (0.0, 0.0, 2.0, 2.0), 3, "ts", "id").orderBy("place").collect()]
    assert got == [(1, 8, True), (2, 9, True), (3, 6, True)]
    assert [(r.id, r.capped) for r in V.feed(layout, (0.0, 0.0, 2.0, 2.0), 11, "ts", "id").orderBy("place").collect()][-1] == (10, False)
