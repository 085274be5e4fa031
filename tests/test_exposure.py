"""Freehand numbers by hand, and sites in the reach of events against brute force."""

import math
import random

from pyspark.sql import functions as F

from trackloom.operators import exposure as E
from trackloom.operators import readings as R


def column(spark, values, make):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r.out for r in spark.createDataFrame(rows, "i int, v string").withColumn("out", make(F.col("v"))).orderBy("i").collect()]


def test_outputs_and_years_by_hand(spark):
    said = {"1200 MW": 1200.0, "800000000 W": 800.0, " 1 200 mw ": 1200.0, "2.5GW": 2500.0, "500 kW": 0.5, "1e3 MW": 1000.0, ".5 MW": 0.5, "-3 MW": -3.0, "MW": None, "12": None, "yes": None, "": None, None: None, "3 MW; 4 MW": None, "5 MWp": None, "1,200 MW": None, "infMW": None}
    assert column(spark, list(said), R.megawatts) == list(said.values())
    built = {"1986": 1986, "1986-05": 1986, " 2001 ": 2001, "circa 1970": None, "1849": None, "1850": 1850, "2100": 2100, "2101": None, "110000": None, "198": None, "": None, None: None}
    assert column(spark, list(built), R.built_year) == list(built.values())


def test_axes_by_hand(spark):
    rows = [
        ("g;56.7493960;27.0279540", 56.749363, 27.027974, (27.027954, 56.749396)), ("g;27.0279540;56.7493960", 56.749363, 27.027974, (27.027954, 56.749396)),
        ("a;b;10;20", None, None, (20.0, 10.0)), ("g;10;20", 10.2, 20.0, None), ("g;10;20", 10.04, 20.04, (20.0, 10.0)), ("g;10;120", None, None, None), ("g;120;10", 10.0, 120.0, None),
        (";10;20", None, None, None), ("10;20", None, None, None), ("g;x;20", None, None, None), ("g;nan;20", None, None, None), ("g;1e999;20", None, None, None), ("", None, None, None), (None, 1.0, 1.0, None), ("g; 10 ;20", 10.0, None, (20.0, 10.0)), ("g;10;", None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, raw string, x double, y double")
    got = [r.at and tuple(r.at) for r in df.withColumn("at", R.settled_place(F.col("raw"), F.col("x"), F.col("y"))).orderBy("i").collect()]
    assert got == [r[3] for r in rows]


def test_sources_by_hand(spark):
    rows = [("1", "2", "3", "4", (1.0, 2.0, "own")), ("1", " ", "3", "4", (3.0, 4.0, "river")), (None, "2", "3", "4", (3.0, 4.0, "river")), ("x", "2", "3", "4", None), (None, None, "3", "", None), (None,) * 5]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, a string, b string, c string, d string")
    got = [r.at and tuple(r.at) for r in df.withColumn("at", R.preferred_place(("own", F.col("a"), F.col("b")), ("river", F.col("c"), F.col("d")))).orderBy("i").collect()]
    assert got == [r[4] for r in rows]


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


EVENT, SITE = "lat double, lon double, radius_km double", "category string, id string, name string, lat double, lon double"


def test_sites_in_reach_equal_brute_force(spark):
    r = random.Random(5)
    sites = [(r.choice([*E.LABELS, "other"]), str(i) if i % 9 else None, r.choice(["", None, "N"]), r.uniform(-89, 89) if i % 8 else None, r.uniform(-180, 180)) for i in range(300)]
    sites += [("dam", "edge", "Edge", 0.0, 179.99), ("dam", "pole", "Pole", 89.9, 10.0), ("port", "far", "Far", float("nan"), 0.0)]
    events = [(r.uniform(-90, 90), r.uniform(-180, 180), r.choice([0.5, 5.0, 50.0, 400.0, 3000.0, 25_000.0, 0.0, -1.0, None, float("nan")])) for _ in range(150)]
    events += [(0.0, -179.99, 5.0), (89.9, -170.0, 40.0), (None, 1.0, 5.0), (1.0, None, 5.0), (float("nan"), 1.0, 5.0)] + [(10.0, 10.0, 400.0)] * 200  # one crowded centroid
    usable = [(f"{c}:{i}", c, y, x) for c, i, _, y, x in sites if c in E.LABELS and i is not None and y is not None and not math.isnan(y)]
    fine = [e for e in events if None not in e[:2] and not math.isnan(e[0])]
    searched = [e for e in fine if e[2] is not None and e[2] > 0]
    want = {s: sum(km(e[0], e[1], y, x) <= e[2] for e in searched) for s, _, y, x in usable}
    ev, st = spark.createDataFrame(events, EVENT), E.usable_sites(spark.createDataFrame(sites, SITE))
    assert {x.site_id: x.event_count for x in E.exposed_sites(ev, st).collect()} == {s: n for s, n in want.items() if n}
    top = [(x.site_id, x.event_count) for x in E.risk_document(ev, st, 7).collect()]
    assert top == sorted(((s, n) for s, n in want.items() if n), key=lambda x: (-x[1], x[0]))[:7]
    counters = {x.counter: x.n for x in E.risk_counters(ev, st).collect()}
    assert counters["events:searched"] == len(searched) and counters["events:without_radius"] == len(fine) - len(searched) and counters["events:missing_coordinate"] == len(events) - len(fine)
    assert all(counters[f"sites:{c}"] == sum(u[1] == c for u in usable) for c in E.LABELS)
    assert {x.name for x in st.where("category = 'port'").collect()} <= {"N", "Port"}


def test_no_events_and_no_sites(spark):
    none, st = spark.createDataFrame([], EVENT), E.usable_sites(spark.createDataFrame([], SITE))
    assert E.risk_document(none, st).count() == 0 and {x.n for x in E.risk_counters(none, st).collect()} == {0}
