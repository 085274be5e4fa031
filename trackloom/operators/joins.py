"""Joins: lookups, look-back intervals, ranges, boxes, nearest neighbours, radii, twins, pairs, prefixes and merges.

Spatial and range conditions become equi-joins on cells or blocks: the smaller side is exploded to the cells it can
reach, so the join is a hash or merge join with a residual, never a nested loop over both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import EARTH_KM, haversine_km, in_box
from trackloom.sources.standins import km_sql, oracle, positions, reports, sites, table

#: Named boxes as (south, west, north, east) for the registered queries.
BOXES = {"north": (30.0, -60.0, 60.0, 60.0), "middle": (-10.0, -180.0, 35.0, 20.0), "south": (-60.0, -90.0, 0.0, 120.0)}


def _cells(lat: str, lon: str, reach_lat: Column, reach_lon: Column, cell: float) -> Column:
    """All cells within reach of a point; longitudes wrap."""
    across = int(round(360 / cell))
    y, x = F.floor(F.col(lat) / cell).cast("int"), F.floor(F.col(lon) / cell).cast("int")
    grid = F.transform(F.sequence(y - reach_lat, y + reach_lat), lambda j: F.transform(F.sequence(x - reach_lon, x + reach_lon), lambda i: F.struct(j.alias("cy"), F.pmod(i, F.lit(across)).alias("cx"))))
    return F.explode(F.array_distinct(F.flatten(grid)))


def cell_for(km: float) -> float:
    """The cell, in degrees, at which a circle of km spans one cell north and south: an even part of 360, at least 0.001."""
    return 360 / max(4, min(360_000, math.floor(360 / max(math.degrees(km / EARTH_KM), 1e-9))))


def within_radius(left: DataFrame, right: DataFrame, km: float, l=("lat", "lon"), r=("lat2", "lon2"), cell: float | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of left and right rows at most km apart (and equal in the columns `also`), with their distance. The right side is exploded to the cells it can reach."""
    cell = cell or cell_for(km)
    across = int(round(360 / cell))
    placed = left.withColumn("_cy", F.floor(F.col(l[0]) / cell).cast("int")).withColumn("_cx", F.pmod(F.floor(F.col(l[1]) / cell).cast("int"), F.lit(across)))
    return placed.join(_spread(right, km, r, cell), ["_cy", "_cx", *also]).withColumn("km", haversine_km(*l, *r)).where(F.col("km") <= km).drop("_cy", "_cx")


def _spread(right: DataFrame, km: float, r: tuple[str, str], cell: float) -> DataFrame:
    """Rows copied to every cell (_cy, _cx) that a circle of km around them can touch."""
    across = int(round(360 / cell))
    angle = math.degrees(km / EARTH_KM)
    up = F.lit(math.ceil(angle / cell))
    # the widest longitude of a circle around the point; all of them where it holds a pole
    sine = math.sin(math.radians(min(angle, 90.0))) / F.cos(F.radians(F.col(r[0])))
    wide = F.when(F.abs(F.col(r[0])) + angle < 90, F.degrees(F.asin(F.least(sine, F.lit(1.0))))).otherwise(F.lit(180.0))
    aside = F.least(F.ceil(wide / cell).cast("int"), F.lit(across // 2))
    return right.withColumn("_c", _cells(*r, up, aside, cell)).withColumn("_cy", F.col("_c.cy")).withColumn("_cx", F.col("_c.cx")).drop("_c")


def within_days(left: DataFrame, right: DataFrame, km: float, days: int, also: tuple[str, ...] = (), first: str = "true") -> DataFrame:
    """All pairs of left (lat, lon, day) and right rows (lat2, lon2, day2) at most km and days apart, equal in the columns `also`, for which `first` holds.

    A cell is as wide as three reaches, in degrees and in days, and a right row goes to those cells alone that its own reach
    touches: some five copies at middle latitudes, where the cells of within_radius() and three blocks are 27 and more.
    """
    angle = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-9
    across, block = max(4, math.floor(120 / angle)), max(1, 3 * days)
    cell = 360 / across
    at = lambda c, w=cell: F.floor(c / w).cast("int")
    sine = math.sin(math.radians(min(angle, 90.0))) / F.cos(F.radians("lat2"))
    wide = F.when(F.abs("lat2") + angle < 90, F.degrees(F.asin(F.least(sine, F.lit(1.0)))) + 1e-9).otherwise(180.0)
    west = at(F.col("lon2") - wide)
    reach = right.withColumn("_cd", F.explode(F.sequence(at(F.col("day2") - days, block), at(F.col("day2") + days, block))))
    reach = reach.withColumn("_cy", F.explode(F.sequence(at(F.col("lat2") - angle), at(F.col("lat2") + angle))))
    reach = reach.withColumn("_cx", F.explode(F.sequence(west, F.least(at(F.col("lon2") + wide), west + (across - 1))))).withColumn("_cx", F.pmod("_cx", F.lit(across)))
    placed = left.withColumn("_cd", at(F.col("day"), block)).withColumn("_cy", at(F.col("lat"))).withColumn("_cx", F.pmod(at(F.col("lon")), F.lit(across)))
    met = placed.join(reach, ["_cd", "_cy", "_cx", *also]).where(F.expr(first) & (F.abs(F.col("day") - F.col("day2")) <= days) & (F.abs(F.col("lat") - F.col("lat2")) <= angle))
    return met.where(haversine_km("lat", "lon", "lat2", "lon2") <= km).drop("_cd", "_cy", "_cx")


def nearest_attached(rows: DataFrame, places: DataFrame, km: float, out: str = "place") -> DataFrame:
    """Rows (lat, lon) with the id and distance of the nearest place (place_id, place_lat, place_lon) within km, null where there is none.

    Each cell holds the places that reach it as one array, so a row meets one row and nothing is grouped after the join:
    it also serves streams. Places are a dimension: a cell's array is as long as places are dense. Ties go to the greater id,
    so of places at one point only the greatest is kept.
    """
    cell = cell_for(km)
    across = int(round(360 / cell))
    points = places.groupBy(F.col("place_lat").alias("lat2"), F.col("place_lon").alias("lon2")).agg(F.max("place_id").alias("place_id"))
    reach = _spread(points, km, ("lat2", "lon2"), cell)
    table_ = reach.groupBy("_cy", "_cx").agg(F.collect_list(F.struct("place_id", "lat2", "lon2")).alias("_near"))
    placed = rows.withColumn("_cy", F.floor(F.col("lat") / cell).cast("int")).withColumn("_cx", F.pmod(F.floor(F.col("lon") / cell).cast("int"), F.lit(across)))
    away = F.transform("_near", lambda p: F.struct(haversine_km(F.col("lat"), F.col("lon"), p["lat2"], p["lon2"]).alias("km"), (-p["place_id"]).alias("neg")))
    best = F.array_min(F.transform(F.filter(away, lambda p: p["km"] <= km), lambda p: F.struct(F.round(p["km"], 9).alias("r"), p["neg"].alias("neg"), p["km"].alias("km"))))
    joined = placed.join(table_, ["_cy", "_cx"], "left").withColumn("_best", best)
    return joined.select(*rows.columns, (-F.col("_best.neg")).alias(f"{out}_id"), F.col("_best.km").alias(f"{out}_km"))


def nearest_of_list(rows: DataFrame, places: list[tuple], km: float, most: int = 1000) -> DataFrame:
    """Rows with the nearest of a short literal list of (id, lat, lon) within km; of equal ones the later. A longer list is refused."""
    if len(places) > most:
        raise ValueError(f"more than {most} places: use nearest()")
    every = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(-k).alias("k"), haversine_km("lat", "lon", float(y), float(x)).alias("km")) for k, (i, y, x) in enumerate(places)])
    near = F.transform(F.filter(every, lambda p: p["km"] <= km), lambda p: F.struct(p["km"], p["k"], p["id"]))
    return rows.withColumn("_near", F.array_min(near)).withColumn("near_id", F.col("_near.id")).withColumn("near_km", F.col("_near.km")).drop("_near")


def nearest(left: DataFrame, right: DataFrame, km: float, key: str, right_key: str, l=("lat", "lon"), r=("lat2", "lon2"), also: tuple[str, ...] = (), **names) -> DataFrame:
    """For each left key the nearest right row within km; ties go to the greater right key, so of right rows at one point only the greatest is kept."""
    points = right.groupBy(*r, *also).agg(F.max(right_key).alias(right_key))
    near = within_radius(left, points, km, l=l, r=r, also=also, **names)
    return near.groupBy(key).agg(F.min_by(F.struct(right_key, "km"), F.struct(F.round("km", 9), -F.col(right_key))).alias("r")).select(key, F.col(f"r.{right_key}"), F.round("r.km", 6).alias("km"))


def unambiguous(left: DataFrame, right: DataFrame, km: float, key: str, right_key: str, **names) -> DataFrame:
    """The right key of left rows with one candidate within km; more than one is flagged ambiguous and unmatched."""
    near = within_radius(left, right, km, **names).groupBy(key).agg(F.count("*").alias("n"), F.min(right_key).alias("one"))
    return left.select(key).join(near, key, "left").select(key, F.when(F.col("n") == 1, F.col("one")).alias(right_key), (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


def look_back(targets: DataFrame, log: DataFrame, seconds: float) -> DataFrame:
    """Statistics of each target's entity in the seconds before it; targets without history keep a row.

    Both sides meet on entity and time block: a look-back reaches its own block and the ones before, so no entity's
    whole history is joined with all its targets.
    """
    block = lambda t: F.floor(t / seconds).cast("long")
    t = targets.withColumn("_b", F.explode(F.array(block(F.col("before")), block(F.col("before")) - 1)))
    h = log.select("entity_id", "ts", "speed", block(F.col("ts")).alias("_b"))
    hit = t.join(h, ["entity_id", "_b"]).where((F.col("ts") <= F.col("before")) & (F.col("ts") >= F.col("before") - seconds))
    stats = hit.groupBy("target").agg(F.count("*").alias("n"), F.round(F.percentile("speed", F.lit(0.95)), 6).alias("p95"))
    return targets.join(stats, "target", "left").select("target", "entity_id", F.coalesce("n", F.lit(0)).alias("n"), "p95")


def smallest_range(values: DataFrame, ranges: DataFrame, block: int = 64) -> DataFrame:
    """For each value the narrowest range [start, finish] that holds it, then the least start. Ranges are exploded to blocks."""
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("finish") / block))))
    hit = values.withColumn("_b", F.floor(F.col("value") / block)).join(r, "_b").where("value between start and finish")
    best = hit.groupBy("value").agg(F.min_by(F.struct("range_id", "start", "finish"), F.struct(F.col("finish") - F.col("start"), "start", "range_id")).alias("r"))
    return values.join(best, "value", "left").select("value", "r.range_id", "r.start", "r.finish")


def box_labels(df: DataFrame, boxes: dict[str, tuple]) -> DataFrame:
    """A row per box a point lies in (all matches)."""
    hits = F.array_compact(F.array(*[F.when(in_box("lat", "lon", b), F.lit(name)) for name, b in boxes.items()]))
    return df.withColumn("box", F.explode(hits))


def first_box(df: DataFrame, boxes: dict[str, tuple]) -> DataFrame:
    """The first box in declaration order, or null."""
    return df.withColumn("box", F.coalesce(*[F.when(in_box("lat", "lon", b), F.lit(name)) for name, b in boxes.items()]))


def mutual_twins(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Pairs in which b's nearest a is that a, and among the b's that chose it b is the nearest. Keys a_id, b_id."""
    pick = nearest(b, a, km, "b_id", "a_id", l=("b_lat", "b_lon"), r=("a_lat", "a_lon"))
    return pick.groupBy("a_id").agg(F.min_by(F.struct("b_id", "km"), F.struct("km", "b_id")).alias("r")).select("a_id", "r.b_id", "r.km")


def stationary_pairs(latest: DataFrame, places: DataFrame, now: float, km: float = 0.5, knots: float = 1.0, hours: float = 1.0, clear_km: float = 25.0, cap: int | None = None) -> DataFrame:
    """Vessels lying alongside each other away from any place: pairs (a_id < b_id) at most km apart.

    latest: entity_id, lat, lon, speed, moored, moved_at. Both are at most at `knots`, not moored, have not moved for
    `hours`, and have no place (lat2, lon2) within clear_km. With a cap, the longest together are kept.
    """
    still = latest.withColumn("still_hours", (F.lit(now) - F.coalesce("moved_at", F.lit(now))) / 3600)
    calm = still.where((F.col("speed") <= knots) & ~F.coalesce("moored", F.lit(False)) & (F.col("still_hours") >= hours) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    at_place = within_radius(calm, places.select("lat2", "lon2"), clear_km).select("entity_id").distinct()
    free = calm.join(at_place, "entity_id", "left_anti").select("entity_id", "lat", "lon", "still_hours")
    other = free.select(F.col("entity_id").alias("b_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("still_hours").alias("b_still"))
    pairs = within_radius(free.withColumnRenamed("entity_id", "a_id"), other, km).where("a_id < b_id")
    out = pairs.select("a_id", "b_id", ((F.col("lat") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon") + F.col("lon2")) / 2).alias("lon"), F.rint(F.col("km") * 1000).cast("long").alias("separation_m"), F.bround(F.least("still_hours", "b_still"), 1).alias("together_hours"))
    return out if cap is None else out.orderBy(F.desc("together_hours"), "a_id", "b_id").limit(cap)


def corroborated(df: DataFrame, degrees: float = 0.5, days: int = 2) -> DataFrame:
    """For each report the sorted sources of other reports within the box and days.

    Reports meet on cells of the box and blocks of days. One side goes to its own cell and the half of the neighbours
    that come after it, so each pair is met once and then told to both.
    """
    k = lambda c, w: F.floor(F.col(c) / w).cast("int")
    base = df.select("report_id", "lat", "lon", "day", "category", k("lat", degrees).alias("cy"), k("lon", degrees).alias("cx"), k("day", days).alias("cd"))
    steps = [(j, i, d) for j in (-1, 0, 1) for i in (-1, 0, 1) for d in (-1, 0, 1) if (j, i, d) >= (0, 0, 0)]
    near = F.explode(F.array(*[F.struct((F.col("cy") + j).alias("cy"), (F.col("cx") + i).alias("cx"), (F.col("cd") + d).alias("cd"), F.lit((j, i, d) == (0, 0, 0)).alias("own")) for j, i, d in steps]))
    right = base.select(F.col("report_id").alias("rid"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("day").alias("day2"), F.col("category").alias("category2"), near.alias("c")).select("*", "c.*").drop("c")
    close = (F.abs(F.col("lat") - F.col("lat2")) <= degrees) & (F.abs(F.col("lon") - F.col("lon2")) <= degrees) & (F.abs(F.col("day") - F.col("day2")) <= days)
    hit = base.join(right, ["cy", "cx", "cd"]).where(close & F.when(F.col("own"), F.col("report_id") < F.col("rid")).otherwise(True))
    both = hit.select(F.explode(F.array(F.struct(F.col("report_id").alias("id"), F.col("category2").alias("source")), F.struct(F.col("rid").alias("id"), F.col("category").alias("source")))).alias("x"))
    counted = both.groupBy("x.id", "x.source").agg(F.count("*").alias("n"))
    return counted.groupBy(F.col("id").alias("report_id")).agg(F.concat_ws(",", F.array_sort(F.collect_list("source"))).alias("sources"), F.sum("n").alias("n"))


def name_join(df: DataFrame, dim: DataFrame, name: str, value: str) -> DataFrame:
    """df with the value of the dimension's row of that name, else of the row whose folded name is the same; matched says which.

    Of several rows of a name (or a folded one) the first by `ordinal` counts. Names are folded once each, not per row.
    """
    from trackloom.operators.gazetteer import folded

    exact = dim.groupBy(name).agg(F.min_by(value, "ordinal").alias("_exact"))
    fuzzy = folded(dim.select(name, value, "ordinal"), name, "_key").where("_key is not null and _key <> ''").groupBy("_key").agg(F.min_by(value, "ordinal").alias("_fuzzy"))
    keyed = folded(df, name, "_key").join(exact, name, "left").join(fuzzy, "_key", "left")
    matched = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_fuzzy").isNotNull(), "normalised").otherwise("none")
    return keyed.withColumn(value, F.coalesce("_exact", "_fuzzy")).withColumn("matched", matched).drop("_exact", "_fuzzy", "_key")


def hex_allocation(df: DataFrame, address: str, blocks: DataFrame, block: int = 1 << 12) -> DataFrame:
    """df with the country and military flag of the smallest address block (start, finish, country, military) that holds its hexadecimal address."""
    keyed = df.withColumn("_value", F.conv(F.trim(F.col(address)), 16, 10).cast("long"))
    asked = keyed.select(F.col("_value").alias("value")).where("value is not null").distinct()
    hit = smallest_range(asked, blocks.withColumn("range_id", F.struct("country", "military")), block).select("value", "range_id.*")
    return keyed.join(hit, F.col("_value") == F.col("value"), "left").drop("_value", "value")


def priority_lookup(df: DataFrame, steps: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """The value of the first step whose key matches, and that step's name as matched_on. Steps are (name, dimension, key)."""
    out, hits = df, []
    for name, dim, key in steps:
        one = dim.groupBy(key).agg(F.min(value).alias(f"_{name}"))
        out = out.join(one, key, "left")
        hits.append(name)
    return out.withColumn(value, F.coalesce(*[F.col(f"_{h}") for h in hits])).withColumn("matched_on", F.coalesce(*[F.when(F.col(f"_{h}").isNotNull(), F.lit(h)) for h in hits])).drop(*[f"_{h}" for h in hits])


def longest_prefix(df: DataFrame, code: str, dim: DataFrame) -> DataFrame:
    """Label of the longest prefix of a code that the dimension (prefix, label) holds."""
    p = df.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substring(F.col(code), F.lit(1), n))))
    best = p.join(dim, "prefix").groupBy(code).agg(F.max_by(F.struct("prefix", "label"), F.length("prefix")).alias("r"))
    return df.select(code).distinct().join(best, code, "left").select(code, "r.prefix", "r.label")


def merge_feeds(a: DataFrame, b: DataFrame, key: str, fields: list[str], kept: list[str]) -> DataFrame:
    """Full outer merge: b's fields overwrite a's where b has the row, nulls too, save the `kept` ones; sources names who had it."""
    x, y = a.select(key, F.lit(True).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields]), b.select(key, F.lit(True).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    j = x.join(y, key, "full")
    value = lambda f: F.coalesce(f"b_{f}", f"a_{f}") if f in kept else F.when(F.col("_b"), F.col(f"b_{f}")).otherwise(F.col(f"a_{f}"))
    who = F.concat_ws("+", F.when(F.col("_a"), F.lit("a")), F.when(F.col("_b"), F.lit("b")))
    return j.select(key, *[value(f).alias(f) for f in fields], who.alias("sources"))


def truth_match(events: DataFrame, truth: DataFrame, days: int, km: float) -> DataFrame:
    """For each event the nearest truth row of its actor group within days; truths are exploded to the days they reach."""
    t = truth.withColumn("d", F.explode(F.expr(f"sequence(day - {days}, day + {days})"))).select("grp", "d", F.col("report_id").alias("truth_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    hit = events.join(t, (events["grp"] == t["grp"]) & (events["day"] == t["d"])).withColumn("km", haversine_km("lat", "lon", "lat2", "lon2")).where(F.col("km") <= km)
    return hit.groupBy("report_id").agg(F.min_by(F.struct("truth_id", "km"), F.struct(F.round("km", 9), "truth_id")).alias("r")).select("report_id", "r.truth_id", F.round("r.km", 6).alias("km"))


def _grp(s, d):
    return reports(s, d).withColumn("grp", F.col("actor") % 50)



def _targets(s, d):
    return positions(s, d).select(F.col("event_id").alias("target"), "entity_id", F.col("ts").alias("before"))


#: Fixed "now" of the registered queries, and the pair distance that fits the stand-in log.
NOW, PAIR_KM = 1_706_700_000.0, 3.0


def vessels(s, d):
    """The stand-in log as vessels of their own: slow ones, some moored."""
    return positions(s, d).select(F.col("event_id").alias("entity_id"), "lat", "lon", (F.col("speed") / 40).alias("speed"), (F.col("event_id") % 7 == 0).alias("moored"), F.when(F.col("event_id") % 9 != 0, F.col("ts")).alias("moved_at"))


def _site2(s, d):
    return sites(s, d).select("site_id", F.col("site_lat").alias("lat2"), F.col("site_lon").alias("lon2"))


_LIST = [(1, 12.0, 30.0), (2, -35.5, 120.25), (3, 12.0, 30.0), (4, 55.0, -60.0), (5, 0.5, -10.0)]
QUERIES = {
    "join_lookup": lambda s, d: positions(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("entity_id"), "c_name", "c_mktsegment"), "entity_id", "left").select("event_id", F.coalesce("c_name", F.lit("?")).alias("name"), "c_mktsegment"),
    "join_look_back": lambda s, d: look_back(_targets(s, d), positions(s, d), 5 * 86_400.0),
    "join_smallest_range": lambda s, d: smallest_range(table(s, d, "orders").select((F.col("o_orderkey") % 2100).alias("value")).distinct(), table(s, d, "part").selectExpr("p_partkey as range_id", "p_partkey as start", "p_partkey + p_size as finish")),
    "join_boxes_all": lambda s, d: box_labels(positions(s, d), BOXES).groupBy("entity_id", "box").count().withColumnRenamed("count", "n"),
    "join_box_first": lambda s, d: first_box(positions(s, d), BOXES).select("event_id", "box"),
    "join_nearest": lambda s, d: nearest(positions(s, d), _site2(s, d), 120.0, "event_id", "site_id"),
    "join_radius": lambda s, d: within_radius(positions(s, d), _site2(s, d), 400.0).select("event_id", "site_id", F.round("km", 6).alias("km")),
    "join_unambiguous": lambda s, d: unambiguous(positions(s, d), _site2(s, d), 150.0, "event_id", "site_id"),
    "join_mutual_twins": lambda s, d: mutual_twins(sites(s, d).select(F.col("site_id").alias("a_id"), F.col("site_lat").alias("a_lat"), F.col("site_lon").alias("a_lon")), positions(s, d).select(F.col("event_id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon")), 120.0),
    "join_close_pairs": lambda s, d: stationary_pairs(vessels(s, d), _site2(s, d), NOW, PAIR_KM).select("a_id", "b_id", "separation_m", "together_hours"),
    "join_nearest_attached": lambda s, d: nearest_attached(positions(s, d).select("event_id", "lat", "lon"), _site2(s, d).selectExpr("site_id as place_id", "lat2 as place_lat", "lon2 as place_lon"), 40.0).select("event_id", "place_id", F.round("place_km", 6).alias("place_km")),
    "join_nearest_of_list": lambda s, d: nearest_of_list(positions(s, d).select("event_id", "lat", "lon"), _LIST, 900.0).select("event_id", "near_id", F.round("near_km", 6).alias("near_km")),
    "join_names": lambda s, d: name_join(table(s, d, "part").selectExpr("p_partkey", "if(p_partkey % 3 = 0, upper(p_name), p_name) as name"), table(s, d, "part").selectExpr("if(p_partkey % 2 = 0, p_name, concat(' ', replace(p_name, ' ', '-'))) as name", "p_brand as label", "p_partkey as ordinal"), "name", "label").select("p_partkey", "label", "matched"),
    "join_hex_allocation": lambda s, d: hex_allocation(positions(s, d).select("event_id", F.lower(F.hex((F.col("event_id") * 3) % 2100)).alias("hex")), "hex", table(s, d, "part").selectExpr("p_partkey as start", "p_partkey + p_size as finish", "p_brand as country", "p_size % 2 = 0 as military")).select("event_id", "country", "military"),
    "join_corroborated": lambda s, d: corroborated(reports(s, d)),
    "join_priority": lambda s, d: priority_lookup(
        reports(s, d).select("report_id", "actor", F.col("mentions").alias("m"), "day"),
        [("actor", table(s, d, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey as actor", "c_name as label"), "actor"), ("m", table(s, d, "nation").where("n_regionkey < 3").selectExpr("cast(n_nationkey as int) as m", "n_name as label"), "m")], "label",
    ).select("report_id", "label", "matched_on"),
    "join_longest_prefix": lambda s, d: longest_prefix(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("code")), "code", table(s, d, "part").where("p_type like 'PROMO%'").select(F.col("p_partkey").cast("string").alias("prefix"), F.col("p_brand").alias("label"))),
    "join_merge_feeds": lambda s, d: merge_feeds(table(s, d, "customer").where("c_acctbal >= 0").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as v"), table(s, d, "supplier").selectExpr("s_suppkey as id", "s_name as name", "case when s_suppkey % 2 = 0 then s_acctbal end as v"), "id", ["name", "v"], ["name"]),
    "join_truth_days": lambda s, d: truth_match(_grp(s, d).where("status <> 'F'"), _grp(s, d).where("status = 'F'"), 3, 800.0),
    "join_semi_anti": lambda s, d: reports(s, d).join(table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("report_id")), "report_id", "left_semi").join(table(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("actor")), "actor", "left_anti").select("report_id", "actor"),
    "join_snap_capital": lambda s, d: reports(s, d).withColumn("country", F.col("actor") % 25).join(sites(s, d).groupBy("country").agg(F.min_by(F.struct("site_lat", "site_lon"), "site_id").alias("c")), "country", "left").select("report_id", F.when(F.col("status") == "P", F.col("c.site_lat")).otherwise(F.col("lat")).alias("lat"), F.when(F.col("status") == "P", F.col("c.site_lon")).otherwise(F.col("lon")).alias("lon"), F.col("lat").alias("original_lat")),
    "join_full_halves": lambda s, d: positions(s, d).where("kind = 'click'").groupBy("entity_id").agg(F.count("*").alias("clicks")).join(positions(s, d).where("kind = 'error' and value > 60").groupBy("entity_id").agg(F.count("*").alias("errors")), "entity_id", "full"),
}

_KM = km_sql("p.lat", "p.lon", "s.site_lat", "s.site_lon")
_BOX = {n: f"lat BETWEEN {b[0]} AND {b[2]} AND lon BETWEEN {b[1]} AND {b[3]}" for n, b in BOXES.items()}
ORACLES = {
    "join_lookup": oracle("positions", "SELECT event_id, coalesce(c_name, '?') AS name, c_mktsegment FROM positions LEFT JOIN customer ON c_custkey = entity_id"),
    "join_look_back": oracle(
        "positions", "SELECT t.target, t.entity_id, count(h.ts) AS n, round(quantile_cont(h.speed, 0.95), 6) AS p95 FROM t LEFT JOIN positions h ON h.entity_id = t.entity_id AND h.ts <= t.before AND h.ts >= t.before - 432000 GROUP BY ALL",
        "t AS (SELECT event_id AS target, entity_id, ts AS before FROM positions)",
    ),
    "join_smallest_range": """WITH v AS (SELECT DISTINCT o_orderkey % 2100 AS value FROM orders)
        SELECT value, p_partkey AS range_id, p_partkey AS start, p_partkey + p_size AS finish FROM v LEFT JOIN part ON value BETWEEN p_partkey AND p_partkey + p_size QUALIFY row_number() OVER (PARTITION BY value ORDER BY p_size, p_partkey) = 1""",
    "join_boxes_all": oracle("positions", " UNION ALL ".join(f"SELECT entity_id, '{n}' AS box, count(*) AS n FROM positions WHERE {c} GROUP BY 1" for n, c in _BOX.items())),
    "join_box_first": oracle("positions", "SELECT event_id, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _BOX.items()) + " END AS box FROM positions"),
    "join_nearest": oracle("positions sites", f"SELECT event_id, site_id, round(km, 6) AS km FROM (SELECT event_id, site_id, {_KM} AS km FROM positions p, sites s) WHERE km <= 120 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), site_id DESC) = 1"),
    "join_radius": oracle("positions sites", f"SELECT event_id, site_id, round(km, 6) AS km FROM (SELECT event_id, site_id, {_KM} AS km FROM positions p, sites s) WHERE km <= 400"),
    "join_unambiguous": oracle("positions sites", "SELECT p.event_id, CASE WHEN n = 1 THEN one END AS site_id, coalesce(n, 0) > 1 AS ambiguous FROM positions p LEFT JOIN c USING (event_id)", f"c AS (SELECT event_id, count(*) AS n, min(site_id) AS one FROM (SELECT event_id, site_id, {_KM} AS km FROM positions p, sites s) WHERE km <= 150 GROUP BY 1)"),
    "join_mutual_twins": oracle(
        "positions sites", "SELECT a_id, b_id, km FROM n QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY km, b_id) = 1",
        f"n AS (SELECT event_id AS b_id, site_id AS a_id, round(km, 6) AS km FROM (SELECT event_id, site_id, {_KM} AS km FROM positions p, sites s) WHERE km <= 120 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), site_id DESC) = 1)",
    ),
    "join_close_pairs": oracle(
        "positions sites", f"SELECT a_id, b_id, CAST(round_even(km * 1000, 0) AS BIGINT) AS separation_m, round_even(least(x, y), 1) AS together_hours FROM (SELECT a.event_id AS a_id, b.event_id AS b_id, a.h AS x, b.h AS y, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM f a JOIN f b ON a.event_id < b.event_id AND floor(a.lat * 10) BETWEEN floor(b.lat * 10) - 1 AND floor(b.lat * 10) + 1) WHERE km <= {PAIR_KM}",
        f"c AS (SELECT event_id, lat, lon, ({NOW} - ts) / 3600 AS h FROM positions WHERE speed / 40 <= 1 AND event_id % 7 <> 0 AND event_id % 9 <> 0 AND ({NOW} - ts) / 3600 >= 1)",
        f"f AS (SELECT * FROM c p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE {_KM} <= 25))",
    ),
    "join_nearest_attached": oracle("positions sites", f"SELECT p.event_id, n.site_id AS place_id, round(n.km, 6) AS place_km FROM positions p LEFT JOIN n USING (event_id)", f"n AS (SELECT event_id, site_id, km FROM (SELECT event_id, site_id, {_KM} AS km FROM positions p, sites s) WHERE km <= 40 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), site_id DESC) = 1)"),
    "join_nearest_of_list": oracle("positions", f"SELECT p.event_id, id AS near_id, round(km, 6) AS near_km FROM positions p LEFT JOIN n USING (event_id)", f"l(id, y, x) AS (VALUES {', '.join(f'({i}, {y}::DOUBLE, {x}::DOUBLE)' for i, y, x in _LIST)})", f"n AS (SELECT event_id, id, km FROM (SELECT event_id, id, {km_sql('lat', 'lon', 'y', 'x')} AS km FROM positions, l) WHERE km <= 900 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, id DESC) = 1)"),
    "join_names": """WITH d AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ' ' || replace(p_name, ' ', '-') END AS name, p_brand AS label, p_partkey AS o FROM part), e AS (SELECT name, arg_min(label, o) AS label FROM d GROUP BY 1),
        z AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS k, arg_min(label, o) AS label FROM d GROUP BY 1), p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part)
        SELECT p_partkey, coalesce(e.label, z.label) AS label, CASE WHEN e.label IS NOT NULL THEN 'exact' WHEN z.label IS NOT NULL THEN 'normalised' ELSE 'none' END AS matched FROM p LEFT JOIN e ON e.name = p.name LEFT JOIN z ON z.k = trim(regexp_replace(lower(p.name), '[^a-z0-9]+', ' ', 'g'))""",
    "join_hex_allocation": "SELECT event_id, p_brand AS country, p_size % 2 = 0 AS military FROM events LEFT JOIN part ON (event_id * 3) % 2100 BETWEEN p_partkey AND p_partkey + p_size QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p_size, p_partkey) = 1",
    "join_corroborated": oracle("reports", "SELECT a.report_id, string_agg(DISTINCT b.category, ',' ORDER BY b.category) AS sources, count(DISTINCT b.report_id) AS n FROM reports a JOIN reports b ON abs(a.lat - b.lat) <= 0.5 AND abs(a.lon - b.lon) <= 0.5 AND abs(a.day - b.day) <= 2 AND a.report_id <> b.report_id GROUP BY 1"),
    "join_priority": oracle("reports", "SELECT report_id, coalesce(c_name, n_name) AS label, CASE WHEN c_name IS NOT NULL THEN 'actor' WHEN n_name IS NOT NULL THEN 'm' END AS matched_on FROM reports LEFT JOIN customer ON c_custkey = actor AND c_mktsegment = 'BUILDING' LEFT JOIN nation ON n_nationkey = mentions AND n_regionkey < 3"),
    "join_longest_prefix": """WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS prefix, p_brand AS label FROM part WHERE p_type LIKE 'PROMO%'), c AS (SELECT CAST(p_partkey AS VARCHAR) AS code FROM part)
        SELECT code, prefix, label FROM c LEFT JOIN d ON starts_with(code, prefix) QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(prefix) DESC NULLS LAST) = 1""",
    "join_merge_feeds": """SELECT coalesce(a.c_custkey, b.s_suppkey) AS id, coalesce(b.s_name, a.c_name) AS name, CASE WHEN b.s_suppkey IS NOT NULL THEN CASE WHEN b.s_suppkey % 2 = 0 THEN b.s_acctbal END ELSE a.c_acctbal END AS v,
        CASE WHEN a.c_custkey IS NULL THEN 'b' WHEN b.s_suppkey IS NULL THEN 'a' ELSE 'a+b' END AS sources FROM (SELECT * FROM customer WHERE c_acctbal >= 0) a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey""",
    "join_truth_days": oracle("reports", f"SELECT report_id, truth_id, round(km, 6) AS km FROM (SELECT a.report_id, b.report_id AS truth_id, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM reports a JOIN reports b ON a.actor % 50 = b.actor % 50 AND a.status <> 'F' AND b.status = 'F' AND abs(a.day - b.day) <= 3) WHERE km <= 800 QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY round(km, 9), truth_id) = 1"),
    "join_semi_anti": oracle("reports", "SELECT report_id, actor FROM reports WHERE report_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND actor NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "join_snap_capital": oracle("reports sites", "SELECT report_id, CASE WHEN status = 'P' THEN site_lat ELSE lat END AS lat, CASE WHEN status = 'P' THEN site_lon ELSE lon END AS lon, lat AS original_lat FROM reports LEFT JOIN (SELECT country, arg_min(site_lat, site_id) AS site_lat, arg_min(site_lon, site_id) AS site_lon FROM sites GROUP BY 1) c ON c.country = actor % 25"),
    "join_full_halves": oracle("positions", "SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, clicks, errors FROM (SELECT entity_id, count(*) AS clicks FROM positions WHERE kind = 'click' GROUP BY 1) a FULL JOIN (SELECT entity_id, count(*) AS errors FROM positions WHERE kind = 'error' AND value > 60 GROUP BY 1) b ON a.entity_id = b.entity_id"),
}
