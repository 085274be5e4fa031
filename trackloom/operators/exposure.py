"""Sites that lie inside the area of doubt of recent events, ranked, with counts of what could and couldn't be searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import haversine_km
from trackloom.operators.joins import _spread, cell_for
from trackloom.sources.standins import km_sql, oracle, reports, table

#: Days that count as recent, sites that a document shows, and what an unnamed site is called.
RECENT_DAYS, SHOWN = 30, 30
LABELS = {"dam": "Dam / reservoir", "power_plant": "Power plant", "cable_landing": "Submarine cable landing", "airfield": "Airfield", "port": "Port"}
#: Radii of these kilometres bound the bands in which events are joined, each with cells of its own size; the last is half the way round.
BANDS = (1.0, 8.0, 64.0, 512.0, 20_040.0)


def usable_sites(rows: DataFrame) -> DataFrame:
    """Sites (site_id, category, name, lat2, lon2) of rows (category, id, name, lat, lon): known categories with an id and a place; ids carry their category."""
    label = reduce(lambda c, k: c.when(F.col("category") == k, LABELS[k]), list(LABELS)[1:], F.when(F.col("category") == "dam", LABELS["dam"]))
    placed = F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("category").isin(*LABELS)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), label)
    return rows.where(placed).select(F.concat_ws(":", "category", F.col("id").cast("string")).alias("site_id"), "category", name.alias("name"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))


def _search(events: DataFrame) -> DataFrame:
    """events with `state`: searched, without_radius (null, NaN or not above 0) or missing_coordinate."""
    placed = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    wide = (F.col("radius_km") > 0) & ~F.isnan("radius_km")
    state = F.when(~F.coalesce(placed, F.lit(False)), "missing_coordinate").when(~F.coalesce(wide, F.lit(False)), "without_radius").otherwise("searched")
    return events.select("lat", "lon", F.col("radius_km").cast("double").alias("radius_km")).withColumn("state", state)


def exposed_sites(events: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites inside at least one event's radius, with the number of such events: site_id, category, name, lat2, lon2, event_count.

    events: lat, lon, radius_km. Events of one place and radius, as country centroids give them, are one row with a count
    before anything is joined. A circle lies in one cell of its band's size, and sites are copied to the cells of each band
    that reach them, so a small circle doesn't pay for the widest and events are read once; counts are added before the shuffle.
    """
    circles = _search(events).where("state = 'searched'").groupBy("lat", "lon", "radius_km").agg(F.count("*").alias("n"))
    band = reduce(lambda c, i: F.when(F.col("radius_km") <= BANDS[i], i).otherwise(c), reversed(range(len(BANDS) - 1)), F.lit(len(BANDS) - 1))
    cells = [cell_for(km) for km in BANDS]
    size, across = (F.element_at(F.array(*map(F.lit, v)), F.col("_band") + 1) for v in (cells, [int(round(360 / c)) for c in cells]))
    placed = circles.withColumn("_band", band).withColumn("_cy", F.floor(F.col("lat") / size).cast("int")).withColumn("_cx", F.pmod(F.floor(F.col("lon") / size).cast("int"), across))
    at = sites.select("site_id", "lat2", "lon2")
    reach = reduce(DataFrame.unionByName, [_spread(at, km, ("lat2", "lon2"), c).withColumn("_band", F.lit(i)) for i, (km, c) in enumerate(zip(BANDS, cells))])
    hits = placed.join(reach, ["_band", "_cy", "_cx"]).where(haversine_km("lat", "lon", "lat2", "lon2") <= F.col("radius_km"))
    counts = hits.groupBy("site_id").agg(F.sum("n").alias("event_count"))
    return sites.join(counts, "site_id")


def risk_document(events: DataFrame, sites: DataFrame, most: int = SHOWN) -> DataFrame:
    """The `most` sites with the most events, ties by site_id: the document's list."""
    return exposed_sites(events, sites).orderBy(F.desc("event_count"), "site_id").limit(most)


def risk_counters(events: DataFrame, sites: DataFrame) -> DataFrame:
    """The document's counters (counter, n): events by what became of their search, sites by category; zeros are there too."""
    names = [*(f"events:{s}" for s in ("searched", "without_radius", "missing_coordinate")), *(f"sites:{c}" for c in LABELS)]
    every = events.sparkSession.createDataFrame([(n,) for n in names], "counter string")
    found = _search(events).select(F.concat(F.lit("events:"), "state").alias("counter")).unionByName(sites.select(F.concat(F.lit("sites:"), "category").alias("counter")))
    return every.join(found.groupBy("counter").agg(F.count("*").alias("n")), "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


#: The query's day, and a window that the test tables fill.
TODAY, DAYS = 10_000, 365


def _events(s, d):
    return reports(s, d).where(F.col("day").between(TODAY - DAYS, TODAY)).select(F.expr("if(report_id % 11 = 0, null, lat)").alias("lat"), "lon", F.expr("case mentions when 0 then null else (mentions - 1) * mentions * 10.0D end").alias("radius_km"))


def _sites(s, d):
    kinds = ", ".join(f"'{k}'" for k in LABELS)
    t = table(s, d, "supplier")
    return usable_sites(t.selectExpr(f"element_at(array({kinds}, 'other'), cast(s_suppkey % 6 + 1 as int)) as category", "if(s_suppkey % 13 = 0, null, s_suppkey) as id", "if(s_suppkey % 4 = 0, '', s_name) as name", "((s_suppkey * 37) % 100) - 50 + 0.25D as lat", "((s_suppkey * 91) % 300) - 150 + 0.3D as lon"))


QUERIES = {"doc_infra_risk": lambda s, d: risk_document(_events(s, d), _sites(s, d)), "doc_infra_counters": lambda s, d: risk_counters(_events(s, d), _sites(s, d))}
_CASE = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(LABELS))
_NAMES = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LABELS.values()))
_SITES = f"""w AS (SELECT CASE s_suppkey % 6 {_CASE} END || ':' || s_suppkey AS site_id, CASE s_suppkey % 6 {_CASE} END AS category, CASE WHEN s_suppkey % 4 = 0 THEN CASE s_suppkey % 6 {_NAMES} END ELSE s_name END AS name,
    ((s_suppkey * 37) % 100) - 50 + 0.25::DOUBLE AS lat2, ((s_suppkey * 91) % 300) - 150 + 0.3::DOUBLE AS lon2 FROM supplier WHERE s_suppkey % 6 < 5 AND s_suppkey % 13 <> 0)"""
_EVENTS = f"v AS (SELECT report_id, lat, lon, mentions, (mentions - 1) * mentions * 10.0::DOUBLE AS radius FROM reports WHERE day BETWEEN {TODAY - DAYS} AND {TODAY})"
ORACLES = {
    "doc_infra_risk": oracle("reports", f"SELECT site_id, category, name, lat2, lon2, count(*) AS event_count FROM v, w WHERE report_id % 11 <> 0 AND mentions > 1 AND {km_sql('lat', 'lon', 'lat2', 'lon2')} <= radius GROUP BY ALL ORDER BY event_count DESC, site_id LIMIT {SHOWN}", _SITES, _EVENTS),
    "doc_infra_counters": oracle(
        "reports", "SELECT 'sites:' || category AS counter, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT 'events:missing_coordinate', count(*) FILTER (report_id % 11 = 0) FROM v UNION ALL SELECT 'events:without_radius', count(*) FILTER (report_id % 11 <> 0 AND mentions <= 1) FROM v UNION ALL SELECT 'events:searched', count(*) FILTER (report_id % 11 <> 0 AND mentions > 1) FROM v",
        _SITES, _EVENTS,
    ),
}
