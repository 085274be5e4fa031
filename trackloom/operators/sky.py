"""Sun, terminator, sunrise; orbits, ground tracks, footprints and passes as column expressions and windows.

Orbits are Kepler's with the secular drift that the Earth's flattening gives node, perigee and anomaly (J2), from mean
elements. That is good to some tens of kilometres within a day of the epoch; drag and short-period terms are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import EARTH_KM, wrap_lon
from trackloom.operators.tracks import running_sum, with_previous
from trackloom.sources.standins import oracle, positions, sites

#: Gravity (km3/s2), equatorial radius (km) and flattening term.
MU, EQUATOR_KM, J2 = 398_600.4418, 6_378.137, 1.08262668e-3
SUNRISE_DEG = -0.833


def days_2000(ts: Column) -> Column:
    return ts / 86_400 + 2_440_587.5 - 2_451_545.0


def sun_angles(ts: Column) -> tuple[Column, Column]:
    """Declination and Greenwich hour angle of the sun in degrees, by the low-precision formulas."""
    n = days_2000(ts)
    mean, g = 280.46 + 0.9856474 * n, F.radians(357.528 + 0.9856003 * n)
    lam, eps = F.radians(mean + 1.915 * F.sin(g) + 0.02 * F.sin(2 * g)), F.radians(23.439 - 0.0000004 * n)
    dec, ra = F.degrees(F.asin(F.sin(eps) * F.sin(lam))), F.degrees(F.atan2(F.cos(eps) * F.sin(lam), F.cos(lam)))
    return dec, F.pmod(sidereal(n) - ra, F.lit(360.0))


def sidereal(n: Column) -> Column:
    return F.pmod(280.46061837 + 360.98564736629 * n, F.lit(360.0))


def sun_elevation(lat: Column, lon: Column, ts: Column) -> Column:
    dec, gha = sun_angles(ts)
    h, a, b = F.radians(gha + lon), F.radians(lat), F.radians(dec)
    return F.degrees(F.asin(F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(h)))


def subsolar(ts: Column) -> tuple[Column, Column]:
    dec, gha = sun_angles(ts)
    return dec, wrap_lon(-gha)


def terminator_latitude(lon: Column, ts: Column, threshold: float = 0.0) -> Column:
    """The latitude at which the sun stands at the threshold on a meridian; null where there is none."""
    dec, gha = sun_angles(ts)
    a, b = F.sin(F.radians(dec)), F.cos(F.radians(dec)) * F.cos(F.radians(gha + lon))
    r, phi, c = F.hypot(a, b), F.atan2(b, a), math.sin(math.radians(threshold))
    wrap = lambda x: F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi
    one, two = (wrap(x - phi) for x in (F.asin(c / r), math.pi - F.asin(c / r)))
    half = math.pi / 2 + 1e-9
    return F.when((r < 1e-9) | (F.abs(c / r) > 1), F.lit(None).cast("double")).when(F.abs(one) <= half, F.degrees(one)).when(F.abs(two) <= half, F.degrees(two))


def night_ring(df: DataFrame, ts: str, step: int = 2) -> DataFrame:
    """The edge of the night at each row's time: (ts, lon, lat) every `step` degrees."""
    dealt = df.select(ts, F.explode(F.sequence(F.lit(-180), F.lit(180 - step), F.lit(step))).alias("lon")).withColumn("lon", F.col("lon").cast("double"))
    return dealt.withColumn("lat", terminator_latitude(F.col("lon"), F.col(ts))).where("lat is not null")


def sun_times(df: DataFrame, lat: str, lon: str, day: str, threshold: float = SUNRISE_DEG, minutes: int = 10, halvings: int = 24) -> DataFrame:
    """df with rise and set (epoch seconds) on a UTC day that starts at `day`, null where there is none; `light` says what then holds all day.

    The first crossing between samples `minutes` apart is halved down, by a fold over a fixed number of steps.
    """
    y, x = F.col(lat), F.col(lon)
    at = lambda t: sun_elevation(y, x, t)
    starts = F.transform(F.sequence(F.lit(0), F.lit(1440 - minutes), F.lit(minutes)), lambda m: F.col(day) + m * 60.0)

    def crossing(up: bool) -> Column:
        low = (lambda t: at(t) < threshold) if up else (lambda t: at(t) >= threshold)
        hit = F.filter(starts, lambda t: low(t) & ~low(t + minutes * 60.0))
        first = F.struct(F.try_element_at(hit, F.lit(1)).alias("a"), (F.try_element_at(hit, F.lit(1)) + minutes * 60.0).alias("b"))

        def halve(s, _):
            m = (s["a"] + s["b"]) / 2
            return F.when(low(m), F.struct(m.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), m.alias("b")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), first, halve, lambda s: (s["a"] + s["b"]) / 2)

    rise, fall = crossing(True), crossing(False)
    return df.withColumn("rise", rise).withColumn("set", fall).withColumn("light", F.when(F.col("rise").isNull() & F.col("set").isNull(), F.when(at(F.col(day)) >= threshold, "always").otherwise("never")))


def subpoints(el: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of elements (sat_id, epoch, motion, ecc, incl, node, peri, anomaly) and a time, with lat, lon and alt_km of the point below."""
    rev = F.col("motion") * 2 * math.pi / 86_400  # radians a second
    a = F.pow(MU / F.pow(rev, 2), F.lit(1 / 3))
    e, i, t = F.col("ecc"), F.radians("incl"), F.col(ts) - F.col("epoch")
    drift = 1.5 * J2 * F.pow(EQUATOR_KM / (a * (1 - e * e)), 2) * rev
    node = F.radians("node") - drift * F.cos(i) * t
    peri = F.radians("peri") + drift * (2 - 2.5 * F.pow(F.sin(i), 2)) * t
    m = F.radians("anomaly") + (rev + drift * F.sqrt(1 - e * e) * (1 - 1.5 * F.pow(F.sin(i), 2))) * t
    s = el.withColumn("_a", a).withColumn("_node", node).withColumn("_peri", peri).withColumn("_m", F.pmod(m, F.lit(2 * math.pi)))
    # Kepler's equation by Newton's steps; ten are enough for eccentricities below 0.9
    ecc = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.col("_m") + e * F.sin("_m"), lambda x, _: x - (x - e * F.sin(x) - F.col("_m")) / (1 - e * F.cos(x)))
    s = s.withColumn("_e", ecc)
    true = 2 * F.atan2(F.sqrt(1 + e) * F.sin(F.col("_e") / 2), F.sqrt(1 - e) * F.cos(F.col("_e") / 2))
    u = true + F.col("_peri")
    lat = F.asin(F.sin(i) * F.sin(u))
    ra = F.col("_node") + F.atan2(F.cos(i) * F.sin(u), F.cos(u))
    s = s.withColumn("lat", F.degrees(lat)).withColumn("lon", wrap_lon(F.degrees(ra) - sidereal(days_2000(F.col(ts))))).withColumn("alt_km", F.col("_a") * (1 - e * F.cos("_e")) - EQUATOR_KM)
    return s.drop("_a", "_node", "_peri", "_m", "_e")


def orbit_summary(el: DataFrame) -> DataFrame:
    """Period (minutes), apogee and perigee (km above the equator's radius)."""
    a = F.pow(MU / F.pow(F.col("motion") * 2 * math.pi / 86_400, 2), F.lit(1 / 3))
    return el.select("sat_id", (1440 / F.col("motion")).alias("period_min"), (a * (1 + F.col("ecc")) - EQUATOR_KM).alias("apogee_km"), (a * (1 - F.col("ecc")) - EQUATOR_KM).alias("perigee_km"))


def footprint_km(alt: Column) -> Column:
    """Ground radius within which a satellite is above the horizon."""
    return EARTH_KM * F.acos(F.least(F.lit(1.0), EARTH_KM / (EARTH_KM + F.greatest(alt, F.lit(0.0)))))


def elevation_of(lat: float, lon: float) -> Column:
    """Elevation in degrees of a point (lat, lon, alt_km) seen from a place, on a sphere."""
    a, b = F.radians("lat"), F.radians(F.col("lon") - lon)
    central = F.acos(F.least(F.lit(1.0), math.sin(math.radians(lat)) * F.sin(a) + math.cos(math.radians(lat)) * F.cos(a) * F.cos(b)))
    r = EARTH_KM / (EARTH_KM + F.col("alt_km"))
    return F.degrees(F.atan2(F.cos(central) - r, F.sin(central)))


def ground_track(el: DataFrame, center: float, before_min: int = 90, after_min: int = 90, step_min: int = 1) -> DataFrame:
    """Points around a time, with a part number that rises where the track crosses the antimeridian."""
    times = F.explode(F.sequence(F.lit(-before_min), F.lit(after_min), F.lit(step_min)))
    p = subpoints(el.withColumn("k", times).withColumn("ts", F.lit(center) + F.col("k") * 60.0)).select(F.col("sat_id").alias("entity_id"), F.col("k").cast("long").alias("event_id"), "ts", "lat", "lon", "alt_km")
    jumps = with_previous(p, ["lon"]).withColumn("jump", F.coalesce(F.abs(F.col("lon") - F.col("b.lon")) > 180, F.lit(False)))
    return running_sum(jumps, F.col("jump"), "part").select(F.col("entity_id").alias("sat_id"), F.col("event_id").alias("minute"), "ts", "lat", "lon", "alt_km", "part")


def passes(el: DataFrame, lat: float, lon: float, start: float, hours: float = 24.0, least: float = 10.0, step_s: int = 30, most_sats: int = 200, most: int = 40) -> DataFrame:
    """Whole passes over a place above `least` degrees: rise, culmination and set to the sample, with the highest elevation.

    Satellites whose inclination and footprint can't reach the place are left out first; the `most_sats` that are nearest at
    the start are searched, and the first `most` passes given, which are this report's own limits. A pass that is cut by
    the window's ends isn't whole and isn't given.
    """
    top = F.least(F.col("incl"), 180 - F.col("incl"))
    s = orbit_summary(el)
    reach = el.join(s, "sat_id").where(top + F.degrees(footprint_km(F.col("apogee_km")) / EARTH_KM) >= abs(lat))
    here = subpoints(reach.withColumn("ts", F.lit(start)), "ts")
    near = here.orderBy(F.desc(elevation_of(lat, lon)), "sat_id").limit(most_sats).drop("lat", "lon", "alt_km", "ts", "period_min", "apogee_km", "perigee_km")
    n = int(hours * 3600 / step_s)
    p = subpoints(near.withColumn("event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))).withColumn("ts", F.lit(start) + F.col("event_id") * float(step_s)))
    seen = p.select(F.col("sat_id").alias("entity_id"), "event_id", "ts", elevation_of(lat, lon).alias("el")).withColumn("up", F.col("el") >= least)
    runs = running_sum(with_previous(seen, ["up"]), F.col("up") & ~F.coalesce("b.up", F.lit(False)), "run").where("up")
    g = runs.groupBy("entity_id", "run").agg(F.min("ts").alias("rise"), F.max_by("ts", F.struct("el", -F.col("event_id"))).alias("culminate"), F.max("ts").alias("set"), F.max("el").alias("max_elevation"))
    whole = g.where((F.col("rise") > start) & (F.col("set") < start + n * float(step_s)))
    return whole.orderBy("rise", "entity_id").limit(most).select(F.col("entity_id").alias("sat_id"), "rise", "culminate", "set", "max_elevation")


def elements(s, d) -> DataFrame:
    """Stand-in satellites: one a site."""
    return sites(s, d).selectExpr("site_id as sat_id", "1.7e9D as epoch", "12D + site_id % 4 as motion", "0.001D * (site_id % 50) as ecc", "30D + site_id % 70 as incl", "cast(site_id * 17 % 360 as double) as node", "cast(site_id * 29 % 360 as double) as peri", "cast(site_id * 53 % 360 as double) as anomaly")


T = 1_700_050_000.0
_SUN = lambda ts, p: (
    f"{p}n AS (SELECT *, {ts} / 86400 + 2440587.5::DOUBLE - 2451545.0::DOUBLE AS n FROM {p}r)",
    f"{p}l AS (SELECT *, radians(280.46::DOUBLE + 0.9856474::DOUBLE * n + 1.915::DOUBLE * sin(radians(357.528::DOUBLE + 0.9856003::DOUBLE * n)) + 0.02::DOUBLE * sin(2 * radians(357.528::DOUBLE + 0.9856003::DOUBLE * n))) AS lam, radians(23.439::DOUBLE - 0.0000004::DOUBLE * n) AS eps FROM {p}n)",
    f"{p}s AS (SELECT *, asin(sin(eps) * sin(lam)) AS dec, ((280.46061837::DOUBLE + 360.98564736629::DOUBLE * n) % 360 + 360) % 360 - degrees(atan2(cos(eps) * sin(lam), cos(lam))) AS gha FROM {p}l)",
)
QUERIES = {
    "fn_sun": lambda s, d: positions(s, d).select("event_id", F.round(sun_elevation(F.col("lat"), F.col("lon"), F.col("ts")), 5).alias("elevation"), F.round(subsolar(F.col("ts"))[0], 5).alias("declination")),
    "fn_terminator": lambda s, d: night_ring(positions(s, d).select((F.floor(F.col("ts") / 43_200) * 43_200.0).alias("ts")).distinct(), "ts", 20).select(F.round("ts", 3).alias("ts"), "lon", F.round("lat", 4).alias("lat")),
    "fn_sun_times": lambda s, d: sun_times(sites(s, d).select("site_id", "site_lat", "site_lon", F.lit(1_704_067_200.0).alias("day")), "site_lat", "site_lon", "day").select("site_id", F.round("rise", 1).alias("rise"), F.round("set", 1).alias("set"), "light"),
    "orbit_summary": lambda s, d: orbit_summary(elements(s, d)).select("sat_id", *[F.round(c, 4).alias(c) for c in ("period_min", "apogee_km", "perigee_km")]),
    "orbit_track": lambda s, d: ground_track(elements(s, d), T).select("sat_id", "minute", *[F.round(c, 4).alias(c) for c in ("lat", "lon", "alt_km")], "part", F.round(footprint_km(F.col("alt_km")), 3).alias("footprint_km")),
    "orbit_passes": lambda s, d: passes(elements(s, d), 48.0, 11.0, T).select("sat_id", "rise", "culminate", "set", F.round("max_elevation", 3).alias("max_elevation")),
}
ORACLES = {
    "fn_sun": oracle("positions", "SELECT event_id, round(degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(radians(gha + lon)))), 5) AS elevation, round(degrees(dec), 5) AS declination FROM s", "r AS (SELECT * FROM positions)", *_SUN("ts", "")),
    "orbit_summary": oracle("sites", f"SELECT site_id AS sat_id, round(1440 / m, 4) AS period_min, round(a * (1 + e) - {EQUATOR_KM}, 4) AS apogee_km, round(a * (1 - e) - {EQUATOR_KM}, 4) AS perigee_km FROM (SELECT *, power({MU}::DOUBLE / power(m * 2 * pi() / 86400, 2), 1.0::DOUBLE / 3) AS a FROM (SELECT site_id, 12.0::DOUBLE + site_id % 4 AS m, 0.001::DOUBLE * (site_id % 50) AS e FROM sites))"),
}
