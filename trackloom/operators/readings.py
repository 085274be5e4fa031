"""Numbers out of freehand fields: outputs with units, years, and places whose axes are settled by a witness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.sources.standins import oracle, positions, sites, table

#: Years outside these are no years of building.
FIRST_YEAR, LAST_YEAR = 1850, 2100
#: Fixed value: degrees within which an id and its geometry agree.
AGREE = 0.05

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:E[+-]?[0-9]+)?"


def megawatts(value: Column) -> Column:
    """Megawatts of `1200 MW` or `8e8 W`, whatever the case and spaces; null without a unit, or where anything else stands in the field."""
    text = F.replace(F.upper(F.trim(value)), F.lit(" "), F.lit(""))
    whole = rf"^({_NUMBER})(GW|MW|KW|W)$"
    number = F.regexp_extract(text, whole, 1).try_cast("double")
    unit = F.regexp_extract(text, whole, 2)
    scaled = F.when(unit == "GW", number * 1000.0).when(unit == "MW", number).when(unit == "KW", number / 1000.0).when(unit == "W", number / 1_000_000.0)
    return F.when(text.rlike(whole), scaled)


def built_year(value: Column) -> Column:
    """The year that a field begins with, null where it begins otherwise or the year is out of range."""
    year = F.regexp_extract(F.trim(value), r"^([0-9]{4})", 1).try_cast("int")
    return F.when(year.between(FIRST_YEAR, LAST_YEAR), year)


def id_pair(raw: Column) -> Column:
    """The last two numbers of `name;a;b` (the name may hold semicolons and must not be empty) as a struct a, b; null where either is no finite number."""
    whole = r"(?s)^.+;\s*([^;]*?)\s*;\s*([^;]*?)\s*$"
    number = lambda i: F.when(F.upper(F.regexp_extract(raw, whole, i)).rlike(f"^{_NUMBER}$"), F.regexp_extract(raw, whole, i).try_cast("double"))
    a, b = number(1), number(2)
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.when(raw.rlike(whole) & finite, F.struct(a.alias("a"), b.alias("b")))


def settled_place(raw: Column, geom_lon: Column, geom_lat: Column, agree: float = AGREE) -> Column:
    """The place (lat, lon) that an id names, its axes settled by a geometry near it.

    The id's two numbers are taken as longitude and latitude, or the other way where only that agrees with the geometry
    within `agree` degrees on both axes; null where neither does. Without a geometry the first order holds. Null too where
    the place is off the globe.
    """
    pair = id_pair(raw)
    a, b = pair["a"], pair["b"]
    at = lambda lat, lon: (F.abs(lat - geom_lat) <= agree) & (F.abs(lon - geom_lon) <= agree)
    on_globe = lambda lat, lon: F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))
    alone = geom_lon.isNull() | geom_lat.isNull()
    return F.when(alone | at(b, a), on_globe(b, a)).when(at(a, b), on_globe(a, b))


def preferred_place(*pairs: tuple[str, Column, Column]) -> Column:
    """The first of several (source, lat, lon) text pairs with both fields filled, as a struct lat, lon, source; null where that pair is not numeric."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    pick = F.coalesce(*[F.when(filled(y).isNotNull() & filled(x).isNotNull(), F.struct(filled(y).alias("y"), filled(x).alias("x"), F.lit(name).alias("source"))) for name, y, x in pairs])
    lat, lon = pick["y"].try_cast("double"), pick["x"].try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), pick["source"].alias("source")))


def _outputs(s, d):
    p = table(s, d, "part")
    field = F.expr("element_at(array(concat(p_size, ' MW'), concat(' ', p_size, 'gw '), concat(p_size, '000 kW'), concat(p_size, '00 000 000 W'), concat(p_size, ' horses'), cast(p_size as string), concat(p_size, ' MW; 3 MW'), null), cast(p_partkey % 8 + 1 as int))")
    year = F.expr("element_at(array(cast(1800 + p_size * 5 as string), concat(' ', 1800 + p_size * 5, '-05'), concat('circa ', 1800 + p_size), concat(1800 + p_size * 5, '00'), ''), cast(p_partkey % 5 + 1 as int))")
    return p.select("p_partkey", megawatts(field).alias("mw"), built_year(year).alias("year"))


def _settled(s, d):
    p = positions(s, d)
    raw = F.expr("case event_id % 5 when 0 then concat('scene;7;', lat, ';', lon) when 4 then concat(lon, ';', lat) else concat('scene;', lon, ';', lat) end")
    geometry = lambda c: F.expr(f"case when event_id % 5 = 1 then null when event_id % 5 = 2 then {c} + 0.2D else {c} + 0.01D end")
    return p.select("event_id", settled_place(raw, geometry("lon"), geometry("lat")).alias("at")).select("event_id", "at.lat", "at.lon")


def _preferred(s, d):
    own = lambda c: F.when(F.col("site_id") % 3 == 0, F.lit(" ")).when(F.col("site_id") % 7 == 0, F.lit("n/a")).otherwise(F.col(c).cast("string"))
    other = lambda c: F.when(F.col("site_id") % 2 == 0, (F.col(c) + 1).cast("string"))
    return sites(s, d).select("site_id", preferred_place(("own", own("site_lat"), own("site_lon")), ("snapped", other("site_lat"), other("site_lon"))).alias("at")).select("site_id", "at.*")


QUERIES = {"fn_outputs": _outputs, "fn_settled_place": _settled, "fn_preferred_place": _preferred}
ORACLES = {
    "fn_outputs": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN p_size::DOUBLE WHEN 3 THEN p_size * 100.0::DOUBLE END AS mw,
        CASE WHEN p_partkey % 5 IN (0, 1, 3) AND 1800 + p_size * 5 BETWEEN 1850 AND 2100 THEN CAST(1800 + p_size * 5 AS INT) END AS year FROM part""",
    "fn_settled_place": oracle("positions", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 3) THEN lat END AS lat, CASE WHEN event_id % 5 IN (0, 1, 3) THEN lon END AS lon FROM positions"),
    "fn_preferred_place": oracle(
        "sites", """SELECT site_id, CASE k WHEN 1 THEN site_lat WHEN 2 THEN site_lat + 1 END AS lat, CASE k WHEN 1 THEN site_lon WHEN 2 THEN site_lon + 1 END AS lon, CASE k WHEN 1 THEN 'own' WHEN 2 THEN 'snapped' END AS source
        FROM (SELECT *, CASE WHEN site_id % 3 <> 0 AND site_id % 7 <> 0 THEN 1 WHEN site_id % 6 = 0 THEN 2 END AS k FROM sites)""",
    ),
}
