"""Geographic column expressions (degrees in, kilometres or degrees out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
DEGREE_KM = 111.32


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees clockwise from north at the first point, in [0, 360)."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    y, x = F.sin(d - b) * F.cos(c), F.cos(a) * F.sin(c) - F.sin(a) * F.cos(c) * F.cos(d - b)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat, lon, bearing, km) -> tuple[Column, Column]:
    a, b, t, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(bearing)), _c(km) / EARTH_KM
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    over = b + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), wrap_lon(F.degrees(over))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance at DEGREE_KM a degree."""
    a, b, c, d = map(_c, (lat1, lon1, lat2, lon2))
    return DEGREE_KM * F.sqrt(F.pow(c - a, 2) + F.pow((d - b) * F.cos(F.radians((a + c) / 2)), 2))


def wrap_lon(lon) -> Column:
    return F.pmod(_c(lon) + 180, F.lit(360.0)) - 180


def lon_reach(lat, km, cell: float) -> Column:
    """Cells of `cell` degrees to look east and west for all within km."""
    return F.ceil(_c(km) / (DEGREE_KM * F.greatest(F.cos(F.radians(_c(lat))), F.lit(0.1)) * cell)).cast("int")


def turn(a, b) -> Column:
    """The angle between two directions, 0 to 180."""
    d = F.pmod(_c(a) - _c(b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def in_box(lat, lon, box: tuple[float, float, float, float]) -> Column:
    """Inside (south, west, north, east), edges included; not across the antimeridian."""
    s, w, n, e = box
    return _c(lat).between(s, n) & _c(lon).between(w, e)


def in_box_wrapped(lat, lon, box) -> Column:
    """As in_box, but a box whose west exceeds its east spans the antimeridian. box holds numbers or columns."""
    s, w, n, e = map(_c, box)
    return _c(lat).between(s, n) & F.when(w <= e, _c(lon).between(w, e)).otherwise((_c(lon) >= w) | (_c(lon) <= e))


def intersect_boxes(a: tuple, b: tuple) -> tuple:
    """The common part of two boxes; disjoint ones give the degenerate box at 0, 0."""
    s, w, n, e = max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])
    return (s, w, n, e) if s <= n and w <= e else (0.0, 0.0, 0.0, 0.0)


def boxes_overlap(a, b) -> Column:
    """Whether two boxes (south, west, north, east) touch; either may span the antimeridian."""
    (s1, w1, n1, e1), (s2, w2, n2, e2) = (tuple(map(_c, x)) for x in (a, b))
    plain = lambda w, e, v, u: (w <= u) & (v <= e)
    split1 = F.when(w1 <= e1, F.when(w2 <= e2, plain(w1, e1, w2, e2)).otherwise((e1 >= w2) | (w1 <= e2)))
    split2 = F.when(w2 <= e2, (e2 >= w1) | (w2 <= e1)).otherwise(F.lit(True))
    return (s1 <= n2) & (s2 <= n1) & F.coalesce(split1, split2)


def circular_mean(angle) -> Column:
    """Aggregate: mean direction in degrees, null if the vectors cancel or there are none."""
    s, c = F.sum(F.sin(F.radians(_c(angle)))), F.sum(F.cos(F.radians(_c(angle))))
    return F.when((s == 0) & (c == 0), F.lit(None).cast("double")).otherwise(F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))
