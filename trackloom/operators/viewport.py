"""Rows kept in the order of a space-filling curve, so that a view opens only the folders, row groups and pages it needs.

A place has a key: the bits of its latitude and longitude in turn, BITS of each. Files are written by ranges of the key and
sorted by it, in folders by its leading bits. A view is turned into at most MOST key ranges that cover it; Spark prunes the
folders by them and Parquet its row groups and pages. The exact test follows, so the ranges never decide a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import in_box_wrapped
from trackloom.operators.predicates import PACIFIC, REGION
from trackloom.session import fresh_path
from trackloom.sources.standins import oracle, positions

#: Bits of each coordinate in a key: cells of 0.0028 by 0.0055 degrees.
BITS = 16
#: Bits of each coordinate in a folder's name: at most 256 folders.
ZONE_BITS = 4
#: Most ranges of a view.
MOST = 32


def _step(value, low: float, span: float):
    """Which of 2^BITS steps a coordinate lies in; what is outside its range goes to the nearest."""
    return F.least(F.greatest(F.floor((value - low) / span * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def _apart(v: Column) -> Column:
    """Bits of a number moved to every other place."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def curve_key(lat: Column, lon: Column) -> Column:
    """The key of a place, null where a coordinate is null or NaN."""
    placed = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return F.when(placed, F.shiftleft(_apart(_step(lat, -90.0, 180.0)), 1).bitwiseOR(_apart(_step(lon, -180.0, 360.0))))


def write_layout(df: DataFrame, path: str, tie: str, files: int, lat: str = "lat", lon: str = "lon") -> None:
    """Write df for views, in about `files` files: columns of df, curve_key and curve_zone.

    Places that many rows share are split by `tie`, a column that tells rows apart. Rows without a place are kept in a
    folder of their own; no view opens it. df must have no columns curve_key and curve_zone.
    """
    taken = {"curve_key", "curve_zone"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the layout's own")
    keyed = df.withColumn("curve_key", curve_key(F.col(lat).cast("double"), F.col(lon).cast("double")))
    keyed = keyed.withColumn("curve_zone", F.shiftright("curve_key", 2 * (BITS - ZONE_BITS)).cast("int"))
    keyed.repartitionByRange(files, "curve_key", tie).sortWithinPartitions("curve_zone", "curve_key").write.partitionBy("curve_zone").mode("overwrite").parquet(path)


def _cells(box: tuple) -> tuple[int, int, int, int]:
    """South, west, north and east of a box in steps; a step more on each side stands for rounding."""
    at = lambda v, low, span, more: min(max(int((v - low) / span * (1 << BITS)) + more, 0), (1 << BITS) - 1)
    south, west, north, east = box
    return at(south, -90.0, 180.0, -1), at(west, -180.0, 360.0, -1), at(north, -90.0, 180.0, 1), at(east, -180.0, 360.0, 1)


def key_ranges(box: tuple, most: int = MOST) -> list[tuple[int, int]]:
    """Ranges of keys (first and last), sorted and apart, that cover a box (south, west, north, east), west > east spanning the antimeridian.

    Squares on the border are quartered, level by level, while there are few; the narrowest gaps are closed until `most` ranges are left.
    """
    south, west, north, east = box
    if south > north:
        return []
    boxes = [_cells(box)] if west <= east else [_cells((south, west, north, 180.0)), _cells((south, -180.0, north, east))]

    def meets(y, x, size):
        return any(y <= n and y + size > s and x <= e and x + size > w for s, w, n, e in boxes)

    def within(y, x, size):
        return any(y >= s and y + size - 1 <= n and x >= w and x + size - 1 <= e for s, w, n, e in boxes)

    def parts(square):
        key, y, x, size = square
        half = size // 2
        found = [(key + i * half * half, y + (i >> 1) * half, x + (i & 1) * half, half) for i in range(4)]
        return [q for q in found if meets(*q[1:])]

    whole, border = [], [(0, 0, 0, 1 << BITS)]
    while border:
        split = [p for square in border for p in parts(square)] if border[0][3] > 1 else []
        inner = [p for p in split if within(*p[1:])]
        outer = [p for p in split if not within(*p[1:])]
        if not split or len(whole) + len(split) > 4 * most:
            break
        whole, border = whole + inner, outer
    spans = sorted((key, key + size * size - 1) for key, _, _, size in whole + border)
    joined: list[tuple[int, int]] = []
    for first, last in spans:
        if joined and first <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], last)
        else:
            joined.append((first, last))
    while len(joined) > most:  # close the narrowest gap
        i = min(range(1, len(joined)), key=lambda i: joined[i][0] - joined[i - 1][1])
        joined[i - 1 : i + 1] = [(joined[i - 1][0], joined[i][1])]
    return joined


def in_view(layout: DataFrame, box: tuple, lat: str = "lat", lon: str = "lon", most: int = MOST) -> DataFrame:
    """Rows of a layout in a box, edges included, without the layout's columns; the same rows as the plain test gives; NaN is in no view."""
    ranges = key_ranges(box, most)
    shift = 2 * (BITS - ZONE_BITS)
    zones = sorted({z for first, last in ranges for z in range(first >> shift, (last >> shift) + 1)})
    near = F.lit(False)
    for first, last in ranges:
        near = near | F.col("curve_key").between(first, last)
    return layout.where(F.col("curve_zone").isin(zones) & near & in_box_wrapped(lat, lon, box)).drop("curve_key", "curve_zone")


def feed(layout: DataFrame, box: tuple, most: int, newest: str, tie: str) -> DataFrame:
    """A region's feed: its `most` newest rows (ties by the smaller `tie`, unknown times last), their place, and whether the cap cut it.

    One row more than `most` is taken to know; the windows are over those rows alone.
    """
    order = (F.desc_nulls_last(newest), F.asc(tie))
    top = in_view(layout, box).orderBy(*order).limit(most + 1)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("capped", F.count("*").over(Window.partitionBy()) > most)
    return placed.where(F.col("place") <= most)


def _laid_out(s: SparkSession, d: str) -> DataFrame:
    path = fresh_path(s, "viewport")
    write_layout(positions(s, d).select("event_id", "entity_id", "ts", "lat", "lon"), path, "event_id", int(s.conf.get("spark.sql.shuffle.partitions")))
    return s.read.parquet(path)


def _latest_laid_out(s: SparkSession, d: str) -> DataFrame:
    last = positions(s, d).groupBy("entity_id").agg(F.max_by(F.struct("event_id", "ts", "lat", "lon"), F.struct("ts", "event_id")).alias("r")).select("entity_id", "r.*")
    path = fresh_path(s, "viewport")
    write_layout(last, path, "entity_id", int(s.conf.get("spark.sql.shuffle.partitions")))
    return s.read.parquet(path)


CAP = 100
QUERIES = {
    "view_box": lambda s, d: in_view(_laid_out(s, d), REGION),
    "view_wrapped": lambda s, d: in_view(_laid_out(s, d), PACIFIC),
    "view_feed": lambda s, d: feed(_latest_laid_out(s, d), REGION, CAP, "ts", "entity_id"),
}
_P = "SELECT event_id, entity_id, ts, lat, lon FROM positions WHERE"
_R = f"lat BETWEEN {REGION[0]} AND {REGION[2]} AND lon BETWEEN {REGION[1]} AND {REGION[3]}"
ORACLES = {
    "view_box": oracle("positions", f"{_P} {_R}"),
    "view_wrapped": oracle("positions", f"{_P} lat BETWEEN -50 AND 50 AND (lon >= 150 OR lon <= -120)"),
    "view_feed": oracle(
        "positions", f"SELECT CAST(row_number() OVER (ORDER BY ts DESC, entity_id) AS INT) AS place, entity_id, event_id, ts, lat, lon, count(*) OVER () > {CAP} AS capped FROM l WHERE {_R} QUALIFY place <= {CAP}",
        "l AS (SELECT * FROM positions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)",
    ),
}
