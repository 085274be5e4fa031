"""Filters and gates: boxes, wildcards, priority flags, lags, cutoffs, screens, policies and text filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import boxes_overlap, in_box, in_box_wrapped, intersect_boxes
from trackloom.sources.standins import oracle, positions, reports, sites, table

REGION = (-20.0, -100.0, 40.0, 60.0)
VIEW = (0.0, -170.0, 70.0, 20.0)
PACIFIC = (-50.0, 150.0, 50.0, -120.0)


def wildcard(value: Column, query: str) -> Column:
    """Upper-cased, trimmed match: no * means starts-with, else * stands for anything. An empty query matches all, an empty value nothing."""
    q = query.strip().upper()
    if not q:
        return F.lit(True)
    v = F.upper(F.trim(value))
    has = F.coalesce(v != "", F.lit(False))
    if "*" not in q:
        return has & v.startswith(q)
    like = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return has & v.like(like)


def any_flag(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def allowed(value: Column, names: set[str]) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(sorted(names)), F.lit(False))


def newest_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """Rows of the n newest distinct periods. The periods are a small aggregate, joined back."""
    top = df.select(period).where(F.col(period).isNotNull()).distinct().orderBy(F.desc(period)).limit(n)
    return df.join(F.broadcast(top), period, "left_semi")


def within_lag(added: Column, occurred: Column, days: int) -> Column:
    """Whether a report came at most `days` whole days (floored) after the event; unknown dates pass."""
    return F.coalesce(F.floor((added - occurred) / 86_400) <= days, F.lit(True))


def before_cutoff(ts: Column, cutoff: float) -> Column:
    return ts.isNull() | (ts <= cutoff)


def failures(**tests: Column) -> Column:
    """The names of the tests that fail, as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))


def collapse_imprecise(df: DataFrame, imprecise: Column) -> DataFrame:
    """Imprecise rows of an actor and day become one: the most severe, with a count and the most mentions; others pass."""
    rough = df.where(imprecise).groupBy("actor", "day").agg(
        F.max_by("report_id", F.struct("severity", -F.col("report_id"))).alias("report_id"), F.max("severity").alias("severity"), F.max("mentions").alias("mentions"), F.count("*").alias("merged")
    )
    return df.where(~imprecise).select("actor", "day", "report_id", "severity", "mentions", F.lit(1).cast("long").alias("merged")).unionByName(rough)


def gate(df: DataFrame, now_year: int) -> DataFrame:
    """Headlines that name a struck word or a figure, are not too old by a year in the text, and have a source on the list."""
    years = F.transform(F.regexp_extract_all("text", F.lit(r"(?<!\w)(19\d\d|20\d\d)(?!\w)")), lambda y: y.cast("int"))
    fresh = ~F.exists(years, lambda y: F.lit(now_year) - y >= 5)
    words = F.col("text").rlike(r"(?i)(?<!\w)(the|und|les|los)(?!\w)")
    return df.where(words & fresh & F.col("source").isin("src1", "src2", "src3") & (F.length("text") > 40))


def officials(df: DataFrame) -> DataFrame:
    """Three-way country test: true, false or unknown; unknown passes only with many mentions."""
    a, b = F.expr("nullif(actor % 7, 0)"), F.expr("nullif(mentions % 4, 0)")
    cross = F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a != b)
    keep = F.when(cross.isNull(), F.col("mentions") >= 5).otherwise(cross)
    return df.where(keep).select("report_id", cross.alias("cross_border"))


def any_field(df: DataFrame, fields: list[str], query: str) -> DataFrame:
    q = query.lower()
    return df.where(F.exists(F.array(*[F.lower(F.col(f).cast("string")) for f in fields]), lambda x: F.contains(x, F.lit(q))))


def payload_number(payload: Column, path: str) -> Column:
    """A numeric field of a JSON payload, null where it is no number."""
    text = F.get_json_object(payload, f"$.{path}")
    return F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))


def capped_kinds(df: DataFrame, by: str, caps: dict[str, int]) -> DataFrame:
    """Kinds whose count reached the cap they are fetched with, so their layer is partial."""
    dim = df.sparkSession.createDataFrame(sorted(caps.items()), f"{by} string, cap int")
    return df.groupBy(by).agg(F.count("*").alias("n")).join(F.broadcast(dim), by, "left").select(by, "n", F.coalesce(F.col("n") >= F.col("cap"), F.lit(False)).alias("partial"))


#: The precisions that place a report no better than an area.
IMPRECISE = ("country", "region", "unknown")


def event_filter(df: DataFrame, today: int, max_age: int | None = 2, least: int = 0, imprecise: bool = False, sure: float = 0.0) -> DataFrame:
    """The reader's event filter: precision, severity and age in whole days; rows of no known day pass. `dimmed` marks doubtful placements.

    df: severity, precision, day, confidence. A null severity is 0; rows without a confidence are never dimmed.
    """
    keep = F.coalesce(F.col("severity"), F.lit(0)) >= least
    if not imprecise:
        keep = keep & ~F.coalesce(F.col("precision").isin(*IMPRECISE), F.lit(False))
    if max_age is not None:
        keep = keep & F.coalesce(F.greatest(F.lit(today) - F.col("day"), F.lit(0)) <= max_age, F.lit(True))
    return df.where(keep).withColumn("dimmed", F.coalesce(F.col("confidence") < sure, F.lit(False)) if sure > 0 else F.lit(False))


def grid_view(cells: DataFrame, least: int, box: tuple | None = None) -> DataFrame:
    """Stored grid cells (lat, lon, transits, sum_sin, sum_cos) with `least` transits or more, in a view; the mean course is null where the vectors cancel."""
    seen = cells.where(F.col("transits") >= least)
    if box:
        seen = seen.where(in_box("lat", "lon", box))
    flat = (F.col("sum_sin") == 0) & (F.col("sum_cos") == 0)
    return seen.withColumn("course", F.when(~flat, F.pmod(F.degrees(F.atan2("sum_sin", "sum_cos")), F.lit(360.0))))


def _gridded(s, d):
    from trackloom.operators.aggregates import lane_cells

    return lane_cells(positions(s, d), 0.5).drop("course").withColumn("lat", F.col("cy") * 0.5 + 0.25).withColumn("lon", F.col("cx") * 0.5 + 0.25)


_BOX = intersect_boxes(REGION, VIEW)
QUERIES = {
    "filter_box": lambda s, d: positions(s, d).where(in_box("lat", "lon", _BOX)).select("event_id", "lat", "lon"),
    "filter_box_wrapped": lambda s, d: positions(s, d).where(in_box_wrapped("lat", "lon", PACIFIC)).select("event_id", "lat", "lon"),
    "filter_box_overlap": lambda s, d: sites(s, d).where(boxes_overlap((F.col("site_lat") - 5, F.col("site_lon") - 9, F.col("site_lat") + 5, F.col("site_lon") + 9), PACIFIC)).select("site_id"),
    "filter_wildcard": lambda s, d: table(s, d, "part").where(wildcard(F.col("p_name"), " re* ring")).select("p_partkey", "p_name"),
    "filter_prefix": lambda s, d: table(s, d, "part").where(wildcard(F.col("p_name"), "small")).select("p_partkey", "p_name"),
    "filter_priority": lambda s, d: positions(s, d).where(any_flag(F.col("on_ground"), F.col("speed") > 115, F.col("kind") == "error")).select("event_id"),
    "filter_allow_list": lambda s, d: reports(s, d).where(allowed(F.concat(F.lit(" "), F.col("category")), {"1-urgent", "2-high"})).select("report_id"),
    "filter_newest_months": lambda s, d: newest_periods(reports(s, d).withColumn("month", F.floor(F.col("day") / 30)), "month", 3).select("report_id", "month"),
    "filter_event_gate": lambda s, d: gate(table(s, d, "documents"), 2026).select("doc_id", "source"),
    "filter_officials": lambda s, d: officials(reports(s, d)),
    "filter_lag": lambda s, d: positions(s, d).where(within_lag(F.col("ts") + F.col("value") * 86_400, F.when(F.col("on_ground").isNotNull(), F.col("ts")), 30)).select("event_id"),
    "filter_cutoff": lambda s, d: positions(s, d).where(before_cutoff(F.when(F.col("on_ground").isNotNull(), F.col("ts")), 1_705_000_000.0)).select("event_id"),
    "filter_screen": lambda s, d: reports(s, d).where("status <> 'F'").withColumn("why", F.concat_ws(",", failures(reach=F.col("mentions") >= 2, weight=F.col("severity") > 50_000, place=F.abs(F.col("lat")) < 45))).where("why <> ''").select("report_id", "why"),
    "filter_precision_policy": lambda s, d: collapse_imprecise(reports(s, d), F.col("status") == "P"),
    "filter_any_field": lambda s, d: any_field(table(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"], "Eco"),
    "filter_payload": lambda s, d: table(s, d, "events").withColumn("k", payload_number(F.col("props"), "k")).where("k >= 50").select("event_id", "k"),
    "filter_events": lambda s, d: event_filter(
        reports(s, d).selectExpr("report_id", "if(mentions = 0, null, mentions * 10) as severity", "element_at(array('country', 'locality', null, 'unknown', 'capital'), cast(actor % 5 + 1 as int)) as precision", "if(report_id % 7 = 0, null, day) as day", "if(report_id % 3 = 0, null, cast(actor % 100 as double)) as confidence"),
        10_000, 400, 20, sure=55.0).select("report_id", "dimmed"),
    "filter_grid_view": lambda s, d: grid_view(_gridded(s, d), 2, REGION).select("cy", "cx", "transits", F.round("course", 4).alias("course")),
    "filter_capped": lambda s, d: capped_kinds(positions(s, d), "kind", {"view": 100, "click": 100_000_000}),
    "filter_latest_scan": lambda s, d: positions(s, d).where("kind = 'view'").groupBy("entity_id").agg(F.max("ts").alias("last_ts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
    "filter_clips": lambda s, d: positions(s, d).where((F.col("ts") > 1_705_000_000.0) & (in_box("lat", "lon", REGION) | in_box("lat", "lon", (40.0, 60.0, 60.0, 120.0))) & F.col("kind").isin("view", "click")).select("event_id"),
}

_in = lambda b: f"lat BETWEEN {b[0]} AND {b[2]} AND lon BETWEEN {b[1]} AND {b[3]}"
ORACLES = {
    "filter_box": oracle("positions", f"SELECT event_id, lat, lon FROM positions WHERE {_in(_BOX)}"),
    "filter_box_wrapped": oracle("positions", "SELECT event_id, lat, lon FROM positions WHERE lat BETWEEN -50 AND 50 AND (lon >= 150 OR lon <= -120)"),
    "filter_box_overlap": oracle("sites", "SELECT site_id FROM sites WHERE site_lat - 5 <= 50 AND site_lat + 5 >= -50 AND (site_lon + 9 >= 150 OR site_lon - 9 <= -120)"),
    "filter_wildcard": "SELECT p_partkey, p_name FROM part WHERE upper(p_name) LIKE 'RE% RING'",
    "filter_prefix": "SELECT p_partkey, p_name FROM part WHERE starts_with(upper(p_name), 'SMALL')",
    "filter_priority": oracle("positions", "SELECT event_id FROM positions WHERE coalesce(on_ground, false) OR speed > 115 OR kind = 'error'"),
    "filter_allow_list": oracle("reports", "SELECT report_id FROM reports WHERE lower(category) IN ('1-urgent', '2-high')"),
    "filter_newest_months": oracle("reports", "SELECT report_id, CAST(floor(day / 30) AS BIGINT) AS month FROM reports WHERE floor(day / 30) >= (SELECT min(m) FROM (SELECT DISTINCT floor(day / 30) AS m FROM reports ORDER BY m DESC LIMIT 3))"),
    "filter_event_gate": r"""SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)\b(the|und|les|los)\b') AND source IN ('src1', 'src2', 'src3') AND length(text) > 40
        AND len(list_filter(regexp_extract_all(text, '\b(19\d\d|20\d\d)\b'), lambda y: 2026 - CAST(y AS INT) >= 5)) = 0""",
    "filter_officials": oracle("reports", "SELECT report_id, cross_border FROM (SELECT *, CASE WHEN nullif(actor % 7, 0) IS NOT NULL AND nullif(mentions % 4, 0) IS NOT NULL THEN actor % 7 <> mentions % 4 END AS cross_border FROM reports) WHERE coalesce(cross_border, mentions >= 5)"),
    "filter_lag": oracle("positions", "SELECT event_id FROM positions WHERE on_ground IS NULL OR floor(((ts + value * 86400) - ts) / 86400) <= 30"),
    "filter_cutoff": oracle("positions", "SELECT event_id FROM positions WHERE on_ground IS NULL OR ts <= 1705000000.0"),
    "filter_screen": oracle("reports", "SELECT report_id, why FROM (SELECT report_id, concat_ws(',', CASE WHEN NOT mentions >= 2 THEN 'reach' END, CASE WHEN NOT severity > 50000 THEN 'weight' END, CASE WHEN NOT abs(lat) < 45 THEN 'place' END) AS why FROM reports WHERE status <> 'F') WHERE why <> ''"),
    "filter_precision_policy": oracle("reports", "SELECT actor, day, report_id, severity, mentions, 1 AS merged FROM reports WHERE status <> 'P' UNION ALL SELECT actor, day, arg_max(report_id, {'s': severity, 'r': -report_id}), max(severity), max(mentions), count(*) FROM reports WHERE status = 'P' GROUP BY ALL"),
    "filter_any_field": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_brand), 'eco') OR contains(lower(p_type), 'eco')",
    "filter_payload": "SELECT event_id, CAST(props ->> 'k' AS DOUBLE) AS k FROM events WHERE TRY_CAST(props ->> 'k' AS DOUBLE) >= 50",
    "filter_events": oracle("reports", "SELECT report_id, report_id % 3 <> 0 AND actor % 100 < 55 AS dimmed FROM reports WHERE mentions >= 2 AND actor % 5 IN (1, 2, 4) AND (report_id % 7 = 0 OR greatest(10000 - day, 0) <= 400)"),
    "filter_grid_view": oracle(
        "positions", f"SELECT cy, cx, transits, round(CASE WHEN s <> 0 OR c <> 0 THEN ((degrees(atan2(s, c)) % 360) + 360) % 360 END, 4) AS course FROM g WHERE transits >= 2 AND {_in(REGION).replace('lat', '(cy * 0.5 + 0.25)').replace('lon', '(cx * 0.5 + 0.25)')}",
        "g AS (SELECT CAST(floor(lat / 0.5 + 1e-9) AS BIGINT) AS cy, CAST(floor(lon / 0.5 + 1e-9) AS BIGINT) AS cx, count(DISTINCT entity_id) AS transits, round(sum(sin(radians(course))) FILTER (course < 360), 6) AS s, round(sum(cos(radians(course))) FILTER (course < 360), 6) AS c FROM positions GROUP BY ALL)",
    ),
    "filter_capped": oracle("positions", "SELECT kind, count(*) AS n, kind = 'view' AND count(*) >= 100 AS partial FROM positions GROUP BY 1"),
    "filter_latest_scan": oracle("positions", "SELECT entity_id, max(ts) AS last_ts, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM positions WHERE kind = 'view' GROUP BY 1"),
    "filter_clips": oracle("positions", f"SELECT event_id FROM positions WHERE ts > 1705000000.0 AND (({_in(REGION)}) OR ({_in((40.0, 60.0, 60.0, 120.0))})) AND kind IN ('view', 'click')"),
}
