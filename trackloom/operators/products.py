"""Composite products: documents built from several operators, as a user of the engine asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import in_box
from trackloom.operators.aggregates import LEAST_DRAUGHTS, T0, draught_profile, mix
from trackloom.operators.dedupe import REC, incident_clusters
from trackloom.operators.joins import BOXES, NOW, PAIR_KM, box_labels, first_box, look_back, nearest_attached, stationary_pairs, vessels
from trackloom.operators.labels import implied_trade
from trackloom.operators.monitor import layer_status
from trackloom.operators.windows import classify_steps, position_gaps, state_at
from trackloom.sources.standins import km_sql, oracle, positions, reports, sites
from trackloom.streaming.sessions import REACH_KM, flight_legs, port_calls

HOURS = 3_600.0


def gap_document(log: DataFrame, places: DataFrame, least_h: float = 4.0, most_h: float = 36.0, cap: int = 120) -> DataFrame:
    """Silences of least_h to most_h hours with both ends in watched boxes, each with the speed habits before it; the longest `cap`."""
    inside = lambda y, x: F.coalesce(*[F.when(in_box(y, x, b), F.lit(True)) for b in BOXES.values()], F.lit(False))
    gaps = position_gaps(log, least_h * HOURS).where(F.col("gap_seconds") <= most_h * HOURS).where(inside("from_lat", "from_lon") & inside("to_lat", "to_lon"))
    start = log.select(F.col("event_id").alias("from_event"), F.col("ts").alias("before"))
    targets = gaps.join(start, "from_event").select(F.col("to_event").alias("target"), "entity_id", "before")
    speeds = look_back(targets, log, 5 * 86_400.0).select(F.col("target").alias("to_event"), F.col("n").alias("samples"), "p95")
    return gaps.join(speeds, "to_event").orderBy(F.desc("gap_seconds"), "to_event").limit(cap).select("entity_id", "from_event", "to_event", "gap_seconds", "samples", "p95")


def fused_events(df: DataFrame) -> DataFrame:
    """One record a cluster of reports: most severe member, totals and how many sources agree."""
    members = df.join(incident_clusters(df), "report_id")
    key = F.struct(F.expr("case status when 'F' then 0 when 'O' then 1 else 2 end"), F.col("report_id"))
    return members.groupBy("cluster").agg(
        F.min_by("report_id", key).alias("primary_id"), F.round(F.max("severity"), 4).alias("severity"), F.max("mentions").alias("mentions"), F.countDistinct("status").alias("sources"), F.count("*").alias("n")
    )


def region_feed(log: DataFrame, at: float, window: float, cap: int) -> DataFrame:
    """Latest state, labelled with its region, the newest `cap`."""
    return first_box(state_at(log, at, window), BOXES).where("box is not null").orderBy(F.desc("ts"), "entity_id").limit(cap).select("entity_id", "event_id", "ts", "box")


def port_call_document(log: DataFrame, places: DataFrame) -> DataFrame:
    """Port calls by the nearest place within reach of where each dwell began: exact, proximity or inferred; dwells without one are dropped."""
    return port_calls(nearest_attached(log, places, REACH_KM))


def flight_leg_document(log: DataFrame, fields: DataFrame, km: float = 40.0) -> DataFrame:
    """Flight legs with the airfields (place_id, place_lat, place_lon) nearest to their ends."""
    near = nearest_attached(log, fields, km, "f").withColumn("field", F.col("f_id").cast("string")).withColumnRenamed("f_km", "field_km")
    return flight_legs(near)


def healthy(gaps: DataFrame, health: DataFrame, share: float = 0.5, least: int = 3) -> DataFrame:
    """Gaps (from_ts, to_ts) during which the feed itself worked: no failed poll, and no count under `share` of the usual one.

    health: ts, items, ok. The usual count is the median of the good polls' positive counts, unknown with under `least` of
    them, and then only failed polls count. Where it is known, a gap without a poll in it is dropped. Polls and gaps meet by hour.
    """
    usual = health.agg(F.count_if(F.col("ok") & (F.col("items") > 0)).alias("k"), F.median(F.when(F.col("ok") & (F.col("items") > 0), F.col("items"))).alias("m")).select(F.when(F.col("k") >= least, F.col("m")).alias("usual"))
    hour = lambda c: F.floor(c / HOURS).cast("long")
    spread = gaps.withColumn("_h", F.explode(F.sequence(hour(F.col("from_ts")), hour(F.col("to_ts")))))
    polls = health.select(F.col("ts").alias("_ts"), "items", "ok", hour(F.col("ts")).alias("_h"))
    hit = spread.join(polls, "_h").where("_ts between from_ts and to_ts").groupBy("to_event").agg(F.count_if(~F.col("ok")).alias("bad"), F.min("items").alias("low"), F.count("*").alias("polls"))
    judged = gaps.join(hit, "to_event", "left").join(F.broadcast(usual))
    fine = F.when(F.coalesce("bad", F.lit(0)) > 0, False).when(F.col("usual").isNull(), True).otherwise(F.coalesce(F.col("low") >= F.col("usual") * share, F.lit(False)))
    return judged.where(fine).select(*gaps.columns)


def dark_vessel_document(log: DataFrame, latest: DataFrame, health: DataFrame, places: DataFrame, now: float, pair_km: float = 0.5, least_h: float = 4.0, most_h: float = 36.0, caps: tuple[int, int] = (120, 80)) -> DataFrame:
    """Gaps that the feed's own health doesn't explain, and vessels lying alongside each other: rows kind, id, other, hours, lat, lon."""
    inside = lambda y, x: F.coalesce(*[F.when(in_box(y, x, b), F.lit(True)) for b in BOXES.values()], F.lit(False))
    start = log.select(F.col("event_id").alias("from_event"), F.col("ts").alias("from_ts"))
    gaps = position_gaps(log, least_h * HOURS).where(F.col("gap_seconds") <= most_h * HOURS).where(inside("from_lat", "from_lon") & inside("to_lat", "to_lon")).join(start, "from_event")
    gaps = healthy(gaps.withColumn("to_ts", F.col("from_ts") + F.col("gap_seconds")), health)
    worst = gaps.orderBy(F.desc("gap_seconds"), "to_event").limit(caps[0]).select(F.lit("gap").alias("kind"), F.col("entity_id").alias("id"), F.col("to_event").alias("other"), F.bround(F.col("gap_seconds") / HOURS, 1).alias("hours"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon"))
    pairs = stationary_pairs(latest, places, now, pair_km, cap=caps[1]).select(F.lit("pair").alias("kind"), F.col("a_id").alias("id"), F.col("b_id").alias("other"), F.col("together_hours").alias("hours"), "lat", "lon")
    return worst.unionByName(pairs).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


def escalation_document(events: DataFrame, polls: DataFrame, boxes: dict[str, tuple], now: int, baseline_days: int = 7, least: int = 3, ratio: float = 1.5, least_polls: int = 24, covered: float = 1.5) -> DataFrame:
    """Regions where the last day stands out against the days before, with the worst events; none at all where our own polls were too few.

    events: report_id, lat, lon, day, severity. ratio is (current + 1) / (baseline a day + 1), the baseline being the days
    before the last one; a region whose oldest event is younger than `covered` days is left out.
    """
    enough = polls.agg((F.count_if((F.col("day") > now - 1) & (F.col("day") <= now) & F.col("ok")) >= least_polls).alias("enough"))
    rows = box_labels(events.where((F.col("day") <= now) & (F.col("day") > now - baseline_days)), boxes)
    current = F.col("day") > now - 1
    top = F.max_by("report_id", F.when(current, F.struct("severity", -F.col("report_id"))))
    g = rows.groupBy("box").agg(F.count_if(current).alias("current"), F.count_if(~current).alias("before"), F.sum(F.when(current, F.col("severity")).otherwise(0)).cast("long").alias("severity_sum"), F.min("day").alias("oldest"), top.alias("worst"))
    days = baseline_days - 1
    scored = g.withColumn("raw", (F.col("current") + 1) / (F.col("before") / days + 1)).where((F.col("current") >= least) & (F.col("raw") >= ratio) & (now - F.col("oldest") >= covered))
    return scored.join(F.broadcast(enough)).where("enough").select("box", "current", F.bround(F.col("before") / days, 2).alias("per_day"), F.bround("raw", 2).alias("ratio"), "severity_sum", "worst")


def field_activity(log: DataFrame, top: int) -> DataFrame:
    """The busiest places (and the busiest by ground traffic) with distinct entities, grounded ones, 24 hourly counts and the three commonest types.

    log: place_id, entity_id, ts, on_ground, kind. Everything comes from one grouping by place, hour and kind sets.
    """
    hour = F.pmod(F.floor(F.col("ts") / HOURS), F.lit(24)).cast("int")
    totals = log.groupBy("place_id").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct(F.when(F.col("on_ground"), F.col("entity_id"))).alias("grounded"))
    pick = totals.orderBy(F.desc("entities"), "place_id").limit(top).select("place_id").unionByName(totals.orderBy(F.desc("grounded"), "place_id").limit(top).select("place_id")).distinct()
    chosen = log.join(F.broadcast(pick), "place_id", "left_semi")
    hours = chosen.groupBy("place_id", hour.alias("h")).agg(F.countDistinct("entity_id").alias("n")).groupBy("place_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("string"))
    kinds = chosen.groupBy("place_id", "kind").agg(F.countDistinct("entity_id").alias("n")).groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "kind"))).alias("k"))
    common = F.array_join(F.transform(F.slice("k", 1, 3), lambda x: x["kind"]), ",")
    return pick.join(totals, "place_id").join(hours, "place_id").join(kinds, "place_id").select("place_id", "entities", "grounded", F.array_join(dense, ",").alias("hours"), common.alias("types"))


def interference_document(steps: DataFrame, cells: DataFrame, least: int = 2, share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Watched cells and the aircraft in them, from classified steps (entity_id, event_id, cell, flagged): two roll-ups of one table.

    A cell is interference, clean or no_traffic; an aircraft flagged, clean (with `least` samples) or insufficient.
    """
    seen = steps.join(cells.select("cell"), "cell", "left_semi").groupBy("cell", "entity_id").agg(F.count("*").alias("samples"), F.count_if("flagged").alias("flags"))
    per_cell = seen.groupBy("cell").agg(F.count("*").alias("observed"), F.count_if(F.col("flags") > 0).alias("bad"))
    status = F.when(F.col("observed").isNull(), "no_traffic").when(F.col("bad") / F.col("observed") >= share, "interference").otherwise("clean")
    by_cell = cells.join(per_cell, "cell", "left").select("cell", F.coalesce("observed", F.lit(0)).alias("observed"), F.coalesce("bad", F.lit(0)).alias("flagged"), status.alias("status"))
    craft = seen.groupBy("entity_id").agg(F.sum("samples").alias("samples"), F.sum("flags").alias("flags"), F.count("*").alias("cells"))
    return by_cell, craft.withColumn("status", F.when(F.col("flags") > 0, "flagged").when(F.col("samples") >= least, "clean").otherwise("insufficient"))


def profile_document(log: DataFrame, calls: DataFrame) -> DataFrame:
    """Each vessel's draught profile with its last port call and a sentence that says what they imply and what they don't.

    reason tells vessels of too few samples from those between the ratios; both are unknown.
    """
    last = calls.groupBy("entity_id").agg(F.max_by("place_id", F.struct("arrived_at", "place_id")).alias("last_place"), F.max("arrived_at").alias("last_call"))
    j = draught_profile(log).join(last, "entity_id", "left")
    j = j.withColumn("reason", F.when(F.col("samples") < LEAST_DRAUGHTS, "insufficient_samples"))
    return j.withColumn("sentence", implied_trade(F.lit(None).cast("string"), F.col("last_place").cast("string"), F.lit(None).cast("string")))


def feed(df: DataFrame, key: str, order: list, box: tuple | None = None, cap: int | None = None) -> DataFrame:
    """A region's feed: rows in the box in a given order; only the world view (no box) is capped."""
    out = df.where(in_box("lat", "lon", box)) if box else df
    return out if box or cap is None else out.orderBy(*order, key).limit(cap)


def export_document(log: DataFrame, chosen: list[str], box: tuple, now: float, stale: float) -> DataFrame:
    """What an export holds of each layer: its status, and the exported rows as features."""
    status = layer_status(log, box, now, stale)
    wanted = log.sparkSession.createDataFrame([(k,) for k in chosen], "kind string")
    s = wanted.join(status, "kind", "left").select("kind", F.coalesce("status", F.lit("off")).alias("status"))
    rows = log.where(in_box("lat", "lon", box)).join(F.broadcast(s.where("status in ('included', 'partial')")), "kind")
    counts = rows.groupBy("kind").agg(F.count("*").alias("rows"))
    return s.join(counts, "kind", "left").select("kind", "status", F.coalesce("rows", F.lit(0)).alias("rows"))


def _slow(log: DataFrame) -> DataFrame:
    """The stand-in log with dwells: fixes of one part of each day stand still; some have no speed."""
    return log.withColumn("speed", F.when(F.col("event_id") % 13 == 0, F.lit(None)).when(F.floor(F.col("ts") / (5 * HOURS)) % 3 == 0, F.lit(0.2)).when(F.floor(F.col("ts") / (5 * HOURS)) % 7 == 1, F.lit(0.8)).otherwise(F.col("speed") + 1.5))


def _aloft(log: DataFrame) -> DataFrame:
    """The stand-in log sixty times as fast, so that most fixes join."""
    return log.withColumn("ts", F.col("ts") / 60)


def _places(s, d):
    return sites(s, d).selectExpr("site_id as place_id", "site_lat as place_lat", "site_lon as place_lon")


def _health(s, d):
    return positions(s, d).groupBy(F.floor(F.col("ts") / HOURS).alias("h")).agg(F.count("*").alias("items")).select((F.col("h") * HOURS).alias("ts"), "items", (F.col("h") % 40 != 7).alias("ok"))


def _polls(s, d):
    return positions(s, d).select((F.lit(9_980) + F.floor((F.col("ts") - T0) / 86_400)).cast("int").alias("day"), F.lit(True).alias("ok"))


def _steps(s, d):
    v = classify_steps(positions(s, d), most_gap=86_400.0).select("event_id", (F.col("verdict") != "ok").alias("flagged"))
    at = F.concat_ws(":", F.floor(F.col("lat") / 10).cast("string"), F.floor(F.col("lon") / 10).cast("string"))
    return positions(s, d).select("entity_id", "event_id", at.alias("cell")).join(v, "event_id")


def _cells(s, d):
    return sites(s, d).select(F.concat_ws(":", F.floor(F.col("site_lat") / 10).cast("string"), F.floor(F.col("site_lon") / 10).cast("string")).alias("cell")).distinct()


QUERIES = {
    "doc_gaps": lambda s, d: gap_document(positions(s, d), sites(s, d)),
    "doc_fused_events": lambda s, d: fused_events(reports(s, d)),
    "doc_region_feed": lambda s, d: region_feed(positions(s, d), T0 + 12 * 86_400, 86_400.0, 500),
    "doc_port_calls": lambda s, d: port_call_document(_slow(positions(s, d)), _places(s, d)),
    "doc_flight_legs": lambda s, d: flight_leg_document(_aloft(positions(s, d)), _places(s, d)),
    "doc_dark_vessels": lambda s, d: dark_vessel_document(positions(s, d), vessels(s, d), _health(s, d), sites(s, d).selectExpr("site_id", "site_lat as lat2", "site_lon as lon2"), NOW, PAIR_KM),
    "doc_escalation": lambda s, d: escalation_document(reports(s, d), _polls(s, d), BOXES, 10_000, 60, least=1, ratio=0.2),
    "doc_field_activity": lambda s, d: field_activity(nearest_attached(positions(s, d), _places(s, d), 60.0).where("place_id is not null"), 20),
    "doc_interference_cells": lambda s, d: interference_document(_steps(s, d), _cells(s, d))[0],
    "doc_interference_aircraft": lambda s, d: interference_document(_steps(s, d), _cells(s, d))[1],
    "doc_vessel_profile": lambda s, d: profile_document(positions(s, d), port_call_document(_slow(positions(s, d)), _places(s, d))).select("entity_id", "state", "reason", "samples", "latest", "low", "high", "last_place", "sentence"),
    "doc_event_feed": lambda s, d: feed(reports(s, d).select("report_id", "severity", "lat", "lon"), "report_id", [F.desc_nulls_last("severity")], None, 1_200),
    "doc_event_region": lambda s, d: feed(reports(s, d).select("report_id", "severity", "lat", "lon"), "report_id", [F.desc_nulls_last("severity")], BOXES["middle"], 1_200),
    "doc_export": lambda s, d: export_document(positions(s, d), ["view", "click", "absent"], BOXES["middle"], T0 + 30 * 86_400, 3_600.0),
    "doc_layer_mix": lambda s, d: mix(positions(s, d), "kind"),
}
_B = " OR ".join("({y} BETWEEN %s AND %s AND {x} BETWEEN %s AND %s)" % (b[0], b[2], b[1], b[3]) for b in BOXES.values())
#: Port calls in SQL: dwells that begin anew after one without a place are a recursion over each slow run.
_CALLS = lambda body: oracle(
    "positions sites", body,
    f"near AS (SELECT event_id, site_id, km FROM (SELECT event_id, site_id, {km_sql('lat', 'lon', 'site_lat', 'site_lon')} AS km FROM positions, sites) WHERE km <= 50 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), site_id DESC) = 1)",
    "p AS (SELECT p.entity_id, p.ts, draught, site_id, km, CASE WHEN p.event_id % 13 = 0 THEN NULL WHEN floor(ts / 18000) % 3 = 0 THEN 0.2 WHEN floor(ts / 18000) % 7 = 1 THEN 0.8 ELSE speed + 1.5 END::DOUBLE AS v, row_number() OVER (PARTITION BY p.entity_id ORDER BY ts, p.event_id) AS i FROM positions p LEFT JOIN near USING (event_id))",
    "m AS (SELECT *, CASE WHEN v <= 0.5 THEN 'slow' WHEN v > 1 THEN 'fast' ELSE 'none' END AS c, lag(draught) OVER (PARTITION BY entity_id ORDER BY i) AS pd, i > 1 AS has FROM p)",
    "r AS (SELECT *, i - row_number() OVER (PARTITION BY entity_id, c ORDER BY i) AS run FROM m)",
    "tries(entity_id, run, anchor, done) AS (SELECT entity_id, run, min(i), (SELECT min(x.i) FROM r x WHERE x.entity_id = r.entity_id AND x.run = r.run AND x.c = 'slow' AND x.ts >= min(r.ts) + 3600) FROM r WHERE c = 'slow' GROUP BY entity_id, run "
    "UNION ALL SELECT t.entity_id, t.run, b.i, (SELECT min(x.i) FROM r x WHERE x.entity_id = t.entity_id AND x.run = t.run AND x.c = 'slow' AND x.ts >= b.ts + 3600) FROM tries t JOIN r a ON a.entity_id = t.entity_id AND a.i = t.anchor JOIN r b ON b.entity_id = t.entity_id AND b.run = t.run AND b.c = 'slow' AND b.i = t.done + 1 WHERE t.done IS NOT NULL AND a.site_id IS NULL)",
    "opens AS (SELECT entity_id, done AS i, anchor FROM tries t JOIN (SELECT entity_id AS e, i AS k, site_id FROM r) a ON a.e = t.entity_id AND a.k = t.anchor WHERE done IS NOT NULL AND site_id IS NOT NULL)",
    "leaves AS (SELECT entity_id, min(i) AS i, any_value(since) AS since FROM (SELECT *, min(ts) OVER (PARTITION BY entity_id, run, c) AS since FROM r WHERE c = 'fast') WHERE ts - since >= 1800 GROUP BY entity_id, run)",
    "ev AS (SELECT entity_id, i, anchor, NULL::DOUBLE AS since FROM opens UNION ALL SELECT entity_id, i, NULL, since FROM leaves)",
    "ord AS (SELECT *, lag(anchor IS NOT NULL) OVER (PARTITION BY entity_id ORDER BY i) AS before FROM ev)",
    "begun AS (SELECT o.*, (SELECT arg_min({'i': l.i, 's': l.since}, l.i) FROM leaves l WHERE l.entity_id = o.entity_id AND l.i > o.i) AS d FROM ord o WHERE anchor IS NOT NULL AND NOT coalesce(before, false))",
    """done AS (SELECT b.entity_id, a.site_id AS place_id, CASE WHEN a.km <= 3 THEN 'exact' WHEN a.km <= 15 THEN 'proximity' ELSE 'inferred' END AS match, a.ts AS arrived_at, d.s AS departed_at, CASE WHEN a.has THEN a.pd ELSE a.draught END AS draught_in,
    CASE WHEN d IS NOT NULL THEN (SELECT arg_max(x.draught, x.i) FROM r x WHERE x.entity_id = b.entity_id AND x.c = 'slow' AND x.i < b.d.i) END AS draught_out FROM begun b JOIN r a ON a.entity_id = b.entity_id AND a.i = b.anchor)""",
).replace("WITH ", "WITH RECURSIVE ", 1)
_JAM = lambda body: oracle(
    "positions sites", body,
    "b AS (SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lag(on_ground) OVER w AS pg, lag(course) OVER w AS pc FROM positions WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))",
    f"""m AS (SELECT *, ts - pt AS dt, {km_sql('pla', 'plo', 'lat', 'lon')} AS km, degrees(atan2(sin(radians(lon) - radians(plo)) * cos(radians(lat)), cos(radians(pla)) * sin(radians(lat)) - sin(radians(pla)) * cos(radians(lat)) * cos(radians(lon) - radians(plo)))) AS brg
    FROM b WHERE ts - pt > 0 AND ts - pt <= 86400 AND NOT coalesce(on_ground, false) AND NOT coalesce(pg, false))""",
    "v AS (SELECT entity_id AS e, CAST(floor(lat / 10) AS BIGINT) || ':' || CAST(floor(lon / 10) AS BIGINT) AS cell, km / dt * 3600 > 2200 OR coalesce(km >= 5 AND least(d, 360 - d) > 150, false) AS bad FROM (SELECT *, (((brg - CASE WHEN pc < 360 THEN pc END) % 360) + 360) % 360 AS d FROM m))",
    "w AS (SELECT DISTINCT CAST(floor(site_lat / 10) AS BIGINT) || ':' || CAST(floor(site_lon / 10) AS BIGINT) AS cell FROM sites)",
    "g AS (SELECT cell, e, count(*) AS samples, count(*) FILTER (bad) AS flags FROM v JOIN w USING (cell) GROUP BY ALL)",
)
ORACLES = {
    "doc_gaps": oracle(
        "positions",
        "SELECT g.entity_id, pe AS from_event, g.event_id AS to_event, round(g.ts - pt, 3) AS gap_seconds, count(h.ts) AS samples, round(quantile_cont(h.speed, 0.95), 6) AS p95 FROM k g LEFT JOIN positions h ON h.entity_id = g.entity_id AND h.ts <= pt AND h.ts >= pt - 432000 GROUP BY ALL ORDER BY gap_seconds DESC, to_event LIMIT 120",
        "g AS (SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo, lag(event_id) OVER w AS pe FROM positions WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))",
        f"k AS (SELECT * FROM g WHERE ts - pt >= 14400 AND round(ts - pt, 3) <= 129600 AND ({_B.format(y='lat', x='lon')}) AND ({_B.format(y='pla', x='plo')}))",
    ),
    "doc_layer_mix": oracle("positions", "SELECT kind, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT kind, count(*) AS n FROM positions GROUP BY 1)"),
    "doc_region_feed": oracle(
        "positions",
        "SELECT entity_id, event_id, ts, box FROM (SELECT *, CASE " + " ".join(f"WHEN lat BETWEEN {b[0]} AND {b[2]} AND lon BETWEEN {b[1]} AND {b[3]} THEN '{n}'" for n, b in BOXES.items()) + " END AS box FROM l) WHERE box IS NOT NULL ORDER BY ts DESC, entity_id LIMIT 500",
        f"a AS (SELECT max(ts) AS anchor FROM positions WHERE ts > {T0 + 11 * 86400} AND ts <= {T0 + 12 * 86400})",
        "l AS (SELECT p.* FROM positions p, a WHERE ts <= anchor AND ts >= anchor - 86400 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)",
    ),
    "doc_fused_events": REC(
        "SELECT cluster, arg_min(report_id, k) AS primary_id, round(max(severity), 4) AS severity, max(mentions) AS mentions, count(DISTINCT status) AS sources, count(*) AS n FROM (SELECT *, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 1000000000 + report_id AS k FROM reports JOIN c USING (report_id)) GROUP BY 1"
    ),
    "doc_port_calls": _CALLS("SELECT entity_id, place_id, match, arrived_at, departed_at, draught_in, draught_out FROM done"),
    "doc_vessel_profile": _CALLS(
        """SELECT g.entity_id, CASE WHEN samples < 5 THEN 'unknown' WHEN latest / high > 0.85 THEN 'laden' WHEN latest / high < 0.55 THEN 'ballast' ELSE 'unknown' END AS state, CASE WHEN samples < 5 THEN 'insufficient_samples' END AS reason, samples, latest, low, high, last_place, CASE WHEN last_place IS NOT NULL THEN 'last port call: ' || last_place ELSE 'no port call on record' END || '; no declared destination. From position reports alone; no cargo is asserted.' AS sentence
        FROM (SELECT entity_id, count(DISTINCT round(draught, 1)) FILTER (draught > 0) AS samples, arg_max(round(draught, 1), {'t': ts, 'e': event_id}) FILTER (draught > 0) AS latest, min(round(draught, 1)) FILTER (draught > 0) AS low, max(round(draught, 1)) FILTER (draught > 0) AS high FROM positions GROUP BY 1) g LEFT JOIN (SELECT entity_id, arg_max(place_id, {'a': arrived_at, 'p': place_id}) AS last_place FROM done GROUP BY 1) x ON x.entity_id = g.entity_id""",
    ),
    "doc_flight_legs": oracle(
        "positions sites",
        """SELECT entity_id, departed_at, arrived_at, origin, dest, CASE WHEN seen AND arrived_at IS NOT NULL THEN 'observed_both' WHEN seen OR arrived_at IS NOT NULL THEN 'observed_one' ELSE 'inferred' END AS confidence, km, top, last_seen_at, fixes FROM legs""",
        f"near AS (SELECT event_id, site_id, km FROM (SELECT event_id, site_id, {km_sql('lat', 'lon', 'site_lat', 'site_lon')} AS km FROM positions, sites) WHERE km <= 40 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), site_id DESC) = 1)",
        "p AS (SELECT p.entity_id, p.event_id, ts / 60 AS ts, lat, lon, on_ground AS g, altitude AS alt, CAST(site_id AS VARCHAR) AS field, km AS fkm FROM positions p LEFT JOIN near USING (event_id))",
        "q AS (SELECT *, coalesce(ts - lag(ts) OVER w > 1800, true) AS broken FROM p WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))",
        "s AS (SELECT *, sum(CAST(broken AS INT)) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS seg FROM q)",
        "a AS (SELECT *, CASE WHEN count(alt) OVER (PARTITION BY entity_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AND alt IS NOT NULL THEN alt >= 1500 WHEN alt < 1350 THEN false WHEN alt > 1650 THEN true END AS side FROM s)",
        "h AS (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY entity_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM a)",
        "l AS (SELECT *, lag(high) OVER w AS ph, lag(g) OVER w AS pg, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM h WINDOW w AS (PARTITION BY entity_id, seg ORDER BY ts, event_id))",
        "t AS (SELECT *, coalesce(pg <> g, false) AS turned, NOT coalesce(pg <> g, false) AND ph IS NOT NULL AND coalesce(fkm <= 10, false) AND high <> ph AS crossed FROM l)",
        "e AS (SELECT *, coalesce((turned AND pg) OR (crossed AND high), false) AS up, CASE WHEN coalesce((turned AND pg) OR (crossed AND high), false) OR (broken AND coalesce(NOT g, false)) THEN true WHEN (turned AND g) OR (crossed AND ph) THEN false END AS ev FROM t)",
        "o AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY entity_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS aloft FROM e)",
        "n AS (SELECT *, sum(CAST(NOT aloft AND coalesce(ev, false) AS INT)) OVER (PARTITION BY entity_id, seg ORDER BY ts, event_id) AS leg FROM o)",
        f"""legs AS (SELECT entity_id, seg, leg, min(ts) AS departed_at, max(ts) FILTER (aloft AND NOT coalesce(ev, true)) AS arrived_at, max(field) FILTER (NOT aloft) AS origin, max(field) FILTER (aloft AND NOT coalesce(ev, true)) AS dest, bool_or(NOT aloft AND up) AS seen,
        round_even(coalesce(sum({km_sql('plat', 'plon', 'lat', 'lon')}) FILTER (aloft), 0), 1) AS km, CAST(round_even(max(alt), 0) AS BIGINT) AS top, max(ts) AS last_seen_at, count(*) AS fixes FROM n WHERE aloft OR coalesce(ev, false) GROUP BY ALL)""",
    ),
    "doc_dark_vessels": oracle(
        "positions sites",
        f"""SELECT 'gap' AS kind, entity_id AS id, event_id AS other, round_even(gap / 3600, 1) AS hours, round(pla, 6) AS lat, round(plo, 6) AS lon FROM (SELECT * FROM ok ORDER BY gap DESC, event_id LIMIT 120)
        UNION ALL SELECT 'pair', a_id, b_id, hours, round(lat, 6), round(lon, 6) FROM (SELECT a_id, b_id, round_even(least(x, y), 1) AS hours, lat, lon FROM pairs ORDER BY hours DESC, a_id, b_id LIMIT 80)""",
        "h AS (SELECT floor(ts / 3600) * 3600 AS t, count(*) AS items, floor(ts / 3600) % 40 <> 7 AS ok FROM positions GROUP BY ALL)", "u AS (SELECT CASE WHEN count(*) FILTER (ok) >= 3 THEN median(items) FILTER (ok) END AS usual FROM h)",
        "g AS (SELECT *, lag(ts) OVER w AS pt, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM positions WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id))",
        f"k AS (SELECT *, round(ts - pt, 3) AS gap FROM g WHERE ts - pt >= 14400 AND round(ts - pt, 3) <= 129600 AND ({_B.format(y='lat', x='lon')}) AND ({_B.format(y='pla', x='plo')}))",
        "ok AS (SELECT * FROM (SELECT k.*, count(*) FILTER (NOT h.ok) AS bad, min(items) AS low, max(usual) AS usual FROM k LEFT JOIN h ON t BETWEEN pt AND pt + gap, u GROUP BY ALL) WHERE bad = 0 AND (usual IS NULL OR coalesce(low >= usual * 0.5, false)))",
        f"c AS (SELECT event_id, lat, lon, ({NOW} - ts) / 3600 AS h FROM positions WHERE speed / 40 <= 1 AND event_id % 7 <> 0 AND event_id % 9 <> 0 AND ({NOW} - ts) / 3600 >= 1)",
        f"f AS (SELECT * FROM c p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE {km_sql('p.lat', 'p.lon', 's.site_lat', 's.site_lon')} <= 25))",
        f"pairs AS (SELECT a.event_id AS a_id, b.event_id AS b_id, a.h AS x, b.h AS y, (a.lat + b.lat) / 2 AS lat, (a.lon + b.lon) / 2 AS lon FROM f a JOIN f b ON a.event_id < b.event_id AND floor(a.lat * 10) BETWEEN floor(b.lat * 10) - 1 AND floor(b.lat * 10) + 1 WHERE {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {PAIR_KM})",
    ),
    "doc_escalation": oracle(
        "reports positions",
        "SELECT box, current, round_even(before / 59, 2) AS per_day, round_even((current + 1) / (before / 59 + 1), 2) AS ratio, severity_sum, worst FROM b WHERE current >= 1 AND (current + 1) / (before / 59 + 1) >= 0.2 AND 10000 - oldest >= 1.5 AND (SELECT count(*) >= 24 FROM positions WHERE 9980 + floor((ts - %s) / 86400) = 10000)" % T0,
        f"x(box, s, w, n, e) AS (VALUES {', '.join(str((k, *v)) for k, v in BOXES.items())})",
        "b AS (SELECT box, count(*) FILTER (day > 9999) AS current, count(*) FILTER (day <= 9999) AS before, CAST(trunc(coalesce(sum(severity) FILTER (day > 9999), 0)) AS BIGINT) AS severity_sum, min(day) AS oldest, arg_max(report_id, {'s': severity, 'r': -report_id}) FILTER (day > 9999) AS worst FROM reports JOIN x ON lat BETWEEN s AND n AND lon BETWEEN w AND e WHERE day <= 10000 AND day > 9940 GROUP BY 1)",
    ),
    "doc_field_activity": oracle(
        "positions sites",
        """SELECT t.place_id, entities, grounded, (SELECT string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY r.h) FROM range(24) r(h) LEFT JOIN (SELECT CAST(floor(ts / 3600) AS BIGINT) % 24 AS h, count(DISTINCT entity_id) AS n FROM a WHERE a.place_id = t.place_id GROUP BY 1) x ON x.h = r.h) AS hours,
        (SELECT string_agg(kind, ',' ORDER BY n DESC, kind) FROM (SELECT kind, count(DISTINCT entity_id) AS n FROM a WHERE a.place_id = t.place_id GROUP BY 1 ORDER BY n DESC, kind LIMIT 3)) AS types FROM t
        WHERE place_id IN (SELECT place_id FROM t ORDER BY entities DESC, place_id LIMIT 20) OR place_id IN (SELECT place_id FROM t ORDER BY grounded DESC, place_id LIMIT 20)""",
        f"a AS (SELECT * FROM (SELECT event_id, entity_id, ts, on_ground, kind, site_id AS place_id, {km_sql('lat', 'lon', 'site_lat', 'site_lon')} AS km FROM positions, sites) WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), place_id DESC) = 1)",
        "t AS (SELECT place_id, count(DISTINCT entity_id) AS entities, count(DISTINCT entity_id) FILTER (on_ground) AS grounded FROM a GROUP BY 1)",
    ),
    "doc_interference_cells": _JAM("SELECT w.cell, count(e) AS observed, count(*) FILTER (flags > 0) AS flagged, CASE WHEN count(e) = 0 THEN 'no_traffic' WHEN count(*) FILTER (flags > 0) / count(e) >= 0.25 THEN 'interference' ELSE 'clean' END AS status FROM w LEFT JOIN g USING (cell) GROUP BY 1"),
    "doc_interference_aircraft": _JAM("SELECT e AS entity_id, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(flags) AS BIGINT) AS flags, count(*) AS cells, CASE WHEN sum(flags) > 0 THEN 'flagged' WHEN sum(samples) >= 2 THEN 'clean' ELSE 'insufficient' END AS status FROM g GROUP BY 1"),
    "doc_event_feed": oracle("reports", "SELECT report_id, severity, lat, lon FROM reports ORDER BY severity DESC NULLS LAST, report_id LIMIT 1200"),
    "doc_event_region": oracle("reports", f"SELECT report_id, severity, lat, lon FROM reports WHERE lat BETWEEN {BOXES['middle'][0]} AND {BOXES['middle'][2]} AND lon BETWEEN {BOXES['middle'][1]} AND {BOXES['middle'][3]}"),
    "doc_export": oracle(
        "positions",
        "SELECT k.kind, coalesce(status, 'off') AS status, CASE WHEN status IN ('included', 'partial') THEN viewed ELSE 0 END AS rows FROM (VALUES ('view'), ('click'), ('absent')) k(kind) LEFT JOIN s ON s.kind = k.kind",
        f"g AS (SELECT kind, count(*) AS total, count(*) FILTER (lat BETWEEN {BOXES['middle'][0]} AND {BOXES['middle'][2]} AND lon BETWEEN {BOXES['middle'][1]} AND {BOXES['middle'][3]}) AS viewed, max(ts) AS newest FROM positions GROUP BY 1)",
        f"s AS (SELECT *, CASE WHEN {T0 + 30 * 86400} - newest > 3600 THEN 'unhealthy' WHEN viewed = 0 THEN 'empty' WHEN viewed < total / 20 THEN 'partial' ELSE 'included' END AS status FROM g)",
    ),
}
