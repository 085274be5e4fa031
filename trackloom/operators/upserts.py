"""Keyed state in batch form: latest state, change logs, accumulating and prefer-new merges, decay, alerts, retention, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.tracks import with_previous
from trackloom.sources.standins import oracle, positions, reports, sites, table

EPS = 1e-5
T0 = 1_704_067_200.0
SPLIT = T0 + 15 * 86_400.0


def synthetic_key(*fields: str) -> Column:
    """Twenty hex digits of the sha1 of the fields joined by |, nulls spelled None."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields])), 1, 20)


def upsert_latest(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Latest state after a batch: the newest row of a key wins; moved_at advances only if a coordinate moved by more than EPS.

    state and batch have entity_id, ts, event_id, lat, lon; state has moved_at as well.
    """
    new = batch.groupBy("entity_id").agg(F.max_by(F.struct("ts", "event_id", "lat", "lon"), F.struct("ts", "event_id")).alias("n"))
    j = state.select("entity_id", F.struct("ts", "event_id", "lat", "lon", "moved_at").alias("o")).join(new, "entity_id", "full")
    moved = F.col("o").isNull() | (F.abs(F.col("n.lat") - F.col("o.lat")) > EPS) | (F.abs(F.col("n.lon") - F.col("o.lon")) > EPS)
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    at = F.when(F.col("n").isNull(), F.col("o.moved_at")).when(moved, F.col("n.ts")).otherwise(F.col("o.moved_at"))
    return j.select("entity_id", *map(pick, ("ts", "event_id", "lat", "lon")), at.alias("moved_at"))


def change_log(log: DataFrame, eps: float = EPS) -> DataFrame:
    """Fixes that are new or moved against the one before: what an append-on-change history holds."""
    marked = with_previous(log.select("entity_id", "event_id", "ts", "lat", "lon"), ["lat", "lon"])
    return marked.where(F.col("b").isNull() | (F.abs(F.col("lat") - F.col("b.lat")) > eps) | (F.abs(F.col("lon") - F.col("b.lon")) > eps)).select("entity_id", "event_id", "ts")


def overwrite_all_but_first(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full upsert that keeps the first time a key was seen; zeros become null."""
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    return both.groupBy("id").agg(F.min("seen").alias("first_seen"), F.max_by(F.struct(F.expr("nullif(mentions, 0)").alias("mentions"), "severity"), "gen").alias("r")).select("id", "first_seen", "r.mentions", F.expr("nullif(r.severity, 0.0D)").alias("severity"))


def accumulate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive counters and a key-wise sum of maps; the maps are long tables (cell, class, n) until they are shown."""
    both = old.unionByName(new)
    by = both.groupBy("cell", "class").agg(F.sum("n").alias("n"))
    return by.groupBy("cell").agg(F.sum("n").alias("positions"), F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", F.col("class").cast("string"), F.col("n").cast("string"))))).alias("by_class"))


def coalesce_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per field: keep the old draught, prefer the new kind, take the greatest altitude and last time."""
    j = old.select("id", F.struct("draught", "kind", "altitude", "ts").alias("o")).join(new.select("id", F.struct("draught", "kind", "altitude", "ts").alias("n")), "id", "full")
    return j.select("id", F.coalesce("o.draught", "n.draught").alias("draught"), F.coalesce("n.kind", "o.kind").alias("kind"), F.greatest("o.altitude", "n.altitude").alias("altitude"), F.greatest("o.ts", "n.ts").alias("ts"))


def decay(cells: DataFrame, factor: float, floor: float) -> DataFrame:
    """Counters times a factor, rounded half to even; cells below the floor go."""
    return cells.select("cell", F.rint(F.col("n") * factor).cast("long").alias("n")).where(F.col("n") >= floor)


def alerts(firing: DataFrame, stored: DataFrame, now: int) -> DataFrame:
    """Alert rows after a check: firing ones are open (a resolved one starts anew), stored ones that don't fire are resolved."""
    j = stored.withColumn("s", F.lit(True)).join(firing.select("subject", F.lit(True).alias("f")), "subject", "full")
    was_open = F.col("s") & F.col("resolved_at").isNull()
    first = F.when(F.col("f") & ~F.coalesce(was_open, F.lit(False)), F.lit(now)).otherwise(F.col("first_seen"))
    times = F.coalesce("occurrences", F.lit(0)) + F.when(F.col("f"), 1).otherwise(0)
    resolved = F.when(F.col("f"), F.lit(None).cast("int")).otherwise(F.coalesce("resolved_at", F.lit(now)))
    return j.select("subject", first.alias("first_seen"), times.alias("occurrences"), resolved.alias("resolved_at"))


def health(log: DataFrame) -> DataFrame:
    """Newest poll, newest good poll, and whether the feed's last word was good."""
    ok = ~F.coalesce(F.col("on_ground"), F.lit(True))
    return log.groupBy("kind").agg(F.max("ts").alias("newest"), F.max(F.when(ok, F.col("ts"))).alias("newest_ok"), F.max_by(ok, F.struct("ts", "event_id")).alias("ok"))


def staleness(h: DataFrame, now: float, every: float, multiple: float = 2.5) -> DataFrame:
    verdict = F.when(F.col("newest").isNull(), "missing").when(F.lit(now) - F.col("newest") > every * multiple, "frozen").when(~F.col("ok"), "error").otherwise("fresh")
    return h.withColumn("verdict", verdict)


def retain(log: DataFrame, now: float, ttl: dict[str, float], default: float) -> DataFrame:
    """Rows young enough for their kind's window."""
    window = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in sorted(ttl.items())], F.lit(default))
    return log.where(F.col("ts") >= F.lit(now) - window)


def content_hash(df: DataFrame, *cols: str) -> DataFrame:
    """Sixteen hex digits of the sha256 of each row's sorted-key JSON."""
    return df.withColumn("etag", F.substring(F.sha2(F.to_json(F.struct(*sorted(cols))), 256), 1, 16))


#: Columns that an export adds to every row.
PROVENANCE = ("layer", "generated_at", "health")


def with_provenance(df: DataFrame, layer: str, generated_at: str, health: Column) -> DataFrame:
    return df.withColumn("layer", F.lit(layer)).withColumn("generated_at", F.lit(generated_at)).withColumn("health", health)


def geojson(df: DataFrame, lat: str, lon: str, *props: str) -> DataFrame:
    """One GeoJSON feature a row, nested values encoded; rows without a place have a null geometry."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    geometry = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), point)
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*props).alias("properties"))
    return df.select(*props[:1], F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def csv_field(c: Column) -> Column:
    """A quoted field where it holds a comma, quote or line break, with quotes doubled; null is empty."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_rows(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several layers as lines (layer, key, line) under the union of their columns, in the order they first appear; nested values are JSON.

    The first line of all is the header: layer null.
    """
    columns: list[str] = []
    for df in parts.values():
        columns += [c for c in df.columns if c not in columns]
    text = lambda df, c: F.lit("") if c not in df.columns else csv_field(F.to_json(c) if "<" in df.schema[c].dataType.simpleString() else F.col(c))
    lines = None
    for layer, df in parts.items():
        part = df.select(F.lit(layer).alias("layer"), F.col(key).cast("string").alias("key"), F.concat_ws(",", *[text(df, c) for c in columns]).alias("line"))
        lines = part if lines is None else lines.unionByName(part)
    head = next(iter(parts.values())).sparkSession.createDataFrame([(None, None, ",".join(columns))], "layer string, key string, line string")
    return head.unionByName(lines)


def put_documents(store: DataFrame, batch: DataFrame) -> DataFrame:
    """A store of whole documents by name: the last one of a name wins, by `version` and then body. Rows name, version, body (JSON)."""
    both = store.select("name", "version", "body").unionByName(batch.select("name", "version", "body")).where("name is not null")
    return both.groupBy("name").agg(F.max(F.struct("version", "body")).alias("d")).select("name", "d.*")


def as_documents(df: DataFrame, name: Column, version: Column, *cols: str) -> DataFrame:
    return df.select(name.alias("name"), version.alias("version"), F.to_json(F.struct(*cols)).alias("body"))


def sample_history(history: DataFrame, batch: DataFrame, now: float, keep_s: float, cap: int) -> DataFrame:
    """Bounded samples (key, ts, value) of each key: those of the last keep_s seconds, the newest `cap` of them; numbers only."""
    both = history.unionByName(batch).where("value is not null and ts is not null").where(F.col("ts") >= now - keep_s)
    n = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), F.desc("value")))
    return both.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def changed_since(log: DataFrame, marks: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """The rows of each kind after the reader's watermark, and the new watermarks; a kind without a mark is read whole."""
    known = log.sparkSession.createDataFrame(sorted(marks.items()), "kind string, mark double")
    rows = log.join(F.broadcast(known), "kind", "left").where(F.col("mark").isNull() | (F.col("ts") > F.col("mark")))
    new = log.groupBy("kind").agg(F.max("ts").alias("mark"))
    return rows.drop("mark"), new


def _halves(s, d):
    p = positions(s, d)
    state = p.where(F.col("ts") < SPLIT).groupBy("entity_id").agg(F.max_by(F.struct("ts", "event_id", "lat", "lon"), F.struct("ts", "event_id")).alias("r")).select("entity_id", "r.*").withColumn("moved_at", F.col("ts") - 60)
    return state, p.where((F.col("ts") >= SPLIT) & (F.col("kind") != "view"))


def _cells(s, d, late: bool):
    p = positions(s, d).where((F.col("ts") >= SPLIT) if late else (F.col("ts") < SPLIT))
    return p.groupBy((F.col("entity_id") % 30).alias("cell"), F.floor(F.col("ship_type") / 10).alias("class")).agg(F.count("*").alias("n"))


def _fields(s, d, late: bool):
    p = positions(s, d).where((F.col("ts") >= SPLIT) if late else (F.col("ts") < SPLIT))
    return p.groupBy(F.col("entity_id").alias("id")).agg(F.min("draught").alias("draught"), F.min("kind").alias("kind"), F.max("altitude").alias("altitude"), F.max("ts").alias("ts"))


def _versions(s, d, new: bool):
    r = reports(s, d).where("status = 'F'" if new else "status = 'O'")
    return r.groupBy(F.col("actor").alias("id")).agg(F.min("day").alias("seen"), F.min("mentions").alias("mentions"), F.max("severity").alias("severity"))


def _alerts(s, d):
    fire = reports(s, d).where("mentions = 8 and severity > 300000").select(F.col("actor").alias("subject")).distinct()
    kept = table(s, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey as subject", "cast(c_custkey % 100 as int) as first_seen", "1 as occurrences", "case when c_custkey % 3 = 0 then 50 end as resolved_at")
    return alerts(fire, kept, 1000)


QUERIES = {
    "upsert_latest": lambda s, d: upsert_latest(*_halves(s, d)),
    "upsert_change_log": lambda s, d: change_log(positions(s, d).withColumn("lat", F.floor("lat")).withColumn("lon", F.floor("lon"))),
    "upsert_synthetic_key": lambda s, d: positions(s, d).select("event_id", synthetic_key("event_id", "kind", "on_ground").alias("key")),
    "upsert_overwrite": lambda s, d: overwrite_all_but_first(_versions(s, d, False), _versions(s, d, True)),
    "upsert_accumulate": lambda s, d: accumulate(_cells(s, d, False), _cells(s, d, True)),
    "upsert_coalesce": lambda s, d: coalesce_merge(_fields(s, d, False), _fields(s, d, True)),
    "upsert_decay": lambda s, d: decay(positions(s, d).groupBy(F.col("entity_id").alias("cell")).agg(F.count("*").alias("n")), 0.5, 32),
    "upsert_alerts": lambda s, d: _alerts(s, d),
    "upsert_health": lambda s, d: staleness(health(positions(s, d)), T0 + 30.5 * 86_400, 21_600.0),
    "upsert_retention": lambda s, d: retain(positions(s, d), T0 + 30 * 86_400, {"view": 86_400.0, "click": 3 * 86_400.0}, 7 * 86_400.0).select("event_id", "kind"),
    "upsert_bulk_delete": lambda s, d: positions(s, d).select("event_id").join(table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id")), "event_id", "left_anti"),
    "upsert_content_hash": lambda s, d: content_hash(sites(s, d).select("site_id", "site_name"), "site_name", "site_id").select("site_id", "etag"),
    "export_geojson": lambda s, d: geojson(with_provenance(sites(s, d).withColumn("y", F.when(F.col("site_id") % 5 != 0, F.round("site_lat", 2))).withColumn("x", F.round("site_lon", 2)), "sites", "2024-01-01", F.lit("ok")), "y", "x", "site_id", "site_name", *PROVENANCE),
    "export_csv": lambda s, d: csv_rows({
        "sites": with_provenance(sites(s, d).select("site_id", F.concat(F.col("site_name"), F.lit(', "x"')).alias("name"), F.array("country", "site_id").alias("codes")), "sites", "2024-01-01", F.lit(None).cast("string")),
        "nations": table(s, d, "nation").selectExpr("n_nationkey as site_id", "n_name as title")}, "site_id"),
    "upsert_documents": lambda s, d: put_documents(*[as_documents(reports(s, d).where(w), F.concat(F.lit("d"), F.col("actor") % 20), F.col("day"), "report_id", "status") for w in ("day < 9500", "day >= 9500")]),
    "upsert_sample_history": lambda s, d: sample_history(*[positions(s, d).where(w).select(F.col("entity_id").alias("key"), "ts", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value")) for w in (f"ts < {SPLIT}", f"ts >= {SPLIT}")], T0 + 30 * 86_400, 20 * 86_400.0, 12),
    "upsert_changed_since": lambda s, d: changed_since(positions(s, d), {"view": SPLIT, "click": T0 + 86_400})[0].select("event_id", "kind"),
    "upsert_watermarks": lambda s, d: changed_since(positions(s, d), {})[1],
}

_L = f"ts < {SPLIT}"
ORACLES = {
    "export_geojson": oracle("sites", """SELECT site_id, '{"type":"Feature","geometry":' || CASE WHEN site_id % 5 = 0 THEN 'null' ELSE '{"type":"Point","coordinates":[' || CAST(round(site_lon, 2) AS VARCHAR) || ',' || CAST(round(site_lat, 2) AS VARCHAR) || ']}' END || ',"properties":{"site_id":' || site_id || ',"site_name":"' || site_name || '","layer":"sites","generated_at":"2024-01-01","health":"ok"}}' AS feature FROM sites"""),
    "export_csv": oracle("sites", "SELECT NULL AS layer, NULL AS key, 'site_id,name,codes,layer,generated_at,health,title' AS line UNION ALL SELECT 'sites', CAST(site_id AS VARCHAR), site_id || ',\"' || site_name || ', \"\"x\"\"\",\"[' || country || ',' || site_id || ']\",sites,2024-01-01,,' FROM sites UNION ALL SELECT 'nations', CAST(n_nationkey AS VARCHAR), n_nationkey || ',,,,,,' || n_name FROM nation"),
    "upsert_documents": oracle("reports", """SELECT name, version, body FROM (SELECT 'd' || actor % 20 AS name, day AS version, '{"report_id":' || report_id || ',"status":"' || status || '"}' AS body FROM reports) QUALIFY row_number() OVER (PARTITION BY name ORDER BY version DESC, body DESC) = 1"""),
    "upsert_sample_history": oracle("positions", f"SELECT entity_id AS key, ts, value FROM positions WHERE event_id % 6 <> 0 AND ts >= {T0 + 10 * 86_400} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, value DESC) <= 12"),
    "upsert_changed_since": oracle("positions", f"SELECT event_id, kind FROM positions WHERE ts > CASE kind WHEN 'view' THEN {SPLIT} WHEN 'click' THEN {T0 + 86_400} ELSE -1 END"),
    "upsert_watermarks": oracle("positions", "SELECT kind, max(ts) AS mark FROM positions GROUP BY 1"),
    "upsert_latest": oracle(
        "positions",
        """SELECT coalesce(o.entity_id, n.entity_id) AS entity_id, coalesce(n.ts, o.ts) AS ts, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.lat, o.lat) AS lat, coalesce(n.lon, o.lon) AS lon,
        CASE WHEN n.ts IS NULL THEN o.ts - 60 WHEN o.ts IS NULL OR abs(n.lat - o.lat) > 1e-5 OR abs(n.lon - o.lon) > 1e-5 THEN n.ts ELSE o.ts - 60 END AS moved_at FROM o FULL JOIN n ON o.entity_id = n.entity_id""",
        f"o AS (SELECT * FROM positions WHERE {_L} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)",
        f"n AS (SELECT * FROM positions WHERE NOT {_L} AND kind <> 'view' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) = 1)",
    ),
    "upsert_change_log": oracle("positions", "SELECT entity_id, event_id, ts FROM (SELECT *, lag(floor(lat)) OVER w AS y, lag(floor(lon)) OVER w AS x FROM positions WINDOW w AS (PARTITION BY entity_id ORDER BY ts, event_id)) WHERE y IS NULL OR floor(lat) <> y OR floor(lon) <> x"),
    "upsert_synthetic_key": oracle("positions", "SELECT event_id, substr(sha1(event_id || '|' || kind || '|' || coalesce(CAST(on_ground AS VARCHAR), 'None')), 1, 20) AS key FROM positions"),
    "upsert_overwrite": oracle(
        "reports", "SELECT coalesce(o.id, n.id) AS id, least(o.seen, n.seen) AS first_seen, nullif(CASE WHEN n.id IS NULL THEN o.mentions ELSE n.mentions END, 0) AS mentions, coalesce(n.severity, o.severity) AS severity FROM o FULL JOIN n ON o.id = n.id",
        "o AS (SELECT actor AS id, min(day) AS seen, min(mentions) AS mentions, max(severity) AS severity FROM reports WHERE status = 'O' GROUP BY 1)", "n AS (SELECT actor AS id, min(day) AS seen, min(mentions) AS mentions, max(severity) AS severity FROM reports WHERE status = 'F' GROUP BY 1)",
    ),
    "upsert_accumulate": oracle("positions", "SELECT cell, CAST(sum(n) AS BIGINT) AS positions, string_agg(class || '=' || n, ',' ORDER BY class || '=' || n) AS by_class FROM (SELECT entity_id % 30 AS cell, ship_type // 10 AS class, count(*) AS n FROM positions GROUP BY ALL) GROUP BY 1"),
    "upsert_coalesce": oracle(
        "positions", "SELECT coalesce(o.id, n.id) AS id, coalesce(o.draught, n.draught) AS draught, coalesce(n.kind, o.kind) AS kind, greatest(o.altitude, n.altitude) AS altitude, greatest(o.ts, n.ts) AS ts FROM o FULL JOIN n ON o.id = n.id",
        *(f"{a} AS (SELECT entity_id AS id, min(draught) AS draught, min(kind) AS kind, max(altitude) AS altitude, max(ts) AS ts FROM positions WHERE {w} GROUP BY 1)" for a, w in (("o", _L), ("n", f"NOT {_L}"))),
    ),
    "upsert_decay": oracle("positions", "SELECT cell, n FROM (SELECT entity_id AS cell, CAST(round_even(count(*) * 0.5, 0) AS BIGINT) AS n FROM positions GROUP BY 1) WHERE n >= 32"),
    "upsert_alerts": oracle(
        "reports",
        """SELECT coalesce(s.subject, f.subject) AS subject, CASE WHEN f.subject IS NOT NULL AND NOT (s.subject IS NOT NULL AND resolved_at IS NULL) THEN 1000 ELSE first_seen END AS first_seen,
        coalesce(occurrences, 0) + CASE WHEN f.subject IS NOT NULL THEN 1 ELSE 0 END AS occurrences, CASE WHEN f.subject IS NULL THEN coalesce(resolved_at, 1000) END AS resolved_at FROM s FULL JOIN f ON s.subject = f.subject""",
        "f AS (SELECT DISTINCT actor AS subject FROM reports WHERE mentions = 8 AND severity > 300000)",
        "s AS (SELECT c_custkey AS subject, CAST(c_custkey % 100 AS INT) AS first_seen, 1 AS occurrences, CASE WHEN c_custkey % 3 = 0 THEN 50 END AS resolved_at FROM customer WHERE c_acctbal > 0)",
    ),
    "upsert_health": oracle(
        "positions", f"SELECT *, CASE WHEN {T0 + 30.5 * 86400} - newest > 54000 THEN 'frozen' WHEN NOT ok THEN 'error' ELSE 'fresh' END AS verdict FROM h",
        "h AS (SELECT kind, max(ts) AS newest, max(ts) FILTER (NOT coalesce(on_ground, true)) AS newest_ok, arg_max(NOT coalesce(on_ground, true), {'t': ts, 'e': event_id}) AS ok FROM positions GROUP BY 1)",
    ),
    "upsert_retention": oracle("positions", f"SELECT event_id, kind FROM positions WHERE ts >= {T0 + 30 * 86400} - CASE kind WHEN 'view' THEN 86400 WHEN 'click' THEN 259200 ELSE 604800 END"),
    "upsert_bulk_delete": "SELECT event_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "upsert_content_hash": """SELECT s_suppkey AS site_id, substr(sha256('{"site_id":' || s_suppkey || ',"site_name":"' || s_name || '"}'), 1, 16) AS etag FROM supplier""",
}
