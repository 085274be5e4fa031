"""Aggregations: conditional and distinct counts, percentiles, grids, baselines, spines, spreads, mixes and normalisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import circular_mean
from trackloom.operators.joins import BOXES, box_labels, nearest_attached, within_radius
from trackloom.operators.tracks import with_previous
from trackloom.sources.standins import km_sql, oracle, positions, reports, sites, table

T0 = 1_704_067_200.0  # 2024-01-01
DAY = 86_400.0
SPEED_SENTINEL = 102.3
#: Distinct draughts below which nothing is said of a vessel's load.
LEAST_DRAUGHTS = 5


def filtered_counts(log: DataFrame) -> DataFrame:
    """Several conditional aggregates in one scan."""
    return log.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("speed") > 50).alias("fast"),
        F.round(F.sum(F.when(F.col("on_ground"), F.col("speed"))), 4).alias("ground_speed"),
        F.min(F.when(~F.col("on_ground"), F.col("altitude"))).alias("lowest_air"),
    )


def distinct_counts(log: DataFrame, by: list[str]) -> DataFrame:
    """Exact distinct entities, all and filtered, with flags and names."""
    return log.groupBy(*by).agg(
        F.countDistinct("entity_id").alias("entities"),
        F.countDistinct(F.when(F.col("on_ground"), F.col("entity_id"))).alias("grounded"),
        F.bool_or(F.coalesce("on_ground", F.lit(False))).alias("any_ground"),
        F.max("kind").alias("name"),
    )


def speed_stats(log: DataFrame, p: float = 0.95) -> DataFrame:
    ok = log.where(F.col("speed") < SPEED_SENTINEL)
    return ok.groupBy("entity_id").agg(F.round(F.percentile("speed", F.lit(p)), 6).alias("p"), F.round(F.stddev_samp("speed"), 6).alias("sd"), F.count("*").alias("n"))


def guarded_median(df: DataFrame, by: str, value: str, least: int = 3) -> DataFrame:
    """The median of positive values, null with fewer than `least` of them."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(by).agg(F.when(F.count(v) >= least, F.median(v)).alias("median"), F.count(v).alias("n"))


def nearest_rank(df: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, int(f * n))] for each fraction.

    Equal values are counted before the shuffle; the running count then passes over distinct values, not rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("m"))
    w = Window.partitionBy(by)
    upto = F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(by, value, upto.alias("upto"), F.sum("m").over(w).alias("n"))
    at = lambda f: F.least(F.col("n") - 1, F.floor(F.lit(f) * F.col("n")))
    return ranked.groupBy(by).agg(*[F.min(F.when(F.col("upto") > at(f), F.col(value))).alias(name) for name, f in fractions.items()])


def cell_of(value: str, res: float) -> Column:
    return F.floor(F.col(value) / res + 1e-9).cast("long")


def lane_cells(log: DataFrame, res: float) -> DataFrame:
    """Density grid: fixes, distinct hulls, hulls by class (an entity's last class in the cell counts) and mean course."""
    course = F.when(F.col("course") < 360, F.radians(F.col("course").cast("double")))
    hulls = log.groupBy(cell_of("lat", res).alias("cy"), cell_of("lon", res).alias("cx"), "entity_id").agg(
        F.count("*").alias("n"), F.sum(F.sin(course)).alias("s"), F.sum(F.cos(course)).alias("c"),
        F.max_by(F.floor(F.col("ship_type") / 10), F.struct("ts", "event_id")).alias("class"),
    )
    degrees = F.pmod(F.degrees(F.atan2(F.sum("s"), F.sum("c"))), F.lit(360.0))
    return hulls.groupBy("cy", "cx").agg(
        F.sum("n").alias("positions"), F.count("*").alias("transits"), F.count_if(F.col("class") == 7).alias("cargo"), F.count_if(F.col("class") == 8).alias("tankers"),
        F.round(F.sum("s"), 6).alias("sum_sin"), F.round(F.sum("c"), 6).alias("sum_cos"), F.round(degrees, 4).alias("course"),
    )


def weighted_centroid(df: DataFrame, by: str, lat: str, lon: str, weight: str) -> DataFrame:
    w = F.greatest(F.col(weight), F.lit(1.0))
    x, y = F.sum(F.cos(F.radians(lon)) * w), F.sum(F.sin(F.radians(lon)) * w)
    return df.groupBy(by).agg(F.round(F.sum(F.col(lat) * w) / F.sum(w), 6).alias("lat"), F.round(F.degrees(F.atan2(y, x)), 6).alias("lon"), F.count("*").alias("n"))


def escalation(df: DataFrame, now: int, baseline_days: int = 7, least: int = 3, ratio: float = 1.5) -> DataFrame:
    """Keys whose last day's count stands out against the days before: (c + 1) / (b + 1), b a mean a day."""
    now_ = F.lit(now)
    current, past = (F.col("day") > now_ - 1) & (F.col("day") <= now_), (F.col("day") > now_ - 1 - baseline_days) & (F.col("day") <= now_ - 1)
    counted = df.where((F.col("day") <= now_) & (F.col("day") > now_ - 1 - baseline_days)).groupBy("category").agg(
        F.count_if(current).alias("current"), F.count_if(past).alias("past"), F.round(F.sum(F.when(current, F.col("severity"))), 4).alias("severity")
    )
    scored = counted.withColumn("ratio", F.round((F.col("current") + 1) / (F.col("past") / baseline_days + 1), 6))
    return scored.where((F.col("current") >= least) & (F.col("ratio") >= ratio)).orderBy(F.desc("ratio"), F.desc("severity"), "category")


def spike_verdicts(df: DataFrame, key: str, now: float, lookback: float, samples: int = 3, span: float = 21_600.0, factor: float = 2.0) -> DataFrame:
    """The newest value of each series against the greatest before it: no_data, immature, too_short, spike or normal."""
    last = F.max_by("value", F.struct("ts", "event_id"))
    newest = df.where(F.col("ts") <= now).groupBy(key).agg(last.alias("current"), F.max(F.struct("ts", "event_id")).alias("at"))
    prior = df.join(newest.select(key, "at"), key).where((F.struct("ts", "event_id") < F.col("at")) & (F.col("ts") >= now - lookback))
    base = prior.groupBy(key).agg(F.count("*").alias("n"), F.max("value").alias("top"), (F.max("ts") - F.min("ts")).alias("span"))
    v = (
        F.when(F.col("n").isNull(), "no_data").when(F.col("n") < samples, "immature").when(F.col("span") < span, "too_short")
        .when(F.col("current") / F.col("top") >= factor, "spike").otherwise("normal")
    )
    return newest.join(base, key, "left").select(key, "current", F.coalesce("n", F.lit(0)).alias("samples"), v.alias("verdict"))


def ranked_counts(df: DataFrame, by: str, k: int) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(k)


def presence(log: DataFrame, boxes: dict[str, tuple], now: float, least: int) -> DataFrame:
    """Distinct entities in each box in the last day and the day before it. Boxes at zero are kept; the trend is null where the feed is thin.

    The feed is thin when either day has under `least` fixes in all, whatever the box.
    """
    last, before = F.col("ts") >= now - DAY, (F.col("ts") >= now - 2 * DAY) & (F.col("ts") < now - DAY)
    recent = log.where((F.col("ts") >= now - 2 * DAY) & (F.col("ts") <= now))
    feed = recent.agg((F.count_if(last) >= least).alias("a"), (F.count_if(before) >= least).alias("b")).select((F.col("a") & F.col("b")).alias("enough"))
    counts = box_labels(recent, boxes).groupBy("box").agg(F.countDistinct(F.when(last, F.col("entity_id"))).alias("today"), F.countDistinct(F.when(before, F.col("entity_id"))).alias("day_before"))
    names = log.sparkSession.createDataFrame([(b,) for b in boxes], "box string")
    joined = names.join(counts, "box", "left").join(F.broadcast(feed))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("box", zero("today"), zero("day_before")).join(F.broadcast(feed)).select("box", "today", "day_before", F.when(F.col("enough"), F.col("today") - F.col("day_before")).alias("trend"))


def port_presence(log: DataFrame, places: DataFrame, now: float, km: float = 25.0) -> DataFrame:
    """Distinct entities at each place (the nearest within km of a fix) in the last day and the day before; places with none are left out."""
    last, before = F.col("ts") >= now - DAY, (F.col("ts") >= now - 2 * DAY) & (F.col("ts") < now - DAY)
    recent = log.where((F.col("ts") >= now - 2 * DAY) & (F.col("ts") <= now)).select("entity_id", "ts", "lat", "lon")
    at = nearest_attached(recent, places, km).where("place_id is not null")
    return at.groupBy("place_id").agg(F.countDistinct(F.when(last, F.col("entity_id"))).alias("today"), F.countDistinct(F.when(before, F.col("entity_id"))).alias("day_before"))


def site_counts(events: DataFrame, places: DataFrame, top: int = 30) -> tuple[DataFrame, DataFrame]:
    """Events within their own radius of each site, the `top` sites; and what was searched: events used, without a radius, without a place.

    events: event_id, lat, lon, radius_km. Each event goes to the cells its radius covers, in one of a few sizes of cells,
    so a large radius isn't many cells and a small one doesn't meet far sites. places: site_id, lat2, lon2.
    """
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    sized = placed & F.coalesce(F.col("radius_km") > 0, F.lit(False))
    searched = events.agg(F.count_if(sized).alias("searched"), F.count_if(placed & ~F.coalesce(F.col("radius_km") > 0, F.lit(False))).alias("without_radius"), F.count_if(~placed).alias("without_place"))
    hits = None
    for low, high in ((0.0, 10.0), (10.0, 100.0), (100.0, 1000.0)):
        part = events.where(sized & (F.col("radius_km") > low) & (F.col("radius_km") <= high)).select("event_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "radius_km")
        near = within_radius(places.select("site_id", "lat2", "lon2"), part, high, l=("lat2", "lon2"), r=("lat1", "lon1")).where("km <= radius_km").select("site_id")
        hits = near if hits is None else hits.unionByName(near)
    ranked = hits.groupBy("site_id").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "site_id").limit(top)
    return ranked, searched


def daily_spine(log: DataFrame, start: float, days: int, whole: int) -> DataFrame:
    """A row per day and kind with counted, partial (under `whole` rows that day) or missing; null where missing, which is not zero."""
    spark = log.sparkSession
    spine = spark.range(days).select(F.col("id").alias("day")).crossJoin(log.select("kind").distinct())
    of_day = F.floor((F.col("ts") - start) / DAY).cast("long")
    counted = log.withColumn("day", of_day).groupBy("day", "kind").agg(F.countDistinct("entity_id").alias("n"))
    seen = log.withColumn("day", of_day).groupBy("day").agg(F.count("*").alias("all"))
    state = F.when(F.col("all").isNull(), "missing").when(F.col("all") < whole, "partial").otherwise("counted")
    return spine.join(counted, ["day", "kind"], "left").join(seen, "day", "left").select("day", "kind", F.when(F.col("all").isNotNull(), F.coalesce("n", F.lit(0))).alias("n"), state.alias("state"))


def hourly_series(log: DataFrame, start: float) -> DataFrame:
    """24 zero-filled hourly counts a kind, as one comma-separated column."""
    hour = F.floor((F.col("ts") - start) / 3600) % 24
    counts = log.groupBy("kind", hour.alias("h")).agg(F.count("*").alias("n"))
    m = counts.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0)))
    return m.select("kind", F.concat_ws(",", F.transform(dense, lambda x: x.cast("string"))).alias("hours"))


def merge_cluster(df: DataFrame) -> DataFrame:
    """One record a cluster (actor and day): primary by priority, maxima, first non-null by priority, distinct union."""
    key = F.struct(F.expr("case status when 'F' then 0 when 'O' then 1 else 2 end"), F.col("report_id"))
    mentions = F.expr("nullif(mentions, 0)")
    first = F.min_by(mentions, F.when(mentions.isNotNull(), key))
    return df.groupBy("actor", "day").agg(
        F.min_by("report_id", key).alias("primary_id"), F.round(F.max("severity"), 4).alias("severity"), first.alias("mentions"),
        F.concat_ws(",", F.array_sort(F.collect_set("category"))).alias("categories"), F.count("*").alias("n"),
    )


def excluded_counts(df: DataFrame) -> DataFrame:
    """Counts by type as columns; one class is counted on its own and left out of the total."""
    n = lambda s: F.count_if(F.col("status") == s)
    return df.groupBy("actor").agg(n("F").alias("f"), n("O").alias("o"), n("P").alias("excluded"), F.count_if(F.col("status") != "P").alias("total"))


def newest_period(df: DataFrame) -> DataFrame:
    """Sums over each actor's newest day only."""
    top = df.groupBy("actor").agg(F.max("day").alias("day"))
    return df.join(top, ["actor", "day"]).groupBy("actor", "day").agg(F.round(F.sum("severity"), 4).alias("severity"), F.countDistinct("category").alias("categories"))


def series_stats(log: DataFrame) -> DataFrame:
    v = F.when(F.col("on_ground").isNotNull(), F.col("value"))
    return log.groupBy("entity_id").agg(
        F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.max_by(v, F.when(v.isNotNull(), F.struct("ts", "event_id"))).alias("latest"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Per field the largest and least publisher estimate, where two or more give one."""
    long = df.selectExpr("p_partkey as id", "stack(3, 'size', cast(p_size as double), 'price', p_retailprice, 'odd', case when p_partkey % 2 = 1 then p_retailprice * 2 end) as (field, v)", "p_brand as publisher")
    got = long.where("v is not null").groupBy("field", "publisher").agg(F.round(F.avg("v"), 6).alias("v"))
    out = got.groupBy("field").agg(
        F.round(F.max("v") - F.min("v"), 6).alias("spread"), F.min_by("publisher", F.struct("v", "publisher")).alias("lowest"),
        F.min_by("publisher", F.struct(-F.col("v"), F.col("publisher"))).alias("highest"), F.count("*").alias("n"),
    )
    return out.where("n >= 2")


def draught_profile(log: DataFrame, laden=0.85, ballast=0.55, least=LEAST_DRAUGHTS) -> DataFrame:
    d = F.when(F.col("draught") > 0, F.round("draught", 1))
    base = log.groupBy("entity_id").agg(
        F.countDistinct(d).alias("samples"), F.max_by(d, F.when(d.isNotNull(), F.struct("ts", "event_id"))).alias("latest"), F.min(d).alias("low"), F.max(d).alias("high")
    )
    r = F.col("latest") / F.col("high")
    verdict = F.when(F.col("samples") < least, "unknown").when(r > laden, "laden").when(r < ballast, "ballast").otherwise("unknown")
    return base.withColumn("state", verdict)


def cell_rollup(log: DataFrame, res: float = 1.0, least: float = 0.25) -> DataFrame:
    flag = F.col("speed") > 100
    out = log.groupBy(cell_of("lat", res).alias("cy"), cell_of("lon", res).alias("cx")).agg(F.count("*").alias("observed"), F.count_if(flag).alias("flagged"))
    return out.withColumn("jammed", F.col("flagged") / F.col("observed") >= least)


def mix(df: DataFrame, by: str) -> DataFrame:
    """Counts with their share of all; the total is a window over the few groups."""
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def unknown_last(df: DataFrame) -> DataFrame:
    g = df.withColumn("g", F.when(F.col("mentions") == 0, "unknown").otherwise(F.concat(F.lit("m"), F.col("mentions"))))
    out = g.groupBy("g").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("g") == "unknown", F.desc("n"), "g"))
    return out.withColumn("place", place)


#: A metric registry: name -> aggregate of the rows of one group.
METRICS: dict[str, Callable[[], Column]] = {
    "customers": lambda: F.count("*").cast("double"), "balance": lambda: F.round(F.sum("c_acctbal"), 2), "debtors": lambda: F.count_if(F.col("c_acctbal") < 0).cast("double"),
    "richest": lambda: F.max("c_acctbal"), "median": lambda: F.when(F.count("*") >= 3, F.median("c_acctbal")),
}


def comparison(df: DataFrame, by: str, groups: list, metrics: dict[str, Callable[[], Column]]) -> DataFrame:
    """Named metrics of the chosen groups, long; `differs` says whether a metric's values do, and a group without rows is `not_collected`."""
    wanted = df.sparkSession.createDataFrame([(g,) for g in groups], f"{by} {df.schema[by].dataType.simpleString()}")
    base = df.join(F.broadcast(wanted), by).groupBy(by).agg(*[f().alias(m) for m, f in metrics.items()])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    long = wanted.join(base, by, "left").select(by, F.explode(pairs).alias("p")).select(by, "p.metric", "p.v")
    differs = long.groupBy("metric").agg((F.countDistinct("v") > 1).alias("differs"))
    return long.join(F.broadcast(differs), "metric").withColumn("state", F.when(F.col("v").isNull(), "not_collected").otherwise("value"))


def choropleth(df: DataFrame, by: str, value: str) -> DataFrame:
    """Percent rank and log-scaled position of each group's sum among all groups."""
    g = df.groupBy(by).agg(F.round(F.sum(value), 4).alias("v"))
    all_ = Window.partitionBy(F.lit(0))  # over groups, not rows
    lg = F.log1p(F.greatest("v", F.lit(0.0)))
    lo, hi = F.min(lg).over(all_), F.max(lg).over(all_)
    return g.select(by, "v", F.round(F.percent_rank().over(all_.orderBy("v")), 9).alias("rank"), F.round((lg - lo) / (hi - lo), 6).alias("log_scale"))


def counter_rates(log: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rate a second of a counter over its samples, resets counted from zero."""
    before = F.col("b.value")
    d = with_previous(log.select(F.col(key).alias("entity_id"), "ts", "event_id", "value"), ["value"]).withColumnRenamed("entity_id", key).withColumn("d", F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.when(before.isNotNull(), F.col("value"))))
    return d.groupBy(key).agg(F.round(F.sum("d") / (F.max("ts") - F.min("ts")), 9).alias("rate"), F.count("*").alias("n"))


def dataset_lag(log: DataFrame, now: float) -> DataFrame:
    return log.groupBy("kind").agg(F.bround((F.lit(now) - F.max("ts")) / DAY, 1).alias("lag_days"))


_BOXES = {**BOXES, "nowhere": (80.0, 0.0, 89.0, 1.0)}


def _sized(s, d):
    return reports(s, d).select(F.col("report_id").alias("event_id"), F.when(F.col("report_id") % 13 != 0, F.col("lat")).alias("lat"), "lon", F.element_at(F.array(*map(F.lit, (5.0, 60.0, 400.0, 0.0))), (F.col("report_id") % 4 + 1).cast("int")).alias("radius_km"))


def _place2(s, d):
    return sites(s, d).select("site_id", F.col("site_lat").alias("lat2"), F.col("site_lon").alias("lon2"))


QUERIES = {
    "agg_filtered": lambda s, d: filtered_counts(positions(s, d)),
    "agg_distinct_hourly": lambda s, d: distinct_counts(positions(s, d).withColumn("hour", F.floor((F.col("ts") - T0) / 3600)), ["hour"]),
    "agg_speed_stats": lambda s, d: speed_stats(positions(s, d)),
    "agg_guarded_median": lambda s, d: guarded_median(reports(s, d), "actor", "mentions"),
    "agg_nearest_rank": lambda s, d: nearest_rank(positions(s, d), "kind", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}),
    "agg_lane_cells": lambda s, d: lane_cells(positions(s, d), 0.05),
    "agg_circular_mean": lambda s, d: positions(s, d).where("course < 360").groupBy("entity_id").agg(F.round(circular_mean("course"), 4).alias("course")),
    "agg_weighted_centroid": lambda s, d: weighted_centroid(sites(s, d), "country", "site_lat", "site_lon", "weight"),
    "agg_escalation": lambda s, d: escalation(reports(s, d), 10_000, least=1, ratio=0.5),
    "agg_spike_verdict": lambda s, d: spike_verdicts(positions(s, d), "entity_id", T0 + 20 * DAY, 5 * DAY),
    "agg_ranked_counts": lambda s, d: ranked_counts(positions(s, d), "entity_id", 30),
    "agg_presence_trend": lambda s, d: presence(positions(s, d), _BOXES, T0 + 12 * DAY, 30),
    "agg_port_presence": lambda s, d: port_presence(positions(s, d), sites(s, d).selectExpr("site_id as place_id", "site_lat as place_lat", "site_lon as place_lon"), T0 + 12 * DAY),
    "agg_site_counts": lambda s, d: site_counts(_sized(s, d), _place2(s, d))[0],
    "agg_site_coverage": lambda s, d: site_counts(_sized(s, d), _place2(s, d))[1],
    "agg_daily_spine": lambda s, d: daily_spine(positions(s, d), T0 - 2 * DAY, 34, 300),
    "agg_hourly_series": lambda s, d: hourly_series(positions(s, d), T0),
    "agg_merge_cluster": lambda s, d: merge_cluster(reports(s, d)),
    "agg_excluded_counts": lambda s, d: excluded_counts(reports(s, d)),
    "agg_newest_period": lambda s, d: newest_period(reports(s, d)),
    "agg_series_stats": lambda s, d: series_stats(positions(s, d)),
    "agg_spread": lambda s, d: spread(table(s, d, "part")),
    "agg_priors": lambda s, d: positions(s, d).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "error").alias("errors"), F.max("ts").alias("last_ts"), F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind")),
    "agg_draught_profile": lambda s, d: draught_profile(positions(s, d)),
    "agg_cell_rollup": lambda s, d: cell_rollup(positions(s, d)),
    "agg_mix": lambda s, d: mix(reports(s, d), "category"),
    "agg_unknown_last": lambda s, d: unknown_last(reports(s, d)),
    "agg_comparison": lambda s, d: comparison(table(s, d, "customer"), "c_nationkey", [1, 2, 3, 5, 99], METRICS),
    "agg_choropleth": lambda s, d: choropleth(table(s, d, "customer"), "c_nationkey", "c_acctbal"),
    "agg_counter_rates": lambda s, d: counter_rates(positions(s, d)),
    "agg_dataset_lag": lambda s, d: dataset_lag(positions(s, d), T0 + 40 * DAY),
    "agg_gate_counters": lambda s, d: reports(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("mentions") >= 3).alias("reach"), F.count_if((F.col("mentions") >= 3) & (F.col("status") == "F")).alias("independent"), F.count_if(F.col("severity") > 400000).alias("severe")),
}

_D = str(DAY)
ORACLES = {
    "agg_filtered": oracle("positions", "SELECT kind, count(*) AS n, count(*) FILTER (speed > 50) AS fast, round(sum(speed) FILTER (on_ground), 4) AS ground_speed, min(altitude) FILTER (NOT on_ground) AS lowest_air FROM positions GROUP BY kind"),
    "agg_distinct_hourly": oracle("positions", f"SELECT CAST(floor((ts - {T0}) / 3600) AS BIGINT) AS hour, count(DISTINCT entity_id) AS entities, count(DISTINCT entity_id) FILTER (on_ground) AS grounded, bool_or(coalesce(on_ground, false)) AS any_ground, max(kind) AS name FROM positions GROUP BY 1"),
    "agg_speed_stats": oracle("positions", "SELECT entity_id, round(quantile_cont(speed, 0.95), 6) AS p, round(stddev_samp(speed), 6) AS sd, count(*) AS n FROM positions WHERE speed < 102.3 GROUP BY 1"),
    "agg_guarded_median": oracle("reports", "SELECT actor, CASE WHEN count(*) FILTER (mentions > 0) >= 3 THEN median(mentions) FILTER (mentions > 0) END AS median, count(*) FILTER (mentions > 0) AS n FROM reports GROUP BY 1"),
    "agg_nearest_rank": oracle("positions", "SELECT kind, v[CAST(least(n - 1, floor(0.5 * n)) AS BIGINT) + 1] AS p50, v[CAST(least(n - 1, floor(0.95 * n)) AS BIGINT) + 1] AS p95, v[CAST(least(n - 1, floor(0.99 * n)) AS BIGINT) + 1] AS p99 FROM (SELECT kind, list(value ORDER BY value) AS v, count(*) AS n FROM positions GROUP BY 1)"),
    "agg_lane_cells": oracle(
        "positions",
        """SELECT cy, cx, CAST(sum(n) AS BIGINT) AS positions, count(*) AS transits, count(*) FILTER (class = 7) AS cargo, count(*) FILTER (class = 8) AS tankers,
        round(sum(s), 6) AS sum_sin, round(sum(c), 6) AS sum_cos, round(((degrees(atan2(sum(s), sum(c))) % 360) + 360) % 360, 4) AS course FROM h GROUP BY ALL""",
        """h AS (SELECT CAST(floor(lat / 0.05 + 1e-9) AS BIGINT) AS cy, CAST(floor(lon / 0.05 + 1e-9) AS BIGINT) AS cx, entity_id, count(*) AS n, sum(sin(radians(course))) FILTER (course < 360) AS s,
        sum(cos(radians(course))) FILTER (course < 360) AS c, arg_max(ship_type // 10, {'ts': ts, 'e': event_id}) AS class FROM positions GROUP BY ALL)""",
    ),
    "agg_circular_mean": oracle("positions", "SELECT entity_id, round(((degrees(atan2(sum(sin(radians(course))), sum(cos(radians(course))))) % 360) + 360) % 360, 4) AS course FROM positions WHERE course < 360 GROUP BY 1"),
    "agg_weighted_centroid": oracle("sites", "SELECT country, round(sum(site_lat * w) / sum(w), 6) AS lat, round(degrees(atan2(sum(sin(radians(site_lon)) * w), sum(cos(radians(site_lon)) * w))), 6) AS lon, count(*) AS n FROM (SELECT *, greatest(weight, 1.0) AS w FROM sites) GROUP BY 1"),
    "agg_escalation": oracle(
        "reports", "SELECT * FROM (SELECT category, current, past, severity, round((current + 1) / (past / 7 + 1), 6) AS ratio FROM c) WHERE current >= 1 AND ratio >= 0.5",
        "c AS (SELECT category, count(*) FILTER (day > 9999) AS current, count(*) FILTER (day <= 9999) AS past, round(sum(severity) FILTER (day > 9999), 4) AS severity FROM reports WHERE day <= 10000 AND day > 9992 GROUP BY 1)",
    ),
    "agg_spike_verdict": oracle(
        "positions",
        "SELECT entity_id, current, coalesce(n, 0) AS samples, CASE WHEN n IS NULL THEN 'no_data' WHEN n < 3 THEN 'immature' WHEN span < 21600 THEN 'too_short' WHEN current / top >= 2 THEN 'spike' ELSE 'normal' END AS verdict FROM l LEFT JOIN b USING (entity_id)",
        f"p AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS k FROM positions WHERE ts <= {T0 + 20 * DAY})",
        "l AS (SELECT entity_id, value AS current FROM p WHERE k = 1)",
        f"b AS (SELECT entity_id, count(*) AS n, max(value) AS top, max(ts) - min(ts) AS span FROM p WHERE k > 1 AND ts >= {T0 + 15 * DAY} GROUP BY 1)",
    ),
    "agg_ranked_counts": oracle("positions", "SELECT entity_id, count(*) AS n FROM positions GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 30"),
    "agg_presence_trend": oracle(
        "positions", f"SELECT box, count(DISTINCT entity_id) FILTER (ts >= {T0 + 11 * DAY}) AS today, count(DISTINCT entity_id) FILTER (ts < {T0 + 11 * DAY}) AS day_before, CASE WHEN (SELECT count(*) FILTER (ts >= {T0 + 11 * DAY}) >= 30 AND count(*) FILTER (ts < {T0 + 11 * DAY}) >= 30 FROM r) THEN count(DISTINCT entity_id) FILTER (ts >= {T0 + 11 * DAY}) - count(DISTINCT entity_id) FILTER (ts < {T0 + 11 * DAY}) END AS trend FROM b LEFT JOIN r ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1",
        f"r AS (SELECT * FROM positions WHERE ts >= {T0 + 10 * DAY} AND ts <= {T0 + 12 * DAY})", f"b(box, s, w, n, e) AS (VALUES {', '.join(str((k, *v)) for k, v in _BOXES.items())})",
    ),
    "agg_port_presence": oracle(
        "positions sites", f"SELECT site_id AS place_id, count(DISTINCT entity_id) FILTER (ts >= {T0 + 11 * DAY}) AS today, count(DISTINCT entity_id) FILTER (ts < {T0 + 11 * DAY}) AS day_before FROM n GROUP BY 1",
        f"n AS (SELECT * FROM (SELECT event_id, entity_id, ts, site_id, {km_sql('lat', 'lon', 'site_lat', 'site_lon')} AS km FROM positions, sites WHERE ts >= {T0 + 10 * DAY} AND ts <= {T0 + 12 * DAY}) WHERE km <= 25 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(km, 9), site_id DESC) = 1)",
    ),
    "agg_site_counts": oracle("reports sites", f"SELECT site_id, count(*) AS events FROM (SELECT site_id, {km_sql('lat', 'lon', 'site_lat', 'site_lon')} AS km, [5.0, 60.0, 400.0, 0.0][report_id % 4 + 1] AS r FROM reports, sites WHERE report_id % 13 <> 0) WHERE r > 0 AND km <= r GROUP BY 1 ORDER BY events DESC, site_id LIMIT 30"),
    "agg_site_coverage": oracle("reports", "SELECT count(*) FILTER (report_id % 13 <> 0 AND report_id % 4 <> 3) AS searched, count(*) FILTER (report_id % 13 <> 0 AND report_id % 4 = 3) AS without_radius, count(*) FILTER (report_id % 13 = 0) AS without_place FROM reports"),
    "agg_daily_spine": oracle(
        "positions",
        "SELECT d.day, k.kind, CASE WHEN a IS NOT NULL THEN coalesce(n, 0) END AS n, CASE WHEN a IS NULL THEN 'missing' WHEN a < 300 THEN 'partial' ELSE 'counted' END AS state FROM range(34) d(day) CROSS JOIN (SELECT DISTINCT kind FROM positions) k LEFT JOIN c ON c.day = d.day AND c.kind = k.kind LEFT JOIN s ON s.day = d.day",
        f"c AS (SELECT CAST(floor((ts - {T0 - 2 * DAY}) / {_D}) AS BIGINT) AS day, kind, count(DISTINCT entity_id) AS n FROM positions GROUP BY ALL)",
        f"s AS (SELECT CAST(floor((ts - {T0 - 2 * DAY}) / {_D}) AS BIGINT) AS day, count(*) AS a FROM positions GROUP BY ALL)",
    ),
    "agg_hourly_series": oracle("positions", f"SELECT k.kind, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY r.h) AS hours FROM (SELECT DISTINCT kind FROM positions) k CROSS JOIN range(24) r(h) LEFT JOIN c ON c.kind = k.kind AND c.h = r.h GROUP BY 1", f"c AS (SELECT kind, CAST(floor((ts - {T0}) / 3600) AS BIGINT) % 24 AS h, count(*) AS n FROM positions GROUP BY ALL)"),
    "agg_merge_cluster": oracle(
        "reports",
        """SELECT actor, day, arg_min(report_id, k) AS primary_id, round(max(severity), 4) AS severity, arg_min(nullif(mentions, 0), k) FILTER (mentions > 0) AS mentions,
        string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n FROM r GROUP BY ALL""",
        "r AS (SELECT *, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 1000000000 + report_id AS k FROM reports)",
    ),
    "agg_excluded_counts": oracle("reports", "SELECT actor, count(*) FILTER (status = 'F') AS f, count(*) FILTER (status = 'O') AS o, count(*) FILTER (status = 'P') AS excluded, count(*) FILTER (status <> 'P') AS total FROM reports GROUP BY 1"),
    "agg_newest_period": oracle("reports", "SELECT actor, day, round(sum(severity), 4) AS severity, count(DISTINCT category) AS categories FROM reports r WHERE day = (SELECT max(day) FROM reports x WHERE x.actor = r.actor) GROUP BY ALL"),
    "agg_series_stats": oracle("positions", "SELECT entity_id, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, arg_max(value, {'t': ts, 'e': event_id}) AS latest FROM positions WHERE on_ground IS NOT NULL GROUP BY 1"),
    "agg_spread": """WITH l AS (SELECT 'size' AS field, CAST(p_size AS DOUBLE) AS v, p_brand AS publisher FROM part UNION ALL SELECT 'price', p_retailprice, p_brand FROM part UNION ALL SELECT 'odd', p_retailprice * 2, p_brand FROM part WHERE p_partkey % 2 = 1),
        g AS (SELECT field, publisher, round(avg(v), 6) AS v FROM l GROUP BY ALL)
        SELECT field, round(max(v) - min(v), 6) AS spread, arg_min(publisher, {'v': v, 'p': publisher}) AS lowest, arg_min(publisher, {'v': -v, 'p': publisher}) AS highest, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2""",
    "agg_priors": oracle("positions", "SELECT entity_id, count(*) AS n, count(*) FILTER (kind = 'error') AS errors, max(ts) AS last_ts, arg_max(kind, {'t': ts, 'e': event_id}) AS last_kind FROM positions GROUP BY 1"),
    "agg_draught_profile": oracle(
        "positions", "SELECT *, CASE WHEN samples < 5 THEN 'unknown' WHEN latest / high > 0.85 THEN 'laden' WHEN latest / high < 0.55 THEN 'ballast' ELSE 'unknown' END AS state FROM g",
        "g AS (SELECT entity_id, count(DISTINCT round(draught, 1)) FILTER (draught > 0) AS samples, arg_max(round(draught, 1), {'t': ts, 'e': event_id}) FILTER (draught > 0) AS latest, min(round(draught, 1)) FILTER (draught > 0) AS low, max(round(draught, 1)) FILTER (draught > 0) AS high FROM positions GROUP BY 1)",
    ),
    "agg_cell_rollup": oracle("positions", "SELECT cy, cx, observed, flagged, flagged / observed >= 0.25 AS jammed FROM (SELECT CAST(floor(lat + 1e-9) AS BIGINT) AS cy, CAST(floor(lon + 1e-9) AS BIGINT) AS cx, count(*) AS observed, count(*) FILTER (speed > 100) AS flagged FROM positions GROUP BY ALL)"),
    "agg_mix": oracle("reports", "SELECT category, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT category, count(*) AS n FROM reports GROUP BY 1)"),
    "agg_unknown_last": oracle("reports", "SELECT g, n, CAST(row_number() OVER (ORDER BY g = 'unknown', n DESC, g) AS INT) AS place FROM (SELECT CASE WHEN mentions = 0 THEN 'unknown' ELSE 'm' || mentions END AS g, count(*) AS n FROM reports GROUP BY 1)"),
    "agg_comparison": """WITH w(c_nationkey) AS (VALUES (1), (2), (3), (5), (99)), b AS (SELECT w.c_nationkey, CASE WHEN count(c_custkey) > 0 THEN CAST(count(c_custkey) AS DOUBLE) END AS customers, round(sum(c_acctbal), 2) AS balance, CASE WHEN count(c_custkey) > 0 THEN CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) END AS debtors, max(c_acctbal) AS richest,
        CASE WHEN count(c_custkey) >= 3 THEN median(c_acctbal) END AS median FROM w LEFT JOIN customer c ON c.c_nationkey = w.c_nationkey GROUP BY 1),
        l AS (SELECT c_nationkey, unnest(['customers', 'balance', 'debtors', 'richest', 'median']) AS metric, unnest([customers, balance, debtors, richest, median]) AS v FROM b)
        SELECT metric, c_nationkey, v, (SELECT count(DISTINCT x.v) > 1 FROM l x WHERE x.metric = l.metric) AS differs, CASE WHEN v IS NULL THEN 'not_collected' ELSE 'value' END AS state FROM l""",
    "agg_choropleth": """WITH g AS (SELECT c_nationkey, round(sum(c_acctbal), 4) AS v FROM customer GROUP BY 1), s AS (SELECT *, ln(1 + greatest(v, 0.0)) AS lg FROM g)
        SELECT c_nationkey, v, round(percent_rank() OVER (ORDER BY v), 9) AS rank, round((lg - min(lg) OVER ()) / (max(lg) OVER () - min(lg) OVER ()), 6) AS log_scale FROM s""",
    "agg_counter_rates": oracle("positions", "SELECT entity_id, round(sum(CASE WHEN value >= b THEN value - b WHEN b IS NOT NULL THEN value END) / (max(ts) - min(ts)), 9) AS rate, count(*) AS n FROM (SELECT *, lag(value) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS b FROM positions) GROUP BY 1"),
    "agg_dataset_lag": oracle("positions", f"SELECT kind, round_even(({T0 + 40 * DAY} - max(ts)) / {_D}, 1) AS lag_days FROM positions GROUP BY 1"),
    "agg_gate_counters": oracle("reports", "SELECT count(*) AS n, count(*) FILTER (mentions >= 3) AS reach, count(*) FILTER (mentions >= 3 AND status = 'F') AS independent, count(*) FILTER (severity > 400000) AS severe FROM reports"),
}
