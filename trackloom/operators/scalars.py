"""Scalar functions as column expressions: geometry, scores, cleaning, identifiers, dates, URLs, formats and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import destination, initial_bearing, lon_reach, planar_km, wrap_lon
from trackloom.sources.standins import oracle, positions, reports, sites, table

#: Base severity by the label of an event; the longest label that the event's own holds counts.
SEVERITY_BASE = {
    "Ethnic cleansing": 50, "Mass killing": 50, "Weapons of mass destruction": 55, "Mass expulsion": 45, "Mass violence": 45, "One-sided violence": 45, "Unconventional mass violence": 45,
    "Suicide bombing": 45, "Aerial bombardment": 45, "Violence against civilians": 40, "State-based armed conflict": 40, "Artillery or armour": 40, "Vehicle bombing": 40, "Roadside bombing": 38,
    "Assassination": 38, "Bombing": 38, "Blockade or siege": 36, "Small-arms fighting": 35, "Fighting": 35, "Non-state conflict": 35, "Battle": 35, "Explosion": 35, "Ceasefire violation": 33, "Killing": 33,
    "Abduction or hostage-taking": 32, "Occupation of territory": 30, "Assault": 30, "Physical assault": 30, "Use of conventional force": 28, "Unconventional violence": 28,
}
#: The base of other labels, what confidence a location's precision leaves, and reliability by tier of the best outlet.
SEVERITY_OTHER = 20.0
PRECISION_CONFIDENCE = {"country": 0.70, "capital": 0.70, "region": 0.85, "unknown": 0.80, "locality": 1.0}
RELIABILITY_BASE = {1: 82.0, 2: 60.0, 3: 20.0}


def severity(label: Column, fatalities: Column, outlets: Column, datasets: Column, has_notes: Column, goldstein: Column, jamming: Column, thermal: Column, precision: Column | None = None) -> Column:
    """0 to 100, truncated: (base by label + dead + reach + headline + hostility) times confidence, plus evidence.

    Confidence is 1 with three outlets, .88 with two, else 1 if a second dataset has it and .7 if not; .92 of that without
    notes. A precision column applies PRECISION_CONFIDENCE too (the policy `demote`). Nulls count as 0, false or one dataset.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    low, sets = F.lower(F.trim(label)), F.greatest(zero(datasets), F.lit(1))
    base = F.coalesce(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(float(v))) for k, v in sorted(SEVERITY_BASE.items(), key=lambda x: -len(x[0]))], F.lit(SEVERITY_OTHER))
    size = base + F.least(F.sqrt(zero(fatalities)) * 8, F.lit(30.0)) + F.least(F.log10(zero(outlets) + 1.0) * 18, F.lit(22.0)) + F.when(no(has_notes), 6.0).otherwise(0.0)
    size = size + F.least(F.greatest(-zero(goldstein), F.lit(0.0)), F.lit(10.0)) * 0.5
    sure = F.when(zero(outlets) >= 3, 1.0).when(zero(outlets) == 2, 0.88).when(sets > 1, 1.0).otherwise(0.7)
    if precision is not None:
        sure = sure * F.coalesce(*[F.when(precision == k, F.lit(v)) for k, v in PRECISION_CONFIDENCE.items()], F.lit(1.0))
    sure = sure * F.when(no(has_notes), 1.0).otherwise(0.92)
    evidence = F.least((sets - 1) * 10.0, F.lit(20.0)) + F.when(no(jamming), 10.0).otherwise(0.0) + F.when(no(thermal), 8.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(size * sure + evidence, F.lit(100.0))).cast("int")


def reliability(structured: Column, tier: Column, outlets: Column, datasets: Column, has_notes: Column, doubted: Column, non_news: Column, months: Column) -> Column:
    """1 to 99, halves rounded to even: a base by who reported, plus capped reach (log10 of the outlets, of two or more) and a second dataset, less penalties.

    tier is that of the best outlet, null where there is none; months is the age of the address, null where it isn't known.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    by_tier = F.coalesce(*[F.when(tier == k, F.lit(v)) for k, v in RELIABILITY_BASE.items()])
    score = F.when(no(structured), 88.0).otherwise(F.coalesce(by_tier, F.lit(10.0))) + F.when(zero(outlets) > 1, F.least(F.log10(zero(outlets).cast("double")) * 14, F.lit(12.0))).otherwise(0.0)
    score = score + F.when(zero(datasets) > 1, 8.0).otherwise(0.0) - F.when(no(has_notes), 0.0).otherwise(10.0) - F.when(no(doubted), 12.0).otherwise(0.0) - F.when(no(non_news), 18.0).otherwise(0.0)
    score = score - F.when(zero(months) >= 1, F.least(months * 5.0, F.lit(20.0))).otherwise(0.0)
    return F.greatest(F.lit(1.0), F.least(F.bround(score), F.lit(99.0))).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").when(score >= 25, "low").otherwise("very_low")


def speed_or_null(v: Column) -> Column:
    return F.when(v < 102.3, v)


def course_or_null(v: Column) -> Column:
    return F.when((v >= 0) & (v < 360), v)


def ship_class(t: Column) -> Column:
    return F.when(t.between(60, 69), "passenger").when(t.between(70, 79), "cargo").when(t.between(80, 89), "tanker").when(t == 30, "fishing").when(t == 35, "military").otherwise("other")


def host(url: Column) -> Column:
    """Lower-cased host without www., null where there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", ""), F.lit(""))


def strip_tracking(url: Column) -> Column:
    """The URL without fragment and utm_*, ref parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    cut = F.regexp_replace(bare, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(cut, "&&+", "&"), r"[?&]+$", "")


def largest_number(text: Column, pattern: str) -> Column:
    """The greatest of a pattern's numbers in a text, null without one."""
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    return F.array_max(F.transform(found, lambda x: x.try_cast("long")))


def identifier(value: Column, length: int) -> Column:
    """The digits of a value, null unless there are `length` of them."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return F.when(F.length(digits) == length, digits)


def unpack_eta(packed: Column) -> list[Column]:
    """Month (4 bits), day (5), hour (5) and minute (6) of a packed time; sentinels 0, 0, 24 and 60 are null."""
    part = lambda shift, bits: F.shiftright(packed, shift).bitwiseAND((1 << bits) - 1)
    return [F.when(part(16, 4) != 0, part(16, 4)), F.when(part(11, 5) != 0, part(11, 5)), F.when(part(6, 5) < 24, part(6, 5)), F.when(part(0, 6) < 60, part(0, 6))]


def any_date(text: Column) -> Column:
    """A date in one of several forms, null where none fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "yyyy/MM/dd")])


def age_opacity(hours: Column) -> Column:
    """1 up to 6 hours, falling to 0.3 at 72, in steps of 0.05."""
    raw = F.when(hours <= 6, 1.0).when(hours >= 72, 0.3).otherwise(1 - 0.7 * (hours - 6) / 66)
    return F.floor(raw / 0.05 + 0.5) * 5 / 100


def parse_dms(text: Column) -> Column:
    """Decimal degrees of `12 34 56 S`-like text."""
    g = lambda k: F.regexp_extract(text, r"^\s*(\d+)\D+(\d+)\D+(\d+)\D*([NSEW])", k)
    v = g(1).cast("double") + g(2).cast("double") / 60 + g(3).cast("double") / 3600
    return F.when(g(4) == "", F.lit(None).cast("double")).when(g(4).isin("S", "W"), -v).otherwise(v)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of structs (x, y)."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, i)
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: at(i)["x"] * at(F.pmod(i, n) + 1)["y"] - at(F.pmod(i, n) + 1)["x"] * at(i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray casting over an array of structs (x, y)."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.pmod(i, n) + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda acc, i: acc != F.coalesce(crosses(i), F.lit(False)))


_DMS = lambda: F.concat_ws(" ", (F.col("event_id") % 180).cast("string"), (F.col("event_id") % 60).cast("string"), (F.col("event_id") % 59).cast("string"), F.element_at(F.array(*map(F.lit, "NSEW")), (F.col("event_id") % 4 + 1).cast("int")))
_GRADED = ("label", "dead", "outlets", "datasets", "has_notes", "goldstein", "jamming", "thermal")
_JUDGED = ("structured", "tier", "outlets", "datasets", "has_notes", "doubted", "non_news", "months")
_LABELS = ("Battle", " small-arms fighting near", "Suicide bombing", "unconventional mass violence", "Protest", "Killing")
_RING = lambda: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-100, -40), (80, -30), (20, 0), (90, 45), (-60, 30))])


def _graded(s, d):
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("report_id") % len(_LABELS) + 1).cast("int"))
    return reports(s, d).select(
        "report_id", label.alias("label"), F.expr("nullif(mentions * 2, 0)").alias("dead"), (F.col("actor") % 5).alias("outlets"), F.expr("nullif(report_id % 4, 0)").alias("datasets"), (F.col("report_id") % 3 != 0).alias("has_notes"),
        (F.col("actor") % 21 - 10.0).alias("goldstein"), (F.col("report_id") % 7 == 0).alias("jamming"), (F.col("report_id") % 11 == 0).alias("thermal"), F.expr("element_at(array('country', 'region', 'locality', null), cast(actor % 4 + 1 as int))").alias("precision"),
    )


def _judged(s, d):
    return reports(s, d).select(
        "report_id", (F.col("report_id") % 9 == 0).alias("structured"), F.expr("nullif(mentions % 4, 0)").alias("tier"), (F.col("actor") % 12).alias("outlets"), (F.col("report_id") % 3).alias("datasets"), (F.col("report_id") % 5 != 0).alias("has_notes"),
        (F.col("actor") % 7 == 0).alias("doubted"), (F.col("actor") % 11 == 0).alias("non_news"), F.expr("nullif(report_id % 6, 3)").alias("months"),
    )


QUERIES = {
    "fn_bearing": lambda s, d: sites(s, d).select("site_id", F.round(initial_bearing("site_lat", "site_lon", 10.0, 20.0), 6).alias("bearing"), *[F.round(c, 6).alias(n) for c, n in zip(destination("site_lat", "site_lon", 75.0, 300.0), ("to_lat", "to_lon"))]),
    "fn_planar": lambda s, d: positions(s, d).select("event_id", F.round(planar_km("lat", "lon", 5.0, 6.0), 6).alias("km"), F.round(wrap_lon(F.col("lon") * 3), 6).alias("wrapped"), lon_reach("lat", 250.0, 0.5).alias("reach")),
    "fn_severity": lambda s, d: _graded(s, d).select("report_id", severity(*[F.col(c) for c in _GRADED], precision=F.col("precision")).alias("score")),
    "fn_reliability": lambda s, d: _judged(s, d).select("report_id", reliability(*[F.col(c) for c in _JUDGED]).alias("score")).withColumn("band", band(F.col("score"))),
    "fn_sentinels": lambda s, d: positions(s, d).select("event_id", speed_or_null(F.col("speed")).alias("speed"), course_or_null(F.col("course").cast("double")).alias("course"), ship_class(F.col("ship_type")).alias("class")),
    "fn_urls": lambda s, d: table(s, d, "pages").select("page_id", host(F.col("url")).alias("host"), strip_tracking(F.col("url")).alias("clean")),
    "fn_largest_number": lambda s, d: table(s, d, "documents").select("doc_id", largest_number(F.col("text"), r"(?<!\w)(\d{1,6})(?!\w)").alias("n")),
    "fn_identifiers": lambda s, d: table(s, d, "customer").select("c_custkey", identifier(F.col("c_name"), 9).alias("ident")),
    "fn_unpack_eta": lambda s, d: positions(s, d).withColumn("p", (F.col("event_id") * 977) % 1_048_576).select("event_id", *[c.cast("long").alias(n) for c, n in zip(unpack_eta(F.col("p")), ("month", "day", "hour", "minute"))]),
    "fn_dates": lambda s, d: table(s, d, "orders").select("o_orderkey", F.datediff(any_date(F.expr("case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'yyyyMMdd') when 2 then date_format(o_orderdate, 'dd.MM.yyyy') else 'soon' end")), F.lit("1970-01-01").cast("date")).alias("day")),
    "fn_age_opacity": lambda s, d: positions(s, d).select("event_id", age_opacity(F.col("speed")).alias("opacity")),
    "fn_dms": lambda s, d: positions(s, d).select("event_id", F.round(parse_dms(_DMS()), 9).alias("degrees")),
    "fn_in_ring": lambda s, d: reports(s, d).select("report_id", in_ring(_RING(), F.col("lon"), F.col("lat")).alias("inside")),
    "fn_templates": lambda s, d: reports(s, d).select("report_id", F.concat_ws(" ", F.initcap(F.lower("status")), F.when(F.col("mentions") > 0, F.concat(F.lit("seen by "), F.col("mentions").cast("string"))), F.concat(F.lit("("), F.lower("category"), F.lit(")"))).alias("sentence")),
    "fn_keywords": lambda s, d: table(s, d, "documents").select("doc_id", F.when(F.col("text").rlike("(?i)license|copyright"), "legal").when(F.col("text").rlike(r"[\w.]+@[\w.]+"), "contact").when(F.col("text").rlike("token|secret|key"), "secret").otherwise("plain").alias("kind")),
}

_BR = lambda a, b, c, d: f"(((degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b})))) % 360) + 360) % 360)"
_A = "asin(sin(radians(site_lat)) * cos(300.0::DOUBLE / 6371.0088) + cos(radians(site_lat)) * sin(300.0::DOUBLE / 6371.0088) * cos(radians(75.0)))"
_O = f"degrees(radians(site_lon) + atan2(sin(radians(75.0)) * sin(300.0::DOUBLE / 6371.0088) * cos(radians(site_lat)), cos(300.0::DOUBLE / 6371.0088) - sin(radians(site_lat)) * sin({_A})))"
ORACLES = {
    "fn_bearing": oracle("sites", f"SELECT site_id, round({_BR('site_lat', 'site_lon', '10.0', '20.0')}, 6) AS bearing, round(degrees({_A}), 6) AS to_lat, round((({_O} + 180) % 360 + 360) % 360 - 180, 6) AS to_lon FROM sites"),
    "fn_planar": oracle("positions", "SELECT event_id, round(111.32 * sqrt(power(5.0 - lat, 2) + power((6.0 - lon) * cos(radians((lat + 5.0) / 2)), 2)), 6) AS km, round(((lon * 3 + 180) % 360 + 360) % 360 - 180, 6) AS wrapped, CAST(ceil(250.0 / (111.32 * greatest(cos(radians(lat)), 0.1) * 0.5)) AS INT) AS reach FROM positions"),
    "fn_severity": oracle(
        "reports",
        """SELECT report_id, CAST(trunc(greatest(0, least((base + least(sqrt(mentions * 2) * 8, 30) + least(log10(actor % 5 + 1) * 18, 22) + n * 6 + least(greatest(-(actor % 21 - 10), 0), 10) * 0.5::DOUBLE)
        * CASE WHEN actor % 5 >= 3 THEN 1.0 WHEN actor % 5 = 2 THEN 0.88 WHEN sets > 1 THEN 1.0 ELSE 0.7 END::DOUBLE * CASE actor % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 0.85 ELSE 1.0 END::DOUBLE * CASE WHEN n = 1 THEN 1.0 ELSE 0.92 END::DOUBLE
        + least((sets - 1) * 10, 20) + CASE WHEN report_id % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN report_id % 11 = 0 THEN 8 ELSE 0 END, 100))) AS INT) AS score
        FROM (SELECT *, CASE report_id % 6 WHEN 0 THEN 35 WHEN 1 THEN 35 WHEN 2 THEN 45 WHEN 3 THEN 45 WHEN 4 THEN 20 ELSE 33 END AS base, greatest(report_id % 4, 1) AS sets, CASE WHEN report_id % 3 <> 0 THEN 1 ELSE 0 END AS n FROM reports)""",
    ),
    "fn_reliability": oracle(
        "reports",
        """SELECT report_id, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' WHEN score >= 25 THEN 'low' ELSE 'very_low' END AS band FROM (SELECT report_id, CAST(greatest(1, least(99, round_even(
        CASE WHEN report_id % 9 = 0 THEN 88 ELSE CASE mentions % 4 WHEN 1 THEN 82 WHEN 2 THEN 60 WHEN 3 THEN 20 ELSE 10 END END + CASE WHEN actor % 12 > 1 THEN least(log10(actor % 12) * 14, 12) ELSE 0 END + CASE WHEN report_id % 3 > 1 THEN 8 ELSE 0 END
        - CASE WHEN report_id % 5 = 0 THEN 10 ELSE 0 END - CASE WHEN actor % 7 = 0 THEN 12 ELSE 0 END - CASE WHEN actor % 11 = 0 THEN 18 ELSE 0 END - CASE WHEN report_id % 6 IN (1, 2, 4, 5) THEN least(report_id % 6 * 5, 20) ELSE 0 END, 0))) AS INT) AS score FROM reports)""",
    ),
    "fn_sentinels": oracle("positions", "SELECT event_id, CASE WHEN speed < 102.3 THEN speed END AS speed, CASE WHEN course < 360 THEN CAST(course AS DOUBLE) END AS course, CASE WHEN ship_type BETWEEN 60 AND 69 THEN 'passenger' WHEN ship_type BETWEEN 70 AND 79 THEN 'cargo' WHEN ship_type BETWEEN 80 AND 89 THEN 'tanker' WHEN ship_type = 30 THEN 'fishing' WHEN ship_type = 35 THEN 'military' ELSE 'other' END AS class FROM positions"),
    "fn_urls": r"SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', ''), '') AS host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '[?&]+$', '') AS clean FROM pages",
    "fn_largest_number": r"SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '\b(\d{1,6})\b', 1), lambda x: CAST(x AS BIGINT))) AS n FROM documents",
    "fn_identifiers": "SELECT c_custkey, CASE WHEN length(regexp_replace(c_name, '[^0-9]', '', 'g')) = 9 THEN regexp_replace(c_name, '[^0-9]', '', 'g') END AS ident FROM customer",
    "fn_unpack_eta": "SELECT event_id, nullif((p >> 16) & 15, 0) AS month, nullif((p >> 11) & 31, 0) AS day, CASE WHEN (p >> 6) & 31 < 24 THEN (p >> 6) & 31 END AS hour, CASE WHEN p & 63 < 60 THEN p & 63 END AS minute FROM (SELECT event_id, (event_id * 977) % 1048576 AS p FROM events)",
    "fn_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) END AS day FROM orders",
    "fn_age_opacity": oracle("positions", "SELECT event_id, floor(CASE WHEN speed <= 6 THEN 1.0::DOUBLE WHEN speed >= 72 THEN 0.3::DOUBLE ELSE 1 - 0.7::DOUBLE * (speed - 6) / 66 END / 0.05::DOUBLE + 0.5::DOUBLE) * 5 / 100 AS opacity FROM positions"),
    "fn_dms": "SELECT event_id, round(CASE WHEN event_id % 4 IN (1, 3) THEN -1 ELSE 1 END * ((event_id % 180)::DOUBLE + (event_id % 60)::DOUBLE / 60 + (event_id % 59)::DOUBLE / 3600), 9) AS degrees FROM events",
    "fn_in_ring": oracle(
        "reports", "SELECT report_id, count(x1) % 2 = 1 AS inside FROM reports LEFT JOIN e ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY 1",
        "e(x1, y1, x2, y2) AS (VALUES (-100.0::DOUBLE, -40.0::DOUBLE, 80.0::DOUBLE, -30.0::DOUBLE), (80, -30, 20, 0), (20, 0, 90, 45), (90, 45, -60, 30), (-60, 30, -100, -40))",
    ),
    "fn_templates": oracle("reports", "SELECT report_id, concat_ws(' ', status, CASE WHEN mentions > 0 THEN 'seen by ' || mentions END, '(' || lower(category) || ')') AS sentence FROM reports"),
    "fn_keywords": r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license|copyright') THEN 'legal' WHEN regexp_matches(text, '[\w.]+@[\w.]+') THEN 'contact' WHEN regexp_matches(text, 'token|secret|key') THEN 'secret' ELSE 'plain' END AS kind FROM documents",
}
