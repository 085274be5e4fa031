"""Text for readers and codes for machines: cleaning, outlets, flags, formats, sentences, kinds and feature identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import DEGREE_KM
from trackloom.sources.standins import oracle, positions, reports, sites, table

KM_PER_MI, KM_PER_NM = 1.609344, 1.852
#: Entities that plain text may hold, and month names of arrival times.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: What a title's words say about the act, the weightiest kind first. `*` stands for any ending, `/` for a choice, `+` for two
#: words in either order with up to three between, a blank for words that follow each other.
TITLE_TERMS = (
    ("rupture", "embargo, expel*, expulsion, sanction, sanctions"),  # penalties
    ("rupture", "ambassador/charg*+expel*/recall*/summon*/withdraw*, relations/ties+sever*/suspend*, withdraw* from"),  # broken ties
    ("threat", "consequences, retaliat*, threat, threaten*, ultimatum, warn/warns of"),
    ("agreement", "accord, agreement, ceasefire, deal, memorandum, ratif*, signed/signing/signs, treaty, truce"),
    ("meeting", "consultation/consultations, delegation, host/hosted/hosts, meet/meeting/meetings/meets, negotiation*, received, summit, talks, visit/visited/visiting/visits"),  # in person
    ("meeting", "call with, conversation with, phone call, spoke with, spoke by phone with, telephone conversation"),  # by wire
    ("demand", "call/calls for/on, condemn*, demand*, denounc*, deplor*, protest*, reject*, urge/urges"),
    ("aid", "aid, assistance, donat*, funding, humanitarian, relief/support package"),
)
#: Classes of water by the source's own names.
WATER_CLASSES = {"ocean": "ocean", "sea": "sea", "gulf": "gulf", "bay": "bay", "strait": "strait", "channel": "channel", "sound": "sound", "river": "river", "lake centerline": "river", "lake": "lake", "reservoir": "lake", "alkaline lake": "lake"}


def clean_location(c: Column) -> Column:
    """The parts of a comma-separated place, trimmed, without `(general)`, empty ones and repeats whatever their case; null if none is left."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\(general\)$", "")))
    add = lambda acc, p: F.when((p == "") | F.exists(acc, lambda x: F.lower(x) == F.lower(p)), acc).otherwise(F.concat(acc, F.array(p)))
    return F.nullif(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), add), ", "), F.lit(""))


def country_of_location(c: Column) -> Column:
    return F.nullif(F.trim(F.element_at(F.split(c, ","), -1)), F.lit(""))


def plain_text(c: Column) -> Column:
    """Without tags, entities spelled out, blanks collapsed."""
    out = F.regexp_replace(c, "<[^>]+>", " ")
    for k, v in ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def actor_name(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """Words of a coded actor with a capital first; those of `keep` stay in capitals."""
    words = F.split(F.trim(F.regexp_replace(c, r"[_\s]+", " ")), " ")
    return F.nullif(F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin(*keep), F.upper(w)).otherwise(F.initcap(w)) if keep else F.initcap(w)), " "), F.lit(""))


def split_outlets(c: Column, most: int = 8, longest: int = 80) -> Column:
    """Distinct outlet names between ; or |, the first `most`."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;|]"), lambda p: F.trim(F.substring(F.trim(p), 1, longest)))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, most)


def rank_outlets(names: Column, preferred: Column, verified: list[str], most: int = 8) -> Column:
    """Distinct names: the preferred one, then verified ones, then by name; the first `most`."""
    known = F.array(*map(F.lit, verified))
    rank = lambda n: F.struct((~n.eqNullSafe(preferred)).alias("p"), (~F.array_contains(known, n)).alias("v"), F.lower(n).alias("l"), n.alias("n"))
    return F.slice(F.transform(F.array_sort(F.transform(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != ""))), rank)), lambda x: x["n"]), 1, most)


def best_tier(df: DataFrame, key: str, names: str, tiers: DataFrame, unknown: int = 3) -> DataFrame:
    """(key, tier, majors): the best tier among each row's names and how many are of tier 1. tiers: label, tier."""
    each = df.select(key, F.explode_outer(names).alias("label"))
    dim = tiers.groupBy("label").agg(F.min("tier").alias("tier"))
    return each.join(dim, "label", "left").groupBy(key).agg(F.coalesce(F.min("tier"), F.lit(unknown)).alias("tier"), F.count_if(F.col("tier") == 1).alias("majors"))


def mid_of(mmsi: Column) -> Column:
    """The three digits of a maritime identity that name its country, by the forms of nine digits and the shortened ones of eight and seven; null otherwise."""
    d = F.when(mmsi.rlike(r"^\d+$"), mmsi)
    mid = lambda p: F.nullif(F.regexp_extract(d, p, 1), F.lit(""))
    nine = F.coalesce(mid(r"^([2-7]\d\d)\d{6}$"), mid(r"^0([2-7]\d\d)\d{5}$"), mid(r"^00([2-7]\d\d)\d{4}$"), mid(r"^111([2-7]\d\d)\d{3}$"), mid(r"^9[89]([2-7]\d\d)\d{4}$"))
    return F.coalesce(nine, mid(r"^([2-7]\d\d)\d{5}$"), mid(r"^([2-7]\d\d)\d{4}$"))


def flags(df: DataFrame, mmsi: str, mids: DataFrame) -> DataFrame:
    """df with the country that its identity's digits name. mids: mid, country."""
    return df.withColumn("mid", mid_of(F.col(mmsi).cast("string"))).join(mids, "mid", "left")


def callsign_countries(df: DataFrame, callsign: str, series: DataFrame) -> DataFrame:
    """df with the country of its callsign's series (prefix, lo, hi, country): the longest prefix whose next character is between lo and hi."""
    clean = F.regexp_replace(F.upper(F.col(callsign)), "[^A-Z0-9]", "")
    marked = df.withColumn("_cs", clean)
    asked = marked.select("_cs").where("_cs <> ''").distinct()
    cut = asked.withColumn("n", F.explode(F.sequence(F.lit(0), F.least(F.length("_cs") - 1, F.lit(3))))).select("_cs", F.substring(F.col("_cs"), F.lit(1), F.col("n")).alias("prefix"), F.substring(F.col("_cs"), F.col("n") + 1, F.lit(1)).alias("next"))
    hit = cut.join(series, "prefix").where("next between lo and hi").groupBy("_cs").agg(F.max_by("country", F.struct(F.length("prefix"), "country")).alias("country"))
    return marked.join(hit, "_cs", "left").drop("_cs")


def one_decimal(x: Column) -> Column:
    """A double's exact value to one decimal, ties to even, as printf has it; format_string rounds its shortest digits, ties up."""
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    tenths = F.floor(part * 10)
    # part * 20 as a sum of two exact products and what its rounding left out, held against the middle of two tenths
    twenty = part * 16 + part * 4
    past = (twenty - (tenths * 2 + 1)) + (part * 4 - (twenty - part * 16))
    n = whole * 10 + tenths + F.when((past > 0) | ((past == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.when(size < 1e14, text).otherwise(F.format_string("%.1f", x))


def distance_text(km: Column, system: str = "metric") -> Column:
    size, unit = {"imperial": (KM_PER_MI, "mi"), "nautical": (KM_PER_NM, "nm")}.get(system, (1.0, "km"))
    return F.when(km.isNull() | F.isnan(km), "n/a").otherwise(F.concat(one_decimal(km / size), F.lit(f" {unit}")))


def speed_text(kmh: Column, system: str = "metric") -> Column:
    size, unit = {"imperial": (KM_PER_MI, "mph"), "nautical": (KM_PER_NM, "kn")}.get(system, (1.0, "km/h"))
    return F.when(kmh.isNull() | F.isnan(kmh), "n/a").otherwise(F.format_string(f"%.0f {unit}", F.rint(kmh / size)))


def eta_text(month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """`Mar 4, 06:30`, without the time if a part of it is missing; null without a real month and day."""
    name = F.element_at(F.array(*map(F.lit, MONTHS)), month.cast("int"))
    text = F.concat(name, F.lit(" "), day.cast("string"))
    timed = F.concat(text, F.lit(", "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))
    return F.when(month.between(1, 12) & day.between(1, 31), F.when(hour.between(0, 23) & minute.between(0, 59), timed).otherwise(text))


def incident_sentence(actor1: Column, verb: Column, actor2: Column, where: Column) -> Column:
    """Who did what to whom, where: without an object the verb loses its last preposition; without anyone there is no sentence."""
    alone = F.regexp_replace(F.concat_ws(" ", actor1, F.rtrim(verb)), r" (on|against|with|of|held by|to)$", "")
    said = F.when(actor1.isNotNull() & actor2.isNotNull(), F.concat_ws(" ", actor1, verb, actor2)).when(actor1.isNotNull(), alone).when(actor2.isNotNull(), F.concat(actor2, F.lit(" was targeted")))
    return F.when(verb.isNotNull(), F.concat(said, F.when(where.isNotNull(), F.concat(F.lit(" in "), where)).otherwise(""), F.lit(".")))


def implied_trade(destination: Column, port: Column, country: Column) -> Column:
    """A statement of what a vessel's broadcast implies, and that it asserts no cargo."""
    last = F.when(port.isNotNull(), F.concat(F.lit("last port call: "), F.concat_ws(", ", port, country))).otherwise("no port call on record")
    to = F.when(destination.isNotNull(), F.concat(F.lit('declared destination: "'), destination, F.lit('"'))).otherwise("no declared destination")
    return F.concat(last, F.lit("; "), to, F.lit(". From position reports alone; no cargo is asserted."))


def _words(term: str) -> str:
    """A term of TITLE_TERMS as a pattern over words parted by anything else."""

    def word(choice: str) -> str:
        return "(?:" + "|".join(w.replace("*", "\\w*") for w in choice.split("/")) + ")"

    if "+" in term:
        a, b = map(word, term.split("+"))
        between = r"(?:\W+\w+){0,3}\W+"
        return f"{a}{between}{b}|{b}{between}{a}"
    return r"\W+".join(map(word, term.split()))


def title_kind(title: Column, terms: tuple[tuple[str, str], ...] = TITLE_TERMS) -> Column:
    """The first kind one of whose terms a title holds as whole words; a title that holds none, or is null, is a statement."""
    pattern = lambda line: r"(?i)\b(?:" + "|".join(_words(t.strip()) for t in line.split(",")) + r")\b"
    return F.coalesce(*[F.when(title.rlike(pattern(line)), F.lit(kind)) for kind, line in terms], F.lit("statement"))


def evidence(tokens: Column, classes: dict[str, str], order: tuple[str, ...]) -> Column:
    """The evidence classes of risk tokens in a fixed order, joined by ;, `unclassified` where none is known."""
    known = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    present = F.transform(tokens, lambda t: F.coalesce(known[t], F.lit("unclassified")))
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*[F.when(F.array_contains(present, c), F.lit(c)) for c in order])), ";"), F.lit("")), F.lit("unclassified"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def water_features(df: DataFrame, prefix: str) -> DataFrame:
    """Identity and class of water features (ordinal, ne_id, name, scalerank, featurecla): the source's id, else rank and name, else the class and a running number; repeats get #n."""
    from pyspark.sql import Window

    cls = F.coalesce(*[F.when(F.lower(F.trim("featurecla")) == k, F.lit(v)) for k, v in WATER_CLASSES.items()], F.lit("other"))
    nameless = F.row_number().over(Window.partitionBy(F.col("name").isNull(), slug(F.col("featurecla"))).orderBy("ordinal"))
    own = F.concat_ws(":", F.lit(prefix), F.coalesce("scalerank", F.lit(0)).cast("string"), F.when(F.col("name").isNotNull(), slug(F.col("name"))).otherwise(F.concat_ws("-", slug(F.col("featurecla")), nameless.cast("string"))))
    base = df.withColumn("_base", F.coalesce(F.when(F.col("ne_id").isNotNull(), F.concat(F.lit(f"{prefix}:"), F.col("ne_id").cast("string"))), own))
    n = F.row_number().over(Window.partitionBy("_base").orderBy("ordinal"))
    return base.withColumn("id", F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("#"), n.cast("string")))).withColumn("class", cls).drop("_base")


def box_radius_km(south: Column, west: Column, north: Column, east: Column, least: float = 50.0) -> Column:
    """Half the diagonal of a box, at least `least`."""
    up, mid = (north - south) * 110.574, F.radians((north + south) / 2)
    across = (east - west) * DEGREE_KM * F.greatest(F.cos(mid), F.lit(0.05))
    return F.greatest(F.lit(least), F.hypot(up, across) / 2)


_VERIFIED = ["F", "O"]
#: Parts of titles by row, and the kind that each brings with it; the weightiest of a title's two parts is its kind.
_PARTS = (("recalls its ambassador", 1), ("ambassador to France is recalled", 1), ("suspends diplomatic relations", 1), ("warns of delays", 2), ("accord in sight", 3), ("Telephone conversation", 4), ("spoke by phone with counterpart", 4), ("Call with the Prime Minister", 4), ("calls for calm", 5), ("humanitarian convoy", 6), ("weather", 7), ("withdraws a bill", 7))
_KINDS = ("rupture", "threat", "agreement", "meeting", "demand", "aid", "statement")
QUERIES = {
    "fn_locations": lambda s, d: reports(s, d).select("report_id", F.concat(F.col("status"), F.lit(", "), F.lower("status"), F.lit(" (general), ,"), F.col("category"), F.lit(" ")).alias("l")).select("report_id", clean_location(F.col("l")).alias("place"), country_of_location(F.col("l")).alias("country")),
    "fn_plain_text": lambda s, d: reports(s, d).select("report_id", plain_text(F.concat(F.lit("<b>A &amp; "), F.col("status"), F.lit("</b>  &lt;x&gt;"))).alias("text"), actor_name(F.concat(F.lower("status"), F.lit("_usa  group")), ("USA",)).alias("actor")),
    "fn_outlets": lambda s, d: reports(s, d).select("report_id", F.array_join(rank_outlets(split_outlets(F.concat(F.lit("zeta;"), F.col("status"), F.lit(" | alpha;;zeta"))), F.lit("alpha"), _VERIFIED), ",").alias("outlets")),
    "fn_outlet_tiers": lambda s, d: best_tier(reports(s, d).select("report_id", F.array(F.col("status"), F.when(F.col("mentions") > 4, F.lit("X"))).alias("names")), "report_id", "names", s.createDataFrame([("F", 1), ("O", 2), ("X", 1)], "label string, tier int")),
    "fn_flags": lambda s, d: flags(positions(s, d).select("event_id", F.concat(F.element_at(F.array(*map(F.lit, ("", "0", "00", "111", "98", "9"))), (F.col("event_id") % 6 + 1).cast("int")), F.lpad((F.col("event_id") % 900).cast("string"), 3, "0"), F.element_at(F.array(*map(F.lit, ("123456", "12345", "1234", "123", "1234", "00000"))), (F.col("event_id") % 6 + 1).cast("int"))).alias("mmsi")), "mmsi", table(s, d, "nation").selectExpr("cast(200 + n_nationkey * 20 as string) as mid", "n_name as country")).select("event_id", "mid", "country"),
    "fn_callsigns": lambda s, d: callsign_countries(table(s, d, "part").selectExpr("p_partkey", "concat(substring(p_name, 1, 2), '-', p_partkey % 50) as callsign"), "callsign", s.createDataFrame([("", "A", "F", "one"), ("R", "A", "E", "two"), ("S", "A", "Z", "three"), ("SM", "0", "5", "four")], "prefix string, lo string, hi string, country string")).select("p_partkey", "country"),
    "fn_formats": lambda s, d: positions(s, d).select(
        "event_id", distance_text(F.col("event_id") * 1.5, "imperial").alias("far"), distance_text(F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 0.3718281)).alias("near"), speed_text(F.col("event_id") * 3.0, "nautical").alias("speed"),
        eta_text(F.col("event_id") % 14, F.col("event_id") % 33, F.col("event_id") % 26, F.col("event_id") % 60).alias("eta")),
    "fn_sentences": lambda s, d: reports(s, d).select("report_id", incident_sentence(F.when(F.col("mentions") % 3 != 0, F.col("status")), F.lit("fired on"), F.when(F.col("mentions") % 2 == 0, F.lit("B")), F.when(F.col("mentions") > 4, F.lit("Town"))).alias("sentence"), implied_trade(F.when(F.col("mentions") > 3, F.col("status")), F.when(F.col("mentions") % 2 == 0, F.lit("Port")), F.lit("XX")).alias("trade")),
    "fn_title_kinds": lambda s, d: reports(s, d).select("report_id", title_kind(F.concat_ws("; ", *[F.element_at(F.array(*[F.lit(t) for t, _ in _PARTS]), (F.col(c) % 12 + 1).cast("int")) for c in ("report_id", "mentions")])).alias("kind"), evidence(F.split(F.concat_ws(";", F.when(F.col("mentions") > 2, F.lit("b")), F.when(F.col("mentions") > 5, F.lit("a")), F.when(F.col("mentions") == 1, F.lit("q"))), ";"), {"a": "court", "b": "list"}, ("list", "court")).alias("evidence")),
    "fn_water_features": lambda s, d: water_features(sites(s, d).selectExpr("site_id as ordinal", "if(site_id % 3 = 0, site_id div 6, null) as ne_id", "if(site_id % 3 = 1, concat('Lake ', country % 4), null) as name", "cast(site_id % 2 as int) as scalerank", "if(site_id % 2 = 0, ' Alkaline Lake', 'Fjord') as featurecla"), "w").select("ordinal", "id", "class"),
    "fn_box_radius": lambda s, d: sites(s, d).select("site_id", F.round(box_radius_km(F.col("site_lat"), F.col("site_lon"), F.col("site_lat") + F.col("site_id") % 5, F.col("site_lon") + F.col("site_id") % 7), 6).alias("km")),
}
ORACLES = {
    "fn_locations": oracle("reports", "SELECT report_id, status || ', ' || category AS place, category AS country FROM reports"),
    "fn_plain_text": oracle("reports", "SELECT report_id, 'A & ' || status || ' <x>' AS text, status || ' USA Group' AS actor FROM reports"),
    "fn_outlets": oracle("reports", "SELECT report_id, 'alpha,' || CASE WHEN status IN ('F', 'O') THEN status || ',zeta' ELSE 'P,zeta' END AS outlets FROM reports"),
    "fn_outlet_tiers": oracle("reports", "SELECT report_id, CAST(least(CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, CASE WHEN mentions > 4 THEN 1 ELSE 3 END) AS INT) AS tier, CAST(CASE WHEN status = 'F' THEN 1 ELSE 0 END + CASE WHEN mentions > 4 THEN 1 ELSE 0 END AS BIGINT) AS majors FROM reports"),
    "fn_flags": r"""WITH s AS (SELECT event_id, ['', '0', '00', '111', '98', '9'][event_id % 6 + 1] || lpad(CAST(event_id % 900 AS VARCHAR), 3, '0') || ['123456', '12345', '1234', '123', '1234', '00000'][event_id % 6 + 1] AS m FROM events),
        c AS (SELECT event_id, m, CASE WHEN m[1] = '0' AND m[2] = '0' THEN m[3:5] WHEN m[1] = '0' THEN m[2:4] WHEN m[1:3] = '111' THEN m[4:6] WHEN m[1:2] IN ('98', '99') THEN m[3:5] ELSE m[1:3] END AS d FROM s), k AS (SELECT event_id, CASE WHEN d BETWEEN '200' AND '799' THEN d END AS mid FROM c)
        SELECT event_id, mid, n_name AS country FROM k LEFT JOIN nation ON CAST(200 + n_nationkey * 20 AS VARCHAR) = mid""",
    "fn_callsigns": """WITH c AS (SELECT p_partkey, regexp_replace(upper(substr(p_name, 1, 2) || '-' || p_partkey % 50), '[^A-Z0-9]', '', 'g') AS cs FROM part)
        SELECT p_partkey, CASE WHEN cs LIKE 'SM%' AND substr(cs, 3, 1) BETWEEN '0' AND '5' THEN 'four' WHEN cs LIKE 'S%' AND substr(cs, 2, 1) BETWEEN 'A' AND 'Z' THEN 'three' WHEN cs LIKE 'R%' AND substr(cs, 2, 1) BETWEEN 'A' AND 'E' THEN 'two' WHEN substr(cs, 1, 1) BETWEEN 'A' AND 'F' THEN 'one' END AS country FROM c""",
    "fn_formats": """SELECT event_id, printf('%.1f mi', event_id * 1.5::DOUBLE / 1.609344::DOUBLE) AS far, CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE printf('%.1f km', event_id * 0.3718281::DOUBLE) END AS near, printf('%.0f kn', event_id * 3.0::DOUBLE / 1.852::DOUBLE) AS speed,
        CASE WHEN event_id % 14 BETWEEN 1 AND 12 AND event_id % 33 BETWEEN 1 AND 31 THEN ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][event_id % 14] || ' ' || event_id % 33 || CASE WHEN event_id % 26 <= 23 THEN ', ' || lpad(CAST(event_id % 26 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') ELSE '' END END AS eta FROM events""",
    "fn_sentences": oracle("reports", """SELECT report_id, CASE WHEN mentions % 3 <> 0 AND mentions % 2 = 0 THEN status || ' fired on B' WHEN mentions % 3 <> 0 THEN status || ' fired' WHEN mentions % 2 = 0 THEN 'B was targeted' END || CASE WHEN mentions > 4 THEN ' in Town' ELSE '' END || '.' AS sentence,
        CASE WHEN mentions % 2 = 0 THEN 'last port call: Port, XX' ELSE 'no port call on record' END || '; ' || CASE WHEN mentions > 3 THEN 'declared destination: "' || status || '"' ELSE 'no declared destination' END || '. From position reports alone; no cargo is asserted.' AS trade FROM reports"""),
    "fn_title_kinds": oracle("reports", f"SELECT report_id, {list(_KINDS)}[least({[k for _, k in _PARTS]}[report_id % 12 + 1], {[k for _, k in _PARTS]}[mentions % 12 + 1])] AS kind, CASE WHEN mentions > 5 THEN 'list;court' WHEN mentions > 2 THEN 'list' ELSE 'unclassified' END AS evidence FROM reports"),
    "fn_water_features": oracle(
        "sites", "SELECT ordinal, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY ordinal) = 1 THEN base ELSE base || '#' || row_number() OVER (PARTITION BY base ORDER BY ordinal) END AS id, CASE WHEN ordinal % 2 = 0 THEN 'lake' ELSE 'other' END AS class FROM b",
        "b AS (SELECT site_id AS ordinal, CASE WHEN site_id % 3 = 0 THEN 'w:' || site_id // 6 WHEN site_id % 3 = 1 THEN 'w:' || site_id % 2 || ':lake-' || country % 4 ELSE 'w:' || site_id % 2 || CASE WHEN site_id % 2 = 0 THEN ':alkaline-lake-' ELSE ':fjord-' END || row_number() OVER (PARTITION BY site_id % 3 = 1, site_id % 2 ORDER BY site_id) END AS base FROM sites)",
    ),
    "fn_box_radius": oracle("sites", "SELECT site_id, round(greatest(50, sqrt(power(site_id % 5 * 110.574::DOUBLE, 2) + power(site_id % 7 * 111.32::DOUBLE * greatest(cos(radians((site_lat + site_lat + site_id % 5) / 2)), 0.05), 2)) / 2), 6) AS km FROM sites"),
}
