"""Queries over journeys put together from plans and recordings, waypoint registries, models and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo, text
from ..operators import assembly, labels, registry, rows
from ..operators import trajectory as T
from . import domain as D
from .domain import q, sql

# ---- lookups -------------------------------------------------------------------------------------------

_CUSTOMER_POINTS = """reg AS (SELECT source, ident, region, min_by((lat, lon, confidence), k) AS r FROM (SELECT c_custkey AS k, ['official', 'flightgear', 'xplane', 'openaip', 'aixm', 'unheard'][c_custkey % 6 + 1] AS source, 'Q' || CAST(c_custkey * 7 % 300 AS VARCHAR) AS ident,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'R' || CAST(c_custkey % 3 AS VARCHAR) END AS region, (c_custkey * 7 % 300 * 13 % 9000) / 100e0 + (c_custkey % 3) * 0.0005e0 + CASE WHEN c_custkey % 11 = 0 THEN 2e0 ELSE 0e0 END AS lat, (c_custkey * 7 % 300 * 17 % 9000) / 100e0 AS lon, CAST(50 + c_custkey % 50 AS INT) AS confidence FROM customer) GROUP BY 1, 2, 3),
ord AS (SELECT * FROM (VALUES (1, 'official'), (2, 'flightgear'), (3, 'xplane'), (4, 'openaip'), (5, 'aixm')) t(rank, source)),
asked AS (SELECT p_partkey AS key, 'Q' || CAST(p_partkey % 400 AS VARCHAR) AS ident, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'R' || CAST(p_partkey % 3 AS VARCHAR) END AS region FROM part),
best AS (SELECT key, rank, source, min_by(r, CASE WHEN reg.region = asked.region THEN 0 ELSE 1 END) AS r FROM asked JOIN reg ON reg.ident = asked.ident AND reg.region IN (asked.region, '') JOIN ord USING (source) GROUP BY 1, 2, 3),
top AS (SELECT key, min(rank) AS rank, min_by(source, rank) AS source, min_by(r, rank) AS r FROM best GROUP BY key),"""


@query(sql(f"""WITH {_CUSTOMER_POINTS} cmp AS (SELECT top.key, count(*) FILTER (best.rank > top.rank AND nm < 0.1) AS n_agree, count(*) FILTER (best.rank > top.rank AND nm > 50) AS n_far FROM top JOIN (SELECT best.*, {D.hav_nm('t.r[1]', 't.r[2]', 'best.r[1]', 'best.r[2]')} AS nm FROM best JOIN top t USING (key)) best USING (key) GROUP BY top.key)
SELECT key, r[1] AS lat, r[2] AS lon, source, CASE WHEN source IS NOT NULL THEN CAST(least(100, r[3] + 10 * n_agree) AS INT) END AS confidence, CASE WHEN n_agree > 0 THEN 'cross_validated' ELSE source || '_exact' END AS method, n_far FROM asked LEFT JOIN top USING (key) LEFT JOIN cmp USING (key)""").replace("r[1]", "r.lat").replace("r[2]", "r.lon").replace("r[3]", "r.confidence").replace("(lat, lon, confidence)", "{'lat': lat, 'lon': lon, 'confidence': confidence}"))
def waypoint_resolver(spark: SparkSession, d: str) -> DataFrame:
    """Places of idents from the first source that knows them in a region or anywhere, with what the later sources say."""
    k = F.col("c_custkey")
    found = D.table(spark, d, "customer").select(
        k.alias("k"), F.get(F.array(*map(F.lit, (*registry.SOURCE_ORDER, "unheard"))), (k % 6).cast("int")).alias("source"), F.concat(F.lit("Q"), (k * 7 % 300).cast("string")).alias("ident"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("R"), (k % 3).cast("string"))).alias("region"),
        ((k * 7 % 300 * 13 % 9000) / F.lit(100.0) + (k % 3) * 0.0005 + F.when(k % 11 == 0, 2.0).otherwise(0.0)).alias("lat"), ((k * 7 % 300 * 17 % 9000) / F.lit(100.0)).alias("lon"), (50 + k % 50).cast("int").alias("confidence"),
    )
    p = F.col("p_partkey")
    asked = D.table(spark, d, "part").select(p.alias("key"), F.concat(F.lit("Q"), (p % 400).cast("string")).alias("ident"), F.when(p % 7 == 0, "").otherwise(F.concat(F.lit("R"), (p % 3).cast("string"))).alias("region"))
    return registry.resolve(asked, rows.first_wins(found, ["source", "ident", "region"], "k"))


_MODELS = """m AS (SELECT p_partkey AS ord, 'model-' || CAST(p_partkey AS VARCHAR) AS model, 'ZX' || CAST(p_partkey % 40 AS VARCHAR) AS name, 'QY' || CAST(p_partkey * 3 % 50 AS VARCHAR) AS alias,
  p_size % 5 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 4 < 2 AND p_partkey % 6 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 3 < 2
  AND 200 * (1 + p_partkey % 9) >= 500 AND 1000000 * (1 + p_partkey % 4) <= 3000000 AND (p_partkey % 5 = 0 OR p_partkey * 37 BETWEEN 200 * (1 + p_partkey % 9) AND 1000000 * (1 + p_partkey % 4)) AS ready FROM part)"""


def _models(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda values, k: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (p % k).cast("int"))
    m = D.table(spark, d, "part").select(
        p.alias("ord"), F.concat(F.lit("model-"), p.cast("string")).alias("model"), F.array(F.concat(F.lit("zx-"), (p % 40).cast("string")), F.concat(F.lit(" QY "), (p * 3 % 50).cast("string"))).alias("names"),
        F.when(F.col("p_size") % 5 == 0, "draft").otherwise("ready").alias("status"), F.when(p % 13 == 0, "  ").otherwise("models/file").alias("url"), pick(("CC0", "CC BY", "CC BY-NC", None), 4).alias("licence"),
        (p % 6 != 0).alias("commercial"), (p % 7 != 0).alias("derivatives"), (p % 17 == 0).alias("editorial"), pick(("glb", "gltf", "obj"), 3).alias("format"),
        (200 * (1 + p % 9)).alias("least"), (1_000_000 * (1 + p % 4)).alias("most"), F.when(p % 5 != 0, p * 37).alias("actual"),
    )
    return m.withColumn("ready", registry.model_ready())


@query(f"WITH {_MODELS} SELECT ord, model, ready FROM m")
def aircraft_model_ready(spark: SparkSession, d: str) -> DataFrame:
    """Models that may be used: status, file, licence, permitted uses, format and polygon budget."""
    return _models(spark, d).select("ord", "model", "ready")


@query(f"""WITH {_MODELS}, idx AS (SELECT name, min_by(model, ord) AS model, min_by(ready, ord) AS ready FROM (SELECT name, ord, model, ready FROM m UNION ALL SELECT alias, ord, model, ready FROM m) GROUP BY name),
r AS (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN 'ZX' || CAST(c_custkey % 60 AS VARCHAR) WHEN 1 THEN 'QY' || CAST(c_custkey % 60 AS VARCHAR) END AS name FROM customer),
f AS (SELECT coalesce((SELECT model FROM idx WHERE name = 'ZX7' AND ready), (SELECT min_by(model, ord) FROM m WHERE ready)) AS model)
SELECT request, CASE WHEN idx.ready THEN idx.model ELSE (SELECT model FROM f) END AS model, idx.model AS found FROM r LEFT JOIN idx USING (name)""")
def aircraft_model_select(spark: SparkSession, d: str) -> DataFrame:
    """The model of a requested type by any of its names, or the default's, or the first that is ready."""
    c = F.col("c_custkey")
    kind = F.when(c % 3 == 0, F.concat(F.lit("Zx "), (c % 60).cast("string"))).when(c % 3 == 1, F.concat(F.lit("qy_"), (c % 60).cast("string")))
    return registry.select_model(D.table(spark, d, "customer").select(c.alias("request"), kind.alias("aircraft_type")), _models(spark, d), "ZX-7")


# ---- dedupes -------------------------------------------------------------------------------------------


@query(sql("""WITH x AS (SELECT airway, seq, 'W' || CAST(point % 60 AS VARCHAR) AS ident, (point % 60) / 8e0 + (seq % 2) * 1e-6 AS lat, (point % 30) / 4e0 AS lon FROM route_points),
y AS (SELECT *, row_number() OVER (PARTITION BY ident, floor(lat * 1e5 + 0.5e0), floor(lon * 1e5 + 0.5e0) ORDER BY airway, seq) AS n FROM x) SELECT airway, seq, ident, floor(lat * 1e6 + 0.5e0) / 1e6 AS lat, lon FROM y WHERE n = 1""", "route_points"))
def waypoint_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One waypoint for each ident and place on a grid of a hundred-thousandth degree, the first in order."""
    r = D.route_points(spark, d)
    x = r.select("airway", "seq", F.concat(F.lit("W"), (F.col("point") % 60).cast("string")).alias("ident"), (F.col("point") % 60 / F.lit(8.0) + (F.col("seq") % 2) * 1e-6).alias("lat"), (F.col("point") % 30 / F.lit(4.0)).alias("lon"))
    best = registry.first_of(x, [F.col("ident"), geo.quantise(F.col("lat"), 5), geo.quantise(F.col("lon"), 5)], ["airway", "seq"])
    return best.select("airway", "seq", "ident", geo.quantise(F.col("lat"), 6).alias("lat"), "lon")


@query(sql("""WITH x AS (SELECT ord, date_trunc('hour', ts) AS ts, floor(lat) AS lat, floor(lon) AS lon FROM points) SELECT min(ord) AS ord, ts, lat, lon FROM x GROUP BY ts, lat, lon""", "points"))
def point_time_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first point of each time and place to five places, here of coarse times and places."""
    x = D.points(spark, d).select("ord", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.floor("lat").cast("double").alias("lat"), F.floor("lon").cast("double").alias("lon"))
    return registry.first_of(x, [F.col("ts"), geo.quantise(F.col("lat"), 5), geo.quantise(F.col("lon"), 5)], ["ord"])


@query("SELECT type || ':' || CAST(id AS VARCHAR) AS feature, min(k) AS k FROM (SELECT p_partkey AS k, p_type AS type, p_partkey % 40 AS id FROM part) GROUP BY 1")
def scene_feature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first feature of each type and id."""
    x = D.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat("p_type", F.lit(":"), (F.col("p_partkey") % 40).cast("string")).alias("feature"))
    return rows.first_wins(x, ["feature"], "k").select("feature", "k")


# ---- labels --------------------------------------------------------------------------------------------

_KIND = "['airport', 'majorCity', 'landmark', 'region'][CAST(p_partkey % 4 AS INT) + 1]"


@query(f"SELECT p_partkey AS feature, CASE {_KIND} WHEN 'airport' THEN true WHEN 'majorCity' THEN p_size / 50e0 >= 0.76 AND p_partkey % 12 <= 8 ELSE p_size / 50e0 >= 0.9 AND p_partkey % 12 <= 1 END AS shown FROM part")
def globe_labels(spark: SparkSession, d: str) -> DataFrame:
    """Whether each feature has a label on the globe."""
    kind = F.get(F.array(*map(F.lit, ("airport", "majorCity", "landmark", "region"))), (F.col("p_partkey") % 4).cast("int"))
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("feature"), labels.renderable(kind, F.col("p_size") / F.lit(50.0), F.col("p_partkey") % 12).alias("shown"))


@query("""WITH RECURSIVE c AS (SELECT user_id AS frame, lpad(CAST(event_id AS VARCHAR), 9, '0') AS label, (event_id * 37 % 1600) * 1e0 AS x, (event_id * 53 % 800) * 1e0 AS y, 60e0 + event_id % 9 * 10 AS w, 14e0 + event_id % 3 * 4 AS h,
  (event_id % 100) / 100e0 * CASE WHEN event_id % 3 = 0 THEN 1.55e0 WHEN event_id % 3 = 1 THEN 1.15e0 ELSE 1e0 END - least(1.8e0, event_id * 7919 % 900000 / 450000e0) AS p FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY p DESC, label) AS k, {'l': x - 16, 'r': x + w + 8, 't': y - h * 0.65e0 - 8, 'b': y + h * 0.65e0 + 8, 'label': label} AS box FROM c),
g(frame, k, sel) AS (SELECT frame, CAST(1 AS BIGINT), [box] FROM o WHERE k = 1 UNION ALL SELECT g.frame, g.k + 1, CASE WHEN len(list_filter(sel, lambda s: greatest(s.l, box.l) < least(s.r, box.r) AND greatest(s.t, box.t) < least(s.b, box.b))) = 0 THEN list_append(sel, box) ELSE sel END FROM g JOIN o ON o.frame = g.frame AND o.k = g.k + 1 WHERE len(sel) < 8),
f AS (SELECT frame, max_by(sel, k) AS sel FROM g GROUP BY frame)
SELECT frame, sel[i].label AS label, CAST(i AS INT) AS place FROM (SELECT frame, sel, unnest(range(1, len(sel) + 1)) AS i FROM f)""")
def label_selection(spark: SparkSession, d: str) -> DataFrame:
    """The labels that a view shows: eight at most, by priority and without overlaps."""
    e, k = D.table(spark, d, "events"), F.col("event_id")
    c = e.select(
        F.col("user_id").alias("frame"), F.lpad(k.cast("string"), 9, "0").alias("label"), F.when(k % 3 == 0, "airport").when(k % 3 == 1, "landmark").otherwise("majorCity").alias("kind"), (k % 100 / F.lit(100.0)).alias("importance"),
        (k * 7919 % 900000).alias("distance_m"), (k * 37 % 1600).alias("x"), (k * 53 % 800).alias("y"), (60 + k % 9 * 10).alias("width"), (14 + k % 3 * 4).alias("height"),
    )
    return labels.select_visible(c, 8)


# ---- planned journeys ----------------------------------------------------------------------------------

_FLIGHTS = """flights AS (SELECT a.id AS flight, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, CASE WHEN a.id % 5 = 0 THEN '2024-02-30' ELSE '2024-0' || CAST(1 + a.id % 9 AS VARCHAR) || '-11' END AS date, CASE WHEN a.id % 3 = 0 THEN ' ' ELSE '1' || CAST(a.id % 10 AS VARCHAR) || ':45' END AS time, CASE WHEN a.id % 4 = 0 THEN 95 END AS minutes
  FROM airports a JOIN airports b ON b.id = a.id + 1)"""


def _flights(spark: SparkSession, d: str) -> DataFrame:
    a = D.airports(spark, d).select("id", "lat", "lon")
    i = F.col("flight")
    j = a.toDF("flight", "alat", "alon").join(a.select((F.col("id") - 1).alias("flight"), F.col("lat").alias("blat"), F.col("lon").alias("blon")), "flight")
    date = F.when(i % 5 == 0, "2024-02-30").otherwise(F.concat(F.lit("2024-0"), (1 + i % 9).cast("string"), F.lit("-11")))
    time = F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("1"), (i % 10).cast("string"), F.lit(":45")))
    return j.select("*", date.alias("date"), time.alias("time"), F.when(i % 4 == 0, 95).alias("minutes"))


_START = "try_strptime(date || ' ' || coalesce(nullif(trim(time), ''), '09:00'), '%Y-%m-%d %H:%M')"


@query(sql(f"WITH {_FLIGHTS} SELECT flight, {_START} AS start_ts FROM flights", "airports"))
def departure_instants(spark: SparkSession, d: str) -> DataFrame:
    """Departures from dates and times as text, at 09:00 where no time is given; no day, no departure."""
    return _flights(spark, d).select("flight", assembly.departure(F.col("date"), F.col("time")).cast("timestamp_ntz").alias("start_ts"))


_LENGTH = D.hav_m("alat", "alon", "blat", "blon")
_MINUTES = f"CAST(coalesce(minutes, floor(greatest(45e0, {_LENGTH} / 1000 / 810 * 60 + 28) + 0.5e0)) AS BIGINT)"


@query(sql(f"WITH {_FLIGHTS}, x AS (SELECT *, {_START} AS start_ts, {_MINUTES} AS m FROM flights) SELECT flight, start_ts, start_ts + to_minutes(m) AS end_ts, m AS minutes, {q(_LENGTH, 0)} AS length_m FROM x", "airports"))
def planned_journeys(spark: SparkSession, d: str) -> DataFrame:
    """Start, end, duration and length of each planned flight."""
    j = assembly.planned_journeys(_flights(spark, d))
    return j.select("flight", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start_ts", "end_ts")), "minutes", geo.quantise(F.col("length_m"), 0).alias("length_m"))


def _slerp(f: str) -> tuple[str, str]:
    """SQL of the great-circle point at fraction f between the ends of a row with its angle."""
    a, b = f"(sin((1e0 - {f}) * angle) / sin(angle))", f"(sin({f} * angle) / sin(angle))"
    part = lambda u, v: f"({a} * {u('alat', 'alon')} + {b} * {v('blat', 'blon')})"
    x = part(*[lambda p, l: f"cos(radians({p})) * cos(radians({l}))"] * 2)
    y = part(*[lambda p, l: f"cos(radians({p})) * sin(radians({l}))"] * 2)
    z = part(*[lambda p, l: f"sin(radians({p}))"] * 2)
    return f"degrees(atan2({z}, sqrt({x} * {x} + {y} * {y})))", f"degrees(atan2({y}, {x}))"


_ROUTES = " UNION ALL ".join(f"SELECT '{r}' AS route, {i} AS seq, {x!r}e0 AS fraction" for r, f in assembly.FRACTIONS.items() for i, x in enumerate(f))
_CRUISE_M = f"(CASE WHEN {_LENGTH} < 900000 THEN 8800e0 WHEN {_LENGTH} < 2500000 THEN 10700e0 ELSE 11600e0 END)"


@query(sql(f"""WITH {_FLIGHTS}, f AS (SELECT *, 2e0 * atan2(sqrt({D._chord('alat', 'alon', 'blat', 'blon')}), sqrt(1e0 - {D._chord('alat', 'alon', 'blat', 'blon')})) AS angle FROM flights), r AS ({_ROUTES}), x AS (SELECT * FROM f, r)
SELECT flight, route, CAST(seq AS INT) AS seq, fraction, {q(_slerp('fraction')[0], 4)} AS lat, {q(_slerp('fraction')[1], 4)} AS lon,
  {q(f"CASE WHEN fraction <= 0.08 THEN 3600e0 * fraction / 0.08e0 WHEN fraction <= 0.24 THEN 3600e0 + ({_CRUISE_M} - 3600e0) * (fraction - 0.08e0) / 0.16e0 WHEN fraction >= 0.86 THEN {_CRUISE_M} * (1e0 - (fraction - 0.86e0) / 0.14e0) ELSE {_CRUISE_M} END", 1)} AS alt FROM x""", "airports"))
def planned_route_samples(spark: SparkSession, d: str) -> DataFrame:
    """The points of the three routes of each planned flight, at fixed fractions of its way."""
    f = _flights(spark, d).select("flight", F.lit(0.0).alias("start_s"), F.lit(3600.0).alias("duration_s"), "alat", "alon", "blat", "blon")
    r = assembly.planned_routes(f)
    return r.select("flight", "route", "seq", "fraction", geo.quantise(F.col("lat"), 4).alias("lat"), geo.quantise(F.col("lon"), 4).alias("lon"), geo.quantise(F.col("alt"), 1).alias("alt"))


@query(sql("SELECT journey, greatest(1, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 + 0.5e0) AS BIGINT)) AS minutes, count(*) AS n_points, md5(string_agg(CAST(CAST(floor(lat * 100 + 0.5e0) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(floor(alt) AS BIGINT) AS VARCHAR), ',' ORDER BY ts, ord)) AS route FROM points GROUP BY journey", "points"))
def flight_plan_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a journey tells a recorder: its duration and its planned route, here as a digest."""
    p = D.points(spark, d)
    point = F.concat_ws(" ", F.floor(F.col("lat") * 100 + 0.5), F.floor("alt"))
    route = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "ord", point.alias("p")))), lambda s: s.p), ",")
    minutes = F.floor((T.seconds(F.max("ts")) - T.seconds(F.min("ts"))) / 60.0 + 0.5).cast("long")
    return p.groupBy("journey").agg(F.greatest(F.lit(1), minutes).alias("minutes"), F.count("*").alias("n_points"), F.md5(route).alias("route"))


# ---- recordings ----------------------------------------------------------------------------------------

_RECORDINGS = """rec AS (SELECT c_custkey AS recording, CASE WHEN c_custkey % 3 <> 0 THEN ia(c_custkey % 7) END AS origin, CASE WHEN c_custkey % 4 <> 0 THEN ia(c_custkey % 5 + 1) END AS destination, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(c_custkey % 700 AS INT)) AS started,
  CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_hours(CAST(c_custkey % 700 AS INT)) END AS ended, CASE WHEN c_custkey % 6 <> 0 THEN 'WF' || CAST(c_custkey AS VARCHAR) END AS flight_number FROM customer),
pts AS (SELECT ord * 7919 % 1500 AS recording, ts, ord, lat, lon, speed, CASE WHEN ord % 3 = 0 THEN 'gps' ELSE 'estimated' END AS source FROM points WHERE ord % 10 < 7),
gps AS (SELECT * FROM pts WHERE source = 'gps'), n AS (SELECT recording, count(*) AS n FROM gps GROUP BY 1),
ap AS (SELECT iata, min_by(lat, id) AS lat, min_by(lon, id) AS lon FROM airports GROUP BY 1),
lone AS (SELECT g.*, ended FROM gps g JOIN n USING (recording) JOIN rec USING (recording) WHERE n = 1),
anchor AS (SELECT recording, started AS ts, CAST(0 AS BIGINT) AS ord, CASE WHEN a.lat IS NOT NULL THEN a.lat ELSE b.lat END AS lat, CASE WHEN a.lat IS NOT NULL THEN a.lon ELSE b.lon END AS lon, CAST(NULL AS DOUBLE) AS speed, 'estimated' AS source, ended FROM rec LEFT JOIN n USING (recording) LEFT JOIN ap a ON a.iata = origin LEFT JOIN ap b ON b.iata = destination WHERE n IS NULL AND coalesce(a.lat, b.lat) IS NOT NULL),
one AS (SELECT recording, ts, ord, lat, lon, speed, source, ended FROM lone UNION ALL SELECT recording, ts, ord, lat, lon, speed, source, ended FROM anchor),
every AS (SELECT recording, ts, ord, lat, lon, speed, source, 0 AS made FROM gps WHERE recording IN (SELECT recording FROM rec) UNION ALL SELECT recording, ts, ord, lat, lon, speed, source, 0 FROM anchor
  UNION ALL SELECT recording, CASE WHEN ended > ts THEN ended ELSE ts + INTERVAL 60 SECOND END, ord, lat + 0.0001e0, lon + 0.0001e0, 0e0, 'estimated', 1 FROM one),
replay AS (SELECT recording, CAST(row_number() OVER (PARTITION BY recording ORDER BY ts, ord, made) AS INT) AS seq, ts, lat, lon, speed, source FROM every)""".replace("ia(c_custkey % 7)", "(SELECT min(iata) FROM airports WHERE id = c_custkey % 7)").replace("ia(c_custkey % 5 + 1)", "(SELECT min(iata) FROM airports WHERE id = c_custkey % 5 + 1)")


def _recordings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = F.col("c_custkey")
    codes = D.airports(spark, d).where("id < 10").groupBy("id").agg(F.min("iata").alias("code"))
    r = D.table(spark, d, "customer").select(c.alias("recording"), F.when(c % 3 != 0, c % 7).alias("o"), F.when(c % 4 != 0, c % 5 + 1).alias("t"), F.timestamp_add("HOUR", c % 700, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("started"), F.when(c % 2 == 0, F.timestamp_add("HOUR", c % 700, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))).alias("ended"), F.when(c % 6 != 0, F.concat(F.lit("WF"), c.cast("string"))).alias("flight_number"))
    r = r.join(F.broadcast(codes.toDF("o", "origin")), "o", "left").join(F.broadcast(codes.toDF("t", "destination")), "t", "left").drop("o", "t")
    p = D.points(spark, d).where("ord % 10 < 7").select((F.col("ord") * 7919 % 1500).alias("recording"), "ts", "ord", "lat", "lon", "speed", F.when(F.col("ord") % 3 == 0, "gps").otherwise("estimated").alias("source"))
    a = D.airports(spark, d).groupBy("iata").agg(F.min_by("lat", "id").alias("lat"), F.min_by("lon", "id").alias("lon"))
    return r, p.join(r.select("recording"), "recording", "left_semi"), a


@query(sql(f"WITH {_RECORDINGS} SELECT recording, seq, ts, {q('lat', 4)} AS lat, {q('lon', 4)} AS lon, speed, source FROM replay", "points", "airports"))
def recording_replay(spark: SparkSession, d: str) -> DataFrame:
    """The points of each recording's replay; short ones are filled up."""
    r = assembly.replayable(*_recordings(spark, d))
    return r.select("recording", "seq", "ts", geo.quantise(F.col("lat"), 4).alias("lat"), geo.quantise(F.col("lon"), 4).alias("lon"), "speed", "source")


@query(sql(f"""WITH {_RECORDINGS}, e AS (SELECT recording, min(ts) AS a, max(ts) AS b FROM replay GROUP BY 1), x AS (SELECT rec.*, a, b, coalesce(n, 0) AS n FROM rec JOIN e USING (recording) LEFT JOIN n USING (recording))
SELECT recording, 'gpsRecordingStart' AS kind, a AS ts, coalesce(flight_number, 'Flight') || ' GPS recording started' AS title, coalesce(nullif(concat_ws(' to ', origin, destination), ''), 'iOS CoreLocation recording') AS subtitle FROM x
UNION ALL SELECT recording, 'gpsRecordingStop', b, coalesce(flight_number, 'Flight') || ' GPS recording completed', CASE WHEN n >= 2 THEN CAST(n AS VARCHAR) || ' real GPS points' ELSE CAST(n AS VARCHAR) || ' real GPS point(s); replay route estimated' END FROM x""", "points", "airports"))
def recording_events(spark: SparkSession, d: str) -> DataFrame:
    """Start and stop of each recording on the timeline."""
    r, p, a = _recordings(spark, d)
    n = p.where("source = 'gps'").groupBy("recording").agg(F.count("*").alias("n"))
    return assembly.recording_events(r, assembly.replayable(r, p, a), n)


@query(sql(f"""WITH {_RECORDINGS}, e AS (SELECT recording, min(ts) AS a, count(*) AS n_points FROM replay GROUP BY 1)
SELECT recording, CASE WHEN flight_number IS NOT NULL AND origin IS NOT NULL AND destination IS NOT NULL THEN flight_number || ' ' || origin || ' to ' || destination ELSE 'GPS Recording ' || strftime(a, '%Y-%m-%d') END AS title, n_points FROM rec JOIN e USING (recording)""", "points", "airports"))
def recording_journeys(spark: SparkSession, d: str) -> DataFrame:
    """A journey of its own for each recording that can be replayed."""
    r, p, a = _recordings(spark, d)
    e = assembly.replayable(r, p, a).groupBy("recording").agg(F.min("ts").alias("start"), F.count("*").alias("n_points"))
    return r.join(e, "recording").select("recording", assembly.recording_title(F.col("flight_number"), F.col("origin"), F.col("destination"), F.col("start")).alias("title"), "n_points")


@query("""SELECT 'WF' || CAST(o_orderkey AS VARCHAR) AS flight_number, 'T' || chr(CAST(65 + o_orderkey % 26 AS INT)) || 'E' AS origin, 'NRT' AS destination, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INT)), '%H:%M') END AS departure_time,
CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 300 > 0 THEN CAST(o_orderkey % 300 AS BIGINT) END AS minutes FROM orders WHERE o_orderkey % 11 <> 0""")
def flight_records(spark: SparkSession, d: str) -> DataFrame:
    """Records kept of the flights that an API returns."""
    k = F.col("o_orderkey")
    at = F.timestamp_add("MINUTE", k % 1440, F.col("o_orderdate"))
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    f = D.table(spark, d, "orders").select(F.concat(F.lit(" wf-"), k.cast("string")).alias("flight_number"), F.when(k % 11 != 0, F.concat(F.lit("t"), F.char((65 + k % 26).cast("int")), F.lit("e "))).alias("origin"), F.lit("NRT").alias("destination"), F.when(k % 5 != 0, iso(at)).alias("scheduled"), F.when(k % 7 != 0, iso(F.timestamp_add("MINUTE", k % 300, at))).otherwise("soon").alias("arrival"))
    return assembly.flight_record(f)


# ---- points and small functions ------------------------------------------------------------------------


@query(sql(f"""WITH c AS (SELECT journey, ord, CASE WHEN ord % 3 <> 0 THEN course - 400 END AS course, {D.bearing('plat', 'plon', 'lat', 'lon')} AS b FROM steps)
SELECT journey, ord, {q("coalesce(" + D.mod('course', '360e0') + ", b)", 3)} AS course FROM c""", "steps"))
def course_fill(spark: SparkSession, d: str) -> DataFrame:
    """The course of each point, brought to 0 to 360, or the bearing from the point before where it is missing."""
    w = T.in_order()
    p = D.points(spark, d).withColumn("course", F.when(F.col("ord") % 3 != 0, F.col("course") - 400))
    back = geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return p.select("journey", "ord", geo.quantise(F.coalesce(geo.positive_modulo(F.col("course"), 360), back), 3).alias("course"))


@query("SELECT o_orderkey AS journey, o_orderdate AS start_time FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def recent_journeys(spark: SparkSession, d: str) -> DataFrame:
    """The latest 25 journeys."""
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("journey"), F.col("o_orderdate").alias("start_time")).orderBy(F.desc("start_time"), "journey").limit(max(1, 25))


@query(sql("""SELECT journey, count(*) FILTER (epoch_us(ts) <= epoch_us(TIMESTAMP '2024-01-15 12:00:00')) AS shown, count(*) FILTER (epoch_us(ts) > epoch_us(TIMESTAMP '2024-01-15 12:00:00')) AS ahead, max(ts) FILTER (ts <= TIMESTAMP '2024-01-15 12:00:00') AS last_shown, min(ts) FILTER (ts > TIMESTAMP '2024-01-15 12:00:00') AS next_ahead FROM points GROUP BY journey""", "points"))
def route_split_at(spark: SparkSession, d: str) -> DataFrame:
    """How a moment splits each journey's route into what is flown and what lies ahead."""
    ahead = F.col("ts") > F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return D.points(spark, d).groupBy("journey").agg(F.count_if(~ahead).alias("shown"), F.count_if(ahead).alias("ahead"), F.max(F.when(~ahead, F.col("ts"))).alias("last_shown"), F.min(F.when(ahead, F.col("ts"))).alias("next_ahead"))


@query(sql("SELECT journey, count(*) FILTER (ord % 4 IN (0, 1)) AS gps, count(*) FILTER (ord % 4 = 2) AS photos FROM points GROUP BY journey", "points"))
def visit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Visits of each journey by where they come from: marked by hand or in a recording, or from photos."""
    kind = F.get(F.array(*map(F.lit, ("quickGps", "recordingMarker", "photoGps", "imported"))), (F.col("ord") % 4).cast("int"))
    return D.points(spark, d).groupBy("journey").agg(F.count_if(kind.isin("quickGps", "recordingMarker")).alias("gps"), F.count_if(kind == "photoGps").alias("photos"))


@query("SELECT 'airports' AS part, count(*) AS n FROM supplier UNION ALL SELECT 'points', count(*) FROM part UNION ALL SELECT 'airways', count(*) FROM orders UNION ALL SELECT 'segments', count(*) FROM lineitem")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each part of a data set."""
    out = None
    for part, name in (("airports", "supplier"), ("points", "part"), ("airways", "orders"), ("segments", "lineitem")):
        n = D.table(spark, d, name).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = n if out is None else out.unionAll(n)
    return out


@query("SELECT p_partkey, CAST(list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a, b) * 16777619 % 4294967296, 2166136261) AS BIGINT) AS hash, ((CAST(p_partkey AS BIGINT) * 1664525 + 1013904223) % 4294967296 * 1664525 + 1013904223) % 4294967296 / 4294967295e0 AS second FROM part")
def jitter_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of names, and the second number of a seeded generator."""
    return D.table(spark, d, "part").select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"), text.seeded(F.col("p_partkey"), 2).alias("second"))


_CLOCK = "x AS (SELECT user_id AS journey, 60 + user_id * 7 % 900 AS duration, 1 + user_id % 8 AS speed FROM (SELECT DISTINCT user_id FROM events))"


@query(f"WITH {_CLOCK}, t AS (SELECT *, unnest(range(1, 61)) AS tick FROM x) SELECT journey, CAST(tick AS INT) AS tick, CAST(least(duration, tick * 10 * speed) AS BIGINT) AS at_s, (tick - 1) * 10 * speed < duration AS playing FROM t")
def replay_clock(spark: SparkSession, d: str) -> DataFrame:
    """Where a scaled clock stands at each of 60 ticks of ten seconds: it stops at a journey's end."""
    u = F.col("journey")
    x = D.table(spark, d, "events").select(F.col("user_id").alias("journey")).distinct().select("journey", (60 + u * 7 % 900).alias("duration"), (1 + u % 8).alias("speed"))
    t = x.withColumn("tick", F.explode(F.sequence(F.lit(1), F.lit(60))))
    gone = F.col("tick") * 10 * F.greatest(F.lit(1), F.col("speed"))
    return t.select("journey", "tick", F.least("duration", gone).cast("long").alias("at_s"), (gone - 10 * F.col("speed") < F.col("duration")).alias("playing"))


@query("""SELECT o_orderkey AS pack, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 13 < 6 THEN 'throttled' WHEN o_orderkey % 3 = 0 THEN 'current' ELSE 'staged' END AS action FROM orders""")
def pack_update_check(spark: SparkSession, d: str) -> DataFrame:
    """What an update check does with each pack: it waits six hours, and stages a revision that differs."""
    k = F.col("o_orderkey")
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    last = F.when(k % 5 != 0, F.timestamp_add("HOUR", -(k % 13), now))
    return D.table(spark, d, "orders").select(k.alias("pack"), assembly.update_state(last, now, F.lit("r1"), F.when(k % 3 == 0, "r1").otherwise("r2")).alias("action"))


@query(sql(f"""SELECT ord, {q('(2e0 + alt / 900000e0) * cos(radians(lat)) * sin(radians(lon))', 6)} AS x, {q('(2e0 + alt / 900000e0) * sin(radians(lat))', 6)} AS y, {q('(2e0 + alt / 900000e0) * cos(radians(lat)) * cos(radians(lon))', 6)} AS z FROM points""", "points"))
def globe_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Places as vectors on a globe of radius 2."""
    x = geo.vector(F.col("lat"), F.col("lon"), F.col("alt"))
    return D.points(spark, d).select("ord", *(geo.quantise(v, 6).alias(n) for v, n in zip(x, "xyz", strict=True)))


_BELOW = "CASE WHEN admin1 IS NOT NULL AND lat > 30 AND lon > 130 THEN admin1 WHEN lat > 24 AND lat < 32 AND lon > 122 AND lon < 130 THEN 'East China Sea' WHEN lat > 32 AND lon > 135 THEN 'Japan FIR' WHEN lat < 26 AND lon < 123 THEN 'Taiwan north coast' ELSE coalesce(admin1, 'Open ocean') END"


@query(sql(f"WITH p AS (SELECT uid, 20e0 + uid % 200 / 10e0 AS lat, 118e0 + uid * 7 % 250 / 10e0 AS lon, CASE WHEN uid % 3 = 0 THEN country END AS admin1 FROM nav_points) SELECT uid, {_BELOW} AS below, CASE WHEN lat > 32 AND lon > 135 THEN 'Japan FIR' WHEN lat > 24 AND lon > 122 AND lon < 134 THEN 'Pacific / East China Sea corridor' ELSE 'Taiwan FIR' END AS crossing FROM p", "nav_points"))
def below_and_crossing(spark: SparkSession, d: str) -> DataFrame:
    """What lies below places of the northern Pacific rim, and what a route crosses there."""
    u = F.col("uid")
    p = D.nav_points(spark, d).select("uid", (20 + u % 200 / F.lit(10.0)).alias("lat"), (118 + u * 7 % 250 / F.lit(10.0)).alias("lon"), F.when(u % 3 == 0, F.col("country")).alias("admin1"))
    return p.select("uid", geo.below_label(F.col("lat"), F.col("lon"), F.col("admin1")).alias("below"), geo.crossing_label(F.col("lat"), F.col("lon")).alias("crossing"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 500 + 0.25e0 END AS number, CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 500 + 0.25e0) * 100 ELSE p_partkey % 500 + 0.25e0 END END AS feet,
CASE WHEN p_partkey % 6 = 0 THEN 'bidirectional' WHEN p_partkey % 2 = 0 THEN 'odd' WHEN p_partkey % 3 = 0 THEN 'even' END AS direction FROM part""")
def decimal_commas(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with commas, flight levels in feet, and directions of levels."""
    k = F.col("p_partkey")
    raw = F.when(k % 9 == 0, "n/a").otherwise(F.concat((k % 500).cast("string"), F.lit(",25")))
    number = text.decimal_comma(raw)
    return D.table(spark, d, "part").select("p_partkey", number.alias("number"), text.flight_level_ft(number, F.when(k % 2 == 0, "fl").otherwise("ft")).alias("feet"), text.direction_code(F.when(k % 2 == 0, "x").otherwise(" "), F.when(k % 3 == 0, "y")).alias("direction"))


_SIZES = "CAST(power(10, o_orderkey % 11) AS BIGINT) + o_orderkey"


@query(f"""WITH x AS (SELECT o_orderkey, {_SIZES} AS n FROM orders), t AS (SELECT *, CASE WHEN n < 1000000 THEN 1e3 WHEN n < 1000000000 THEN 1e6 ELSE 1e9 END AS unit FROM x)
SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) || ' B' ELSE printf('%.1f', floor(n / unit * 10 + 0.5e0) / 10e0) || CASE unit WHEN 1e3 THEN ' KB' WHEN 1e6 THEN ' MB' ELSE ' GB' END END AS size,
CASE WHEN n >= 1000 THEN CAST(CAST(floor(n / 1000e0 + 0.5e0) AS BIGINT) AS VARCHAR) || ' km' ELSE CAST(n AS VARCHAR) || ' m' END AS distance, CAST(CAST(floor(n / 60e0 + 0.5e0) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(n / 60e0 + 0.5e0) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration FROM t""")
def number_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sizes, distances and durations as shown."""
    n = (F.pow(F.lit(10), F.col("o_orderkey") % 11).cast("long") + F.col("o_orderkey")).alias("n")
    x = D.table(spark, d, "orders").select("o_orderkey", n)
    return x.select("o_orderkey", text.bytes_label(F.col("n")).alias("size"), text.distance_label(F.col("n")).alias("distance"), text.duration_label(F.col("n")).alias("duration"))


@query("""SELECT p_partkey, 'IN-ENR-3.' || CAST(p_partkey % 9 AS VARCHAR) || 'L' || CAST(p_partkey % 900 + 1 AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN 'N' ELSE '' END || '-en-' || CASE WHEN p_partkey % 5 = 0 THEN 'US' ELSE 'GB' END || '.html' AS file,
CASE WHEN p_partkey % 5 <> 0 THEN 'L' || CAST(p_partkey % 900 + 1 AS VARCHAR) || CASE WHEN p_partkey % 4 = 0 THEN 'N' ELSE '' END END AS route, left(lpad(CAST(p_partkey AS VARCHAR), 20, 'a') || '|' || p_name, 24) AS checksum FROM part""")
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    """Routes in the names of files, and checksums of several files as one label."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("IN-ENR-3."), (k % 9).cast("string"), F.lit("L"), (k % 900 + 1).cast("string"), F.when(k % 4 == 0, "N").otherwise(""), F.lit("-en-"), F.when(k % 5 == 0, "US").otherwise("GB"), F.lit(".html"))
    parts = F.array(F.concat(F.lit("sha256:"), F.lpad(k.cast("string"), 20, "a")), F.col("p_name"))
    return D.table(spark, d, "part").select("p_partkey", name.alias("file"), text.route_of_file(name).alias("route"), text.checksum_label(parts).alias("checksum"))


@query("SELECT p_partkey, ['正前方', '右前方', '右側', '右後方', '左後方', '左側', '左前方', 'above'][CAST(p_partkey % 8 AS INT) + 1] AS direction FROM part")
def window_names(spark: SparkSession, d: str) -> DataFrame:
    """Sectors of the view in the display's language."""
    names = F.array(*map(F.lit, (*text.WINDOW_NAMES, "above")))
    return D.table(spark, d, "part").select("p_partkey", text.window_name(F.get(names, (F.col("p_partkey") % 8).cast("int"))).alias("direction"))


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'right' WHEN c_custkey % 3 = 1 THEN 'left' END AS gate, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def spread_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two maps as one: the right one's entries count, even those that say there is no value."""
    k = F.col("c_custkey")
    left = F.create_map(F.lit("name"), F.col("c_name"), F.lit("gate"), F.lit("left"))
    right = F.when(k % 3 == 1, F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"))).otherwise(F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("gate"), F.when(k % 3 == 0, "right")))
    m = D.table(spark, d, "customer").select("c_custkey", assembly.spread(left, right).alias("m"))
    return m.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["gate"].alias("gate"), F.col("m")["nation"].alias("nation"))


@query("""SELECT s_suppkey, '{"active":' || CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END || ',"id":' || CAST(s_suppkey AS VARCHAR) || ',"name":"' || s_name || '","nation":' || CAST(s_nationkey AS VARCHAR) || '}' AS json FROM supplier""")
def json_sorted_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON objects with their keys in order."""
    fields = {"name": F.col("s_name"), "id": F.col("s_suppkey"), "nation": F.col("s_nationkey"), "active": F.col("s_acctbal") > 0}
    return D.table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).alias("json"))


@query("""SELECT min(s_suppkey) AS k, CAST(s_suppkey % 37 AS VARCHAR) AS service, any_value(s_suppkey % 37 % 4) AS category, CASE WHEN any_value(s_suppkey % 37 % 5) = 0 THEN '' ELSE '[redacted]' END AS auth_id, '[redacted]' AS auth_password FROM supplier WHERE s_suppkey % 37 % 4 = 2 OR s_suppkey % 37 % 6 = 0 GROUP BY s_suppkey % 37""")
def service_projection(spark: SparkSession, d: str) -> DataFrame:
    """Services of publications, each once, with their credentials blotted out."""
    k = F.col("s_suppkey")
    details = F.struct(F.when(k % 37 % 5 == 0, "").otherwise("queue").alias("auth_id"), F.lit("secret").alias("auth_password"))
    s = D.table(spark, d, "supplier").select(k.alias("k"), (k % 37).cast("string").alias("service"), (k % 37 % 4).alias("category"), F.when(k % 37 % 6 == 0, "AIP data").otherwise("other").alias("name"), details.alias("details"))
    mine = rows.first_wins(s.where((F.col("category") == 2) | F.col("name").contains("AIP")), ["service"], "k")
    for secret in ("auth_id", "auth_password"):
        held = F.col("details").getField(secret)
        mine = mine.withColumn("details", F.col("details").withField(secret, F.when(held != "", "[redacted]").otherwise(held)))
    return mine.select("k", "service", "category", "details.*")


@query("SELECT n_name AS nation, (SELECT max(s_acctbal) FROM supplier) AS top FROM nation")
def scalar_value(spark: SparkSession, d: str) -> DataFrame:
    """One value of a query beside every row of another."""
    D.table(spark, d, "supplier").createOrReplaceTempView("wayfare_supplier")
    D.table(spark, d, "nation").createOrReplaceTempView("wayfare_nation")
    return spark.sql("SELECT n_name AS nation, (SELECT max(s_acctbal) FROM wayfare_supplier) AS top FROM wayfare_nation")


@query(sql("SELECT ident, lat, lon, point_type FROM nav_points UNION ALL SELECT CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE iata END, lat, lon, 'AIRPORT' FROM airports", "nav_points", "airports"))
def route_points_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Points of packs and airports as points of a route; every fourth airport has no code here."""
    p, a = D.nav_points(spark, d), D.airports(spark, d)
    rows_ = p.select(assembly.route_point(F.col("ident"), F.col("lat"), F.col("lon"), F.col("point_type")).alias("r"))
    places = a.select(assembly.place_route_point(F.when(F.col("id") % 4 != 0, F.col("iata")), F.col("id"), F.col("lat"), F.col("lon")).alias("r"))
    return rows_.unionByName(places).select("r.*")
