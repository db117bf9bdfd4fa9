"""Queries over journeys: lengths, replay, events, phases, summaries, records, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo, text
from ..operators import rows
from ..operators import trajectory as T
from . import domain as D
from .domain import clamp, mod, q, sql


@query(sql(f"SELECT journey, count(*) AS n_points, {q('CAST(sum(step_mm) AS DOUBLE) / 1e3', 1)} AS length_m FROM steps GROUP BY journey", "steps"))
def trajectory_length(spark: SparkSession, d: str) -> DataFrame:
    return T.bounds(D.points(spark, d)).select("journey", "n_points", "length_m")


@query(sql(f"SELECT journey, min(ts) AS start_ts, max(ts) AS end_ts, greatest(1e0, max(t) - min(t)) AS duration_s, {q('CAST(sum(step_mm) AS DOUBLE) / 1e3', 1)} AS length_m, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, max(coalesce(alt, 0)) AS max_alt, max(coalesce(speed, 0)) AS max_speed FROM steps GROUP BY journey", "steps"))
def route_bounds(spark: SparkSession, d: str) -> DataFrame:
    return T.bounds(D.points(spark, d)).drop("n_points")


_FLOWN = "f AS (SELECT *, CAST(sum(step_mm) OVER (PARTITION BY journey ORDER BY ts, ord ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e3 AS flown, CAST(sum(step_mm) OVER (PARTITION BY journey) AS DOUBLE) / 1e3 AS total FROM steps)"


@query(sql(f"WITH {_FLOWN} SELECT journey, ord, {q('flown', 1)} AS flown_m, {q('greatest(0e0, total - flown)', 1)} AS remaining_m FROM f", "steps"))
def flown_remaining_running(spark: SparkSession, d: str) -> DataFrame:
    return T.flown(D.points(spark, d)).select("journey", "ord", geo.quantise(F.col("flown_m"), 1).alias("flown_m"), geo.quantise(F.col("remaining_m"), 1).alias("remaining_m"))


def _profile_sql(low: str, cruise: str) -> str:
    c = cruise
    return f"CASE WHEN fr <= 0.08 THEN 0e0 + ({low} - 0e0) * least(1e0, greatest(0e0, fr / 0.08e0)) WHEN fr <= 0.24 THEN {low} + ({c} - {low}) * least(1e0, greatest(0e0, (fr - 0.08e0) / 0.16e0)) WHEN fr >= 0.86 THEN {c} + (0e0 - {c}) * least(1e0, greatest(0e0, (fr - 0.86e0) / 0.14e0)) ELSE {c} END"


@query(sql(f"""WITH {_FLOWN}, g AS (SELECT *, least(1e0, flown / greatest(1e0, total)) AS fr, CASE WHEN total < 900000 THEN 8800e0 WHEN total < 2500000 THEN 10700e0 ELSE 11600e0 END AS ca, CASE WHEN total < 900000 THEN 210e0 ELSE 245e0 END AS cs FROM f)
SELECT journey, ord, {q('fr', 6)} AS fraction, {q('36000e0 * fr', 2)} AS at_s, {q(_profile_sql('3600e0', 'ca'), 1)} AS alt_m, {q(_profile_sql('145e0', 'cs'), 2)} AS speed FROM g""", "steps"))
def timed_route_fraction(spark: SparkSession, d: str) -> DataFrame:
    """A planned route of ten hours by the fraction flown."""
    r = T.timed(D.points(spark, d), F.lit(36000.0), F.lit(0.0))
    return r.select("journey", "ord", geo.quantise(F.col("fraction"), 6).alias("fraction"), geo.quantise(F.col("at_s"), 2).alias("at_s"), geo.quantise(F.col("plan_alt"), 1).alias("alt_m"), geo.quantise(F.col("plan_speed"), 2).alias("speed"))


@query(sql(f"""WITH j AS (SELECT journey, min(t) AS lo, max(t) AS hi FROM steps GROUP BY 1), k AS (SELECT journey, lo, hi, CAST(floor(lo) AS BIGINT) - 3600 + i * 86400 AS tick FROM j, (SELECT unnest(range(0, 32)) AS i)),
c AS (SELECT journey, CAST(tick AS DOUBLE) AS tick_s, least(hi, greatest(lo, CAST(tick AS DOUBLE))) AS tm FROM k),
x AS (SELECT c.journey, c.tick_s, c.tm, (SELECT max(t) FROM steps s WHERE s.journey = c.journey AND s.t <= c.tm) AS ta, (SELECT min(t) FROM steps s WHERE s.journey = c.journey AND s.t > c.tm) AS tb FROM c),
pa AS (SELECT journey, t, max_by(struct_pack(lat := lat, lon := lon, alt := alt, speed := speed, source := source), ord) AS p FROM steps GROUP BY 1, 2),
pb AS (SELECT journey, t, min_by(struct_pack(lat := lat, lon := lon, alt := alt, speed := speed, source := source), ord) AS p FROM steps GROUP BY 1, 2),
y AS (SELECT x.journey, x.tick_s, pa.p AS a, coalesce(pb.p, pa.p) AS b, coalesce((tm - ta) / nullif(tb - ta, 0e0), 0e0) AS f FROM x JOIN pa ON pa.journey = x.journey AND pa.t = x.ta LEFT JOIN pb ON pb.journey = x.journey AND pb.t = x.tb)
SELECT journey, tick_s, {q('a.alt + (b.alt - a.alt) * least(1e0, greatest(0e0, f))', 2)} AS alt, {q('a.speed + (b.speed - a.speed) * least(1e0, greatest(0e0, f))', 3)} AS speed, CASE WHEN a.source = 'gps' AND b.source = 'gps' THEN 'interpolated' ELSE a.source END AS source FROM y""", "steps"))
def replay_sample_asof(spark: SparkSession, d: str) -> DataFrame:
    """Replay positions once a day, clamped to a journey's span."""
    p = D.points(spark, d)
    lo = p.groupBy("journey").agg(F.floor(F.min(T.seconds("ts"))).cast("bigint").alias("lo"))
    ticks = lo.select("journey", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "lo").select("journey", (F.col("lo") - 3600 + F.col("i") * 86400).cast("double").alias("tick_s"))
    s = T.sample_at(p, ticks)
    return s.select("journey", "tick_s", geo.quantise(F.col("alt"), 2).alias("alt"), geo.quantise(F.col("speed"), 3).alias("speed"), "source")


_EVENTS = """r AS (SELECT journey, ts, ord, coalesce(alt, 0e0) AS alt, coalesce(speed, 0e0) AS speed, row_number() OVER (PARTITION BY journey ORDER BY ts, ord) AS n, max(coalesce(alt, 0e0)) OVER (PARTITION BY journey) AS top FROM points),
g AS (SELECT journey, coalesce(min(n) FILTER (alt > 600 AND speed > 35), min(n) FILTER (n >= 2), 1) AS takeoff, min(n) FILTER (alt >= top * 0.92e0) AS toc, max(n) FILTER (alt >= top * 0.92e0) AS tod, max(n) AS landing, arg_max(n, struct_pack(a := alt, b := -n)) AS ma, arg_max(n, struct_pack(a := speed, b := -n)) AS ms FROM r GROUP BY 1),
k AS (SELECT journey, unnest(['takeoff', 'topOfClimb', 'cruise', 'topOfDescent', 'landing', 'maxAltitude', 'maxSpeed']) AS kind, unnest([takeoff, toc, toc, tod, landing, ma, ms]) AS n, unnest([0, 1, 2, 3, 4, 5, 6]) AS rank FROM g),
e AS (SELECT k.journey, kind, ts, ord, rank FROM k JOIN r ON k.journey = r.journey AND k.n = r.n)"""


@query(sql(f"""WITH {_EVENTS}, a AS (SELECT * FROM e UNION ALL SELECT journey, 'cruise', ts, ord, 7 FROM points WHERE event_type = 'purchase' AND ord % 10 = 0)
SELECT journey, kind, ts, ord FROM (SELECT *, row_number() OVER (PARTITION BY journey, kind, ts ORDER BY rank, ord) AS rn FROM a) WHERE rn = 1""", "points"))
def flight_events(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d)
    known = p.where("event_type = 'purchase' AND ord % 10 = 0").select("journey", F.lit("cruise").alias("kind"), "ts", "ord")
    return T.flight_events(p, known).select("journey", "kind", "ts", "ord")


@query(sql(f"""WITH {_EVENTS}, {_FLOWN}, s AS (SELECT journey, ord, t, alt, flown FROM f),
l AS (SELECT s.*, (SELECT arg_max(kind, struct_pack(t := epoch_us(e.ts) / 1e6, r := e.rank)) FROM e WHERE e.journey = s.journey AND epoch_us(e.ts) / 1e6 <= s.t) AS last FROM s)
SELECT journey, ord, t AS tick_s, CASE WHEN last IN ('topOfClimb', 'cruise') THEN 'Cruise' WHEN last = 'topOfDescent' THEN 'Descent' WHEN alt < 900 AND flown > 10000 THEN 'Approach' WHEN last = 'takeoff' THEN 'Takeoff' WHEN last = 'landing' THEN 'Landing' WHEN last = 'maxAltitude' THEN 'Max altitude' WHEN last = 'maxSpeed' THEN 'Max speed' ELSE 'Climb' END AS phase FROM l""", "points", "steps"))
def flight_phase(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d)
    samples = T.flown(p).select("journey", "ord", T.seconds("ts").alias("tick_s"), "alt", "flown_m")
    return T.phase_at(samples, T.flight_events(p))


@query(sql("""WITH v AS (SELECT *, lag(alt) OVER w AS pa, lag(t) OVER w AS pt FROM steps WINDOW w AS (PARTITION BY journey ORDER BY ts, ord))
SELECT journey, ord, CAST(coalesce(floor((alt - coalesce(pa, 0e0)) / greatest(1e0 / 60e0, (t - pt) / 60e0) / 10e0 + 0.5e0) * 10, 0) AS BIGINT) AS vs_mpm FROM v WHERE pt IS NOT NULL""", "steps"))
def vertical_speed(spark: SparkSession, d: str) -> DataFrame:
    w = T.in_order()
    p = D.points(spark, d)
    return T.vertical_speed(p).withColumn("n", F.row_number().over(w)).where("n > 1").select("journey", "ord", "vs_mpm")


@query(sql("""WITH x AS (SELECT *, max(coalesce(alt, 0)) OVER (PARTITION BY journey) AS top FROM steps), y AS (SELECT *, min(n) FILTER (alt >= top * 0.88e0) OVER (PARTITION BY journey) AS a, max(n) FILTER (alt >= top * 0.88e0) OVER (PARTITION BY journey) AS b FROM x)
SELECT journey, ord, CASE WHEN n <= a THEN 'climb' WHEN n >= b THEN 'descent' ELSE 'cruise' END AS part FROM y""", "steps"))
def climb_descent_split(spark: SparkSession, d: str) -> DataFrame:
    return T.climb_descent(D.points(spark, d)).select("journey", "ord", "part")


@query(sql(f"""WITH {_FLOWN}, n AS (SELECT *, lead(flown) OVER (PARTITION BY journey ORDER BY ts, ord) AS nf FROM f)
SELECT journey, ord, {q('flown', 1)} AS at_m, false AS cut FROM n WHERE flown BETWEEN 2000000e0 AND 5000000e0
UNION ALL SELECT journey, ord, 5000000e0, true FROM n WHERE flown <= 5000000e0 AND nf > 5000000e0 AND 5000000e0 - flown > 200""", "steps"))
def lookahead_window(spark: SparkSession, d: str) -> DataFrame:
    """The route from 2,000 km on for 3,000 km, with an interpolated end."""
    return T.look_ahead(D.points(spark, d), 2e6, 3e6).select("journey", "ord", geo.quantise(F.col("at_m"), 1).alias("at_m"), "cut")


@query(sql(f"""WITH c AS (SELECT *, lag(alt) OVER w AS pa, {D.bearing('plat', 'plon', 'lat', 'lon')} AS c1, {D.bearing('lat', 'lon', 'nlat', 'nlon')} AS c2 FROM steps WINDOW w AS (PARTITION BY journey ORDER BY ts, ord)),
t AS (SELECT *, coalesce({mod('c2 - c1 + 540e0', '360e0')} - 180e0, 0e0) AS turn FROM c)
SELECT journey, ord, {q(clamp('degrees(atan2(coalesce(alt - pa, 0e0), greatest(1e0, step_m)))', '-18e0', '18e0'), 3)} AS pitch, {q("CASE WHEN abs(turn) < 0.8 THEN 0e0 ELSE " + clamp('turn * 0.6e0', '-28e0', '28e0') + " END", 3)} AS roll,
{q('speed * sqrt(pow(least(1e0, greatest(0.01e0, 1e0 - 2.25577e-5 * alt)), 4.25588e0))', 2)} AS ias FROM t""", "steps"))
def pilot_attitude(spark: SparkSession, d: str) -> DataFrame:
    a = T.attitude(D.points(spark, d))
    return a.select("journey", "ord", geo.quantise(F.col("pitch"), 3).alias("pitch"), geo.quantise(F.col("roll"), 3).alias("roll"), geo.quantise(F.col("ias"), 2).alias("ias"))


@query(sql(f"""WITH x AS (SELECT journey, list(CASE WHEN abs(coalesce(speed, 0e0)) < 0.8 THEN 0e0 ELSE speed END ORDER BY ts, ord) AS v, list(ord ORDER BY ts, ord) AS o FROM points GROUP BY 1),
y AS (SELECT journey, o, list_reduce(v, lambda a, b: a + (b - a) * 0.12e0, 0e0) AS s FROM x) SELECT journey, o[len(o)] AS ord, {q('s', 4)} AS smooth FROM y""", "points"))
def smoothed_last(spark: SparkSession, d: str) -> DataFrame:
    """The last exponentially smoothed value of each journey."""
    s = T.smoothed(D.points(spark, d), "speed")
    last = rows.last_wins(s.join(D.points(spark, d).select("journey", "ord", "ts"), ["journey", "ord"]), ["journey"], "ts", "ord")
    return last.select("journey", "ord", geo.quantise(F.col("smooth"), 4).alias("smooth"))


_SUMMARY = f"s AS (SELECT journey, count(*) AS n_points, {q('CAST(sum(step_mm) AS DOUBLE) / 1e3', 1)} AS length_m, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS modes, year(min(ts)) AS year FROM steps GROUP BY journey), c AS (SELECT s.*, country FROM s JOIN nations ON n_nationkey = journey % 25)"


def journey_table(spark: SparkSession, d: str) -> DataFrame:
    p = T.with_steps(D.points(spark, d))
    s = p.groupBy("journey").agg(F.count("*").alias("n_points"), geo.quantise(F.sum("step_mm") / 1e3, 1).alias("length_m"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("modes"), F.year(F.min("ts")).cast("bigint").alias("year"))
    return s.withColumn("k", (F.col("journey") % 25).cast("int")).join(F.broadcast(D.nations(spark, d)), F.col("k") == F.col("n_nationkey")).drop("k", "n_nationkey", "region")


@query(sql(f"WITH {_SUMMARY} SELECT * FROM c", "steps", "nations"))
def journey_summary(spark: SparkSession, d: str) -> DataFrame:
    return journey_table(spark, d)


@query(sql(f"WITH {_SUMMARY}, m AS (SELECT DISTINCT event_type AS m FROM points) SELECT count(*) AS journeys, CAST(sum(n_points) AS BIGINT) AS points, {q('sum(length_m)', 0)} AS length_m, (SELECT string_agg(m, ',' ORDER BY m) FROM m) AS modes, string_agg(DISTINCT country, ',' ORDER BY country) AS countries FROM c", "steps", "nations"))
def lifetime_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row over all journeys, from their summaries."""
    j = journey_table(spark, d)
    modes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("modes", ","))))), ",")
    return j.agg(F.count("*").alias("journeys"), F.sum("n_points").alias("points"), geo.quantise(F.sum("length_m"), 0).alias("length_m"), modes.alias("modes"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"))


@query(sql(f"WITH {_SUMMARY} SELECT year, count(*) AS journeys, string_agg(CAST(journey AS VARCHAR), ',' ORDER BY journey) AS ids, {q('CAST(sum(CAST(floor(length_m * 10 + 0.5e0) AS BIGINT)) AS DOUBLE) / 10e0', 0)} AS length_m FROM c GROUP BY year", "steps", "nations"))
def time_machine(spark: SparkSession, d: str) -> DataFrame:
    """Journeys of each year, listed by blocks of a thousand numbers first; lengths are added up in whole tenths of a metre."""
    tenths = F.floor(F.col("length_m") * 10 + 0.5)
    blocks = journey_table(spark, d).groupBy("year", F.floor(F.col("journey") / 1000).alias("block")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("journey")).cast("array<string>"), ",").alias("ids"), F.sum(tenths).alias("tenths"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda s: s.ids), ",")
    return blocks.groupBy("year").agg(F.sum("n").alias("journeys"), ids.alias("ids"), geo.quantise(F.sum("tenths") / 10, 0).alias("length_m"))


_REGION = "CASE " + " ".join(f"WHEN lat BETWEEN {s} AND {n} AND lon BETWEEN {w} AND {e} THEN '{r}'" for r, s, n, w, e in geo.REGION_BOXES) + " ELSE 'world' END"


@query(sql(f"SELECT {_REGION} AS region, year(ts) AS year, month(ts) AS month, count(*) AS records FROM points GROUP BY 1, 2, 3", "points"))
def records_by_region_year(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d)
    return p.groupBy(geo.region(F.col("lat"), F.col("lon")).alias("region"), F.year("ts").cast("bigint").alias("year"), F.month("ts").cast("bigint").alias("month")).agg(F.count("*").alias("records"))


@query(sql(f"""SELECT ord, event_type AS title, {_REGION} AS region, strftime(ts, '%b %d, %Y') AS date_label, printf('%.2f', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || ', ' || printf('%.2f', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS coordinates,
upper(left({_REGION}, 2)) AS marker FROM points WHERE event_type IN ('purchase', 'signup')""", "points"))
def travel_records(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d).where(F.col("event_type").isin("purchase", "signup"))
    region = geo.region(F.col("lat"), F.col("lon"))
    return p.select("ord", F.col("event_type").alias("title"), region.alias("region"), F.date_format("ts", "MMM dd, yyyy").alias("date_label"), text.coordinate_label(F.col("lat"), F.col("lon")).alias("coordinates"), text.marker_label(F.col("event_type"), region).alias("marker"))


@query(sql("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY journey ORDER BY ts, ord) AS n, count(*) OVER (PARTITION BY journey) AS c FROM points)
SELECT journey, ord, CASE WHEN n <= 2 OR n > c - 2 THEN floor(lat * 20 + 0.5e0) / 20e0 ELSE lat END AS lat, CASE WHEN n <= 2 OR n > c - 2 THEN floor(lon * 20 + 0.5e0) / 20e0 ELSE lon END AS lon,
CASE WHEN n <= 2 OR n > c - 2 THEN greatest(coalesce(accuracy, 0e0), 5000e0) ELSE accuracy END AS accuracy FROM w""", "points"))
def share_safe_redaction(spark: SparkSession, d: str) -> DataFrame:
    return T.redact(D.points(spark, d)).select("journey", "ord", "lat", "lon", "accuracy")


@query("SELECT e.event_id, c.c_custkey AS media, c.c_name AS name FROM events e JOIN customer c ON c.c_custkey IN (e.event_id % 1000, e.event_id % 1000 + 1, e.user_id) WHERE e.event_type = 'purchase'")
def media_by_membership(spark: SparkSession, d: str) -> DataFrame:
    """Media of each event by the ids that it lists."""
    e = D.table(spark, d, "events").where("event_type = 'purchase'")
    ids = e.select("event_id", F.explode(F.array_distinct(F.array(F.col("event_id") % 1000, F.col("event_id") % 1000 + 1, F.col("user_id")))).alias("media"))
    return ids.join(D.table(spark, d, "customer").select(F.col("c_custkey").alias("media"), F.col("c_name").alias("name")), "media")


@query("""SELECT event_id, coalesce(nullif(trim(CASE event_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'Edited ' || CAST(event_id AS VARCHAR) END), ''), event_type) AS title FROM events WHERE event_type = 'signup' AND event_id % 7 <> 0""")
def record_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Records with edits laid over them, hidden ones left out."""
    e = D.table(spark, d, "events").where("event_type = 'signup'")
    base = e.select("event_id", F.col("event_type").alias("title"))
    edits = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "  ").when(F.col("event_id") % 3 == 1, F.concat(F.lit("Edited "), F.col("event_id").cast("string"))).alias("title"), (F.col("event_id") % 7 == 0).alias("hidden"))
    shown = base.join(edits.where("hidden").select("event_id"), "event_id", "left_anti")
    return rows.overlay(shown, edits.select("event_id", "title"), "event_id", ["title"])


@query("SELECT event_id, event_type, value FROM events WHERE NOT (event_id % 5 = 0) UNION ALL SELECT event_id, 'edited', value * 2 FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id + 10000000, 'new', value FROM events WHERE event_id % 50 = 1")
def event_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = D.table(spark, d, "events").select("event_id", "event_type", "value")
    new = e.where("event_id % 5 = 0").select("event_id", F.lit("edited").alias("event_type"), (F.col("value") * 2).alias("value")).unionAll(e.where("event_id % 50 = 1").select(F.col("event_id") + 10_000_000, F.lit("new"), "value"))
    return rows.upsert(e, new, ["event_id"])


_VISITS = "old AS (SELECT event_id AS id, user_id AS journey, CASE WHEN event_id % 4 <> 0 THEN event_id % 500 END AS source_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 500 ORDER BY event_id) AS n FROM events WHERE event_id // 500 % 2 = 0) WHERE n = 1), new AS (SELECT event_id AS id, user_id AS journey, CASE WHEN event_id % 4 <> 0 THEN event_id % 500 END AS source_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 500 ORDER BY event_id) AS n FROM events WHERE event_id // 500 % 2 = 1) WHERE n = 1)"


@query(f"WITH {_VISITS} SELECT coalesce(o.id, n.id) AS id, n.journey, n.source_id, n.value FROM new n LEFT JOIN old o ON n.journey = o.journey AND n.source_id = o.source_id WHERE n.source_id IS NOT NULL UNION ALL SELECT * FROM new WHERE source_id IS NULL UNION ALL SELECT * FROM old WHERE source_id IS NULL OR NOT EXISTS (SELECT 1 FROM new n WHERE n.journey = old.journey AND n.source_id = old.source_id)")
def visit_point_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Upsert on (journey, source id) where the source id is known; the first id of a visit stays."""
    e = D.table(spark, d, "events").withColumn("s", F.col("event_id") % 500)

    def part(x: DataFrame) -> DataFrame:
        return rows.first_wins(x, ["user_id", "s"], "event_id").select(F.col("event_id").alias("id"), F.col("user_id").alias("journey"), F.when(F.col("event_id") % 4 != 0, F.col("s")).alias("source_id"), "value")

    return rows.upsert_partial(part(e.where("event_id DIV 500 % 2 = 0")), part(e.where("event_id DIV 500 % 2 = 1")), "source_id", ["journey", "source_id"], ["id"])


@query("""WITH j AS (SELECT o_orderkey AS journey, o_orderdate AS a, o_orderdate + INTERVAL 2 DAY AS b FROM orders),
x AS (SELECT journey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity FROM j JOIN lineitem ON l_shipdate >= a AND l_shipdate <= b WHERE l_orderkey % 3 <> 0),
y AS (SELECT *, row_number() OVER (PARTITION BY journey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM x) SELECT journey, l_orderkey, l_linenumber, n FROM y WHERE n <= 80""")
def photo_interval_anti_limit(spark: SparkSession, d: str) -> DataFrame:
    """Photos within a journey's time that are not imported yet, the first 80 of each journey.

    The interval join is an equi join on days: each interval lists the days that it touches. Journeys
    that span the same time see the same photos, so these are ranked once for each distinct interval.
    """
    o = D.table(spark, d, "orders")
    j = o.select(F.col("o_orderkey").alias("journey"), F.col("o_orderdate").alias("a"))
    spans = j.select("a").distinct().withColumn("b", F.expr("a + INTERVAL 2 DAY")).withColumn("day", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))))
    x = D.table(spark, d, "lineitem")
    imported = D.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    photos = x.join(imported, "l_orderkey", "left_anti").withColumn("day", F.to_date("l_shipdate"))
    hits = spans.join(photos, "day").where("l_shipdate >= a AND l_shipdate <= b")
    first = rows.top_per_key(hits, ["a"], 80, *map(F.col, ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")), rank="n")
    return j.join(first, "a").select("journey", "l_orderkey", "l_linenumber", "n")


@query(sql(f"SELECT journey, ord, replace(format('{{:,}}', CAST(floor(alt * 3.28084e0 + 0.5e0) AS BIGINT)), ' ', '') || ' ft' AS altitude, lpad(CAST(CAST(floor(course + 0.5e0) AS BIGINT) AS VARCHAR), 3, '0') || ' deg' AS heading, {q('speed * 3.6e0', 1)} AS speed_kmh FROM points", "points"))
def hud_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Altitude in feet, heading and speed as shown to a pilot."""
    p = D.points(spark, d)
    feet = F.floor(F.col("alt") * 3.28084 + 0.5)
    return p.select("journey", "ord", F.concat(F.format_number(feet, 0), F.lit(" ft")).alias("altitude"), F.concat(F.lpad(F.floor(F.col("course") + 0.5).cast("string"), 3, "0"), F.lit(" deg")).alias("heading"), geo.quantise(F.col("speed") * 3.6, 1).alias("speed_kmh"))


@query(sql("SELECT journey, ord, ts FROM (SELECT journey, ord, ts, row_number() OVER (PARTITION BY journey ORDER BY ts DESC, ord DESC) AS n FROM points) WHERE n <= 20", "points"))
def recent_points(spark: SparkSession, d: str) -> DataFrame:
    """The latest 20 points of each journey."""
    return rows.top_per_key(D.points(spark, d), ["journey"], 20, F.desc("ts"), F.desc("ord")).select("journey", "ord", "ts")


@query(sql(f"""WITH {_FLOWN}, x AS (SELECT *, lead(alt) OVER w AS nalt, lead(step_m) OVER w AS nstep, max(coalesce(alt, 0e0)) OVER (PARTITION BY journey) AS top FROM f WINDOW w AS (PARTITION BY journey ORDER BY ts, ord)),
k AS (SELECT *, CASE WHEN nlat IS NULL THEN 1 ELSE greatest(4, least(24, CAST(ceil(nstep / 120000e0) AS INT))) END AS pieces FROM x), e AS (SELECT k.*, i AS piece, CAST(i AS DOUBLE) / pieces AS u FROM k, (SELECT unnest(range(0, 24)) AS i) WHERE i < pieces),
p AS (SELECT *, (flown + coalesce(nstep, 0e0) * u) / greatest(1e0, total) AS g FROM e), r AS (SELECT *, CASE WHEN g < 0.26 THEN g / 0.26e0 WHEN g > 0.74 THEN (1e0 - g) / 0.26e0 ELSE 0e0 END AS phase FROM p)
SELECT journey, ord, piece, {q("CASE WHEN nlat IS NULL THEN coalesce(alt, 0e0) ELSE greatest(0e0, coalesce(alt, 0e0) + (coalesce(nalt, 0e0) - coalesce(alt, 0e0)) * (u * u * u * (u * (u * 6e0 - 15e0) + 10e0)) + sin(pi() * phase) * least(4200e0, top * 0.28e0)) END", 2)} AS alt FROM r""", "steps"))
def visual_route(spark: SparkSession, d: str) -> DataFrame:
    """Altitudes of routes cut into short pieces for drawing."""
    return T.smoothed_line(D.points(spark, d)).select("journey", "ord", F.col("piece").cast("long").alias("piece"), geo.quantise(F.col("alt"), 2).alias("alt"))


@query(sql(f"SELECT journey, ord, n = 1 OR t < lt - 1 OR {D.hav_m('plat', 'plon', 'lat', 'lon')} > 15000 AS snap FROM (SELECT journey, ord, lat, lon, epoch_us(ts) / 1e6 AS t, lag(epoch_us(ts) / 1e6) OVER w AS lt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS n FROM points WINDOW w AS (PARTITION BY journey ORDER BY ord % 13, ord))", "points"))
def camera_snaps(spark: SparkSession, d: str) -> DataFrame:
    """Jumps of the view along points in an order of arrival of their own."""
    p = D.points(spark, d).withColumn("arrival", F.col("ord") % 13)
    return T.snaps(p, order=["arrival", "ord"])


def _smooth_sql(lo: str, hi: str, x: str) -> str:
    t = clamp(f"(({x}) - {lo}) / ({hi} - {lo})", "0e0", "1e0")
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


@query(sql(f"""WITH x AS (SELECT journey, ord, greatest(0e0, coalesce(alt, 0e0)) / 10e0 AS h, lat, lon, first_value(lat) OVER w AS olat, first_value(lon) OVER w AS olon, last_value(lat) OVER w AS dlat, last_value(lon) OVER w AS dlon FROM points WINDOW w AS (PARTITION BY journey ORDER BY ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
y AS (SELECT *, (1e0 - {_smooth_sql('9000e0', '95000e0', D.hav_m('lat', 'lon', 'olat', 'olon'))}) * (1e0 - {_smooth_sql('1200e0', '9800e0', 'h')}) AS o, (1e0 - {_smooth_sql('9000e0', '95000e0', D.hav_m('lat', 'lon', 'dlat', 'dlon'))}) * (1e0 - {_smooth_sql('1200e0', '9800e0', 'h')}) AS dd FROM x)
SELECT journey, ord, CASE WHEN dd >= o THEN 'destination' ELSE 'origin' END AS focus, {q('greatest(o, dd)', 5)} AS strength, {q(f"greatest(o, dd) * (1e0 - {_smooth_sql('260e0', '6200e0', 'h')})", 5)} AS ground FROM y""", "points"))
def airport_focus(spark: SparkSession, d: str) -> DataFrame:
    """How much the ends of a journey draw the view at each point, with altitudes of a tenth."""
    w = T.in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = D.points(spark, d).withColumn("alt", F.greatest(F.lit(0.0), F.coalesce("alt", F.lit(0.0))) / 10.0)
    p = p.withColumns({"olat": F.first("lat").over(w), "olon": F.first("lon").over(w), "dlat": F.last("lat").over(w), "dlon": F.last("lon").over(w)})
    a = T.airport_focus(p)
    return a.select("journey", "ord", "focus", geo.quantise(F.col("strength"), 5).alias("strength"), geo.quantise(F.col("ground_strength"), 5).alias("ground"))


@query(sql("SELECT journey, event_type AS key, place FROM (SELECT journey, event_type, row_number() OVER (PARTITION BY journey ORDER BY max(ts) DESC, max(ord) DESC) AS place FROM points GROUP BY 1, 2) WHERE place <= 3", "points"))
def recent_keys(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of events that each journey used last, latest first."""
    last = D.points(spark, d).groupBy("journey", F.col("event_type").alias("key")).agg(F.max("ts").alias("ts"), F.max("ord").alias("o"))
    return rows.top_per_key(last, ["journey"], 3, F.desc("ts"), F.desc("o"), rank="place").select("journey", "key", "place")


@query(sql("""WITH m AS (SELECT o_orderkey AS pack, o_orderpriority AS revision, o_totalprice AS size FROM orders), have AS (SELECT o_orderkey AS pack, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE o_orderpriority END AS revision FROM orders WHERE o_orderkey % 3 <> 0)
SELECT pack, CASE WHEN have.pack IS NULL THEN 'missing' WHEN have.revision <> m.revision THEN 'outdated' ELSE 'ready' END AS status, size FROM m LEFT JOIN have USING (pack)"""))
def pack_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """State of each pack of a manifest against what is there: missing, outdated or ready."""
    o = D.table(spark, d, "orders")
    manifest = o.select(F.col("o_orderkey").alias("pack"), F.col("o_orderpriority").alias("revision"), F.col("o_totalprice").alias("size"))
    have = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("pack"), F.when(F.col("o_orderkey") % 4 == 0, "old").otherwise(F.col("o_orderpriority")).alias("held"))
    status = F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("revision"), "outdated").otherwise("ready")
    return manifest.join(have, "pack", "left").select("pack", status.alias("status"), "size")
