"""Live-position queries in batch form; wayfare.streaming runs the same rules on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo
from ..operators import live
from . import domain as D
from .domain import q, sql


@query("""SELECT user_id AS journey, event_id AS ord FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE top IS NULL OR ts > top""")
def late_drop(spark: SparkSession, d: str) -> DataFrame:
    """Points in an arrival order of their own, late ones dropped."""
    p = D.points(spark, d).withColumn("arrival", F.col("ord") % 97)
    return live.drop_late(p, ["arrival", "ord"]).select("journey", "ord")


_GAP = "g AS (SELECT *, CAST(ord % 120 AS DOUBLE) / 1e0 * 0.9e0 AS gap_s FROM points), s AS (SELECT *, CASE WHEN gap_s <= 1.5 THEN 'live' WHEN gap_s <= 90 AND speed > 0.5 THEN 'estimated' ELSE 'lost' END AS status FROM g)"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return D.points(spark, d).withColumn("gap_s", (F.col("ord") % 120).cast("double") * 0.9)


@query(sql(f"WITH {_GAP} SELECT journey, status, count(*) AS n FROM s GROUP BY 1, 2", "points"))
def gps_gap_status(spark: SparkSession, d: str) -> DataFrame:
    return _gaps(spark, d).groupBy("journey", live.gap_status(F.col("gap_s"), F.col("speed")).alias("status")).agg(F.count("*").alias("n"))


@query(sql(f"""WITH {_GAP}, a AS (SELECT *, speed * gap_s / 6371008.8e0 AS dd FROM s), b AS (SELECT *, asin(least(1e0, greatest(-1e0, sin(radians(lat)) * cos(dd) + cos(radians(lat)) * sin(dd) * cos(radians(course))))) AS la FROM a)
SELECT journey, ord, status, {q("CASE WHEN status = 'estimated' THEN degrees(la) ELSE lat END", 5)} AS est_lat FROM b""", "points"))
def dead_reckoning(spark: SparkSession, d: str) -> DataFrame:
    return live.dead_reckon(_gaps(spark, d)).select("journey", "ord", "status", geo.quantise(F.col("est_lat"), 5).alias("est_lat"))


@query(sql("SELECT journey, ord FROM points WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND accuracy BETWEEN 0 AND 500", "points"))
def accepted_points(spark: SparkSession, d: str) -> DataFrame:
    return live.accepted(D.points(spark, d)).select("journey", "ord")


@query(sql(f"""WITH RECURSIVE_IN p AS (SELECT journey, ord, epoch_us(ts) / 1e6 AS t, lat, lon, alt, course, row_number() OVER (PARTITION BY journey ORDER BY ts, ord) AS n FROM points WHERE source = 'gps'),
w(journey, n, ord, keep, kt, klat, klon, kalt, kcourse) AS (SELECT journey, n, ord, true, t, lat, lon, alt, course FROM p WHERE n = 1 UNION ALL
SELECT journey, n, ord, k, CASE WHEN k THEN t ELSE kt END, CASE WHEN k THEN lat ELSE klat END, CASE WHEN k THEN lon ELSE klon END, CASE WHEN k THEN alt ELSE kalt END, CASE WHEN k THEN course ELSE kcourse END FROM (
SELECT p.*, kt, klat, klon, kalt, kcourse, t - kt >= 5e0 OR {D.hav_m('klat', 'klon', 'lat', 'lon')} >= 250e0 OR least(abs(kcourse - course) % 360, 360 - abs(kcourse - course) % 360) >= 12 OR abs(alt - kalt) >= 120 AS k FROM w JOIN p ON p.journey = w.journey AND p.n = w.n + 1))
SELECT journey, ord FROM w WHERE keep""".replace("RECURSIVE_IN ", ""), "points", recursive=True))
def gps_thinning(spark: SparkSession, d: str) -> DataFrame:
    """Points to save, each held against the last saved one."""
    return live.thin(D.points(spark, d))


def _signals(spark: SparkSession, d: str) -> DataFrame:
    home = (F.col("ord") * 101 % 4000).cast("double")
    return D.points(spark, d).select("journey", "ts", "ord", home.alias("home_m"), (F.col("speed") - 10.0).alias("speed"))


@query(sql("""WITH p AS (SELECT journey, ord, CAST(ord * 101 % 4000 AS DOUBLE) AS m, speed - 10e0 > 2 AS moving, row_number() OVER (PARTITION BY journey ORDER BY ts, ord) AS n FROM points),
w(journey, n, ord, state) AS (SELECT journey, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'Idle' FROM p WHERE n = 1 UNION ALL
SELECT p.journey, p.n, p.ord, CASE WHEN state = 'Idle' AND m > 1200 AND moving THEN 'PossibleJourney' WHEN state = 'PossibleJourney' AND m > 2500 AND moving THEN 'JourneyRecording' WHEN state = 'JourneyRecording' AND NOT moving THEN 'TemporarilyStationary' WHEN state = 'TemporarilyStationary' AND moving THEN 'JourneyRecording' WHEN state IN ('JourneyRecording', 'TemporarilyStationary') AND m < 300 THEN 'JourneyCompleted' ELSE state END FROM w JOIN p ON p.journey = w.journey AND p.n = w.n + 1)
SELECT journey, ord, state FROM w WHERE n > 0""", "points", recursive=True))
def auto_recorder_fsm(spark: SparkSession, d: str) -> DataFrame:
    """State of the trip recorder after each signal."""
    return live.recorder_states(_signals(spark, d))


@query(sql("""WITH x AS (SELECT journey, ts, ord, source, (ord * 7919 % 1000) * 1000000 AS storage_left FROM points),
y AS (SELECT journey, ts, ord, 'gps-estimated' AS id FROM x WHERE source IN ('estimated', 'interpolated') UNION ALL SELECT journey, ts, ord, 'storage-low' FROM x WHERE storage_left < 500000000)
SELECT journey, id, 'warning' AS severity, ts, ord FROM (SELECT *, row_number() OVER (PARTITION BY journey, id ORDER BY ts, ord) AS n FROM y) WHERE n = 1""", "points"))
def notifications_once(spark: SparkSession, d: str) -> DataFrame:
    p = D.points(spark, d).withColumn("storage_left", F.col("ord") * 7919 % 1000 * 1_000_000)
    return live.notifications(p, ["journey"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 10 = 0 THEN 'dropped' ELSE 'location.update' END AS kind FROM events")
def json_payload(spark: SparkSession, d: str) -> DataFrame:
    """Messages decoded whether their payload is an object or a string that holds one; malformed ones are dropped."""
    from ..sources.messages import decode

    e = D.table(spark, d, "events")
    kind = F.when(F.col("event_id") % 10 == 0, "dropped").otherwise("location.update")
    body = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(kind.alias("type"), F.col("props").alias("payload")))).otherwise(F.concat(F.lit('{"type":"'), kind, F.lit('","payload":'), F.col("props"), F.lit("}")))
    m = decode(e.select("event_id", body.alias("message")), "message", "k BIGINT")
    return m.select("event_id", "payload.k", F.col("type").alias("kind"))
