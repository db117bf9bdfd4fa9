"""Live positions in batch form: late data, gaps, dead reckoning, thinning, trip state, notifications."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .folds import fold
from .trajectory import seconds


def accepted(points: DataFrame, most_m: float = 500.0) -> DataFrame:
    """Points on the globe with an accuracy from 0 to most_m."""
    return points.where(geo.in_range(F.col("lat"), F.col("lon")) & F.col("accuracy").between(0, most_m))


def drop_late(points: DataFrame, arrival: list[str]) -> DataFrame:
    """In the order of arrival, the points later than every one before; equal times are late too."""
    w = Window.partitionBy("journey").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("__top", F.max("ts").over(w)).where("__top IS NULL OR ts > __top").drop("__top")


#: Seconds that a position counts as live and as estimable, and the least speed that is motion.
LIVE_S, ESTIMATE_S, MOTION = 1.5, 90.0, 0.5


def gap_status(gap_s: Column, speed: Column) -> Column:
    return F.when(gap_s <= LIVE_S, "live").when((gap_s <= ESTIMATE_S) & F.coalesce(speed > MOTION, F.lit(False)), "estimated").otherwise("lost")


def dead_reckon(rows: DataFrame) -> DataFrame:
    """rows (lat, lon, course, speed, gap_s) with status and the position moved on where it is estimated."""
    status = gap_status(F.col("gap_s"), F.col("speed"))
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), F.coalesce("course", F.lit(0.0)), F.greatest(F.lit(0.0), F.coalesce("speed", F.lit(0.0)) * F.col("gap_s")))
    return rows.withColumn("status", status).withColumns({"est_lat": F.when(F.col("status") == "estimated", lat).otherwise(F.col("lat")), "est_lon": F.when(F.col("status") == "estimated", lon).otherwise(F.col("lon"))})


def recent(points: DataFrame, n: int = 5000) -> DataFrame:
    """The latest n points of each journey."""
    w = Window.partitionBy("journey").orderBy(F.desc("ts"), F.desc("ord"))
    return points.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


#: A point is saved after so many seconds, metres, degrees of turn or metres of altitude.
SAVE_S, SAVE_M, SAVE_TURN, SAVE_ALT = 5.0, 250.0, 12.0, 120.0


def _gone(x: float | None) -> bool:
    return x is None or x != x


def metres(a: float, b: float, c: float, d: float) -> float:
    """Great-circle distance between two places, for code that folds rows."""
    p, q = math.sin(math.radians(c - a) / 2), math.sin(math.radians(d - b) / 2)
    h = min(1.0, p * p + math.cos(math.radians(a)) * math.cos(math.radians(c)) * q * q)
    return 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


#: State before the first point is saved: (seen, t, lat, lon, alt, course), with NaN for what is missing.
NOT_SAVED = (0, 0.0, 0.0, 0.0, math.nan, math.nan)


def save_step(last: tuple, ord_: int, t: float, lat: float, lon: float, alt: float | None, course: float | None) -> tuple[tuple, list[tuple]]:
    """Hold a point against the last saved one; a missing altitude is that of the saved one, and 0 if that has none either."""
    seen, t0, lat0, lon0, alt0, course0 = last
    base = 0.0 if _gone(alt0) else alt0
    climbed = abs((base if _gone(alt) else alt) - base)
    turn = 0.0 if _gone(course0) or _gone(course) else abs(course0 - course) % 360
    save = not seen or t - t0 >= SAVE_S or metres(lat0, lon0, lat, lon) >= SAVE_M or min(turn, 360 - turn) >= SAVE_TURN or climbed >= SAVE_ALT
    plain = lambda v: math.nan if _gone(v) else float(v)
    return ((1, t, float(lat), float(lon), plain(alt), plain(course)), [(ord_,)]) if save else (last, [])


def thin(points: DataFrame) -> DataFrame:
    """(journey, ord) of the points to save: each is held against the last saved one."""
    c = F.col
    columns = {"ord": c("ord").cast("bigint"), "t": seconds("ts"), "lat": c("lat"), "lon": c("lon"), "alt": c("alt"), "course": c("course")}
    return fold(points.where("source = 'gps'"), "journey", ["ts", "ord"], columns, "ord bigint", NOT_SAVED, save_step)


#: Metres from home that make a possible journey, a journey, and an end; and the speed that is moving.
LEAVE_M, RECORD_M, HOME_M, MOVING = 1200.0, 2500.0, 300.0, 2.0


def recorder_step(state: str, ord_: int, home_m: float | None, speed: float | None) -> tuple[str, list[tuple]]:
    """State of the recorder after a signal; the first rule that fits counts."""
    moving, m = not _gone(speed) and speed > MOVING, math.nan if _gone(home_m) else home_m
    if state == "Idle" and m > LEAVE_M and moving:
        state = "PossibleJourney"
    elif state == "PossibleJourney" and m > RECORD_M and moving:
        state = "JourneyRecording"
    elif state == "JourneyRecording" and not moving:
        state = "TemporarilyStationary"
    elif state == "TemporarilyStationary" and moving:
        state = "JourneyRecording"
    elif state in ("JourneyRecording", "TemporarilyStationary") and m < HOME_M:
        state = "JourneyCompleted"
    return state, [(ord_, state)]


def recorder_states(signals: DataFrame) -> DataFrame:
    """(journey, ord, state) after each signal (journey, ts, ord, home_m, speed), from Idle on."""
    columns = {"ord": F.col("ord").cast("bigint"), "home_m": F.col("home_m").cast("double"), "speed": F.col("speed").cast("double")}
    return fold(signals, "journey", ["ts", "ord"], columns, "ord bigint, state string", "Idle", recorder_step)


#: Fixed value: bytes under which storage is low.
LOW_STORAGE = 500_000_000


def notifications(points: DataFrame, session: list[str]) -> DataFrame:
    """The first time in a session that each notice is due."""
    notices = F.array_compact(F.array(F.when(F.col("source").isin("estimated", "interpolated"), F.struct(F.lit("gps-estimated").alias("id"), F.lit("warning").alias("severity"))), F.when(F.col("storage_left") < LOW_STORAGE, F.struct(F.lit("storage-low").alias("id"), F.lit("warning").alias("severity")))))
    due = points.select(*session, "ts", "ord", F.explode(notices).alias("n")).select(*session, "ts", "ord", "n.id", "n.severity")
    return due.groupBy(*session, "id", "severity").agg(F.min(F.struct("ts", "ord")).alias("f")).select(*session, "id", "severity", "f.ts", "f.ord")
