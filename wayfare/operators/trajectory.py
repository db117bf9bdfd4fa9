"""Trajectories: rows (journey, ord, ts, lat, lon, alt, speed, course, source), one row a point."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .folds import fold
from .rows import first_wins


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp, with its fraction."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1e6


def in_order(*more: str) -> Window:
    return Window.partitionBy("journey").orderBy("ts", "ord", *more)


def with_steps(points: DataFrame) -> DataFrame:
    """Points with step_mm and step_m, the distance from the point before in whole millimetres, so that sums are exact."""
    w = in_order()
    d = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("step_mm", F.coalesce(F.floor(d * 1e3 + 0.5), F.lit(0))).withColumn("step_m", F.col("step_mm") / 1e3)


def bounds(points: DataFrame) -> DataFrame:
    """Start, end, duration (a second at least), length, box and extremes of each journey; missing values count as 0."""
    return with_steps(points).groupBy("journey").agg(
        F.count("*").alias("n_points"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.greatest(F.lit(1.0), seconds(F.max("ts")) - seconds(F.min("ts"))).alias("duration_s"),
        geo.quantise(F.sum("step_mm") / 1e3, 1).alias("length_m"),
        F.min("lat").alias("south"),
        F.max("lat").alias("north"),
        F.min("lon").alias("west"),
        F.max("lon").alias("east"),
        F.max(F.coalesce("alt", F.lit(0.0))).alias("max_alt"),
        F.max(F.coalesce("speed", F.lit(0.0))).alias("max_speed"),
    )


def flown(points: DataFrame) -> DataFrame:
    """Points with flown_m, remaining_m and the fraction of the length flown."""
    w = in_order()
    run = with_steps(points).withColumn("flown_m", F.sum("step_mm").over(w.rowsBetween(Window.unboundedPreceding, 0)) / 1e3)
    total = F.sum("step_mm").over(Window.partitionBy("journey")) / 1e3
    return run.withColumn("total_m", total).withColumn("remaining_m", F.greatest(F.lit(0.0), F.col("total_m") - F.col("flown_m"))).withColumn("fraction", F.least(F.lit(1.0), F.col("flown_m") / F.greatest(F.lit(1.0), F.col("total_m"))))


def timed(points: DataFrame, duration_s: Column, start_s: Column) -> DataFrame:
    """A planned route with times, altitudes, speeds and courses by the fraction flown; the last course looks back."""
    w = in_order()
    rows = flown(points)
    lat, lon = (F.coalesce(F.lead(c).over(w), F.lag(c).over(w)) for c in ("lat", "lon"))
    return rows.withColumns(
        {
            "at_s": start_s + duration_s * F.col("fraction"),
            "plan_alt": geo.altitude_profile_m(F.col("fraction"), F.col("total_m")),
            "plan_speed": geo.speed_profile_mps(F.col("fraction"), F.col("total_m")),
            "plan_course": geo.bearing(F.col("lat"), F.col("lon"), lat, lon),
        }
    )


def sample_at(points: DataFrame, ticks: DataFrame) -> DataFrame:
    """The position of a journey at each tick (journey, tick_s), clamped to its time span.

    An as-of join by one sort: points and ticks of a journey are interleaved in time, and a tick takes
    the last point before it and the first one after it. Between them lies the great-circle point, with
    speed in proportion; a sample between measured points is interpolated.
    """
    own = points.select("journey", seconds("ts").alias("t"), F.struct(seconds("ts").alias("t"), "lat", "lon", "alt", "speed", "source").alias("p"), F.lit(0).alias("is_tick"), "ord", F.lit(None).cast("double").alias("tick_s"))
    span = own.groupBy("journey").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    asked = ticks.join(span, "journey").select("journey", F.least("hi", F.greatest("lo", F.col("tick_s").cast("double"))).alias("t"), F.lit(None).cast(own.schema["p"].dataType).alias("p"), F.lit(1).alias("is_tick"), F.lit(0).cast(own.schema["ord"].dataType).alias("ord"), F.col("tick_s").cast("double").alias("tick_s"))
    # both neighbours by running frames, one in each direction, so that a long journey costs a sort and no more
    running = lambda *order: Window.partitionBy("journey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("p", ignorenulls=True)
    both = own.unionByName(asked)
    both = both.withColumn("a", last.over(running("t", "is_tick", "ord"))).withColumn("b", last.over(running(F.desc("t"), F.desc("is_tick"), F.desc("ord"))))
    rows = both.where("is_tick = 1").withColumn("b", F.coalesce("b", "a"))
    f = F.coalesce((F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0)), F.lit(0.0))
    lat, lon = geo.interpolate(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), f)
    return rows.select(
        "journey",
        "tick_s",
        lat.alias("lat"),
        lon.alias("lon"),
        geo.lerp(F.coalesce("a.alt", F.lit(0.0)), F.coalesce("b.alt", F.lit(0.0)), f).alias("alt"),
        geo.lerp(F.coalesce("a.speed", F.lit(0.0)), F.coalesce("b.speed", F.lit(0.0)), f).alias("speed"),
        geo.bearing(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("course"),
        F.when((F.col("a.source") == "gps") & (F.col("b.source") == "gps"), "interpolated").otherwise(F.col("a.source")).alias("source"),
    )


#: Share of the greatest altitude that counts as cruise for events, and for splitting climb and descent.
CRUISE_EVENTS, CRUISE_SPLIT = 0.92, 0.88


def flight_events(points: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(journey, kind, ts, ord): seven generated events of each journey and known ones, the first of equal (kind, ts).

    Takeoff is the first point above 600 m and 35 m/s, else the second point; climb ends at the first
    point of 0.92 of the greatest altitude and descent starts at the last one. Ties go to the earlier point.
    """
    alt, speed = F.coalesce("alt", F.lit(0.0)), F.coalesce("speed", F.lit(0.0))
    w = in_order()
    rows = points.select("journey", "ts", "ord", alt.alias("alt"), speed.alias("speed"), F.row_number().over(w).alias("n"), F.max(alt).over(Window.partitionBy("journey")).alias("top"))
    at = F.struct("ts", "ord")
    high = F.col("alt") >= F.col("top") * CRUISE_EVENTS
    got = rows.groupBy("journey").agg(
        F.coalesce(F.min_by(at, F.when((F.col("alt") > 600) & (F.col("speed") > 35), F.col("n"))), F.min_by(at, F.when(F.col("n") >= 2, F.col("n"))), F.min_by(at, "n")).alias("takeoff"),
        F.min_by(at, F.when(high, F.col("n"))).alias("topOfClimb"),
        F.min_by(at, F.when(high, F.col("n"))).alias("cruise"),
        F.max_by(at, F.when(high, F.col("n"))).alias("topOfDescent"),
        F.max_by(at, "n").alias("landing"),
        F.max(F.struct("alt", (-F.col("n")).alias("n"), at.alias("at")))["at"].alias("maxAltitude"),
        F.max(F.struct("speed", (-F.col("n")).alias("n"), at.alias("at")))["at"].alias("maxSpeed"),
    )
    kinds = ["takeoff", "topOfClimb", "cruise", "topOfDescent", "landing", "maxAltitude", "maxSpeed"]
    listed = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("at")) for i, k in enumerate(kinds)))
    events = got.select("journey", F.explode(listed).alias("e")).select("journey", "e.kind", "e.at.ts", "e.at.ord", "e.rank")
    if known is not None:
        events = events.unionByName(known.select("journey", "kind", "ts", "ord", F.lit(len(kinds)).alias("rank")))
    return first_wins(events, ["journey", "kind", "ts"], "rank", "ord")


def phase_at(samples: DataFrame, events: DataFrame) -> DataFrame:
    """samples (journey, ord, tick_s, alt, flown_m) with the phase by the last event at or before them."""
    own = events.select("journey", seconds("ts").alias("t"), F.lit(0).alias("is_tick"), F.col("rank").alias("r"), F.col("kind").alias("k"), F.lit(None).cast("struct<ord:bigint,tick_s:double,alt:double,flown_m:double>").alias("s"))
    asked = samples.select("journey", F.col("tick_s").alias("t"), F.lit(1).alias("is_tick"), F.lit(0).alias("r"), F.lit(None).cast("string").alias("k"), F.struct(F.col("ord").cast("long").alias("ord"), F.col("tick_s").cast("double").alias("tick_s"), F.col("alt").cast("double").alias("alt"), F.col("flown_m").cast("double").alias("flown_m")).alias("s"))
    w = Window.partitionBy("journey").orderBy("t", "is_tick", "r").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.unionByName(asked).withColumn("last", F.last("k", ignorenulls=True).over(w)).where("is_tick = 1")
    titles = {"takeoff": "Takeoff", "landing": "Landing", "maxAltitude": "Max altitude", "maxSpeed": "Max speed"}
    named = reduce(lambda c, x: c.when(F.col("last") == x[0], x[1]), titles.items(), F.when(F.col("last").isin("topOfClimb", "cruise"), "Cruise").when(F.col("last") == "topOfDescent", "Descent").when((F.col("s.alt") < 900) & (F.col("s.flown_m") > 10_000), "Approach"))
    return rows.select("journey", "s.ord", "s.tick_s", named.otherwise("Climb").alias("phase"))


def vertical_speed(points: DataFrame) -> DataFrame:
    """Points with vs_mpm, metres a minute since the point before, rounded to tens."""
    w = in_order()
    minutes = F.greatest(F.lit(1 / 60), (seconds("ts") - seconds(F.lag("ts").over(w))) / 60.0)
    rate = (F.coalesce("alt", F.lit(0.0)) - F.coalesce(F.lag("alt").over(w), F.lit(0.0))) / minutes
    return points.withColumn("vs_mpm", F.coalesce(F.floor(rate / 10.0 + 0.5) * 10, F.lit(0)).cast("long"))


def climb_descent(points: DataFrame) -> DataFrame:
    """Points with part: climb up to the first point of 0.88 of the greatest altitude, descent from the last one on."""
    alt = F.coalesce("alt", F.lit(0.0))
    whole = Window.partitionBy("journey")
    rows = points.withColumn("n", F.row_number().over(in_order())).withColumn("top", F.max(alt).over(whole))
    high = F.when(alt >= F.col("top") * CRUISE_SPLIT, F.col("n"))
    rows = rows.withColumn("first_high", F.min(high).over(whole)).withColumn("last_high", F.max(high).over(whole))
    return rows.withColumn("part", F.when(F.col("n") <= F.col("first_high"), "climb").when(F.col("n") >= F.col("last_high"), "descent").otherwise("cruise")).drop("n", "top", "first_high", "last_high")


def look_ahead(points: DataFrame, from_m: float, reach_m: float) -> DataFrame:
    """The part of each route from from_m to reach_m further on, with an interpolated end if over 200 m are left of it."""
    rows = flown(points)
    w = in_order()
    rows = rows.withColumns({"__next_m": F.lead("flown_m").over(w), "__nlat": F.lead("lat").over(w), "__nlon": F.lead("lon").over(w)})
    end = F.lit(float(from_m + reach_m))
    inside = rows.where((F.col("flown_m") >= from_m) & (F.col("flown_m") <= end)).select("journey", "ord", F.col("flown_m").alias("at_m"), "lat", "lon", F.lit(False).alias("cut"))
    over = rows.where((F.col("flown_m") <= end) & (F.col("__next_m") > end) & (end - F.col("flown_m") > 200))
    lat, lon = geo.interpolate(F.col("lat"), F.col("lon"), F.col("__nlat"), F.col("__nlon"), (end - F.col("flown_m")) / (F.col("__next_m") - F.col("flown_m")))
    return inside.unionByName(over.select("journey", "ord", end.alias("at_m"), lat.alias("lat"), lon.alias("lon"), F.lit(True).alias("cut")))


def redact(points: DataFrame, ends: int = 2, drop_times: bool = False) -> DataFrame:
    """Points with the first and last ones of each journey on a 0.05-degree grid and an accuracy of 5 km at least."""
    w = Window.partitionBy("journey")
    n, at = F.count("*").over(w), F.row_number().over(in_order())
    blur = (F.col("__at") <= ends) | (F.col("__at") > F.col("__n") - ends)
    coarse = lambda c: F.floor(F.col(c) * 20 + 0.5) / 20.0
    rows = points.withColumns({"__n": n, "__at": at})
    rows = rows.withColumns({"lat": F.when(blur, coarse("lat")).otherwise(F.col("lat")), "lon": F.when(blur, coarse("lon")).otherwise(F.col("lon")), "accuracy": F.when(blur, F.greatest(F.coalesce("accuracy", F.lit(0.0)), F.lit(5000.0))).otherwise(F.col("accuracy"))})
    if drop_times:
        rows = rows.withColumn("ts", F.lit("1970-01-01 00:00:00").cast(points.schema["ts"].dataType))
    return rows.drop("__n", "__at")


def attitude(points: DataFrame) -> DataFrame:
    """Points with pitch and roll in degrees and indicated air speed, from the steps before and after them."""
    w = in_order()
    step = with_steps(points)
    run = F.greatest(F.lit(1.0), F.col("step_m"))
    pitch = geo.clamp(F.degrees(F.atan2(F.coalesce(F.col("alt") - F.lag("alt").over(w), F.lit(0.0)), run)), -18, 18)
    course = geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    ahead = geo.bearing(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    turn = F.coalesce(geo.signed_turn(course, ahead), F.lit(0.0))
    roll = F.when(F.abs(turn) < 0.8, 0.0).otherwise(geo.clamp(turn * 0.6, -28, 28))
    density = F.pow(geo.clamp(1.0 - 2.25577e-5 * F.coalesce("alt", F.lit(0.0)), 0.01, 1), 4.25588)
    return step.withColumns({"pitch": pitch, "turn": turn, "roll": roll, "ias": F.coalesce("speed", F.lit(0.0)) * F.sqrt(density)})


def smoothed(points: DataFrame, value: str, alpha: float = 0.12, dead: float = 0.8) -> DataFrame:
    """(journey, ord, smooth): exponential smoothing along each journey, changes under the dead zone left out; each value rests on the one before."""

    def step(s: float, ord_: int, v: float | None) -> tuple[float, list[tuple]]:
        v = v or 0.0
        s += ((0.0 if abs(v) < dead else v) - s) * alpha
        return s, [(ord_, s)]

    return fold(points, "journey", ["ts", "ord"], {"ord": F.col("ord").cast("bigint"), "v": F.col(value).cast("double")}, "ord bigint, smooth double", 0.0, step)


def smoothed_line(points: DataFrame, metres_a_piece: float = 120_000.0) -> DataFrame:
    """(journey, ord, piece, lat, lon, alt): each leg in 4 to 24 pieces on the great circle, and the last point.

    Altitudes ease from point to point and bulge in climb and descent, the first and last 0.26 of the length.
    """
    w = in_order()
    rows = flown(points).withColumns({f"n_{c}": F.lead(c).over(w) for c in ("lat", "lon", "alt", "step_m")})
    rows = rows.withColumn("top", F.max(F.coalesce("alt", F.lit(0.0))).over(Window.partitionBy("journey")))
    pieces = F.when(F.col("n_lat").isNull(), 1).otherwise(F.greatest(F.lit(4), F.least(F.lit(24), F.ceil(F.col("n_step_m") / metres_a_piece).cast("int"))))
    cut = rows.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    t = F.col("piece") / F.col("pieces")
    at = (F.col("flown_m") + F.coalesce("n_step_m", F.lit(0.0)) * t) / F.greatest(F.lit(1.0), F.col("total_m"))
    phase = F.when(at < 0.26, at / 0.26).when(at > 0.74, (1.0 - at) / 0.26).otherwise(0.0)
    here, there = F.coalesce("alt", F.lit(0.0)), F.coalesce("n_alt", F.lit(0.0))
    lifted = here + (there - here) * geo.smootherstep(0, 1, t) + F.sin(F.lit(math.pi) * phase) * F.least(F.lit(4200.0), F.col("top") * 0.28)
    lat, lon = geo.interpolate(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"), t)
    last = F.col("n_lat").isNull()
    return cut.select("journey", "ord", "piece", F.when(last, F.col("lat")).otherwise(lat).alias("lat"), F.when(last, F.col("lon")).otherwise(lon).alias("lon"), F.when(last, here).otherwise(F.greatest(F.lit(0.0), lifted)).alias("alt"))


def snaps(points: DataFrame, back_s: float = 1.0, jump_m: float = 15_000.0, order: list[str] | None = None) -> DataFrame:
    """(journey, ord, snap): whether a view must jump here: at the first point, where time runs back by over a second, and over long steps."""
    w = Window.partitionBy("journey").orderBy(*(order or ["ts", "ord"]))
    t, before = seconds("ts"), seconds(F.lag("ts").over(w))
    far = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) > jump_m
    return points.select("journey", "ord", (before.isNull() | (t < before - back_s) | far).alias("snap"))


def airport_focus(points: DataFrame) -> DataFrame:
    """points (lat, lon, alt and the ends olat, olon, dlat, dlon) with the nearer end's name and how much it draws the view: 1 at the ground there, 0 far off or high up."""
    height = F.greatest(F.lit(0.0), F.coalesce("alt", F.lit(0.0)))
    low = 1.0 - geo.smoothstep(1200, 9800, height)
    draw = lambda a, b: (1.0 - geo.smoothstep(9000, 95_000, geo.haversine_m(F.col("lat"), F.col("lon"), F.col(a), F.col(b)))) * low
    o, d = draw("olat", "olon"), draw("dlat", "dlon")
    both = points.withColumns({"focus": F.when(d >= o, "destination").otherwise("origin"), "strength": F.greatest(o, d)})
    return both.withColumn("ground_strength", F.col("strength") * (1.0 - geo.smoothstep(260, 6200, height)))
