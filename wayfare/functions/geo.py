"""Geodesy, interpolation and smoothing as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radii in use: metres for journeys, nautical miles for airways. They differ on purpose.
EARTH_M, EARTH_NM = 6_371_008.8, 3440.065


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def quantise(x: Column, digits: int) -> Column:
    """Round half up to digits decimals in a way that other engines repeat bit for bit."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within lo and hi; null stays null, which least() and greatest() would skip."""
    return F.when(x < lo, float(lo)).when(x > hi, float(hi)).otherwise(x)


def lerp(a: Column | float, b: Column | float, f: Column) -> Column:
    return lit(a) + (lit(b) - lit(a)) * clamp(f, 0, 1)


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo), 0, 1)
    return t * t * (3.0 - 2.0 * t)


def smootherstep(lo: float, hi: float, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo), 0, 1)
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def positive_modulo(x: Column, m: float) -> Column:
    return F.pmod(x, F.lit(float(m)))


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0), F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.when(h > 1.0, 1.0).otherwise(h)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = _half_chord(lat1, lon1, lat2, lon2)
    return 2.0 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return 2.0 * EARTH_NM * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing, 0 to 360 degrees."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(q)
    x = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def reverse_course(course: Column) -> Column:
    return F.pmod(course + 180.0, F.lit(360.0))


def normalise_longitude(lon: Column) -> Column:
    return F.pmod(lon + 540.0, F.lit(360.0)) - 180.0


def signed_turn(a: Column, b: Column) -> Column:
    """Turn from course a to course b, -180 to 180."""
    return F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0


def course_delta(a: Column, b: Column) -> Column:
    """Absolute turn between two courses, 0 to 180; 0 where one is missing."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.coalesce(F.least(d, 360.0 - d), F.lit(0.0))


def destination(lat: Column, lon: Column, course: Column, metres: Column) -> tuple[Column, Column]:
    """Latitude and longitude after so many metres on a great circle."""
    d, b, p = metres / EARTH_M, F.radians(course), F.radians(lat)
    q = F.asin(clamp(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b), -1, 1))
    turn = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), normalise_longitude(lon + F.degrees(turn))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.sin(p), F.cos(p) * F.sin(q)


def vector(lat: Column, lon: Column, alt_m: Column, radius: float = 2.0, scale_m: float = 900_000.0) -> tuple[Column, Column, Column]:
    """A place on a globe of a radius, raised by its altitude over scale_m: east at zero longitude, up, and towards zero longitude."""
    p, q = F.radians(lat), F.radians(lon)
    r = radius + (F.coalesce(alt_m, F.lit(0.0)) / scale_m if scale_m else F.lit(0.0))
    return r * F.cos(p) * F.sin(q), r * F.sin(p), r * F.cos(p) * F.cos(q)


def interpolate(lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> tuple[Column, Column]:
    """Great-circle point at fraction f, clamped to 0..1; the start where both ends agree, null between antipodes."""
    f = clamp(f, 0, 1)
    h = _half_chord(lat1, lon1, lat2, lon2)
    angle = 2.0 * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))
    a, b = F.sin((1.0 - f) * angle) / F.sin(angle), F.sin(f * angle) / F.sin(angle)
    (x1, z1, y1), (x2, z2, y2) = unit_vector(lat1, lon1), unit_vector(lat2, lon2)
    x, y, z = a * x1 + b * x2, a * y1 + b * y2, a * z1 + b * z2
    same = angle < 1e-12
    apart = angle > math.pi - 1e-9
    lat = F.when(same, lat1).when(~apart, F.degrees(F.atan2(z, F.sqrt(x * x + y * y))))
    lon = F.when(same, lon1).when(~apart, F.degrees(F.atan2(y, x)))
    return lat, lon


def cell_open(lat: Column, lon: Column, degrees: float = 5.0) -> Column:
    """Grid cell by plain division, unbounded."""
    return F.struct(F.floor(lat / degrees).alias("row"), F.floor(lon / degrees).alias("col"))


def cell_row(lat: Column, degrees: float = 5.0) -> Column:
    """Row of the bounded 5-degree grid: 0 to 35."""
    return clamp(F.floor((lat + 90.0) / degrees), 0, 180 / degrees - 1).cast("int")


def cell_col(lon: Column, degrees: float = 5.0) -> Column:
    return clamp(F.floor((lon + 180.0) / degrees), 0, 360 / degrees - 1).cast("int")


#: Upper ends of the sectors of the view around a heading, in degrees.
WINDOW_SECTORS = ((30, "front"), (75, "right-front"), (120, "right side"), (180, "right-rear"), (240, "left-rear"), (285, "left side"), (330, "left-front"))


def window_direction(heading: Column, course: Column) -> Column:
    """In which of seven sectors something at a bearing is seen."""
    turn = F.pmod(course - heading, F.lit(360.0))
    return reduce(lambda w, s: w.when(turn < s[0], s[1]), WINDOW_SECTORS[1:], F.when(turn < WINDOW_SECTORS[0][0], WINDOW_SECTORS[0][1])).otherwise("front")


#: Most that a place of importance 1 gets as bonus.
MOST_BONUS_M = 150_000.0 + 24_000.0


def proximity_score(metres: Column, kind: Column, importance: Column) -> Column:
    """Distance less a bonus by kind and importance (0 to 1); the least score is the place to name."""
    bonus = F.when(kind == "airport", 60_000.0).when(kind == "majorCity", 0.0).otherwise(150_000.0)
    return metres - bonus - importance * 24_000.0


#: Region boxes as (name, south, north, west, east); the first that holds a point counts.
REGION_BOXES = (
    ("east-asia", 18, 48, 115, 147),
    ("se-asia", -12, 24, 95, 142),
    ("europe", 35, 72, -12, 42),
    ("americas", -56, 72, -170, -30),
    ("south-asia", 5, 34, 60, 95),
    ("oceania", -48, 0, 110, 180),
)


def region(lat: Column, lon: Column) -> Column:
    inside = [(name, lat.between(s, n) & lon.between(w, e)) for name, s, n, w, e in REGION_BOXES]
    return reduce(lambda c, x: c.when(x[1], x[0]), inside[1:], F.when(inside[0][1], inside[0][0])).otherwise("world")


def below_label(lat: Column, lon: Column, admin1: Column) -> Column:
    """What lies below a position on the northern Pacific rim (boxes and names are fixed values)."""
    return (
        F.when(admin1.isNotNull() & (lat > 30) & (lon > 130), admin1)
        .when((lat > 24) & (lat < 32) & (lon > 122) & (lon < 130), "East China Sea")
        .when((lat > 32) & (lon > 135), "Japan FIR")
        .when((lat < 26) & (lon < 123), "Taiwan north coast")
        .otherwise(F.coalesce(admin1, F.lit("Open ocean")))
    )


def crossing_label(lat: Column, lon: Column) -> Column:
    """What a route crosses there (boxes and names are fixed values)."""
    return F.when((lat > 32) & (lon > 135), "Japan FIR").when((lat > 24) & (lon > 122) & (lon < 134), "Pacific / East China Sea corridor").otherwise("Taiwan FIR")


def horizon_m(height: Column) -> Column:
    return F.sqrt(2.0 * EARTH_M * height + height * height)


def in_range(lat: Column, lon: Column) -> Column:
    """Whether a coordinate is present, finite and on the globe."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def utc_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0


def sun(ts: Column) -> tuple[Column, Column]:
    """Declination and subsolar longitude, from the day of the year and the hour."""
    declination = 23.44 * F.sin(F.radians((360.0 / 365.0) * (F.dayofyear(ts) - 81)))
    return declination, normalise_longitude((12.0 - utc_hour(ts)) * 15.0)


def night_factor(lat: Column, lon: Column, ts: Column) -> Column:
    """1 in the night, 0 by day, smooth in twilight."""
    declination, sub = sun(ts)
    score = F.sin(F.radians(lat)) * F.sin(F.radians(declination)) + F.cos(F.radians(lat)) * F.cos(F.radians(declination)) * F.cos(F.radians(lon - sub))
    return 1.0 - smoothstep(-0.1, 0.18, score)


def solar_day(lon: Column, ts: Column) -> tuple[Column, Column]:
    """Local solar hour, and how much of a day it is."""
    hour = positive_modulo(utc_hour(ts) + lon / 15.0, 24)
    return hour, smoothstep(5.5, 7.5, hour) * (1.0 - smoothstep(18.25, 20.25, hour))


def cloud_cover(lat: Column, lon: Column, ts: Column) -> Column:
    """A smooth made-up cloud cover for a place and day, 0.12 to 0.88 (its factors are fixed values)."""
    day = F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400.0)
    by_lat = F.sin((lat + day * 1.7) * math.pi / 18.0) * 0.16
    by_lon = F.cos((lon - day * 2.1) * math.pi / 27.0) * 0.11
    fronts = F.sin((lat * 0.53 + lon * 0.31 + day * 0.77) * math.pi / 12.0) * 0.13
    tropics = F.greatest(F.lit(0.0), 1.0 - F.abs(lat) / 35.0) * 0.18
    poles = F.greatest(F.lit(0.0), (F.abs(lat) - 58.0) / 32.0) * 0.16
    return clamp(0.46 + by_lat + by_lon + fronts + tropics - poles, 0.12, 0.88)


def cruise_altitude_m(distance_m: Column) -> Column:
    return F.when(distance_m < 900_000, 8800.0).when(distance_m < 2_500_000, 10_700.0).otherwise(11_600.0)


def cruise_speed_mps(distance_m: Column) -> Column:
    return F.when(distance_m < 900_000, 210.0).otherwise(245.0)


def profile(f: Column, climb_to: float, cruise: Column) -> Column:
    """Value by flown fraction: up to climb_to at 0.08, to cruise at 0.24, down to 0 from 0.86."""
    return F.when(f <= 0.08, lerp(0, climb_to, f / 0.08)).when(f <= 0.24, lerp(climb_to, cruise, (f - 0.08) / 0.16)).when(f >= 0.86, lerp(cruise, 0, (f - 0.86) / 0.14)).otherwise(cruise)


def altitude_profile_m(f: Column, distance_m: Column) -> Column:
    return profile(f, 3600, cruise_altitude_m(distance_m))


def speed_profile_mps(f: Column, distance_m: Column) -> Column:
    return profile(f, 145, cruise_speed_mps(distance_m))


def flight_minutes(distance_m: Column) -> Column:
    """Estimated duration: time at 810 km/h and 28 minutes, 45 at least, rounded."""
    return F.floor(F.greatest(F.lit(45.0), distance_m / 1000.0 / 810.0 * 60.0 + 28.0) + 0.5)
