"""Journeys put together: planned routes sampled at fixed fractions, journeys of recordings, flight plans, flight records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text

#: Fractions of a planned route at which its three routes have a point.
FRACTIONS = {"derivedReplay": (0.0, 0.08, 0.24, 0.5, 0.76, 0.92, 1.0), "processed": (0.0, 0.25, 0.5, 0.75, 1.0), "raw": (0.0, 0.12, 0.5, 0.88, 1.0)}
#: Seconds from a lone recorded point to the one made up for it, and degrees between them.
SYNTHETIC_S, SYNTHETIC_DEG = 60, 0.0001


def departure(date: Column, time: Column) -> Column:
    """The instant of a local date and time, 09:00 where there is no time, in the session's time zone; null if malformed."""
    at = F.coalesce(F.nullif(F.trim(time), F.lit("")), F.lit("09:00"))
    return F.try_to_timestamp(F.concat(F.trim(date), F.lit(" "), at), F.lit("yyyy-MM-dd HH:mm"))


def planned_routes(flights: DataFrame) -> DataFrame:
    """(flight, route, seq, fraction, at_s, lat, lon, alt, speed, course): the points of the three routes of each flight.

    flights: (flight, start_s, duration_s, alat, alon, blat, blon). Places lie on the great circle, with
    altitude and speed by the flown fraction and the course to the place a hundredth further on.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("route"), F.lit(i).alias("seq"), F.lit(x).alias("fraction")) for r, f in FRACTIONS.items() for i, x in enumerate(f))))
    rows = flights.withColumn("s", each).select("*", "s.*").drop("s")
    ends = [F.col(c) for c in ("alat", "alon", "blat", "blon")]
    f, length = F.col("fraction"), geo.haversine_m(*ends)
    lat, lon = geo.interpolate(*ends, f)
    nlat, nlon = geo.interpolate(*ends, F.least(F.lit(1.0), f + 0.01))
    return rows.select("flight", "route", "seq", "fraction", (F.col("start_s") + F.col("duration_s") * f).alias("at_s"), lat.alias("lat"), lon.alias("lon"), geo.altitude_profile_m(f, length).alias("alt"), geo.speed_profile_mps(f, length).alias("speed"), geo.bearing(lat, lon, nlat, nlon).alias("course"))


def planned_journeys(requests: DataFrame) -> DataFrame:
    """(flight, start_ts, end_ts, minutes, length_m) of requests (flight, date, time, minutes, alat, alon, blat, blon): the stated duration, or one estimated from the distance."""
    length = geo.haversine_m(*(F.col(c) for c in ("alat", "alon", "blat", "blon")))
    minutes = F.coalesce(F.col("minutes").cast("double"), geo.flight_minutes(length)).cast("long")
    start = departure(F.col("date"), F.col("time"))
    return requests.select("flight", start.alias("start_ts"), F.timestamp_add("MINUTE", minutes, start).alias("end_ts"), minutes.alias("minutes"), length.alias("length_m"))


def replayable(recordings: DataFrame, points: DataFrame, airports: DataFrame) -> DataFrame:
    """(recording, seq, ts, lat, lon, speed, source): the points from which a recording can be replayed, two or more.

    recordings: (recording, origin, destination, started, ended); points: (recording, ts, ord, lat, lon,
    speed, source), of which measured ones count; airports: (iata, lat, lon). A lone point gets a second
    one beside it, at the recording's end if that is later; a recording without points starts from its
    origin's airport, or else its destination's; where neither is known it can't be replayed.
    """
    gps = points.where("source = 'gps'")
    counts = gps.groupBy("recording").agg(F.count("*").alias("n"))
    r = recordings.join(counts, "recording", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    measured = gps.select("recording", "ts", "ord", "lat", "lon", "speed", "source").withColumn("made", F.lit(0))
    lone = gps.join(r.where("n = 1").select("recording", "ended"), "recording")
    a, b = (airports.select(F.col("iata").alias(c), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon")) for c in ("origin", "destination"))
    anchor = r.where("n = 0").join(a, "origin", "left").join(b, "destination", "left")
    known = F.col("origin_lat").isNotNull()
    anchor = anchor.select("recording", "ended", F.coalesce("started", "ended").alias("ts"), F.lit(0).cast("long").alias("ord"), F.when(known, F.col("origin_lat")).otherwise(F.col("destination_lat")).alias("lat"), F.when(known, F.col("origin_lon")).otherwise(F.col("destination_lon")).alias("lon"), F.lit(None).cast("double").alias("speed"), F.lit("estimated").alias("source")).where("lat IS NOT NULL")
    first = lone.select(*anchor.columns).unionByName(anchor)
    later = F.when(F.col("ended") > F.col("ts"), F.col("ended")).otherwise(F.timestamp_add("SECOND", F.lit(SYNTHETIC_S), F.col("ts")))
    second = first.select("recording", later.alias("ts"), "ord", (F.col("lat") + SYNTHETIC_DEG).alias("lat"), (F.col("lon") + SYNTHETIC_DEG).alias("lon"), F.lit(0.0).alias("speed"), F.lit("estimated").alias("source"), F.lit(1).alias("made"))
    every = measured.unionByName(anchor.drop("ended").withColumn("made", F.lit(0))).unionByName(second)
    return every.withColumn("seq", F.row_number().over(Window.partitionBy("recording").orderBy("ts", "ord", "made"))).select("recording", "seq", "ts", "lat", "lon", "speed", "source")


def recording_events(recordings: DataFrame, replay: DataFrame, n_gps: DataFrame) -> DataFrame:
    """Two rows (recording, kind, ts, title, subtitle) for each recording: start and stop, at its first and last replayed point."""
    ends = replay.groupBy("recording").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    r = recordings.join(ends, "recording").join(n_gps, "recording", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    label = F.nullif(F.concat_ws(" to ", F.nullif("origin", F.lit("")), F.nullif("destination", F.lit(""))), F.lit(""))
    name = F.coalesce("flight_number", F.lit("Flight"))
    count = F.when(F.col("n") >= 2, F.concat(F.col("n").cast("string"), F.lit(" real GPS points"))).otherwise(F.concat(F.col("n").cast("string"), F.lit(" real GPS point(s); replay route estimated")))
    start = F.struct(F.lit("gpsRecordingStart").alias("kind"), F.col("first").alias("ts"), F.concat(name, F.lit(" GPS recording started")).alias("title"), F.coalesce(label, F.lit("iOS CoreLocation recording")).alias("subtitle"))
    stop = F.struct(F.lit("gpsRecordingStop").alias("kind"), F.col("last").alias("ts"), F.concat(name, F.lit(" GPS recording completed")).alias("title"), count.alias("subtitle"))
    return r.select("recording", F.explode(F.array(start, stop)).alias("e")).select("recording", "e.*")


def recording_title(flight_number: Column, origin: Column, destination: Column, start: Column) -> Column:
    named = F.concat(F.nullif(flight_number, F.lit("")), F.lit(" "), F.nullif(origin, F.lit("")), F.lit(" to "), F.nullif(destination, F.lit("")))
    return F.coalesce(named, F.concat(F.lit("GPS Recording "), F.date_format(start, "yyyy-MM-dd")))


def route_point(ident: Column, lat: Column, lon: Column, kind: Column) -> Column:
    """A point of a route, from the row of a pack."""
    return F.struct(ident.alias("ident"), lat.alias("lat"), lon.alias("lon"), kind.alias("point_type"))


def place_route_point(iata: Column, place: Column, lat: Column, lon: Column) -> Column:
    """A place as a point of a route: an airport, named by its IATA code or else by its id."""
    return route_point(F.coalesce(iata, place.cast("string")), lat, lon, F.lit("AIRPORT"))


def flight_record(flights: DataFrame) -> DataFrame:
    """(flight_number, origin, destination, departure_time, minutes) of flights of an API (flight_number, origin, destination, scheduled, arrival as ISO text); those without two airports are left out."""
    iata = lambda c: F.when(F.upper(F.trim(c)).rlike("^[A-Z]{3}$"), F.upper(F.trim(c)))
    hour = F.nullif(F.regexp_extract("scheduled", r"T(\d{2}:\d{2})", 1), F.lit(""))
    seconds = F.unix_seconds(F.try_to_timestamp("arrival")) - F.unix_seconds(F.try_to_timestamp("scheduled"))
    rows = flights.select(text.normalise_flight_number(F.col("flight_number")).alias("flight_number"), iata("origin").alias("origin"), iata("destination").alias("destination"), hour.alias("departure_time"), F.when(seconds > 0, F.floor(seconds / 60.0 + 0.5).cast("long")).alias("minutes"))
    return rows.where("origin IS NOT NULL AND destination IS NOT NULL")


def spread(left: Column, right: Column) -> Column:
    """A map with the entries of both, right ones first in case of equal keys, even where their value is null."""
    rest = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(rest, right)


def update_state(last_check: Column, now: Column, held: Column, offered: Column, hours: int = 6) -> Column:
    """What an update check does: nothing before so many hours have passed, else it stages another revision or keeps the one held."""
    due = last_check.isNull() | (F.unix_seconds(now) - F.unix_seconds(last_check) >= hours * 3600)
    return F.when(~due, "throttled").when(held.eqNullSafe(offered), "current").otherwise("staged")
