"""Journeys as GPX, KML and journal documents, put together by expressions, one document a journey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import xml_escape


def iso(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def gpx_point() -> Column:
    return F.format_string('      <trkpt lat="%.5f" lon="%.5f"><ele>%.1f</ele><time>%s</time></trkpt>', F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0)), iso("ts"))


def _ordered(rows: DataFrame, line: Column, name: str, sep: str) -> DataFrame:
    """One text a journey from its lines in order of time; a journey's document is one value in any case."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "ord", line.alias("line"))))
    return rows.groupBy("journey").agg(F.array_join(F.transform(listed, lambda s: s.line), sep).alias(name), F.count("*").alias("n"))


def gpx(points: DataFrame, events: DataFrame, titles: DataFrame) -> DataFrame:
    """(journey, gpx): points (journey, ts, ord, lat, lon, alt), events with a title too, titles (journey, title)."""
    track = _ordered(points, gpx_point(), "track", "\n")
    mark = F.concat(F.format_string('  <wpt lat="%.5f" lon="%.5f"><ele>%.1f</ele><time>', F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0))), iso("ts"), F.lit("</time><name>"), xml_escape(F.col("title")), F.lit("</name></wpt>"))
    marks = _ordered(events, mark, "marks", "\n").drop("n")
    rows = titles.join(track.drop("n"), "journey").join(marks, "journey", "left")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="wayfare" xmlns="http://www.topografix.com/GPX/1/1">\n  <metadata><name>'
    title = xml_escape(F.col("title"))
    body = F.concat(F.lit(head), title, F.lit("</name></metadata>\n"), F.when(F.col("marks").isNotNull(), F.concat("marks", F.lit("\n"))).otherwise(""), F.lit("  <trk>\n    <name>"), title, F.lit("</name>\n    <trkseg>\n"), "track", F.lit("\n    </trkseg>\n  </trk>\n</gpx>"))
    return rows.select("journey", body.alias("gpx"))


def kml(points: DataFrame, titles: DataFrame) -> DataFrame:
    """(journey, kml) with each journey's track as one line."""
    line = _ordered(points, F.format_string("%.5f,%.5f,%.1f", F.col("lon"), F.col("lat"), F.coalesce("alt", F.lit(0.0))), "line", " ")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>'
    body = F.concat(F.lit(head), xml_escape(F.col("title")), F.lit("</name>\n    <Placemark>\n      <name>Track</name>\n      <LineString><tessellate>1</tessellate><altitudeMode>absolute</altitudeMode><coordinates>"), "line", F.lit("</coordinates></LineString>\n    </Placemark>\n  </Document>\n</kml>"))
    return titles.join(line, "journey").select("journey", body.alias("kml"))


def journal(events: DataFrame) -> DataFrame:
    """(journey, lines, n): a line for each titled event in order of time."""
    return _ordered(events, F.concat(F.lit("- "), iso("ts"), F.lit(": "), "title"), "lines", "\n")


def portable(points: DataFrame, events: DataFrame) -> DataFrame:
    """(journey, json): a journey as one portable JSON document with a segment whose three routes are its points, and its events.

    points: (journey, ts, ord, lat, lon, alt, speed, course, source); events have a title and type too.
    """
    at = iso("ts")
    point = F.struct(F.concat(F.lit("p"), F.col("ord").cast("string")).alias("id"), at.alias("timestamp"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt").alias("altitudeMeters"), F.col("speed").alias("speedMetersPerSecond"), F.col("course").alias("courseDegrees"), "source")
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ts", "ord", x.alias("x")))), lambda s: s.x)
    tracks = points.groupBy("journey").agg(in_order(point).alias("track"), iso(F.min("ts")).alias("start"), iso(F.max("ts")).alias("end"))
    event = F.struct(F.concat(F.lit("e"), F.col("ord").cast("string")).alias("id"), at.alias("timestamp"), F.col("event_type").alias("type"), "title", F.array().cast("array<string>").alias("mediaIds"), F.lit(1.0).alias("importance"), "source")
    j = tracks.join(events.groupBy("journey").agg(in_order(event).alias("events")), "journey", "left")
    route = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("track").alias("points"))
    segment = F.struct(F.concat(F.lit("segment-"), "journey").alias("id"), F.lit("flight").alias("type"), F.col("start").alias("startTime"), F.col("end").alias("endTime"), route("raw").alias("rawRoute"), route("processed").alias("processedRoute"), route("derivedReplay").alias("derivedReplayRoute"))
    document = F.struct(F.lit("1.0.0").alias("schemaVersion"), F.col("journey").alias("id"), F.concat(F.lit("Journey "), "journey").alias("title"), F.col("start").alias("startTime"), F.col("end").alias("endTime"), F.lit("completed").alias("status"), F.array(segment).alias("segments"), F.coalesce("events", F.array()).alias("events"))
    return j.select("journey", F.to_json(document).alias("json"))
