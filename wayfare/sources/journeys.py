"""Journey documents: nested JSON with segments, three routes each and events, as flat tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "id: string, timestamp: string, latitude: double, longitude: double, altitudeMeters: double, speedMetersPerSecond: double, courseDegrees: double, horizontalAccuracyMeters: double, verticalAccuracyMeters: double, source: string"
_ROUTE = f"struct<kind: string, points: array<struct<{_POINT}>>>"
_EVENT = "struct<id: string, timestamp: string, endTime: string, type: string, title: string, subtitle: string, location: struct<latitude: double, longitude: double, altitudeMeters: double>, mediaIds: array<string>, importance: double, source: string>"
SCHEMA = f"schemaVersion string, id string, title string, startTime string, endTime string, status string, segments array<struct<id: string, type: string, startTime: string, endTime: string, rawRoute: {_ROUTE}, processedRoute: {_ROUTE}, derivedReplayRoute: {_ROUTE}>>, events array<{_EVENT}>"


class Journeys(NamedTuple):
    journeys: DataFrame
    points: DataFrame
    events: DataFrame
    rejected: DataFrame


def tables(documents: DataFrame, column: str = "json") -> Journeys:
    """Flat tables from journey documents (one JSON text a row).

    points: (journey, segment, route, ord, id, ts, lat, lon, alt, speed, course, accuracy, source).
    Documents that are no journey (no id, no segment, or a replay route under two points) are rejected.
    """
    parsed = documents.select(F.from_json(column, SCHEMA).alias("j"), F.col(column).alias("document"))
    ok = F.col("j.id").isNotNull() & (F.coalesce(F.size("j.segments"), F.lit(0)) >= 1) & F.forall(F.coalesce("j.segments", F.array()), lambda s: F.coalesce(F.size(s.derivedReplayRoute.points), F.lit(0)) >= 2)
    good = parsed.where(F.coalesce(ok, F.lit(False))).select("j.*")
    ts = lambda c: F.try_to_timestamp(F.col(c))
    journeys = good.select(F.col("id").alias("journey"), "title", "status", ts("startTime").alias("start_ts"), ts("endTime").alias("end_ts"), F.size("segments").alias("n_segments"))
    seg = good.select(F.col("id").alias("journey"), F.explode("segments").alias("s"))
    routes = seg.select("journey", F.col("s.id").alias("segment"), F.explode(F.array("s.rawRoute", "s.processedRoute", "s.derivedReplayRoute")).alias("r")).where("r IS NOT NULL")
    p = routes.select("journey", "segment", F.col("r.kind").alias("route"), F.posexplode("r.points").alias("ord", "p"))
    points = p.select("journey", "segment", "route", "ord", "p.id", ts("p.timestamp").alias("ts"), F.col("p.latitude").alias("lat"), F.col("p.longitude").alias("lon"), F.col("p.altitudeMeters").alias("alt"), F.col("p.speedMetersPerSecond").alias("speed"), F.col("p.courseDegrees").alias("course"), F.col("p.horizontalAccuracyMeters").alias("accuracy"), "p.source")
    e = good.select(F.col("id").alias("journey"), F.explode("events").alias("e"))
    events = e.select("journey", "e.id", ts("e.timestamp").alias("ts"), "e.type", "e.title", "e.subtitle", F.col("e.location.latitude").alias("lat"), F.col("e.location.longitude").alias("lon"), F.col("e.location.altitudeMeters").alias("alt"), F.col("e.mediaIds").alias("media"), "e.importance", "e.source")
    return Journeys(journeys, points, events, parsed.where(~F.coalesce(ok, F.lit(False))).select("document"))


def read(spark: SparkSession, path: str) -> Journeys:
    """Journeys of JSON files, one document a file."""
    return tables(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "json"))


def complete(points: DataFrame, recordings: DataFrame, recorded: DataFrame) -> DataFrame:
    """points with the routes of completed recordings in place of the planned ones.

    recordings: (journey, recording); recorded: (recording, ord, ts, lat, lon, ...) measured points. Where
    a recording has two points or more, all three routes of its journey become the measured one; else
    they stay as they are.
    """
    full = recorded.groupBy("recording").count().where("count >= 2").select("recording")
    done = recordings.join(full, "recording")
    kept = points.join(done.select("journey"), "journey", "left_anti")
    shape = points.join(done, "journey").select("journey", "recording", "segment", "route").distinct()
    new = shape.join(recorded, "recording").drop("recording")
    return kept.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns]))
