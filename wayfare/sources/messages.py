"""Messages of the device: a type, and a payload that is an object or a string that holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATION = "timestamp STRING, latitude DOUBLE, longitude DOUBLE, altitudeMeters DOUBLE, speedMetersPerSecond DOUBLE, courseDegrees DOUBLE, horizontalAccuracyMeters DOUBLE, verticalAccuracyMeters DOUBLE, source STRING"


def decode(messages: DataFrame, column: str, payload: str) -> DataFrame:
    """messages with type and payload (a struct of the given schema); those that are no JSON object with both are dropped."""
    kind = F.get_json_object(column, "$.type")
    # get_json_object gives an object as JSON text and a string as its contents, so both cases read alike
    body = F.from_json(F.get_json_object(column, "$.payload"), payload)
    return messages.withColumns({"type": kind, "payload": body}).where("type IS NOT NULL AND payload IS NOT NULL").drop(column)


def locations(messages: DataFrame, column: str = "message") -> DataFrame:
    """Measured positions among the messages: on the globe, with a time and an accuracy, from GPS."""
    m = decode(messages, column, LOCATION).where("type = 'location.update'")
    p = F.col("payload")
    ok = (p["source"] == "gps") & p["latitude"].between(-90, 90) & p["longitude"].between(-180, 180) & (p["horizontalAccuracyMeters"] >= 0)
    ts = F.try_to_timestamp(p["timestamp"])
    finite = lambda c: F.when(~F.isnan(c), c)
    return m.where(ok & ts.isNotNull()).select(
        *[c for c in m.columns if c not in ("type", "payload")], ts.alias("ts"), p["latitude"].alias("lat"), p["longitude"].alias("lon"), finite(p["altitudeMeters"]).alias("alt"),
        finite(p["speedMetersPerSecond"]).alias("speed"), F.pmod(finite(p["courseDegrees"]), F.lit(360.0)).alias("course"), p["horizontalAccuracyMeters"].alias("accuracy"), p["source"].alias("source"),
    )
