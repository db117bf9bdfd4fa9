"""Data-quality rules of an airway dataset: one issue row for each rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .grid import _met

#: Nautical miles under which a segment has no length, and over which it is suspect.
ZERO_NM, LONG_NM = 0.01, 700.0


def _issues(rows: DataFrame, entity: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, when in rules)))
    return rows.select(entity.cast("string").alias("entity"), F.explode(found).alias("i")).select("i.severity", "i.code", "entity")


def point_issues(points: DataFrame) -> DataFrame:
    return _issues(points, F.col("uid"), [("error", "point-empty-ident", F.trim(F.coalesce("ident", F.lit(""))) == ""), ("error", "point-coordinate-range", ~geo.in_range(F.col("lat"), F.col("lon")))])


def airway_issues(airways: DataFrame, segments: DataFrame) -> DataFrame:
    used = segments.select(F.col("airway_uid").alias("uid"), F.lit(True).alias("__used")).distinct()
    rows = _met(airways, used, ["uid"], "left")
    return _issues(rows, F.col("uid"), [("error", "airway-empty-designator", F.trim(F.coalesce("designator", F.lit(""))) == ""), ("error", "airway-no-segments", F.col("__used").isNull())])


def segment_issues(segments: DataFrame, points: DataFrame) -> DataFrame:
    """Segments are checked against their two end points; without one of them, their length is not.

    All shuffle partitions take part in the joins, so a task sorts its share of the rows and not as many
    as fit a partition of some size, and no table of points is held whole.
    """
    ends = points.select("uid", "lat", "lon")
    a, b = ends.toDF("from_uid", "a_lat", "a_lon"), ends.toDF("to_uid", "b_lat", "b_lon")
    rows = _met(_met(segments, a, ["from_uid"], "left"), b, ["to_uid"], "left")
    d = geo.haversine_nm(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    missing = F.col("a_lat").isNull() | F.col("b_lat").isNull()
    return _issues(rows, F.col("uid"), [("error", "segment-same-point", F.col("from_uid") == F.col("to_uid")), ("error", "segment-missing-point", missing), ("error", "segment-zero-distance", ~missing & (d <= ZERO_NM)), ("warning", "segment-long-distance", ~missing & (d > LONG_NM))])


def issues(points: DataFrame, airways: DataFrame, segments: DataFrame) -> DataFrame:
    return point_issues(points).unionByName(airway_issues(airways, segments)).unionByName(segment_issues(segments, points))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def coverage(points: DataFrame, airports: DataFrame, airways: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts by country, for the countries that have points; a null country is UNKNOWN for points only."""
    base = points.groupBy("country").agg(F.count("*").alias("points"))
    out = base
    for name, rows in (("airports", airports), ("airways", airways), ("segments", segments.join(airways.select(F.col("uid").alias("airway_uid"), "country"), "airway_uid"))):
        counts = rows.groupBy(F.col("country").alias("__c")).agg(F.count("*").alias(name))
        out = out.join(counts, F.col("country").eqNullSafe(F.col("__c")), "left").drop("__c").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out.withColumn("country", F.coalesce("country", F.lit("UNKNOWN")))
