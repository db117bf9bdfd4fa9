"""Designated points and navaids of aeronautical XML exchange files, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.rows import first_wins
from ..operators.tables import materialize


#: Fixed value: files of fewer bytes hold no data set.
LEAST_BYTES = 10_001
#: The features that have places, in the order in which they count.
LOCATED = ("DesignatedPoint", "Navaid")


def located(spark: SparkSession, path: str, feature: str = "DesignatedPoint", prefix: str = "aixm", least_bytes: int = 0, pattern: str = "*") -> DataFrame:
    """(file, at, ord, ident, lat, lon, kind) of the features of the XML files below a path, of some size at least; file, at and ord say where they stand.

    A place may be a point or one with an elevation. Features without a name or a place are left out.
    """
    slice_, name = f"{prefix}:timeSlice", f"{prefix}:{feature}TimeSlice"
    place = "struct<`gml:pos`:string>"
    inner = f"struct<`{prefix}:designator`:string, `{prefix}:type`:string, `{prefix}:location`:struct<`{prefix}:Point`:{place}, `{prefix}:ElevatedPoint`:{place}>>"
    schema = f"`{slice_}` struct<`{name}`:{inner}>"
    rows = spark.read.format("xml").options(rowTag=f"{prefix}:{feature}", ignoreSurroundingSpaces=True, recursiveFileLookup=True, pathGlobFilter=pattern).schema(schema).load(path)
    rows = rows.where(F.col("_metadata.file_size") >= least_bytes).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col(f"`{slice_}`.`{name}`").alias("s"))
    where = F.col("s").getField(f"{prefix}:location")
    pos = F.split(F.trim(F.coalesce(*(where.getField(f"{prefix}:{k}").getField("gml:pos") for k in ("Point", "ElevatedPoint")))), r"\s+")
    out = rows.select("file", "at", F.monotonically_increasing_id().alias("ord"), text.normalise_ident(F.col("s").getField(f"{prefix}:designator")).alias("ident"), pos[0].try_cast("double").alias("lat"), F.try_element_at(pos, F.lit(2)).try_cast("double").alias("lon"), F.coalesce(F.trim(F.col("s").getField(f"{prefix}:type")), F.lit("ICAO")).alias("kind"))
    return out.where("ident <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def read(spark: SparkSession, path: str, feature: str = "DesignatedPoint", prefix: str = "aixm", least_bytes: int = 0) -> DataFrame:
    """(ident, lat, lon, kind) of the features of XML files of some size at least, the first of each ident in order of file."""
    return first_wins(located(spark, path, feature, prefix, least_bytes), ["ident"], "file", "at", "ord").select("ident", "lat", "lon", "kind")


def merged(spark: SparkSession, roots: dict[str, str], prefix: str = "aixm", least_bytes: int = LEAST_BYTES, pattern: str = "*.xml") -> tuple[DataFrame, DataFrame]:
    """Points of several countries' folders, and what each country has.

    Points: (ident, lat, lon, kind, country, feature), the first of each ident: countries in order of their
    names, designated points before navaids, then files in order. Countries: (country, feature, n), n the
    distinct idents of the file that has most of them; without a file large enough there is no row.
    """
    found = None
    for country, path in sorted(roots.items()):
        for rank, feature in enumerate(LOCATED):
            rows = located(spark, path, feature, prefix, least_bytes, pattern).withColumns({"country": F.lit(country), "feature": F.lit(feature), "rank": F.lit(rank)})
            found = rows if found is None else found.unionByName(rows)
    found = materialize(found, "features")  # files are parsed once for both results
    points = first_wins(found, ["ident"], "country", "rank", "file", "at", "ord").select("ident", "lat", "lon", "kind", "country", "feature")
    per_file = found.groupBy("country", "feature", "file").agg(F.countDistinct("ident").alias("n"))
    return points, per_file.groupBy("country", "feature").agg(F.max("n").alias("n"))
