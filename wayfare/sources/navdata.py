"""Navigation data files of flight simulators: fixes, navaids, airways with inline coordinates or with region keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.rows import first_wins, last_wins
from . import canonical as C

#: Row codes of navaids that are points of airways.
NAVAID_CODES = {2: "NDB", 3: "VOR", 12: "DME", 13: "DME"}


def lines(spark: SparkSession, path: str, pattern: str, encoding: str = "UTF-8", header_skip: bool = True) -> DataFrame:
    """(file, p) of the split data lines of files that fit a pattern.

    header_skip leaves out every line that begins with I or A, as such files' headers do; airway lines
    whose first ident begins with either go too, which header_skip=False avoids by testing for the
    header's own shape.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("encoding", encoding).text(path)
    alone = lambda x: F.explode(F.array(x))  # noqa: E731  worked out once: filters behind a projection would hold a copy for each time that they name it
    rows = read.select(F.input_file_name().alias("file"), alone(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("v"))
    head = F.col("v").rlike("^[IA]") if header_skip else F.col("v").rlike(r"^[IA]$|^\d+ [Vv]ersion")
    return rows.where(~head & (F.col("v") != "") & (F.col("v") != "99")).select("file", alone(F.split("v", " ")).alias("p"))


def header(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, cycle, build) from the heads of files; 'unknown' where they don't say."""
    v = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.array_join(F.slice(F.split("value", "\n"), 1, 5), "\n").alias("h"))
    get = lambda pattern: F.coalesce(F.nullif(F.regexp_extract("h", pattern, 1), F.lit("")), F.lit("unknown"))
    return v.select("file", get(r"(?m)^[IA]\S*\s+(\S+)").alias("version"), get(r"(?i)cycle\s*(\d{4})").alias("cycle"), get(r"(?i)build\s*(\d{8})").alias("build"))


def _at(i: int):
    return F.try_element_at("p", F.lit(i + 1))


def fixes(spark: SparkSession, path: str, pattern: str = "*fix*") -> DataFrame:
    """(file, ident, region, airport, lat, lon, kind) of fixes, with or without airport and region columns; the first of each ident and region in a file."""
    r = lines(spark, path, pattern).where(F.size("p") >= 3).select("file", F.monotonically_increasing_id().alias("ord"), _at(0).try_cast("double").alias("lat"), _at(1).try_cast("double").alias("lon"), text.normalise_ident(_at(2)).alias("ident"), F.coalesce(_at(3), F.lit("ENRT")).alias("airport"), F.coalesce(_at(4), F.lit("XX")).alias("region"), F.lit("SIGNIFICANT_POINT").alias("kind"))
    good = r.where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND length(ident) >= 2")
    return first_wins(good, ["file", "ident", "region"], "ord").drop("ord")


def navaids(spark: SparkSession, path: str, pattern: str = "*nav*") -> DataFrame:
    """The same columns for navaids of the codes of NAVAID_CODES."""
    kind = F.create_map(*(F.lit(x) for kv in NAVAID_CODES.items() for x in kv))[_at(0).try_cast("int")]
    r = lines(spark, path, pattern).where(F.size("p") >= 8).select("file", F.monotonically_increasing_id().alias("ord"), _at(1).try_cast("double").alias("lat"), _at(2).try_cast("double").alias("lon"), text.normalise_ident(_at(7)).alias("ident"), F.lit("ENRT").alias("airport"), F.coalesce(_at(9), F.lit("XX")).alias("region"), kind.alias("kind"))
    return first_wins(r.where("kind IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND ident <> ''"), ["file", "ident", "region"], "ord").drop("ord")


def merged(*tables: DataFrame) -> DataFrame:
    """One row for each ident and region: of the later table, and of the later file in it."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("rank", F.lit(i))
        every = t if every is None else every.unionByName(t)
    return last_wins(every, ["ident", "region"], "rank", "file").drop("rank", "file")


def airways_inline(spark: SparkSession, path: str, pattern: str = "*awy*", header_skip: bool = True) -> DataFrame:
    """(from_ident, from_lat, from_lon, to_ident, to_lat, to_lon, level, base_ft, top_ft, route) of airway lines with coordinates; limits are in hundreds of feet."""
    r = lines(spark, path, pattern, "ISO-8859-1", header_skip).where((F.size("p") >= 10) & _at(0).rlike("^[A-Za-z]") & _at(6).rlike(r"^\d+$"))
    d = lambda i: _at(i).try_cast("double")
    r = r.select(text.normalise_ident(_at(0)).alias("from_ident"), d(1).alias("from_lat"), d(2).alias("from_lon"), text.normalise_ident(_at(3)).alias("to_ident"), d(4).alias("to_lat"), d(5).alias("to_lon"), _at(6).cast("int").alias("level"), (_at(7).try_cast("int") * 100).alias("base_ft"), (_at(8).try_cast("int") * 100).alias("top_ft"), text.normalise_ident(_at(9)).alias("route"))
    return r.where("from_lat IS NOT NULL AND from_lon IS NOT NULL AND to_lat IS NOT NULL AND to_lon IS NOT NULL AND route <> ''")


def airways_keyed(spark: SparkSession, path: str, pattern: str = "*awy*") -> DataFrame:
    """(designator, from_ident, from_region, from_type, to_ident, to_region, to_type, direction, level, base_ft, top_ft) of airway lines that name points by region and type; lines without a designator are left out."""
    r = lines(spark, path, pattern).where(F.size("p") >= 10)
    i = lambda k: _at(k).try_cast("int")
    r = r.select(text.normalise_ident(_at(10)).alias("designator"), text.normalise_ident(_at(0)).alias("from_ident"), _at(1).alias("from_region"), i(2).alias("from_type"), text.normalise_ident(_at(3)).alias("to_ident"), _at(4).alias("to_region"), i(5).alias("to_type"), _at(6).alias("direction"), i(7).alias("level"), i(8).alias("base_ft"), i(9).alias("top_ft"))
    return r.where("designator <> '' AND from_ident <> '' AND to_ident <> ''")


def tables(spark: SparkSession, path: str, source: str = "navdata", fir: str = "GLOBAL", header_skip: bool = True) -> C.Tables:
    """Canonical tables: points by ident alone (the first by region), segments between known points only, without a stated length."""
    found = merged(fixes(spark, path), navaids(spark, path)).withColumn("point_type", F.col("kind"))
    points = C.points_table(found, ["region", "airport"], source, fir, "XX", "global")
    a = airways_inline(spark, path, header_skip=header_skip).withColumn("airway_uid", text.airway_uid(F.col("route"), F.lit(source), F.lit(fir)))
    ends = points.select("ident", F.col("uid").alias("u"))
    known = a.join(ends.toDF("from_ident", "from_uid"), "from_ident").join(ends.toDF("to_ident", "to_uid"), "to_ident")
    known = known.withColumn("sequence", F.row_number().over(C.Window.partitionBy("airway_uid").orderBy("from_ident", "to_ident", "from_lat", "from_lon", "to_lat", "to_lon", "level")))
    segments = known.withColumns({"uid": text.segment_uid(F.col("airway_uid"), F.col("sequence"), F.col("from_uid"), F.col("to_uid")), "source_id": F.lit(source), "lower_ft": F.col("base_ft"), "upper_ft": F.col("top_ft")})
    routes = a.select("airway_uid", F.col("route").alias("designator"), F.lit("ATS").alias("route_type"), F.lit("XX").alias("country"), F.lit(fir).alias("fir")).distinct()
    return C.Tables(C.empty(spark, C.AIRPORT), points, C.airways_table(routes, source), C.shaped(segments, C.SEGMENT), C.empty(spark, C.ISSUE))
