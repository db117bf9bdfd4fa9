"""Fixed-width navigation records of 132 columns, and the small pipe-delimited form of the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.rows import first_wins
from . import canonical as C

#: Countries of customer areas; areas not listed stand for themselves.
AREA_COUNTRY = {"CAN": "CA", "LAM": None, "PAC": None, "SPA": None, "USA": "US"}
#: A leg longer than this is a gap between two parts of an airway.
LONGEST_NM = 700.0


def _cut(start: int, end: int) -> Column:
    """Columns of a record, counted from 0, the end not included."""
    return F.substring("line", start + 1, end - start)


def _country(area: Column) -> Column:
    known = F.create_map(*(x for k, v in AREA_COUNTRY.items() for x in (F.lit(k), F.lit(v).cast("string"))))
    a = F.trim(area)
    return F.when(a.isin(*AREA_COUNTRY), known[a]).otherwise(F.nullif(a, F.lit("")))


def _route_type(designator: Column) -> Column:
    return F.when(designator.startswith("J"), "JET").when(designator.rlike("^[QT]"), "RNAV").when(designator.startswith("V"), "VICTOR").otherwise("ENROUTE")


def fated(lines: DataFrame) -> DataFrame:
    """lines with key, area, country, lat, lon, ident and what becomes of them (fate).

    Every line has one fate: blank, header, record-short-line, airport, point or stop, record-parse (a
    record of these kinds without a usable ident, place or number) or other-record.
    """
    place = r"([NS]\d{8})([EW]\d{9})"
    r = lines.withColumns({"key": _cut(4, 6), "area": _cut(1, 4), "lat_": F.regexp_extract("line", place, 1), "lon_": F.regexp_extract("line", place, 2)})
    r = r.withColumns({"lat": F.when(F.col("lat_") != "", text.arinc_coordinate(F.col("lat_"), 2)), "lon": F.when(F.col("lon_") != "", text.arinc_coordinate(F.col("lon_"), 3)), "country": _country(F.col("area"))})
    ident = F.when(F.col("key") == "P ", _cut(6, 10)).when(F.col("key") == "ER", _cut(29, 34)).otherwise(_cut(13, 18))
    r = r.withColumn("ident", text.normalise_ident(ident))
    kind = F.when((F.col("key") == "P ") & (_cut(12, 13) == "A"), "airport").when(F.col("key").isin("EA", "D ", "DB"), "point").when(F.col("key") == "ER", "stop")
    numbered = F.trim(_cut(25, 29)).rlike(r"^\d+$") & (F.trim(_cut(13, 18)) != "") & (F.col("ident") != "")
    sound = F.when(kind == "airport", F.col("ident").rlike("^[A-Z]{4}$") & F.col("lat").isNotNull()).when(kind == "point", (F.col("ident") != "") & geo.in_range(F.col("lat"), F.col("lon"))).otherwise(numbered)
    fate = F.when(F.coalesce("line", F.lit("")) == "", "blank").when(F.col("line").startswith("HDR"), "header").when(F.length("line") < 132, "record-short-line")
    return r.withColumn("fate", fate.when(kind.isNull(), "other-record").when(F.coalesce(sound, F.lit(False)), kind).otherwise("record-parse")).drop("lat_", "lon_")


def records(lines: DataFrame, source: str) -> C.Tables:
    """Canonical tables from (ord, line) records: waypoints EA, airports P, navaids D and DB, airway points ER.

    A point is known by its ident and area (its region, or its customer area), else by ident; the first
    record of an ident is the point. Airways are told apart by designator, type and customer area.
    """
    r = fated(lines)
    fault = C.issue(r.where("fate = 'record-short-line'"), "warning", "record-short-line", F.concat(F.lit("Line "), F.col("ord").cast("string")), source)
    fault = fault.unionByName(C.issue(r.where("fate = 'record-parse'"), "warning", "record-parse", F.concat(F.lit("Line "), F.col("ord").cast("string"), F.lit(": "), "key"), source))
    a = r.where("fate = 'airport'").select("country", "lat", "lon", F.col("ident").alias("icao"), text.normalise_ident(_cut(13, 16)).alias("code"), text.normalise_ident(_cut(93, 123)).alias("label"))
    a = a.select("country", "lat", "lon", "icao", F.when(F.col("code").rlike("^[A-Z]{3}$"), F.col("code")).alias("iata"), F.coalesce(F.nullif("label", F.lit("")), "icao").alias("name"), text.uid("apt", F.col("icao"), F.lit(source)).alias("uid"), F.lit(source).alias("source_id"))

    p = r.where("fate = 'point'").select("ord", "area", "country", "lat", "lon", "ident", F.trim(_cut(19, 21)).alias("region_area"), F.when(F.col("key") == "EA", "SIGNIFICANT_POINT").otherwise("NAVAID").alias("point_type"), F.nullif(text.normalise_ident(F.when(F.col("key") == "EA", _cut(95, 123)).otherwise(_cut(93, 123))), F.lit("")).alias("name"))
    points = C.points_table(p, ["ord"], source, None, None, "north-america")
    keys = p.select("ident", F.explode(F.array("region_area", F.trim("area"))).alias("area")).distinct().withColumn("exact", F.lit(True))

    e = r.where("fate = 'stop'").select("ord", "country", F.trim("area").alias("customer"), text.normalise_ident(_cut(13, 18)).alias("designator"), F.trim(_cut(25, 29)).cast("int").alias("seq"), "ident", F.trim(_cut(34, 36)).alias("area"))
    e = e.withColumn("route_type", _route_type(F.col("designator")))
    e = e.withColumn("airway_uid", text.airway_uid(F.col("designator"), F.lit(source), F.concat_ws(":", "route_type", "customer")))
    routes = e.select("airway_uid", "designator", "route_type", "country", F.lit(None).cast("string").alias("fir")).distinct()
    # one point stands for an ident in every area, so a point known by area is the one known by ident
    stops = e.join(keys, ["ident", "area"], "left").join(points.select("ident", "uid", "lat", "lon"), "ident", "left").withColumn("leg_nm", F.lit(None).cast("double"))
    missing = C.issue(stops.where("uid IS NULL"), "warning", "airway-point-missing", F.format_string("%s: %s/%s", "designator", "ident", "area"), source)
    segments, gaps = C.segments_table(stops.where("uid IS NOT NULL"), ["seq", "ord"], source, longest=LONGEST_NM, code="airway")
    return C.Tables(C.shaped(a, C.AIRPORT), points, C.airways_table(routes, source), segments, fault.unionByName(missing).unionByName(gaps))


def read(spark, path: str, source: str) -> C.Tables:
    """Records of one text file, by line number."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).select((F.col("i") + 1).alias("ord"), "line")
    return records(lines, source)


def piped(lines: DataFrame, source: str) -> C.Tables:
    """Canonical tables from (ord, line) of pipe-delimited records: APT, FIX, NAVAID, AIRWAY; # starts a comment.

    Points are known by ident, the last of equal ones; a leg with an unknown end is an issue, as are records of another kind.
    """
    r = lines.select("ord", F.trim("line").alias("line")).where("line <> '' AND line NOT LIKE '#%'").select("ord", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)).alias("p")).withColumn("kind", F.upper(F.col("p")[0]))
    at = lambda i: F.nullif(F.try_element_at("p", F.lit(i + 1)), F.lit(""))
    a, p, w = r.where("kind = 'APT'"), r.where("kind IN ('FIX', 'NAVAID')"), r.where("kind = 'AIRWAY'")
    lat, lon = text.coordinate_pair(at(4))
    airports = a.select(text.uid("apt", at(1), F.lit(source)).alias("uid"), text.normalise_ident(at(1)).alias("icao"), text.normalise_ident(at(2)).alias("iata"), at(3).alias("name"), lat.alias("lat"), lon.alias("lon"), at(5).alias("country"), F.lit(source).alias("source_id"))
    lat, lon = text.coordinate_pair(at(3))
    found = p.select((-F.col("ord")).alias("late"), text.normalise_ident(at(1)).alias("ident"), at(2).alias("name"), lat.alias("lat"), lon.alias("lon"), at(4).alias("country"), at(5).alias("fir"), F.col("kind").alias("point_type"))
    points = C.points_table(found, ["late"], source, None, None, None)
    e = w.select("ord", text.normalise_ident(at(1)).alias("designator"), at(2).try_cast("int").alias("seq"), text.normalise_ident(at(3)).alias("ident"), F.coalesce(at(4), F.lit("US")).alias("country"), at(5).alias("fir"))
    first = first_wins(e, ["designator"], "ord").select("designator", F.lit("ENROUTE").alias("route_type"), "country", "fir").withColumn("airway_uid", text.airway_uid(F.col("designator"), F.lit(source), F.col("fir")))
    stops = e.select("ord", "designator", "seq", "ident").join(first.select("designator", "airway_uid"), "designator").join(points.select("ident", "uid", "lat", "lon"), "ident", "left")
    # an unknown point breaks its two legs; the legs keep their numbers
    win = C.Window.partitionBy("airway_uid").orderBy("seq", "ident")
    legs = stops.withColumns({"sequence": F.row_number().over(win), **{f"to_{c}": F.lead(c).over(win) for c in ("uid", "ident", "lat", "lon")}}).where("to_ident IS NOT NULL")
    bad = C.issue(legs.where("uid IS NULL OR to_uid IS NULL"), "error", "airway-point-missing", F.format_string("%s: %s->%s", "designator", "ident", "to_ident"), source)
    here, there = (F.col("lat"), F.col("lon")), (F.col("to_lat"), F.col("to_lon"))
    course = geo.bearing(*here, *there)
    good = legs.where("uid IS NOT NULL AND to_uid IS NOT NULL").withColumns({"from_uid": F.col("uid"), "distance_nm": geo.quantise(geo.haversine_nm(*here, *there), 2), "course_deg": geo.quantise(course, 1), "reverse_deg": geo.quantise(geo.reverse_course(course), 1), "source_id": F.lit(source)})
    good = good.withColumn("uid", text.segment_uid(F.col("airway_uid"), F.col("sequence"), F.col("from_uid"), F.col("to_uid")))
    other = C.issue(r.where("kind NOT IN ('APT', 'FIX', 'NAVAID', 'AIRWAY')"), "warning", "unknown-record", F.concat(F.lit("Line "), F.col("ord").cast("string"), F.lit(": "), "kind"), source)
    return C.Tables(C.shaped(airports, C.AIRPORT), points, C.airways_table(first, source), C.shaped(good, C.SEGMENT), bad.unionByName(other))
