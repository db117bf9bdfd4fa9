"""Sources that list segments row by row: semicolon CSV files, and reports without coordinates that other sources fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.rows import fill_missing, first_wins
from . import canonical as C
from . import html

#: Kinds of points in reports.
POINT_KINDS = {"WPT": "SIGNIFICANT_POINT", "VORDME": "NAVAID", "VOR": "NAVAID", "NDB": "NAVAID", "DME": "NAVAID", "TACAN": "NAVAID"}


def _put(rows: DataFrame, name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) if name in rows.columns else F.lit("")


def _ident(name: Column) -> Column:
    """The last bracketed code of a point's name, else its last word."""
    up = F.upper(name)
    return text.normalise_ident(F.coalesce(F.try_element_at(F.regexp_extract_all(up, F.lit(r"\(([A-Z0-9]{2,5})\)"), F.lit(1)), F.lit(-1)), F.try_element_at(F.regexp_extract_all(up, F.lit(r"\b([A-Z][A-Z0-9]{1,6})\b"), F.lit(1)), F.lit(-1)), up))


def csv_tables(points_csv: DataFrame, navaids_csv: DataFrame, segments_csv: DataFrame, source: str, country: str, fir: str, region: str) -> C.Tables:
    """Canonical tables from lists of points, navaids and segments with their own coordinates.

    A segment's end is the known point of its coordinate (7 decimals), else of its ident, else a new one.
    Lengths, tracks, limits (flight levels times 100) and directions come from the columns, and lengths
    and tracks are measured where those are blank or zero. Rows of one file need a column ord.
    """
    pair = lambda a, b: text.coordinate_pair(F.concat_ws(" ", a, b))

    def listed(rows: DataFrame, kind: str, rank: int) -> DataFrame:
        lat, lon = pair(_put(rows, "Latitud_Latitude"), _put(rows, "Longitud_Longitude"))
        return rows.select(F.lit(rank).alias("rank"), "ord", F.lit(0).alias("end"), text.normalise_ident(_put(rows, "Identificador_Identifier")).alias("ident"), F.nullif(_put(rows, "Nombre_Name"), F.lit("")).alias("name"), lat.alias("lat"), lon.alias("lon"), F.lit(kind).alias("point_type"))

    s = segments_csv.withColumn("designator", text.normalise_ident(_put(segments_csv, "DESIGNATOR_TXT"))).where("designator <> ''")
    ends = []
    for end, suffix in ((1, "INICIO"), (2, "FINAL")):
        name = _put(s, f"PUNTO_{suffix}")
        lat, lon = pair(_put(s, f"COOR_LAT_{suffix}"), _put(s, f"COOR_LON_{suffix}"))
        kind = F.when(text.is_navaid(name), "NAVAID").otherwise("SIGNIFICANT_POINT")
        ends.append(s.where(name != "").select(F.lit(2).alias("rank"), "ord", F.lit(end).alias("end"), _ident(name).alias("ident"), F.lit(None).cast("string").alias("name"), lat.alias("lat"), lon.alias("lon"), kind.alias("point_type")))
    found = listed(points_csv, "SIGNIFICANT_POINT", 0).unionByName(listed(navaids_csv, "NAVAID", 1)).unionByName(ends[0]).unionByName(ends[1])
    found = found.withColumns({c: geo.quantise(F.col(c), 7) for c in ("lat", "lon")})
    points = C.points_table(found, ["rank", "ord", "end"], source, fir, country, region)
    k = F.format_string("%.7f,%.7f", "lat", "lon")
    by_key = first_wins(points.withColumn("k", k), ["k"], "ident").select("k", F.struct("uid", "ident", "lat", "lon").alias("by_key"))
    by_ident = points.select("ident", F.struct("uid", "ident", "lat", "lon").alias("by_ident"))

    def resolved(e: DataFrame, prefix: str) -> DataFrame:
        r = e.withColumns({c: geo.quantise(F.col(c), 7) for c in ("lat", "lon")}).withColumn("k", k).join(by_key, "k", "left").join(by_ident, "ident", "left")
        return r.select("ord", F.coalesce("by_key", "by_ident").alias(prefix))

    number = lambda c: text.decimal_comma(_put(s, c))
    legs = s.select("ord", "designator", number("LENGTH_VAL").alias("length"), number("MAGTRACK_VAL").alias("track"), number("REVERSEMAGTRACK_VAL").alias("back"), text.flight_level_ft(number("DISTVERTLOWER_VAL"), _put(s, "DISTVERTLOWER_UOM")).alias("lower_ft"), text.flight_level_ft(number("DISTVERTUPPER_VAL"), _put(s, "DISTVERTUPPER_UOM")).alias("upper_ft"), F.nullif(_put(s, "DIRECTION_CODE_IMPAR_ODD"), F.lit("")).alias("odd"), F.nullif(_put(s, "DIRECTION_CODE_PAR_EVEN"), F.lit("")).alias("even"), F.coalesce(*(F.nullif(_put(s, c), F.lit("")) for c in ("PBNACCURACY_VAL", "NAVIGATIONPERFORMANCE", "ROUTETYPE_CODE"))).alias("route_type"))
    legs = legs.join(resolved(ends[0], "a"), "ord", "left").join(resolved(ends[1], "b"), "ord", "left").withColumn("airway_uid", text.airway_uid(F.col("designator"), F.lit(source), F.lit(fir)))
    missing = C.issue(legs.where("a IS NULL OR b IS NULL"), "warning", "route-point-missing", F.concat("designator", F.lit(": missing segment endpoint")), source)
    good = legs.where("a IS NOT NULL AND b IS NOT NULL AND a.uid <> b.uid").withColumn("sequence", F.row_number().over(C.Window.partitionBy("airway_uid").orderBy("ord")))
    here, there = (F.col("a.lat"), F.col("a.lon")), (F.col("b.lat"), F.col("b.lon"))
    zero = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), other)
    good = good.withColumn("course", zero("track", geo.bearing(*here, *there)))
    good = good.withColumns(
        {
            "from_uid": F.col("a.uid"), "to_uid": F.col("b.uid"), "distance_nm": geo.quantise(zero("length", geo.haversine_nm(*here, *there)), 2), "course_deg": geo.quantise(F.col("course"), 1),
            "reverse_deg": geo.quantise(zero("back", geo.reverse_course(F.col("course"))), 1), "source_id": F.lit(source),
            "direction": F.when(F.col("odd").isNotNull() & F.col("even").isNotNull(), "bidirectional").when(F.col("odd").isNotNull(), "odd").when(F.col("even").isNotNull(), "even"),
        }
    )
    good = good.withColumn("uid", text.segment_uid(F.col("airway_uid"), F.col("sequence"), F.col("from_uid"), F.col("to_uid")))
    routes = legs.groupBy("airway_uid", "designator").agg(F.min_by("route_type", "ord").alias("route_type")).withColumns({"country": F.lit(country), "fir": F.lit(fir)})
    return C.Tables(C.empty(s.sparkSession, C.AIRPORT), points, C.airways_table(routes, source), C.shaped(good, C.SEGMENT), missing)


def report_tables(documents: DataFrame, source: str, known: DataFrame, fir: str = "REPORT", region: str = "europe") -> C.Tables:
    """Canonical tables from (document, html) reports whose second table lists segments by the names of their ends.

    Columns: id, designator, area, start, its kind, end, its kind. Coordinates come from known (ident,
    lat, lon, priority): the source of least priority that knows the ident. Points that none knows stay
    out with their segments, as an issue; ids of segments follow the filled points.
    """
    rows = html.table_rows(documents, ["document"], "html", table=2).where(F.size("cells") >= 7)
    c = lambda i: F.col("cells")[i]
    r = rows.select("document", "row", text.normalise_ident(c(1)).alias("designator"), c(2).alias("area"), text.normalise_ident(c(3)).alias("a"), c(4).alias("a_kind"), text.normalise_ident(c(5)).alias("b"), c(6).alias("b_kind"))
    r = r.where(F.col("designator").rlike(r"^[A-Z]{1,2}\d") & (F.col("a") != "") & (F.col("b") != ""))
    kinds = F.create_map(*(F.lit(x) for kv in POINT_KINDS.items() for x in kv))
    ends = r.select("document", "row", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("ident"), F.col("a_kind").alias("kind")), F.struct(F.lit(1).alias("end"), F.col("b").alias("ident"), F.col("b_kind").alias("kind")))).alias("e")).select("document", "row", "e.*")
    first = first_wins(ends, ["ident"], "document", "row", "end").select("ident", F.coalesce(kinds[F.col("kind")], F.lit("SIGNIFICANT_POINT")).alias("point_type"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    filled = fill_missing(first, known, "ident", ["lat", "lon"])
    points = C.points_table(filled, ["point_type"], source, fir, None, region)
    unknown = C.issue(filled.where("lat IS NULL OR lon IS NULL"), "warning", "point-without-coordinates", F.col("ident"), source)
    r = r.withColumn("airway_uid", text.airway_uid(F.col("designator"), F.lit(source), F.lit(fir)))
    p = points.select("ident", "uid", "lat", "lon")
    legs = r.where("a <> b").join(p.toDF("a", "from_uid", "alat", "alon"), "a").join(p.toDF("b", "to_uid", "blat", "blon"), "b")
    legs = first_wins(legs, ["airway_uid", "from_uid", "to_uid"], "document", "row").withColumn("sequence", F.row_number().over(C.Window.partitionBy("airway_uid").orderBy("document", "row")))
    here, there = (F.col("alat"), F.col("alon")), (F.col("blat"), F.col("blon"))
    course = geo.bearing(*here, *there)
    legs = legs.withColumns({"distance_nm": geo.quantise(geo.haversine_nm(*here, *there), 2), "course_deg": geo.quantise(course, 1), "reverse_deg": geo.quantise(geo.reverse_course(course), 1), "source_id": F.lit(source)})
    legs = legs.withColumn("uid", text.segment_uid(F.col("airway_uid"), F.col("sequence"), F.col("from_uid"), F.col("to_uid")))
    routes = legs.select("airway_uid", "designator", F.when(F.col("designator").rlike("^[UPQTZ]"), "RNAV").otherwise("ATS").alias("route_type"), F.lit(None).cast("string").alias("country"), F.lit(fir).alias("fir")).distinct()
    return C.Tables(C.empty(documents.sparkSession, C.AIRPORT), points, C.airways_table(routes, source), C.shaped(legs, C.SEGMENT), unknown)
