"""Queries over airways: packs, coverage, quality, segments, dedupe, coordinate fills, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo, text
from ..operators import graph, grid, quality, rows
from . import domain as D
from .domain import q, sql

_SOURCES = [("src0", "public", True), ("src1", "public", True), ("src2", "private", True), ("src3", "public", False)]
_SOURCE_SQL = "sources AS (SELECT * FROM (VALUES ('src0', 'public', true), ('src1', 'public', true), ('src2', 'private', true), ('src3', 'public', false)) t(source_id, status, bundle))"


def sources(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(_SOURCES, "source_id string, status string, bundle boolean"))


def licensed(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Rows whose source may be given away and bundled."""
    return df.join(sources(spark), "source_id").where("status = 'public' AND bundle").drop("status", "bundle")


def pack_vertices(spark: SparkSession, d: str, region: str = "ASIA") -> DataFrame:
    return rows.dense_index(licensed(D.nav_points(spark, d).where(F.col("region") == region), spark), ["ident", "uid"])


_PACK = f"{_SOURCE_SQL}, pack AS (SELECT *, row_number() OVER (ORDER BY ident, uid) - 1 AS idx FROM nav_points JOIN sources USING (source_id) WHERE status = 'public' AND bundle AND region = 'ASIA')"


@query(sql(f"WITH {_PACK} SELECT idx, ident, {q('lat', 6)} AS lat, {q('lon', 6)} AS lon, point_type FROM pack", "nav_points"))
def pack_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of a region's pack in order, with their place in it as id."""
    return pack_vertices(spark, d).select("idx", "ident", geo.quantise(F.col("lat"), 6).alias("lat"), geo.quantise(F.col("lon"), 6).alias("lon"), "point_type")


@query(sql(f"""WITH {_PACK}, s AS (SELECT * FROM segments)
SELECT s.airway, s.seq, a.idx AS from_idx, b.idx AS to_idx, {q(D.hav_nm('a.lat', 'a.lon', 'b.lat', 'b.lon'), 2)} AS nm FROM s JOIN pack a ON s.src = a.uid JOIN pack b ON s.dst = b.uid""", "nav_points", "segments"))
def pack_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose ends are both in the pack, by the points' ids."""
    p = pack_vertices(spark, d).select("uid", "idx", "lat", "lon")
    a, b = p.toDF("src", "from_idx", "alat", "alon"), p.toDF("dst", "to_idx", "blat", "blon")
    j = D.segments(spark, d).join(a, "src").join(b, "dst")
    return j.select("airway", "seq", "from_idx", "to_idx", geo.quantise(geo.haversine_nm(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")), 2).alias("nm"))


@query(sql(f"WITH {_SOURCE_SQL} SELECT DISTINCT o_orderpriority AS designator, status FROM orders JOIN sources ON source_id = 'src' || CAST(o_orderkey % 4 AS VARCHAR) WHERE status = 'public' AND bundle"))
def pack_airways_distinct(spark: SparkSession, d: str) -> DataFrame:
    o = D.table(spark, d, "orders").withColumn("source_id", F.concat(F.lit("src"), (F.col("o_orderkey") % 4).cast("string")))
    return o.join(sources(spark), "source_id").where("status = 'public' AND bundle").select(F.col("o_orderpriority").alias("designator"), "status").distinct()


@query(sql("SELECT source_id FROM nav_points UNION SELECT 'src' || CAST(id % 6 AS VARCHAR) FROM airports", "nav_points", "airports"))
def pack_sources(spark: SparkSession, d: str) -> DataFrame:
    """All source ids of points and airports."""
    return D.nav_points(spark, d).select("source_id").union(D.airports(spark, d).select(F.concat(F.lit("src"), (F.col("id") % 6).cast("string")))).distinct()


@query(sql("""WITH p AS (SELECT CASE WHEN uid % 97 <> 0 THEN country END AS country FROM nav_points), w AS (SELECT o_orderkey AS uid, n_name AS country FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
s AS (SELECT country, count(*) AS n FROM segments JOIN w ON airway = w.uid GROUP BY 1), a AS (SELECT country, count(*) AS n FROM airports GROUP BY 1), ww AS (SELECT country, count(*) AS n FROM w GROUP BY 1)
SELECT coalesce(p.country, 'UNKNOWN') AS country, count(*) AS points, coalesce(any_value(a.n), 0) AS airports, coalesce(any_value(ww.n), 0) AS airways, coalesce(any_value(s.n), 0) AS segments
FROM p LEFT JOIN a ON p.country IS NOT DISTINCT FROM a.country LEFT JOIN ww ON p.country IS NOT DISTINCT FROM ww.country LEFT JOIN s ON p.country IS NOT DISTINCT FROM s.country GROUP BY p.country""", "nav_points", "airports", "segments"))
def coverage_by_country(spark: SparkSession, d: str) -> DataFrame:
    p = D.nav_points(spark, d).withColumn("country", F.when(F.col("uid") % 97 != 0, F.col("country")))
    n = D.table(spark, d, "nation")
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_orderkey") % 25).cast("int").alias("k"))
    w = o.join(F.broadcast(n), F.col("k") == F.col("n_nationkey")).select("uid", F.col("n_name").alias("country"))
    s = D.segments(spark, d).select(F.col("airway").alias("airway_uid"))
    return quality.coverage(p, D.airports(spark, d), w, s)


_IDENTS = ("P000001", "P000777", "P001999", "P999999", "X")


@query(sql("WITH asked AS (SELECT unnest(['P000001', 'P000777', 'P001999', 'P999999', 'X']) AS ident) SELECT ident, count(uid) > 0 AS found, coalesce(string_agg(CAST(uid AS VARCHAR), ',' ORDER BY uid), '') AS matches FROM asked LEFT JOIN nav_points USING (ident) GROUP BY ident", "nav_points"))
def known_idents(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in _IDENTS], "ident string")
    hits = D.nav_points(spark, d).join(F.broadcast(asked), "ident", "left_semi").groupBy("ident").agg(F.array_sort(F.collect_list("uid")).alias("m"))
    return asked.join(hits, "ident", "left").select("ident", F.col("m").isNotNull().alias("found"), F.coalesce(F.array_join(F.col("m").cast("array<string>"), ","), F.lit("")).alias("matches"))


def defective(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points, airways and segments with defects put in by arithmetic."""
    p = D.nav_points(spark, d).select("uid", F.when(F.col("uid") % 211 != 0, F.col("ident")).otherwise("  ").alias("ident"), F.when(F.col("uid") % 307 == 0, F.col("lat") + 200.0).otherwise(F.col("lat")).alias("lat"), "lon")
    w = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.when(F.col("o_orderkey") % 130 != 0, F.concat(F.lit("A"), F.col("o_orderkey").cast("string"))).alias("designator"))
    s = D.segments(spark, d).select(F.concat_ws("-", "airway", "seq").alias("uid"), F.col("airway").alias("airway_uid"), F.col("src").alias("from_uid"), F.when(F.col("airway") % 90 == 0, F.col("src")).when(F.col("airway") % 170 == 0, F.lit(-1)).otherwise(F.col("dst")).alias("to_uid"))
    return p, w, s


_DEFECTS = f"""p AS (SELECT uid, CASE WHEN uid % 211 <> 0 THEN ident ELSE '  ' END AS ident, CASE WHEN uid % 307 = 0 THEN lat + 200e0 ELSE lat END AS lat, lon FROM nav_points),
w AS (SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 130 <> 0 THEN 'A' || CAST(o_orderkey AS VARCHAR) END AS designator FROM orders),
s AS (SELECT CAST(airway AS VARCHAR) || '-' || CAST(seq AS VARCHAR) AS uid, airway, src, CASE WHEN airway % 90 = 0 THEN src WHEN airway % 170 = 0 THEN -1 ELSE dst END AS dst FROM segments),
e AS (SELECT s.*, a.lat AS alat, b.lat AS blat, {D.hav_nm('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS nm FROM s LEFT JOIN p a ON s.src = a.uid LEFT JOIN p b ON s.dst = b.uid),
issues AS (SELECT 'error' AS severity, 'point-empty-ident' AS code, CAST(uid AS VARCHAR) AS entity FROM p WHERE trim(ident) = ''
UNION ALL SELECT 'error', 'point-coordinate-range', CAST(uid AS VARCHAR) FROM p WHERE NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
UNION ALL SELECT 'error', 'airway-empty-designator', CAST(uid AS VARCHAR) FROM w WHERE designator IS NULL
UNION ALL SELECT 'error', 'airway-no-segments', CAST(uid AS VARCHAR) FROM w WHERE uid NOT IN (SELECT airway FROM s)
UNION ALL SELECT 'error', 'segment-same-point', uid FROM e WHERE src = dst
UNION ALL SELECT 'error', 'segment-missing-point', uid FROM e WHERE alat IS NULL OR blat IS NULL
UNION ALL SELECT 'error', 'segment-zero-distance', uid FROM e WHERE nm <= 0.01
UNION ALL SELECT 'warning', 'segment-long-distance', uid FROM e WHERE nm > 700)"""


@query(sql(f"WITH {_DEFECTS} SELECT * FROM issues", "nav_points", "segments"))
def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issues(*defective(spark, d))


@query(sql(f"WITH {_DEFECTS} SELECT code, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues GROUP BY code", "nav_points", "segments"))
def quality_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.severity_counts(quality.issues(*defective(spark, d)))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    p = D.nav_points(spark, d).select("uid", "lat", "lon")
    return D.segments(spark, d).join(p.toDF("src", "alat", "alon"), "src").join(p.toDF("dst", "blat", "blon"), "dst")


_E = "e AS (SELECT s.*, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM segments s JOIN nav_points a ON src = a.uid JOIN nav_points b ON dst = b.uid)"


@query(sql(f"""WITH {_E}, c AS (SELECT *, {D.bearing('alat', 'alon', 'blat', 'blon')} AS course FROM e)
SELECT airway, seq, src, dst, {q(D.hav_nm('alat', 'alon', 'blat', 'blon'), 2)} AS nm, {q('course', 3)} AS course, {q(D.mod('course + 180e0', '360e0'), 3)} AS reverse FROM c WHERE src <> dst""", "nav_points", "segments"))
def segment_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Length and both courses of each segment."""
    e = _ends(spark, d).where("src <> dst")
    c = geo.bearing(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return e.select("airway", "seq", "src", "dst", geo.quantise(geo.haversine_nm(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")), 2).alias("nm"), geo.quantise(c, 3).alias("course"), geo.quantise(geo.reverse_course(c), 3).alias("reverse"))


@query(sql(f"WITH {_E} SELECT airway, count(*) AS kept, count(*) FILTER (NOT ok) AS rejected FROM (SELECT airway, {D.hav_nm('alat', 'alon', 'blat', 'blon')} <= 700 AS ok FROM e) GROUP BY airway", "nav_points", "segments").replace("count(*) AS kept", "count(*) FILTER (ok) AS kept"))
def segments_long_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each airway that are kept, and those rejected as a discontinuity over 700 NM."""
    ok = geo.haversine_nm(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")) <= quality.LONG_NM
    return _ends(spark, d).groupBy("airway").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


@query(sql("""WITH v AS (SELECT airway, seq, point % 7 AS v, lag(point % 7) OVER (PARTITION BY airway ORDER BY seq) AS p, row_number() OVER (PARTITION BY airway ORDER BY seq) AS n FROM route_points)
SELECT airway, row_number() OVER (PARTITION BY airway ORDER BY seq) AS seq, v FROM v WHERE n = 1 OR v IS DISTINCT FROM p""", "route_points"))
def consecutive_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Points of an airway without repeats of the one before, numbered anew."""
    from pyspark.sql import Window

    r = D.route_points(spark, d).withColumn("v", F.col("point") % 7)
    return rows.drop_consecutive(r, ["airway"], ["seq"], "v").select("airway", F.row_number().over(Window.partitionBy("airway").orderBy("seq")).alias("seq"), "v")


_LOADS = "x AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS a, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC, l_quantity DESC) AS z FROM lineitem)"
_LOAD = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


@query(f"WITH {_LOADS} SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM x WHERE a = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return rows.first_wins(D.table(spark, d, "lineitem"), ["l_partkey"], *_LOAD).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query(f"WITH {_LOADS} SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM x WHERE z = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return rows.last_wins(D.table(spark, d, "lineitem"), ["l_partkey"], *_LOAD).select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query(sql(f"SELECT point_type, {q('lat', 0)} AS lat, {q('lon', 0)} AS lon, min(uid) AS uid, count(*) AS merged FROM nav_points GROUP BY 1, 2, 3", "nav_points"))
def coord_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One point of each kind at each rounded coordinate."""
    return D.nav_points(spark, d).groupBy("point_type", geo.quantise(F.col("lat"), 0).alias("lat"), geo.quantise(F.col("lon"), 0).alias("lon")).agg(F.min("uid").alias("uid"), F.count("*").alias("merged"))


_FILL = """t AS (SELECT uid, CASE WHEN uid % 3 = 0 THEN lat END AS lat, CASE WHEN uid % 3 = 0 THEN lon END AS lon FROM nav_points),
src AS (SELECT s_suppkey AS uid, 1 AS priority, (s_suppkey * 13 % 9000) / 100e0 AS lat, (s_suppkey * 17 % 9000) / 100e0 AS lon FROM supplier UNION ALL SELECT c_custkey, 2, (c_custkey * 13 % 9000) / 100e0 + 0.001e0, (c_custkey * 17 % 9000) / 100e0 FROM customer)"""


def _fill_sources(spark: SparkSession, d: str) -> DataFrame:
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("uid"), F.lit(1).alias("priority"), (F.col("s_suppkey") * 13 % 9000 / F.lit(100.0)).alias("lat"), (F.col("s_suppkey") * 17 % 9000 / F.lit(100.0)).alias("lon"))
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.lit(2).alias("priority"), (F.col("c_custkey") * 13 % 9000 / F.lit(100.0) + 0.001).alias("lat"), (F.col("c_custkey") * 17 % 9000 / F.lit(100.0)).alias("lon"))
    return s.unionAll(c)


@query(sql(f"WITH {_FILL}, b AS (SELECT uid, min_by(lat, priority) AS blat, min_by(lon, priority) AS blon FROM src GROUP BY uid) SELECT uid, coalesce(lat, blat) AS lat, coalesce(lon, blon) AS lon FROM t LEFT JOIN b USING (uid)", "nav_points"))
def coordinate_fill_priority(spark: SparkSession, d: str) -> DataFrame:
    """Missing coordinates from the source of best priority that knows the point."""
    p = D.nav_points(spark, d)
    t = p.select("uid", *(F.when(F.col("uid") % 3 == 0, F.col(c)).alias(c) for c in ("lat", "lon")))
    return rows.fill_missing(t, _fill_sources(spark, d), "uid", ["lat", "lon"])


@query(sql(f"""WITH {_FILL}, j AS (SELECT a.uid, {D.hav_nm('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS nm FROM src a JOIN src b ON a.uid = b.uid AND a.priority = 1 AND b.priority = 2)
SELECT uid, {q('nm', 3)} AS nm, CASE WHEN nm < 0.1 THEN 10 ELSE 0 END AS score, nm > 50 AS suspect FROM j""", "nav_points"))
def resolver_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How well two sources agree on a point: under 0.1 NM scores 10, over 50 NM is suspect."""
    s = _fill_sources(spark, d)
    a, b = (s.where(F.col("priority") == k).select("uid", F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}")) for k in (1, 2))
    nm = geo.haversine_nm(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, "uid").select("uid", geo.quantise(nm, 3).alias("nm"), F.when(nm < 0.1, 10).otherwise(0).alias("score"), (nm > 50).alias("suspect"))


@query(sql("""WITH known AS (SELECT ident, point_type, uid FROM nav_points), r AS (SELECT airway, seq, 'P' || lpad(CAST(point AS VARCHAR), 6, '0') AS ident, CASE WHEN point % 2 = 0 THEN p_type ELSE 'none' END AS area FROM route_points JOIN part ON p_partkey = point),
by_ident AS (SELECT ident, min(uid) AS uid FROM known GROUP BY 1)
SELECT r.airway, r.seq, coalesce(k.uid, b.uid) AS uid, k.uid IS NOT NULL AS exact FROM r LEFT JOIN known k ON r.ident = k.ident AND r.area = k.point_type LEFT JOIN by_ident b ON r.ident = b.ident""", "nav_points", "route_points"))
def route_point_two_step(spark: SparkSession, d: str) -> DataFrame:
    """Route points resolved by ident and area, else by ident."""
    known = D.nav_points(spark, d).select("ident", F.col("point_type").alias("area"), F.col("uid").alias("exact_uid"))
    r = D.route_points(spark, d).join(D.table(spark, d, "part").select("p_partkey", "p_type"), F.col("point") == F.col("p_partkey"))
    r = r.select("airway", "seq", F.concat(F.lit("P"), F.lpad(F.col("point").cast("string"), 6, "0")).alias("ident"), F.when(F.col("point") % 2 == 0, F.col("p_type")).otherwise("none").alias("area"))
    any_ = known.groupBy("ident").agg(F.min("exact_uid").alias("any_uid"))
    return r.join(known, ["ident", "area"], "left").join(any_, "ident", "left").select("airway", "seq", F.coalesce("exact_uid", "any_uid").alias("uid"), F.col("exact_uid").isNotNull().alias("exact"))


_REACH = f"""{_E}, kept AS (SELECT airway, seq, src, dst FROM e WHERE src <> dst AND {D.hav_nm('alat', 'alon', 'blat', 'blon')} <= 700),
u AS (SELECT src AS u, dst AS v FROM kept UNION SELECT dst, src FROM kept), reach(u, v) AS (SELECT u, v FROM u UNION SELECT reach.u, u.v FROM reach JOIN u ON reach.v = u.u),
members AS (SELECT u AS vertex, least(u, min(v)) AS component FROM reach GROUP BY u)"""


def kept_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments between two points, without those that a discontinuity makes longer than 700 NM, with their length w."""
    nm = geo.haversine_nm(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return _ends(spark, d).where((F.col("src") != F.col("dst")) & (nm <= quality.LONG_NM)).select("airway", "seq", "src", "dst", geo.quantise(nm, 2).alias("w"))


@query(sql(f"WITH {_REACH} SELECT vertex, component FROM members", "nav_points", "segments", recursive=True))
def components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of the airway graph, isolated points left out."""
    return graph.components(kept_segments(spark, d))


@query(sql(f"""WITH {_REACH}, top AS (SELECT component FROM members GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1), ids AS (SELECT vertex, row_number() OVER (ORDER BY vertex) - 1 AS idx FROM members JOIN top USING (component))
SELECT airway, seq, a.idx AS src_idx, b.idx AS dst_idx FROM kept JOIN ids a ON src = a.vertex JOIN ids b ON dst = b.vertex""", "nav_points", "segments", recursive=True))
def main_component_pack(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the largest component by dense new ids."""
    s = kept_segments(spark, d)
    main = graph.largest_component(graph.components(s))
    _, e = graph.remap(D.nav_points(spark, d), s, main)
    return e.select("airway", "seq", "src_idx", "dst_idx")


@query(sql("""SELECT uid, 'pt-' || left(sha256(upper(trim(regexp_replace(' ' || lower(ident) || '  x', '\\s+', ' ', 'g'))) || '|' || printf('%.6f', lat) || '|' || printf('%.6f', lon) || '||' || point_type || '|' || source_id), 16) AS point_uid FROM nav_points""", "nav_points"))
def ident_normalise_uid(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed ids of points from untidy idents."""
    raw = F.concat(F.lit(" "), F.lower("ident"), F.lit("  x"))
    return D.nav_points(spark, d).select("uid", text.point_uid(raw, F.col("lat"), F.col("lon"), F.lit(None).cast("string"), F.col("point_type"), F.col("source_id")).alias("point_uid"))
