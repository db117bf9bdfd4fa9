"""Queries of distance joins, neighbours and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo
from ..operators import grid, rows
from . import domain as D
from .domain import q, sql


@query(sql(f"SELECT a.id, p.uid, {q(D.hav_nm('a.lat', 'a.lon', 'p.lat', 'p.lon'), 2)} AS nm FROM airports a, nav_points p WHERE {D.hav_nm('a.lat', 'a.lon', 'p.lat', 'p.lon')} <= 450", "airports", "nav_points"))
def points_in_radius_grid(spark: SparkSession, d: str) -> DataFrame:
    """Points within 450 NM of each airport, by grid cells."""
    near = grid.distance_join(D.airports(spark, d).select("id", "lat", "lon"), D.nav_points(spark, d).select("uid", "lat", "lon"), 450.0)
    return near.select("id", "uid", geo.quantise(F.col("dist_nm"), 2).alias("nm"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Places to name: all points."""
    kind = F.when(F.col("uid") % 3 == 0, "airport").when(F.col("uid") % 3 == 1, "majorCity").otherwise("landmark")
    return D.nav_points(spark, d).select(F.col("uid").alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), kind.alias("kind"), (F.col("size") / F.lit(50.0)).alias("importance"))


_PLACES = "places AS (SELECT uid AS place, lat AS plat, lon AS plon, CASE uid % 3 WHEN 0 THEN 'airport' WHEN 1 THEN 'majorCity' ELSE 'landmark' END AS kind, size / 50e0 AS importance FROM nav_points)"
_SECTOR = "CASE WHEN t < 30 OR t >= 330 THEN 'front' WHEN t < 75 THEN 'right-front' WHEN t < 120 THEN 'right side' WHEN t < 180 THEN 'right-rear' WHEN t < 240 THEN 'left-rear' WHEN t < 285 THEN 'left side' ELSE 'left-front' END"


@query(sql(f"""WITH {_PLACES}, x AS (SELECT ord, course AS heading, lat, lon, place, plat, plon, kind, importance, {D.hav_m('lat', 'lon', 'plat', 'plon')} AS m FROM points, places),
y AS (SELECT *, {q("m - (CASE kind WHEN 'airport' THEN 60000e0 WHEN 'majorCity' THEN 0e0 ELSE 150000e0 END) - importance * 24000e0", 2)} AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score, place) AS n, {D.mod(D.bearing('lat', 'lon', 'plat', 'plon') + ' - heading', '360e0')} AS t FROM y)
SELECT ord, place, {q('m', 1)} AS dist_m, {_SECTOR} AS direction FROM z WHERE n = 1""", "points", "nav_points"))
def nearest_landmark_scored(spark: SparkSession, d: str) -> DataFrame:
    """The place to name for a position, and in which sector of the view it is."""
    p = D.points(spark, d).select("ord", "lat", "lon", F.col("course").alias("heading"))
    return grid.nearest_scored(p, places(spark, d), "ord", "place").select("ord", "place", geo.quantise(F.col("dist_m"), 1).alias("dist_m"), "direction")


@query(sql(f"""WITH {_PLACES}, x AS (SELECT ord, place, {q(D.hav_m('lat', 'lon', 'plat', 'plon'), 2)} AS m FROM points, places), y AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY m, place) AS rank FROM x)
SELECT ord, place, m AS dist_m, rank FROM y WHERE rank <= 4""", "points", "nav_points"))
def knn4_features(spark: SparkSession, d: str) -> DataFrame:
    """The four nearest places of each position, by growing rings of cells."""
    p = D.points(spark, d).select("ord", "lat", "lon")
    return grid.knn_exact(p, places(spark, d).select("place", "plat", "plon"), "ord", "place", 4)


@query(sql(f"""WITH {_PLACES}, c AS (SELECT ord, lat, lon, CAST(floor(lat / 5e0) AS BIGINT) AS r, CAST(floor(lon / 5e0) AS BIGINT) AS c FROM points), p AS (SELECT *, CAST(floor(plat / 5e0) AS BIGINT) AS pr, CAST(floor(plon / 5e0) AS BIGINT) AS pc FROM places),
x AS (SELECT ord, place, greatest(abs(pr - r), abs(pc - c)) AS ring, {q(D.hav_m('lat', 'lon', 'plat', 'plon'), 2)} AS m FROM c JOIN p ON abs(pr - r) <= 2 AND abs(pc - c) <= 2),
y AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY ring, m, place) AS n FROM x) SELECT ord, place, ring, m AS dist_m FROM y WHERE n = 1""", "points", "nav_points"))
def ring_search_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The best place of the first ring of plain 5-degree cells that holds any, up to two rings; not always the nearest."""
    m = geo.quantise(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")), 2)
    best = grid.ring_nearest(D.points(spark, d).select("ord", "lat", "lon"), places(spark, d), "ord", "place", m)
    return best.withColumnRenamed("measure", "dist_m")


@query(sql(f"""WITH {_PLACES}, r AS (SELECT journey, lat, lon, row_number() OVER (PARTITION BY journey ORDER BY ts, ord) - 1 AS pos, count(*) OVER (PARTITION BY journey) AS n FROM points),
s AS (SELECT journey, lat, lon, CAST(floor((lat + 90) / 5e0) AS INT) AS sr, CAST(floor((lon + 180) / 5e0) AS INT) AS sc FROM r WHERE pos % greatest(1, CAST(ceil(n / 96e0) AS INT)) = 0 OR pos = n - 1)
SELECT DISTINCT journey, place FROM places p, s WHERE abs(CAST(floor((plat + 90) / 5e0) AS INT) - sr) <= 2 AND abs(CAST(floor((plon + 180) / 5e0) AS INT) - sc) <= 2 AND {D.hav_m('lat', 'lon', 'plat', 'plon')} <= 650000""", "points", "nav_points"))
def landmarks_near_route(spark: SparkSession, d: str) -> DataFrame:
    """Places within 650 km of each route's samples, at most about 96 of them and the last point."""
    r = rows.every_kth(D.points(spark, d), ["journey"], ["ts", "ord"], 96)
    return grid.route_places(r, places(spark, d), "journey", "place", 650_000.0)


@query(sql(f"WITH {_PLACES} SELECT place, EXISTS (SELECT 1 FROM points WHERE {D.hav_m('lat', 'lon', 'plat', 'plon')} < 8000) AS matched FROM places", "points", "nav_points"))
def plan_place_matched(spark: SparkSession, d: str) -> DataFrame:
    """Whether a planned place was visited: any event within 8 km."""
    p = places(spark, d).select("place", F.col("plat").alias("lat"), F.col("plon").alias("lon"))
    e = D.points(spark, d).select("ord", "lat", "lon")
    hit = grid.distance_join(p, e, 5.0).withColumn("m", F.col("dist_nm") * (geo.EARTH_M / geo.EARTH_NM)).where("m < 8000").select("place").distinct().withColumn("matched", F.lit(True))
    return p.select("place").join(hit, "place", "left").select("place", F.coalesce("matched", F.lit(False)).alias("matched"))


@query(sql("""SELECT CAST(CAST(least(35, greatest(0, floor((lat + 90e0) / 5e0))) AS INT) AS VARCHAR) || ':' || CAST(CAST(least(71, greatest(0, floor((lon + 180e0) / 5e0))) AS INT) AS VARCHAR) AS cell,
string_agg(DISTINCT CAST(uid AS VARCHAR), ',' ORDER BY CAST(uid AS VARCHAR)) AS ids FROM nav_points GROUP BY 1""", "nav_points"))
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the bounded grid with their points."""
    p = D.nav_points(spark, d).select(F.col("uid").cast("string").alias("uid"), "lat", "lon")
    return grid.cells_of(p, "uid").select("cell", F.array_join("ids", ",").alias("ids"))


@query(sql(f"SELECT journey, {q('min(m)', 1)} AS deviation_m FROM (SELECT p.journey, {q(D.hav_m('p.lat', 'p.lon', 'r.lat', 'r.lon'), 2)} AS m FROM points p JOIN points r ON p.journey = r.journey AND p.ord % 2 = 0 AND r.ord % 2 = 1) GROUP BY 1", "points"))
def route_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Least distance of a journey's positions (even ones) to its planned ones (odd ones)."""
    p = D.points(spark, d)
    a = p.where("ord % 2 = 0").select("journey", "ord", "lat", "lon")
    b = p.where("ord % 2 = 1").select("journey", F.col("ord").alias("planned"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return grid.knn_exact(a, b, "ord", "planned", 1, ["journey"]).groupBy("journey").agg(geo.quantise(F.min("dist_m"), 1).alias("deviation_m"))


@query(sql(f"SELECT country, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, {q('sqrt(2e0 * 6371008.8e0 * max(size) * 100e0 + (max(size) * 100e0) * (max(size) * 100e0))', 1)} AS horizon_m FROM nav_points GROUP BY country", "nav_points"))
def bounding_boxes(spark: SparkSession, d: str) -> DataFrame:
    h = F.max("size") * F.lit(100.0)
    return D.nav_points(spark, d).groupBy("country").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), geo.quantise(geo.horizon_m(h), 1).alias("horizon_m"))
