"""Routes between airports over airways: connectors, lightest paths, and the great circle where there is none.

The points lie in sheets of 10 rows of 20, neighbours joined by airways but for some gaps; every airport
is near a point, but for a few at the far south. Lengths are whole hundredths of a nautical mile, so that
sums are the same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo
from ..operators import graph, grid
from ..operators.tables import materialize
from . import domain as D
from .domain import sql


def _hundredths(nm: Column) -> Column:
    return F.floor(nm * 100 + 0.5).cast("long")


def points(spark: SparkSession, d: str) -> DataFrame:
    """(uid, lat, lon)."""
    p, k = F.col("p_partkey"), F.col("p_partkey") - 1
    sheet = F.floor(k / 200)
    lat = F.lit(-66.0) + F.pmod(F.floor(sheet / 14), F.lit(10)) * 13.0 + F.floor(k % 200 / 20) * 1.2 + (p * 7919 % 97) / F.lit(200.0)
    lon = F.lit(-176.0) + F.pmod(sheet, F.lit(14)) * 25.0 + (k % 20) * 1.2 + (p * 104729 % 89) / F.lit(200.0)
    return D.table(spark, d, "part").select(p.alias("uid"), lat.alias("lat"), lon.alias("lon"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, w): neighbours in a row and between rows; some lengths are missing."""
    p = points(spark, d)
    u = F.col("uid")
    right = p.where((u % 20 != 0) & (u * 13 % 11 != 0)).select("*", (u + 1).alias("dst"))
    up = p.where(((u - 1) % 200 < 180) & (u * 17 % 13 != 0)).select("*", (u + 20).alias("dst"))
    e = right.unionAll(up).join(p.toDF("dst", "blat", "blon"), "dst")
    w = F.when(u % 53 != 0, _hundredths(geo.haversine_nm(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon"))))
    return e.select(u.alias("src"), "dst", w.alias("w"))


def airports(spark: SparkSession, d: str) -> DataFrame:
    """(airport, lat, lon)."""
    s = F.col("s_suppkey")
    at = D.table(spark, d, "supplier").select(s.alias("airport"), ((s - 1) * 20 + 1 + s * 7 % 20).alias("uid"))
    return at.join(points(spark, d), "uid").select("airport", F.when(F.col("airport") % 10 == 9, -88.0).otherwise(F.col("lat") + 0.3).alias("lat"), "lon")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """(query, origin, goal, region): mostly to an airport of the same sheet; some ask for a region without airways or an unknown airport."""
    c = F.col("c_custkey")
    origin = F.floor((c - 1) / 15) + 1
    goal = F.when(c % 31 == 0, F.lit(0)).when(c % 29 == 0, origin + 10).otherwise(F.floor((origin - 1) / 10) * 10 + 1 + c * 3 % 10)
    return D.table(spark, d, "customer").select(c.alias("query"), origin.cast("long").alias("origin"), goal.cast("long").alias("goal"), F.when(c % 37 == 0, "nowhere").otherwise("everywhere").alias("region"))


_SQL = f"""lp AS (SELECT p_partkey AS uid, -66e0 + ((p_partkey - 1) // 200 // 14 % 10) * 13e0 + ((p_partkey - 1) % 200 // 20) * 1.2e0 + (p_partkey * 7919 % 97) / 200e0 AS lat,
  -176e0 + ((p_partkey - 1) // 200 % 14) * 25e0 + ((p_partkey - 1) % 20) * 1.2e0 + (p_partkey * 104729 % 89) / 200e0 AS lon FROM part),
ls AS (SELECT a.uid AS src, b.uid AS dst, CASE WHEN a.uid % 53 <> 0 THEN CAST(floor({D.hav_nm('a.lat', 'a.lon', 'b.lat', 'b.lon')} * 100e0 + 0.5e0) AS BIGINT) END AS w
  FROM (SELECT *, uid + 1 AS nxt FROM lp WHERE uid % 20 <> 0 AND uid * 13 % 11 <> 0 UNION ALL SELECT *, uid + 20 FROM lp WHERE (uid - 1) % 200 < 180 AND uid * 17 % 13 <> 0) a JOIN lp b ON a.nxt = b.uid),
ed AS (SELECT src, dst, min(coalesce(nullif(w, 0), 100)) AS w FROM (SELECT src, dst, w FROM ls UNION ALL SELECT dst, src, w FROM ls) GROUP BY 1, 2),
ap AS (SELECT s_suppkey AS airport, CASE WHEN s_suppkey % 10 = 9 THEN -88e0 ELSE lat + 0.3e0 END AS lat, lon FROM supplier JOIN lp ON uid = (s_suppkey - 1) * 20 + 1 + s_suppkey * 7 % 20),
rq AS (SELECT query, origin, CASE WHEN query % 31 = 0 THEN 0 WHEN query % 29 = 0 THEN origin + 10 ELSE (origin - 1) // 10 * 10 + 1 + query * 3 % 10 END AS goal, CASE WHEN query % 37 = 0 THEN 'nowhere' ELSE 'everywhere' END AS region
  FROM (SELECT c_custkey AS query, (c_custkey - 1) // 15 + 1 AS origin FROM customer))"""
_COMPONENTS = """comp(v, c) USING KEY (v) AS (SELECT DISTINCT src, src FROM ed UNION
  SELECT e.dst, min(comp.c) FROM comp JOIN ed e ON comp.v = e.src LEFT JOIN recurring.comp k ON k.v = e.dst WHERE k.c IS NULL OR comp.c < k.c GROUP BY e.dst),
near AS (SELECT airport, v AS vertex, c, {cost} AS cost FROM ap JOIN lp ON abs(ap.lat - lp.lat) < 8 JOIN comp ON v = uid WHERE {nm} <= 450),
conn AS (SELECT airport, c, min_by(vertex, (cost, vertex)) AS vertex, min(cost) AS cost FROM near GROUP BY airport, c)""".replace("{nm}", D.hav_nm("ap.lat", "ap.lon", "lp.lat", "lp.lon")).replace("{cost}", f"CAST(floor({D.hav_nm('ap.lat', 'ap.lon', 'lp.lat', 'lp.lon')} * 100e0 + 0.5e0) AS BIGINT)")
_PATHS = """starts AS (SELECT query, vertex, cost FROM rq JOIN conn ON airport = origin WHERE region <> 'nowhere'), goals AS (SELECT query, vertex, cost FROM rq JOIN conn ON airport = goal WHERE region <> 'nowhere'),
dist(q, v, d) USING KEY (q, v) AS (SELECT query, vertex, cost FROM starts UNION
  SELECT t.q, e.dst, min(t.d + e.w) FROM dist t JOIN ed e ON e.src = t.v LEFT JOIN recurring.dist k ON k.q = t.q AND k.v = e.dst WHERE k.d IS NULL OR t.d + e.w < k.d GROUP BY t.q, e.dst),
found AS (SELECT query, min(d + cost) AS hundredths FROM dist JOIN goals ON q = query AND v = vertex GROUP BY query)"""


def connectors(spark: SparkSession, d: str, members: DataFrame) -> DataFrame:
    """(airport, component, vertex, cost): the nearest point of each component within 450 NM."""
    low, high = members.agg(F.min("vertex"), F.max("vertex")).first()
    # points know their components before they meet airports, for the pairs are many more
    p = points(spark, d).withColumnRenamed("uid", "vertex").join(members, "vertex")
    near = grid.distance_join(airports(spark, d), p, 450.0)
    near = near.select(F.col("airport").alias("query"), "component", "vertex", _hundredths(F.col("dist_nm")).alias("cost"))
    return graph.nearest_of_components(near, low or 0, high or 0, 45_001).withColumnRenamed("query", "airport")


def _members(edges: DataFrame) -> DataFrame:
    return materialize(graph.components(edges), "members")


def _search(spark: SparkSession, d: str, paths: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, connectors (place, component, vertex, cost) and the ways (origin, goal, dist[, path]) between airports that any request asks for."""
    edges = materialize(graph.undirected(segments(spark, d), missing=100), "edges")
    members = _members(edges)
    near = materialize(connectors(spark, d, members).withColumnRenamed("airport", "place"), "connectors")
    return edges, near, graph.paths_between(edges, members, near, requests(spark, d).where("region <> 'nowhere'"), paths=paths)


@query(sql(f"WITH {_SQL}, {_COMPONENTS} SELECT airport, vertex, cost FROM conn", recursive=True))
def airport_connectors(spark: SparkSession, d: str) -> DataFrame:
    """The nearest airway point of each airport in each component of the graph."""
    edges = materialize(graph.undirected(segments(spark, d), missing=100), "edges")
    return connectors(spark, d, _members(edges)).select("airport", "vertex", "cost")


@query(sql(f"WITH {_SQL}, {_COMPONENTS}, {_PATHS} SELECT query, hundredths / 100e0 AS nm, hundredths / 100e0 AS walked_nm FROM found", recursive=True))
def shortest_path_batch(spark: SparkSession, d: str) -> DataFrame:
    """The lightest airway path of each request, and the length of walking it from point to point, connectors included."""
    edges, near, found = _search(spark, d, True)
    found, ends = materialize(found, "found"), ["origin", "goal"]
    step = found.select(*ends, F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("src"), F.slice("path", 2, F.size("path")).alias("dst"))).alias("s")).select(*ends, "s.*")
    walked = step.join(edges, ["src", "dst"]).groupBy(*ends).agg(F.sum("w").alias("walked"))
    first, last = (near.select(F.col("place").alias(place), F.col("vertex").alias(at), F.col("cost").alias(n)) for place, at, n in (("origin", "start", "first"), ("goal", "stop", "last")))
    j = found.select(*ends, "dist", F.col("path")[0].alias("start"), F.element_at("path", -1).alias("stop")).join(first, ["origin", "start"]).join(last, ["goal", "stop"]).join(walked, ends, "left")
    j = requests(spark, d).where("region <> 'nowhere'").join(j, ends)
    return j.select("query", (F.col("dist") / 100).alias("nm"), ((F.col("first") + F.col("last") + F.coalesce("walked", F.lit(0))) / 100).alias("walked_nm"))


@query(sql(f"""WITH {_SQL}, {_COMPONENTS}, {_PATHS}, j AS (SELECT rq.*, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, hundredths,
  EXISTS (SELECT 1 FROM conn WHERE airport = origin) AND EXISTS (SELECT 1 FROM conn WHERE airport = goal) AS linked
  FROM rq LEFT JOIN ap a ON origin = a.airport LEFT JOIN ap b ON goal = b.airport LEFT JOIN found USING (query))
SELECT query, CASE WHEN hundredths IS NULL THEN 'great_circle_fallback' ELSE 'airway_graph' END AS method,
  CASE WHEN alat IS NULL OR blat IS NULL THEN 0e0 ELSE coalesce(hundredths, floor({D.hav_nm('alat', 'alon', 'blat', 'blon')} * 100e0 + 0.5e0)) / 100e0 END AS nm,
  CASE WHEN hundredths IS NOT NULL THEN NULL WHEN alat IS NULL OR blat IS NULL THEN 'airport_not_found' WHEN region = 'nowhere' THEN 'airway_graph_empty' WHEN NOT linked THEN 'no_connector_points' ELSE 'airway_path_not_found' END AS fallback_reason FROM j""", recursive=True))
def route_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Airway route of each request, or the great circle with the reason for it; an unknown airport has no length."""
    _, near, found = _search(spark, d, False)
    a = airports(spark, d)
    j = requests(spark, d).join(a.toDF("origin", "alat", "alon"), "origin", "left").join(a.toDF("goal", "blat", "blon"), "goal", "left")
    j = j.join(found, ["origin", "goal"], "left").withColumn("dist", F.when(F.col("region") != "nowhere", F.col("dist")))
    linked = near.select("place").distinct()
    for end, name in (("origin", "has_start"), ("goal", "has_goal")):
        j = j.join(linked.select(F.col("place").alias(end), F.lit(True).alias(name)), end, "left")
    unknown = F.col("alat").isNull() | F.col("blat").isNull()
    reason = (
        F.when(F.col("dist").isNotNull(), F.lit(None).cast("string")).when(unknown, "airport_not_found").when(F.col("region") == "nowhere", "airway_graph_empty")
        .when(F.col("has_start").isNull() | F.col("has_goal").isNull(), "no_connector_points").otherwise("airway_path_not_found")
    )
    direct = _hundredths(geo.haversine_nm(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    return j.select("query", F.when(F.col("dist").isNull(), "great_circle_fallback").otherwise("airway_graph").alias("method"), F.when(unknown, 0.0).otherwise(F.coalesce("dist", direct) / 100).alias("nm"), reason.alias("fallback_reason"))


_RING = f"""cell AS (SELECT v, lat, lon, floor(lat / 5e0) AS r, floor(lon / 5e0) AS c FROM comp JOIN lp ON v = uid),
ring AS (SELECT airport, min_by(v, (ring, m, v)) AS vertex FROM (SELECT airport, v, greatest(abs(r - floor(ap.lat / 5e0)), abs(c - floor(ap.lon / 5e0))) AS ring, floor({D.hav_m('ap.lat', 'ap.lon', 'cell.lat', 'cell.lon')} * 100e0 + 0.5e0) AS m FROM ap, cell) WHERE ring <= 2 GROUP BY airport)"""


def ring_connectors(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """(airport, vertex): the nearest point of the first ring of plain 5-degree cells, up to two rings, that holds any."""
    p = points(spark, d).join(edges.select(F.col("src").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("vertex"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    m = _hundredths(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
    return grid.ring_nearest(airports(spark, d), p, "airport", "vertex", m).select("airport", "vertex")


@query(sql(f"""WITH {_SQL}, {_COMPONENTS.split('near AS')[0].rstrip().rstrip(',')}, {_RING},
dist(q, v, d) USING KEY (q, v) AS (SELECT query, vertex, CAST(0 AS BIGINT) FROM rq JOIN ring ON airport = origin UNION
  SELECT t.q, e.dst, min(t.d + e.w) FROM dist t JOIN ed e ON e.src = t.v LEFT JOIN recurring.dist k ON k.q = t.q AND k.v = e.dst WHERE k.d IS NULL OR t.d + e.w < k.d GROUP BY t.q, e.dst)
SELECT query, d AS hundredths, CASE WHEN a.vertex IS NULL OR b.vertex IS NULL THEN 'airgraph connector missing' WHEN d IS NULL THEN 'airgraph path missing' END AS warning
FROM rq LEFT JOIN ring a ON a.airport = origin LEFT JOIN ring b ON b.airport = goal LEFT JOIN dist ON q = query AND v = b.vertex""", recursive=True))
def route_single_connector(spark: SparkSession, d: str) -> DataFrame:
    """The lightest path between the single points that a ring search finds for both airports, or what is missing."""
    edges = materialize(graph.undirected(segments(spark, d), missing=100), "edges")
    near = materialize(ring_connectors(spark, d, edges), "connectors")
    asked = requests(spark, d)
    starts, goals = (materialize(asked.join(near, F.col(c) == F.col("airport")).select("query", "vertex", F.lit(0).cast("long").alias("cost")), c) for c in ("origin", "goal"))
    found = graph.shortest_paths(edges, starts, goals, paths=False).select("query", F.col("dist").alias("hundredths"))
    ends = starts.select("query").join(goals.select("query"), "query").withColumn("both", F.lit(True))
    j = asked.select("query").join(ends, "query", "left").join(found, "query", "left")
    return j.select("query", "hundredths", F.when(F.col("both").isNull(), "airgraph connector missing").when(F.col("hundredths").isNull(), "airgraph path missing").alias("warning"))
