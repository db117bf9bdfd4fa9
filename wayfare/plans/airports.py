"""Queries over airports: index, search, contexts, route graph, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo, text
from ..operators import rows, search
from . import domain as D
from .domain import q, sql


@query(sql("""WITH runways AS (SELECT l_suppkey, count(*) AS n, max(l_quantity * 100) AS longest FROM lineitem GROUP BY 1)
SELECT id, ident, type, name, iata, icao, a.country, region, municipality, lat, lon, coalesce(n, 0) AS runway_count, coalesce(longest, 0e0) AS longest_runway_ft
FROM airports a LEFT JOIN runways ON l_suppkey = id WHERE regexp_matches(iata, '^[A-Z]{3}$') AND scheduled AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""", "airports"))
def airport_index(spark: SparkSession, d: str) -> DataFrame:
    """Commercial airports with names, region and runway statistics."""
    runways = D.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max(F.col("l_quantity") * 100).alias("longest"))
    a = D.airports(spark, d).where(F.col("iata").rlike("^[A-Z]{3}$") & F.col("scheduled") & geo.in_range(F.col("lat"), F.col("lon")))
    return a.join(runways, a.id == runways.l_suppkey, "left").select("id", "ident", "type", "name", "iata", "icao", "country", "region", "municipality", "lat", "lon", F.coalesce("n", F.lit(0)).alias("runway_count"), F.coalesce("longest", F.lit(0.0)).alias("longest_runway_ft"))


_QUERIES = ("", "AA", "ABA", "zab", "supplier#00000001", "airport", "FRANCE", "nope")


def _search_sql(empty: str, exact: str, begins: str, inside: int, limit: int) -> str:
    values = ", ".join(f"('{x}')" for x in _QUERIES)
    return sql(f"""WITH qs AS (SELECT q, upper(trim(q)) AS u FROM (VALUES {values}) t(q)),
hits AS (SELECT q, id, iata, icao, ident, name, type, scheduled, CASE WHEN u = '' THEN {empty} {exact} {begins}
  WHEN starts_with(upper(name), u) OR starts_with(upper(municipality), u) THEN 20
  WHEN contains(upper(name), u) OR contains(upper(municipality), u) OR contains(upper(country), u) THEN {inside} END AS rank FROM airports, qs),
placed AS (SELECT q, id, rank, row_number() OVER (PARTITION BY q ORDER BY rank, CASE WHEN scheduled THEN '0' ELSE '1' END || '-' || CASE type WHEN 'large_airport' THEN '0' WHEN 'medium_airport' THEN '1' ELSE '2' END || '-' || coalesce(iata, icao, ident, '') || '-' || name, id) AS place FROM hits WHERE rank IS NOT NULL)
SELECT q, place, id, rank FROM placed WHERE place <= {limit}""", "airports")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _QUERIES], "q string")


@query(_search_sql("CASE WHEN scheduled AND type = 'large_airport' THEN 50 WHEN scheduled AND type = 'medium_airport' THEN 70 ELSE 90 END", "WHEN iata = u THEN 0 WHEN coalesce(icao, '') = u OR upper(ident) = u THEN 2", "WHEN starts_with(iata, u) OR starts_with(coalesce(icao, ''), u) OR starts_with(upper(ident), u) THEN 10", 40, 40))
def airport_search_ranked(spark: SparkSession, d: str) -> DataFrame:
    return search.search(D.airports(spark, d), _asked(spark), search.SEARCH)


@query(_search_sql("CASE WHEN scheduled AND type = 'large_airport' THEN 60 WHEN scheduled AND type = 'medium_airport' THEN 70 WHEN scheduled THEN 80 ELSE 95 END", "WHEN iata = u THEN 0 WHEN coalesce(icao, '') = u THEN 1 WHEN upper(ident) = u THEN 2", "WHEN starts_with(iata, u) THEN 10 WHEN starts_with(coalesce(icao, ''), u) THEN 12 WHEN starts_with(upper(ident), u) THEN 14", 30, 12))
def airport_suggest_ranked(spark: SparkSession, d: str) -> DataFrame:
    return search.search(D.airports(spark, d), _asked(spark), search.SUGGEST)


@query(sql("""WITH codes AS (SELECT iata AS code FROM airports WHERE id % 3 <> 1 UNION SELECT icao FROM airports WHERE id % 3 = 1 AND icao IS NOT NULL),
keys AS (SELECT id, 0 AS pref, icao AS code FROM airports WHERE icao IS NOT NULL UNION ALL SELECT id, 1, iata FROM airports),
ranked AS (SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY pref, id) AS n FROM keys JOIN codes USING (code))
SELECT code, id FROM ranked WHERE n = 1""", "airports"))
def airport_lookup_either_code(spark: SparkSession, d: str) -> DataFrame:
    a = D.airports(spark, d)
    codes = a.where("id % 3 <> 1").select(F.col("iata").alias("code")).union(a.where("id % 3 = 1 AND icao IS NOT NULL").select("icao")).distinct()
    return search.by_any_code(a, codes)


@query(sql("""WITH keys AS (SELECT id, iata AS key FROM airports UNION ALL SELECT id, icao FROM airports UNION ALL SELECT id, ident FROM airports)
SELECT upper(key) AS key, max(id) AS id FROM keys WHERE key IS NOT NULL GROUP BY 1""", "airports"))
def airport_lookup_multikey(spark: SparkSession, d: str) -> DataFrame:
    return search.key_index(D.airports(spark, d))


@query(sql("""WITH f AS (SELECT DISTINCT l_suppkey AS id, l_returnflag || l_linestatus AS kind, l_tax AS mhz FROM lineitem),
fl AS (SELECT id, list(kind || ':' || CAST(CAST(round(mhz * 100) AS BIGINT) AS VARCHAR) ORDER BY kind, mhz) AS frequencies FROM f GROUP BY id),
n AS (SELECT l_suppkey AS id, l_partkey AS navaid, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS rn FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
nl AS (SELECT id, list(navaid ORDER BY navaid) AS navaids FROM n WHERE rn <= 12 GROUP BY id)
SELECT a.id, array_to_string(frequencies, ',') AS frequencies, array_to_string(navaids, ',') AS navaids FROM airports a LEFT JOIN fl USING (id) LEFT JOIN nl USING (id)""", "airports"))
def airport_context_lists(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of each airport in order, and its first twelve navaids."""
    x = D.table(spark, d, "lineitem")
    f = x.select(F.col("l_suppkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_tax").alias("mhz")).distinct()
    fl = f.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "mhz"))), lambda s: F.concat(s.kind, F.lit(":"), F.round(s.mhz * 100).cast("bigint").cast("string"))), ",").alias("frequencies"))
    n = rows.top_per_key(x.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("navaid")).distinct(), ["id"], 12, F.col("navaid"))
    nl = n.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("navaid")), ",").alias("navaids"))
    return D.airports(spark, d).select("id").join(fl, "id", "left").join(nl, "id", "left")


def routes(spark: SparkSession, d: str) -> DataFrame:
    """(origin, destination, airline, equipment): lineitems as flights between nations."""
    x, o, c, s, p = (D.table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "part"))
    n = D.nations(spark, d)
    a, b = n.select(F.col("n_nationkey").alias("ak"), F.col("country").alias("origin")), n.select(F.col("n_nationkey").alias("bk"), F.col("country").alias("destination"))
    j = x.select("l_orderkey", "l_partkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(F.broadcast(a), F.col("c_nationkey") == F.col("ak")).join(F.broadcast(b), F.col("s_nationkey") == F.col("bk"))
    return j.select("origin", "destination", F.col("o_orderpriority").alias("airline"), text.equipment_codes(F.regexp_replace("p_type", "[^A-Z ]", "")).alias("equipment"))


_ROUTES = """routes AS (SELECT a.country AS origin, b.country AS destination, o_orderpriority AS airline,
  list_filter(string_split_regex(upper(trim(regexp_replace(p_type, '[^A-Z ]', '', 'g'))), '\\s+'), lambda x: regexp_matches(x, '^[A-Z0-9]{2,4}$')) AS equipment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nations a ON c_nationkey = a.n_nationkey JOIN nations b ON s_nationkey = b.n_nationkey)"""


@query(sql(f"""WITH {_ROUTES}, both_ends AS (SELECT origin AS code, 1 AS o, airline, equipment FROM routes UNION ALL SELECT destination, 0, airline, equipment FROM routes),
al AS (SELECT code, string_agg(x, ',' ORDER BY n DESC, x) AS airlines FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, x) AS r FROM (SELECT code, airline AS x, count(*) AS n FROM both_ends GROUP BY 1, 2)) WHERE r <= 12 GROUP BY 1),
ac AS (SELECT code, string_agg(x, ',' ORDER BY n DESC, x) AS aircraft FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY n DESC, x) AS r FROM (SELECT code, unnest(equipment) AS x, count(*) AS n FROM both_ends GROUP BY 1, 2)) WHERE r <= 12 GROUP BY 1)
SELECT code, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(1 - o) AS BIGINT) AS incoming, any_value(airlines) AS airlines, any_value(aircraft) AS aircraft
FROM both_ends LEFT JOIN al USING (code) LEFT JOIN ac USING (code) GROUP BY code""", "nations"))
def route_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    g = search.route_graph(routes(spark, d))
    return g.select("code", "outgoing", "incoming", F.array_join("airlines", ",").alias("airlines"), F.array_join("aircraft", ",").alias("aircraft"))


@query(sql(f"""WITH {_ROUTES} SELECT code, destination, n AS count, place FROM (SELECT origin AS code, destination, count(*) AS n, row_number() OVER (PARTITION BY origin ORDER BY count(*) DESC, destination) AS place FROM routes GROUP BY 1, 2) WHERE place <= 12""", "nations"))
def route_graph_top12(spark: SparkSession, d: str) -> DataFrame:
    return search.destinations(routes(spark, d)).select("code", "destination", "count", "place")


@query(sql(f"""WITH {_ROUTES}, kinds AS (SELECT origin, destination, x, count(*) AS n FROM (SELECT origin, destination, unnest(equipment) AS x FROM routes) GROUP BY 1, 2, 3),
lists AS (SELECT origin, destination, string_agg(x, ',' ORDER BY n DESC, x) AS aircraft FROM (SELECT *, row_number() OVER (PARTITION BY origin, destination ORDER BY n DESC, x) AS r FROM kinds) WHERE r <= 8 GROUP BY 1, 2)
SELECT origin, destination, count(*) AS flights, any_value(aircraft) AS aircraft FROM routes LEFT JOIN lists USING (origin, destination) WHERE origin < destination GROUP BY 1, 2""", "nations"))
def route_pair_lookup(spark: SparkSession, d: str) -> DataFrame:
    """History of the asked (origin, destination) pairs."""
    n = D.nations(spark, d).select("country")
    asked = n.toDF("code").join(n.toDF("destination"), F.col("code") < F.col("destination"))
    return search.destinations(routes(spark, d), None).join(F.broadcast(asked), ["code", "destination"]).select(F.col("code").alias("origin"), "destination", F.col("count").alias("flights"), F.array_join("aircraft", ",").alias("aircraft"))


@query(sql("""SELECT id, name, CASE WHEN id % 7 = 0 THEN 'requested' WHEN p_type IS NOT NULL THEN 'route' WHEN scheduled THEN 'schedule' ELSE 'default' END AS resolved_by,
CASE WHEN id % 7 = 0 THEN 'B789' WHEN p_type IS NOT NULL THEN p_type WHEN scheduled THEN 'A333' ELSE 'B738' END AS aircraft
FROM airports LEFT JOIN (SELECT p_partkey, p_type FROM part WHERE p_partkey % 2 = 0) ON p_partkey = id""", "airports"))
def aircraft_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The aircraft type by the first source that has one, and which that was."""
    a = D.airports(spark, d)
    p = D.table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_type")
    ways = [("requested", F.when(F.col("id") % 7 == 0, "B789")), ("route", F.col("p_type")), ("schedule", F.when(F.col("scheduled"), "A333")), ("default", F.lit("B738"))]
    by = F.coalesce(*(F.when(v.isNotNull(), n) for n, v in ways))
    return a.join(p, a.id == p.p_partkey, "left").select("id", "name", by.alias("resolved_by"), F.coalesce(*(v for _, v in ways)).alias("aircraft"))


@query(sql("""WITH asked AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN ' ci ' || o_custkey % 3000 || ' ' WHEN 1 THEN 'CI-' || o_custkey % 3000 ELSE 'ci' || o_custkey % 3000 END AS flight FROM orders),
schedule AS (SELECT 'CI' || a.id AS number, a.iata AS origin, b.iata AS destination, 60 + a.id % 600 AS minutes FROM airports a JOIN airports b ON b.id = a.id + 1)
SELECT id, regexp_replace(upper(trim(flight)), '[\\s-]+', '', 'g') AS number, origin, destination, minutes FROM asked LEFT JOIN schedule ON number = regexp_replace(upper(trim(flight)), '[\\s-]+', '', 'g')""", "airports"))
def flight_schedule_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Flights as travellers write them, with the schedule's row of that number; the schedule flies from each airport to the next."""
    k, c = F.col("o_orderkey"), (F.col("o_custkey") % 3000).cast("string")
    written = F.when(k % 3 == 0, F.concat(F.lit(" ci "), c, F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("CI-"), c)).otherwise(F.concat(F.lit("ci"), c))
    asked = D.table(spark, d, "orders").select(k.alias("id"), text.normalise_flight_number(written).alias("number"))
    a = D.airports(spark, d)
    there = a.select((F.col("id") - 1).alias("before"), F.col("iata").alias("destination"))
    schedule = a.join(there, a.id == there.before).select(F.concat(F.lit("CI"), F.col("id").cast("string")).alias("number"), F.col("iata").alias("origin"), "destination", (60 + F.col("id") % 600).alias("minutes"))
    return asked.join(schedule, "number", "left").select("id", "number", "origin", "destination", "minutes")


@query(sql(f"""WITH pairs AS (SELECT a.id AS o, b.id AS dd, {q(D.hav_m('a.lat', 'a.lon', 'b.lat', 'b.lon'), 1)} AS m FROM airports a JOIN airports b ON b.id = a.id + 1)
SELECT o AS origin, dd AS destination, m AS distance_m, CAST(floor(greatest(45e0, m / 1000e0 / 810e0 * 60e0 + 28e0) + 0.5e0) AS BIGINT) AS minutes,
CASE WHEN m < 900000 THEN 8800e0 WHEN m < 2500000 THEN 10700e0 ELSE 11600e0 END AS cruise_m FROM pairs""", "airports"))
def flight_estimate(spark: SparkSession, d: str) -> DataFrame:
    a = D.airports(spark, d).select("id", "lat", "lon")
    b = a.select((F.col("id") - 1).alias("before"), F.col("id").alias("destination"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    m = geo.quantise(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")), 1)
    return a.join(b, a.id == b.before).select(F.col("id").alias("origin"), "destination", m.alias("distance_m")).select("origin", "destination", "distance_m", geo.flight_minutes(F.col("distance_m")).cast("bigint").alias("minutes"), geo.cruise_altitude_m(F.col("distance_m")).alias("cruise_m"))


@query(sql(f"""WITH pairs AS (SELECT a.id AS o, a.lat, a.lon, b.lat AS blat, b.lon AS blon FROM airports a JOIN airports b ON b.id = a.id + 1),
fr AS (SELECT unnest([0.05e0, 0.5e0, 0.86e0, 1e0]) AS f, unnest(['flightTakeoff', 'flightCruise', 'flightTopOfDescent', 'flightLanding']) AS type),
x AS (SELECT *, {D._chord('lat', 'lon', 'blat', 'blon')} AS h FROM pairs, fr), y AS (SELECT *, 2e0 * atan2(sqrt(h), sqrt(abs(1e0 - h))) AS g FROM x),
z AS (SELECT *, sin((1e0 - f) * g) / sin(g) AS a, sin(f * g) / sin(g) AS b FROM y),
v AS (SELECT o, type, f, lat, lon, g, a * (cos(radians(lat)) * cos(radians(lon))) + b * (cos(radians(blat)) * cos(radians(blon))) AS x, a * (cos(radians(lat)) * sin(radians(lon))) + b * (cos(radians(blat)) * sin(radians(blon))) AS y, a * sin(radians(lat)) + b * sin(radians(blat)) AS z FROM z)
SELECT o AS origin, type, f AS fraction, {q('degrees(atan2(z, sqrt(x * x + y * y)))', 4)} AS lat, {q('degrees(atan2(y, x))', 4)} AS lon FROM v""", "airports"))
def planned_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Four milestones of a planned flight on the great circle."""
    a = D.airports(spark, d).select("id", "lat", "lon")
    b = a.select((F.col("id") - 1).alias("before"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    marks = F.array(*(F.struct(F.lit(f).alias("fraction"), F.lit(t).alias("type")) for f, t in ((0.05, "flightTakeoff"), (0.5, "flightCruise"), (0.86, "flightTopOfDescent"), (1.0, "flightLanding"))))
    rows_ = a.join(b, a.id == b.before).withColumn("m", F.explode(marks)).select("id", "lat", "lon", "blat", "blon", "m.*")
    lat, lon = geo.interpolate(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon"), F.col("fraction"))
    return rows_.select(F.col("id").alias("origin"), "type", "fraction", geo.quantise(lat, 4).alias("lat"), geo.quantise(lon, 4).alias("lon"))


_LETTERS = ["é", "E", "z", "ä", "a", "Z", "ö", "A", "o", "ñ", "n", "Å"]


@query(sql(f"""WITH n AS (SELECT id, country, ([{', '.join(f"'{x}'" for x in _LETTERS)}])[1 + CAST(id % {len(_LETTERS)} AS INT)] || CASE WHEN id % 2 = 0 THEN 'b' ELSE 'B' END || CAST(id % 5 AS VARCHAR) AS name FROM airports)
SELECT country, CAST(row_number() OVER (PARTITION BY country ORDER BY icu_sort_key(name, 'en'), id) AS INT) AS place, name, id FROM n""", "airports"))
def airports_in_locale_order(spark: SparkSession, d: str) -> DataFrame:
    """Airports of each country in the order in which people list names, accents and case counting last."""
    k = F.col("id")
    name = F.concat(F.element_at(F.array(*map(F.lit, _LETTERS)), (1 + k % len(_LETTERS)).cast("int")), F.when(k % 2 == 0, "b").otherwise("B"), (k % 5).cast("string"))
    a = D.airports(spark, d).select("id", "country", name.alias("name"))
    w = Window.partitionBy("country").orderBy(search.locale_key(F.col("name")), "id")
    return a.select("country", F.row_number().over(w).alias("place"), "name", "id")
