"""Domain relations over the driver's tables, as DataFrames and as the same relations in SQL.

The tables hold no coordinates, so these come from integer arithmetic that both engines repeat exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arith(key: str, a: int, m: int, offset: int):
    return (F.col(key) * a % m) / F.lit(100.0) - float(offset)


def nations(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def nav_points(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("k", (F.col("p_partkey") % 25).cast("int"))
    return p.join(F.broadcast(nations(spark, d)), F.col("k") == F.col("n_nationkey")).select(
        F.col("p_partkey").alias("uid"), F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("ident"), F.col("p_name").alias("name"),
        _arith("p_partkey", 37, 14000, 70).alias("lat"), _arith("p_partkey", 7919, 36000, 180).alias("lon"), F.col("p_type").alias("point_type"),
        "country", "region", F.concat(F.lit("src"), (F.col("p_partkey") % 4).cast("string")).alias("source_id"), F.col("p_size").alias("size"),
    )


def airports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    letter = lambda div: F.char((F.floor(k / div) % 26 + 65).cast("int"))
    iata = F.concat(letter(676), letter(26), letter(1))
    s = table(spark, d, "supplier")
    return s.join(F.broadcast(nations(spark, d)), s.s_nationkey == F.col("n_nationkey")).select(
        k.alias("id"), F.col("s_name").alias("ident"), iata.alias("iata"), F.when(k % 5 != 0, F.concat(F.lit("Z"), iata)).alias("icao"),
        F.concat(F.lit("Airport "), F.col("s_name")).alias("name"), F.concat("country", F.lit(" City")).alias("municipality"), "country", "region",
        F.when(k % 3 == 0, "large_airport").when(k % 3 == 1, "medium_airport").otherwise("small_airport").alias("type"),
        (F.col("s_acctbal") > 0).alias("scheduled"), _arith("s_suppkey", 997, 14000, 70).alias("lat"), _arith("s_suppkey", 7877, 36000, 180).alias("lon"), F.col("s_acctbal").alias("balance"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def route_points(spark: SparkSession, d: str) -> DataFrame:
    """(airway, seq, point): the parts of an order as the points of an airway."""
    from pyspark.sql import Window

    x = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return x.select(F.col("l_orderkey").alias("airway"), F.row_number().over(w).alias("seq"), F.col("l_partkey").alias("point"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(airway, seq, src, dst) of neighbouring points of an airway."""
    from ..operators.rows import with_next

    return with_next(route_points(spark, d), ["airway"], ["seq"], ["point"]).where("next_point IS NOT NULL").select("airway", "seq", F.col("point").alias("src"), F.col("next_point").alias("dst"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory points: a user's events."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("journey"), F.col("event_id").alias("ord"), "ts",
        ((F.col("user_id") * 313 % 10000) / F.lit(100.0) - 50.0 + (F.col("event_id") * 7 % 200) / F.lit(100.0)).alias("lat"),
        ((F.col("user_id") * 727 % 30000) / F.lit(100.0) - 150.0 + (F.col("event_id") * 11 % 300) / F.lit(100.0)).alias("lon"),
        (F.col("event_id") * 37 % 12000).cast("double").alias("alt"), F.col("value").alias("speed"), (F.col("event_id") * 53 % 360).cast("double").alias("course"),
        (F.col("event_id") * 13 % 700).cast("double").alias("accuracy"),
        F.when(F.col("event_type") == "error", "estimated").when(F.col("event_type") == "signup", "interpolated").otherwise("gps").alias("source"), "event_type", "props",
    )


#: The same relations in SQL.
SQL = {
    "nations": "SELECT n_nationkey, n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "nav_points": """SELECT p_partkey AS uid, 'P' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ident, p_name AS name,
  (p_partkey * 37 % 14000) / 100e0 - 70e0 AS lat, (p_partkey * 7919 % 36000) / 100e0 - 180e0 AS lon, p_type AS point_type,
  country, region, 'src' || CAST(p_partkey % 4 AS VARCHAR) AS source_id, p_size AS size FROM part JOIN nations ON n_nationkey = p_partkey % 25""",
    "airports": """SELECT s_suppkey AS id, s_name AS ident, iata, CASE WHEN s_suppkey % 5 <> 0 THEN 'Z' || iata END AS icao, 'Airport ' || s_name AS name,
  country || ' City' AS municipality, country, region,
  CASE s_suppkey % 3 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport' ELSE 'small_airport' END AS type, s_acctbal > 0 AS scheduled,
  (s_suppkey * 997 % 14000) / 100e0 - 70e0 AS lat, (s_suppkey * 7877 % 36000) / 100e0 - 180e0 AS lon, s_acctbal AS balance
  FROM (SELECT *, chr(CAST(65 + (s_suppkey // 676) % 26 AS INTEGER)) || chr(CAST(65 + (s_suppkey // 26) % 26 AS INTEGER)) || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) AS iata FROM supplier)
  JOIN nations ON n_nationkey = s_nationkey""",
    "route_points": """SELECT l_orderkey AS airway, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS seq,
  l_partkey AS point FROM lineitem""",
    "segments": """SELECT * FROM (SELECT airway, seq, point AS src, lead(point) OVER (PARTITION BY airway ORDER BY seq) AS dst FROM route_points) WHERE dst IS NOT NULL""",
    "points": """SELECT user_id AS journey, event_id AS ord, ts, (user_id * 313 % 10000) / 100e0 - 50e0 + (event_id * 7 % 200) / 100e0 AS lat,
  (user_id * 727 % 30000) / 100e0 - 150e0 + (event_id * 11 % 300) / 100e0 AS lon, CAST(event_id * 37 % 12000 AS DOUBLE) AS alt, value AS speed,
  CAST(event_id * 53 % 360 AS DOUBLE) AS course, CAST(event_id * 13 % 700 AS DOUBLE) AS accuracy,
  CASE event_type WHEN 'error' THEN 'estimated' WHEN 'signup' THEN 'interpolated' ELSE 'gps' END AS source, event_type, props FROM events""",
    "steps": """SELECT *, step_mm / 1e3 AS step_m FROM (SELECT *, coalesce(CAST({step} AS BIGINT), 0) AS step_mm FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS n,
  lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, epoch_us(ts) / 1e6 AS t FROM points WINDOW w AS (PARTITION BY journey ORDER BY ts, ord)))""",
}
_NEEDS = {"nav_points": ["nations"], "airports": ["nations"], "segments": ["route_points"], "steps": ["points"]}


def q(x: str, digits: int) -> str:
    k = f"1e{digits}"
    return f"(floor(({x}) * {k} + 0.5e0) / {k})"


def _chord(a: str, b: str, c: str, d: str) -> str:
    lat, lon = f"sin((radians({c}) - radians({a})) / 2e0)", f"sin((radians({d}) - radians({b})) / 2e0)"
    return f"({lat} * {lat} + cos(radians({a})) * cos(radians({c})) * {lon} * {lon})"


def hav_m(a: str, b: str, c: str, d: str) -> str:
    h = _chord(a, b, c, d)
    return f"(2e0 * 6371008.8e0 * atan2(sqrt({h}), sqrt(abs(1e0 - {h}))))"


def hav_nm(a: str, b: str, c: str, d: str) -> str:
    h = _chord(a, b, c, d)
    return f"(2e0 * 3440.065e0 * atan2(sqrt({h}), sqrt(abs(1e0 - {h}))))"


def mod(x: str, m: str) -> str:
    return f"((({x}) % {m} + {m}) % {m})"


def bearing(a: str, b: str, c: str, d: str) -> str:
    dl = f"(radians({d}) - radians({b}))"
    return mod(f"degrees(atan2(sin({dl}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl})))", "360e0")


def clamp(x: str, lo: str, hi: str) -> str:
    return f"least({hi}, greatest({lo}, {x}))"


SQL["steps"] = SQL["steps"].replace("{step}", f"floor({hav_m('plat', 'plon', 'lat', 'lon')} * 1e3 + 0.5e0)")


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A query over the named relations, and those they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{text[5:]}" if order else f"WITH {'RECURSIVE ' if recursive else ''}{text[5:]}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{text}" if order else text
