"""Queries over places: merging sources, importance, sun and clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo
from ..operators import rows
from . import domain as D
from .domain import mod, q, sql

COLUMNS = ["id", "name", "name_zh", "type", "lat", "lon", "country", "population", "importance", "min_zoom", "source"]


def natural_earth_importance(world: Column, population: Column, rank: Column) -> Column:
    return F.when(world, 0.96).when(F.coalesce(population, F.lit(0)) >= 3_000_000, 0.92).when(rank <= 3, 0.88).otherwise(0.78)


def city_importance(population: Column, capital: Column) -> Column:
    return F.when(capital, 0.94).when(population >= 3_000_000, 0.9).when(population >= 1_000_000, 0.86).when(population >= 250_000, 0.8).otherwise(0.72)


def city_zoom(population: Column, capital: Column) -> Column:
    return F.when(capital | (population >= 3_000_000), 3).when(population >= 1_000_000, 4).when(population >= 250_000, 6).otherwise(8)


def merge_places(*sources: DataFrame) -> DataFrame:
    """Places of all sources, the first source's of equal ones: same country, name and coordinates to two decimals."""
    every = None
    for i, s in enumerate(sources):
        s = s.select(*COLUMNS).withColumn("rank", F.lit(i))
        every = s if every is None else every.unionByName(s)
    good = every.where(F.col("id").isNotNull() & F.col("name").isNotNull() & geo.in_range(F.col("lat"), F.col("lon")))
    keyed = good.withColumns({"k1": F.coalesce("country", F.lit("")), "k2": F.lower(F.coalesce("name_zh", "name")), "k3": geo.quantise(F.col("lat"), 2), "k4": geo.quantise(F.col("lon"), 2)})
    return rows.first_wins(keyed, ["k1", "k2", "k3", "k4"], "rank", "id").select(*COLUMNS)


def driver_sources(spark: SparkSession, d: str) -> list[DataFrame]:
    p, a, c = D.nav_points(spark, d), D.airports(spark, d), D.table(spark, d, "customer")
    none = F.lit(None).cast("string")
    pop = F.col("uid") * 7919 % 5_000_000
    first = p.where("uid % 2 = 0").select(F.concat(F.lit("ne-"), F.col("uid").cast("string")).alias("id"), "name", none.alias("name_zh"), F.lit("majorCity").alias("type"), "lat", "lon", "country", pop.alias("population"), natural_earth_importance(F.col("uid") % 101 == 0, pop, F.col("size")).alias("importance"), F.lit(4).alias("min_zoom"), F.lit("ne").alias("source"))
    second = p.select(F.concat(F.lit("gn-"), F.col("uid").cast("string")).alias("id"), F.upper("name").alias("name"), none.alias("name_zh"), F.lit("city").alias("type"), "lat", "lon", "country", pop.alias("population"), city_importance(pop, F.col("uid") % 103 == 0).alias("importance"), city_zoom(pop, F.col("uid") % 103 == 0).alias("min_zoom"), F.lit("gn").alias("source"))
    third = a.select(F.concat(F.lit("ap-"), F.col("id").cast("string")).alias("id"), "name", none.alias("name_zh"), F.lit("airport").alias("type"), "lat", "lon", "country", F.lit(None).cast("bigint").alias("population"), F.lit(0.7).alias("importance"), F.lit(6).alias("min_zoom"), F.lit("ap").alias("source"))
    fourth = c.select(F.concat(F.lit("cu-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("name_zh"), F.lit("region").alias("type"), (F.col("c_custkey") * 7 % 9000 / F.lit(100.0)).alias("lat"), (F.col("c_custkey") * 3 % 9000 / F.lit(100.0)).alias("lon"), none.alias("country"), F.lit(None).cast("bigint").alias("population"), F.lit(0.5).alias("importance"), F.lit(5).alias("min_zoom"), F.lit("cu").alias("source"))
    return [first, second, third, fourth]


_POP = "(uid * 7919 % 5000000)"


@query(sql(f"""WITH s AS (SELECT 'ne-' || CAST(uid AS VARCHAR) AS id, name, NULL AS name_zh, lat, lon, country, {_POP} AS population, CASE WHEN uid % 101 = 0 THEN 0.96e0 WHEN {_POP} >= 3000000 THEN 0.92e0 WHEN size <= 3 THEN 0.88e0 ELSE 0.78e0 END AS importance, 0 AS rank FROM nav_points WHERE uid % 2 = 0
UNION ALL SELECT 'gn-' || CAST(uid AS VARCHAR), upper(name), NULL, lat, lon, country, {_POP}, CASE WHEN uid % 103 = 0 THEN 0.94e0 WHEN {_POP} >= 3000000 THEN 0.9e0 WHEN {_POP} >= 1000000 THEN 0.86e0 WHEN {_POP} >= 250000 THEN 0.8e0 ELSE 0.72e0 END, 1 FROM nav_points
UNION ALL SELECT 'ap-' || CAST(id AS VARCHAR), name, NULL, lat, lon, country, NULL, 0.7e0, 2 FROM airports
UNION ALL SELECT 'cu-' || CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, (c_custkey * 7 % 9000) / 100e0, (c_custkey * 3 % 9000) / 100e0, NULL, NULL, 0.5e0, 3 FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(country, ''), lower(coalesce(name_zh, name)), {q('lat', 2)}, {q('lon', 2)} ORDER BY rank, id) AS n FROM s)
SELECT id, name, importance, row_number() OVER (ORDER BY importance DESC, coalesce(population, 0) DESC, name, id) AS place FROM k WHERE n = 1""", "nav_points", "airports"))
def place_merge_rank(spark: SparkSession, d: str) -> DataFrame:
    """Places of four sources merged, and ranked by importance."""
    merged = merge_places(*driver_sources(spark, d)).withColumns({"a": -F.col("importance"), "b": -F.coalesce("population", F.lit(0))})
    return rows.dense_index(merged, ["a", "b", "name", "id"], "at").select("id", "name", "importance", (F.col("at") + 1).alias("place"))


@query(sql(f"""WITH s AS (SELECT id, name, population FROM (SELECT uid AS id, name, {_POP} AS population, CASE WHEN {_POP} >= 3000000 THEN 0.92e0 ELSE 0.78e0 END AS importance FROM nav_points WHERE uid % 3 = 1) WHERE importance >= 0.76)
SELECT id, name, population FROM s ORDER BY population DESC, id LIMIT 96""", "nav_points"))
def city_lights(spark: SparkSession, d: str) -> DataFrame:
    """The 96 most populous cities of importance 0.76 or more."""
    pop = F.col("uid") * 7919 % 5_000_000
    c = D.nav_points(spark, d).where("uid % 3 = 1").select(F.col("uid").alias("id"), "name", pop.alias("population"), F.when(pop >= 3_000_000, 0.92).otherwise(0.78).alias("importance"))
    return c.where("importance >= 0.76").orderBy(F.desc("population"), "id").limit(96).select("id", "name", "population")


_HOUR = "(hour(ts) + minute(ts) / 60e0 + second(ts) / 3600e0)"
_DECL = "(23.44e0 * sin(radians((360e0 / 365e0) * (dayofyear(ts) - 81))))"
_SUB = f"({mod('(12e0 - ' + _HOUR + ') * 15e0 + 540e0', '360e0')} - 180e0)"


@query(sql(f"SELECT journey, ord, {q(_DECL, 4)} AS declination, {q(_SUB, 4)} AS subsolar_lon, {q(mod(_HOUR + ' + lon / 15e0', '24e0'), 4)} AS solar_hour FROM points", "points"))
def solar_position(spark: SparkSession, d: str) -> DataFrame:
    declination, sub = geo.sun(F.col("ts"))
    hour, _ = geo.solar_day(F.col("lon"), F.col("ts"))
    return D.points(spark, d).select("journey", "ord", geo.quantise(declination, 4).alias("declination"), geo.quantise(sub, 4).alias("subsolar_lon"), geo.quantise(hour, 4).alias("solar_hour"))


def _smooth(x: str, lo: str, hi: str) -> str:
    t = f"least(1e0, greatest(0e0, (({x}) - {lo}) / ({hi} - {lo})))"
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


@query(sql(f"""WITH x AS (SELECT journey, ord, sin(radians(lat)) * sin(radians({_DECL})) + cos(radians(lat)) * cos(radians({_DECL})) * cos(radians(lon - {_SUB})) AS s, {mod(_HOUR + ' + lon / 15e0', '24e0')} AS h FROM points)
SELECT journey, ord, {q('1e0 - ' + _smooth('s', '-0.1e0', '0.18e0'), 4)} AS night, {q(_smooth('h', '5.5e0', '7.5e0') + ' * (1e0 - ' + _smooth('h', '18.25e0', '20.25e0') + ')', 4)} AS day FROM x""", "points"))
def night_and_day(spark: SparkSession, d: str) -> DataFrame:
    _, day = geo.solar_day(F.col("lon"), F.col("ts"))
    return D.points(spark, d).select("journey", "ord", geo.quantise(geo.night_factor(F.col("lat"), F.col("lon"), F.col("ts")), 4).alias("night"), geo.quantise(day, 4).alias("day"))


@query(sql(f"""WITH x AS (SELECT journey, ord, lat, lon, floor(epoch_us(ts) / 1e6 / 86400e0) AS dd FROM points)
SELECT journey, ord, {q("least(0.88e0, greatest(0.12e0, 0.46e0 + sin((lat + dd * 1.7e0) * pi() / 18e0) * 0.16e0 + cos((lon - dd * 2.1e0) * pi() / 27e0) * 0.11e0 + sin((lat * 0.53e0 + lon * 0.31e0 + dd * 0.77e0) * pi() / 12e0) * 0.13e0 + greatest(0e0, 1e0 - abs(lat) / 35e0) * 0.18e0 - greatest(0e0, (abs(lat) - 58e0) / 32e0) * 0.16e0))", 5)} AS cover FROM x""", "points"))
def cloud_cover(spark: SparkSession, d: str) -> DataFrame:
    return D.points(spark, d).select("journey", "ord", geo.quantise(geo.cloud_cover(F.col("lat"), F.col("lon"), F.col("ts")), 5).alias("cover"))
