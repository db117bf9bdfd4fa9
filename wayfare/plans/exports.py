"""Queries of exports: GPX lines, journal lines, pack payloads, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sinks import documents as docs
from . import domain as D
from .domain import sql


@query(sql("""SELECT journey, ord, '      <trkpt lat="' || printf('%.5f', lat) || '" lon="' || printf('%.5f', lon) || '"><ele>' || printf('%.1f', coalesce(alt, 0e0)) || '</ele><time>' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '</time></trkpt>' AS line FROM points""", "points"))
def gpx_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.points(spark, d).select("journey", "ord", docs.gpx_point().alias("line"))


@query(sql("""SELECT journey, md5(string_agg('- ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ': ' || event_type, chr(10) ORDER BY ts, ord)) AS digest, count(*) AS n FROM points WHERE event_type IN ('purchase', 'signup') GROUP BY 1""", "points"))
def journal_lines(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each journey's journal lines."""
    e = D.points(spark, d).where(F.col("event_type").isin("purchase", "signup")).withColumn("title", F.col("event_type"))
    return docs.journal(e).select("journey", F.md5("lines").alias("digest"), "n")


@query(sql("""WITH b AS (SELECT source_id, uid // 1000 AS block, count(*) AS n, sha256(string_agg(ident || ':' || CAST(size AS VARCHAR), '|' ORDER BY ident, CAST(size AS VARCHAR))) AS d FROM nav_points GROUP BY 1, 2)
SELECT source_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '|' ORDER BY block)) AS signature FROM b GROUP BY 1""", "nav_points"))
def content_signature(spark: SparkSession, d: str) -> DataFrame:
    """A signature of each source's files: that of the signatures of blocks of sorted names and sizes."""
    p = D.nav_points(spark, d).select("source_id", F.floor(F.col("uid") / 1000).alias("block"), "ident", F.concat_ws(":", "ident", "size").alias("part"))
    listed = lambda key, x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, x))), lambda s: s[x]), "|"), 256)
    blocks = p.groupBy("source_id", "block").agg(F.count("*").alias("n"), listed("ident", "part").alias("d"))
    return blocks.groupBy("source_id").agg(F.sum("n").alias("n"), listed("block", "d").alias("signature"))


@query(sql("SELECT country, count(*) AS points, CAST(sum(size) AS BIGINT) AS bytes, bool_and(size > 0) AS complete FROM nav_points GROUP BY 1", "nav_points"))
def pack_sizes(spark: SparkSession, d: str) -> DataFrame:
    return D.nav_points(spark, d).groupBy("country").agg(F.count("*").alias("points"), F.sum("size").alias("bytes"), F.bool_and(F.col("size") > 0).alias("complete"))
