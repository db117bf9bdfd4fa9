"""Queries that render tables as files of some format and read them back through the readers of that format."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geo
from ..operators import quality
from ..operators import trajectory as T
from ..operators.tables import materialize, shared_dir
from ..sinks import documents as docs
from ..sinks import packs
from ..sources import archives, build, fixed_width, html, journeys, navdata, publications, tabular
from ..sources import canonical as C
from ..streaming import positions as S
from . import domain as D
from .domain import q, sql


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wayfare-{name}-{uuid.uuid4().hex}"


# ---- delimited text ------------------------------------------------------------------------------------


@query(sql("""SELECT ident, 'The "' || name || '", ' || country AS name, lat, lon FROM airports""", "airports"))
def csv_airports(spark: SparkSession, d: str) -> DataFrame:
    """Airports through quoted CSV files with headers."""
    path = scratch(spark, "csv")
    a = D.airports(spark, d).select("ident", F.concat(F.lit('The "'), "name", F.lit('", '), "country").alias("name"), "lat", "lon")
    a.write.options(header=True, quote='"', escape='"').csv(path)
    return tabular.csv(spark, path).select("ident", "name", tabular.number(F.col("lat")).alias("lat"), tabular.number(F.col("lon")).alias("lon"))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def semicolon_csv(spark: SparkSession, d: str) -> DataFrame:
    """A semicolon file with a byte-order mark."""
    path = scratch(spark, "bom")
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.concat_ws(";", "n_nationkey", "n_name").alias("value"))
    head = spark.createDataFrame([(-1, "﻿k;name")], "i int, value string")
    head.unionByName(n).coalesce(1).sortWithinPartitions("i").select("value").write.text(path)  # a file of 26 lines
    return tabular.csv(spark, path, sep=";").select(F.col("k").cast("int").alias("k"), "name")


@query("""SELECT 'A' || CAST(o_orderkey % 50 AS VARCHAR) AS airline, chr(CAST(65 + o_orderkey % 26 AS INT)) || 'AA' AS origin, 'B' || chr(CAST(65 + o_orderkey % 25 AS INT)) || 'B' AS destination, CASE WHEN o_orderkey % 7 <> 0 THEN 'Y' END AS codeshare, '320 738' AS equipment FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0""")
def airline_routes_file(spark: SparkSession, d: str) -> DataFrame:
    """Direct flights between known airports, through a file without a header and with a mark for absent values."""
    path, k = scratch(spark, "routes"), F.col("o_orderkey")
    letter = lambda m: F.char((65 + k % m).cast("int"))
    r = D.table(spark, d, "orders").select(F.concat(F.lit("A"), (k % 50).cast("string")), F.lit("1"), F.when(k % 5 != 0, F.concat(letter(26), F.lit("AA"))), F.lit("2"), F.concat(F.lit("B"), letter(25), F.lit("B")), F.lit("3"), F.when(k % 7 != 0, "Y"), (k % 3).cast("int"), F.lit("320 738"))
    r.toDF(*(f"c{i}" for i in range(9))).write.options(nullValue="\\N").csv(path)
    return tabular.airline_routes(spark, path)


@query("""SELECT p_partkey AS geonameid, 'Town "' || p_name || '"' AS name, (p_partkey * 37 % 14000) / 100e0 - 70e0 AS lat, CAST(p_partkey * 977 % 90000 AS BIGINT) AS population FROM part WHERE p_partkey * 977 % 90000 >= 15000""")
def gazetteer_cities(spark: SparkSession, d: str) -> DataFrame:
    """Large towns of a tab-separated gazetteer of 19 columns, quotes being text."""
    path, k = scratch(spark, "cities"), F.col("p_partkey")
    blank = F.lit("")
    line = F.concat_ws("\t", k, F.concat(F.lit('Town "'), "p_name", F.lit('"')), blank, blank, (k * 37 % 14000) / F.lit(100.0) - 70.0, (k * 7919 % 36000) / F.lit(100.0) - 180.0, F.lit("P"), F.lit("PPL"), F.lit("XX"), blank, blank, blank, blank, blank, k * 977 % 90000, blank, blank, F.lit("UTC"), F.lit("2024-01-01"))
    D.table(spark, d, "part").select(line.alias("value")).write.text(path)
    return tabular.cities(spark, path).select("geonameid", "name", "lat", "population")


@query("SELECT n_nationkey AS k FROM nation")
def optional_file(spark: SparkSession, d: str) -> DataFrame:
    """A table, and what a file adds that isn't there."""
    gone = tabular.optional(lambda: spark.read.schema("k int").parquet(scratch(spark, "gone")), spark, "k int")
    return D.table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).unionByName(gone)


# ---- HTML ----------------------------------------------------------------------------------------------


def _joined(order: str, value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda s: s.v), "")


@query(sql("SELECT airway, seq, 'P&' || CAST(point AS VARCHAR) AS point FROM route_points", "route_points"))
def html_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Points of airways out of HTML tables, one page an airway, heads told by the class of their row."""
    row = F.concat(F.lit("<tr><td>"), F.col("seq").cast("string"), F.lit("</td><td> <b>P&amp;</b>"), F.col("point").cast("string"), F.lit("</td></tr>"))
    page = F.concat(F.lit("<html><table><tr class='head'><th>No</th><th>Point</th></tr>"), _joined("seq", row), F.lit("</table></html>"))
    pages = D.route_points(spark, d).groupBy("airway").agg(page.alias("html"))
    return html.table_rows(pages, ["airway"]).where("row_class <> 'head'").select("airway", F.col("cells")[0].cast("bigint").alias("seq"), F.col("cells")[1].alias("point"))


@query("SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS inner_text FROM orders")
def nested_tables(spark: SparkSession, d: str) -> DataFrame:
    """The second table of each page, and what a table within a cell of it holds."""
    o = D.table(spark, d, "orders")
    page = F.concat(F.lit("<table><tr><td>menu</td></tr></table><table><tr><td>"), F.col("o_custkey").cast("string"), F.lit("</td><td><table><tr><td>"), "o_orderpriority", F.lit("</td></tr></table></td></tr></table>"))
    pages = o.select(F.col("o_orderkey").alias("k"), page.alias("html"))
    outer = html.table_rows(pages, ["k"], depth=1, table=2).select("k", F.col("cells")[0].alias("customer"))
    inner = html.table_rows(pages, ["k"], depth=2).select("k", F.col("cells")[0].alias("inner_text"))
    return outer.join(inner, "k")


#: First letters of the idents of a million points each, of the later letters of designators, and of their last ones; hemispheres, AD and FL would be read as something else.
_MILLIONS, _SECOND, _LAST = "PQRTUVXYZABCDGHIJKLMO", "ZYXWVUTSRQPONMKJIHGFECBA", "ABCDFGHIJKLMOPQRTUVXYZ"
_IDENT = f"substr('{_MILLIONS}', CAST({{0}} // 1000000 % {len(_MILLIONS)} AS INT) + 1, 1) || lpad(CAST({{0}} % 1000000 AS VARCHAR), 6, '0')"
_PLACES = f"pl AS (SELECT p_partkey AS point, {_IDENT.format('p_partkey')} AS ident, p_partkey * 7 % 60 + (p_partkey * 11 % 60) / 60e0 + (p_partkey * 13 % 60) / 3600e0 AS lat, p_partkey * 17 % 170 + (p_partkey * 19 % 60) / 60e0 + (p_partkey * 23 % 60) / 3600e0 AS lon FROM part)"
_NAME = f"chr(CAST(65 + airway // 10000 % 26 AS INT)) || substr('{_SECOND}', CAST(airway // 260000 % 24 AS INT) + 1, 1) || CAST(airway % 10000 AS VARCHAR) || substr(' {_LAST}', CAST(airway // 6240000 % 23 AS INT) + 1, CASE WHEN airway // 6240000 % 23 > 0 THEN 1 ELSE 0 END)"


def _letter(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1))


def _ident(k: Column) -> Column:
    """A point's ident: a letter and six digits, so that 21 million points have idents of their own."""
    return F.concat(_letter(_MILLIONS, F.floor(k / 1_000_000) % len(_MILLIONS)), F.lpad((k % 1_000_000).cast("string"), 6, "0"))


def _designator(airway: Column) -> Column:
    """An airway's name as designators are written: two letters, up to four digits, perhaps a letter; 143 million airways have names of their own."""
    first, second, last = (F.floor(airway / n) % m for n, m in ((10_000, 26), (260_000, 24), (6_240_000, 23)))
    return F.concat(F.char((65 + first).cast("int")), _letter(_SECOND, second), (airway % 10_000).cast("string"), F.when(last > 0, _letter(_LAST, last - 1)).otherwise(""))


def _place(k: Column) -> tuple[Column, Column]:
    """A point's place as digits: degrees, minutes and seconds."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(k * 7 % 60), two(k * 11 % 60), two(k * 13 % 60), F.lit("N")), F.concat(F.lpad((k * 17 % 170).cast("string"), 3, "0"), two(k * 19 % 60), two(k * 23 % 60), F.lit("E"))


def _publication(spark: SparkSession, d: str, classes: bool) -> DataFrame:
    """(document, html): a page for each 2,000 numbers of airways; each airway has a head and a row for each point."""
    lat, lon = _place(F.col("point"))
    css = (lambda n: F.lit(f"<tr class='table-row-type-{n}'>")) if classes else (lambda n: F.lit("<tr>"))
    name, ident = _designator(F.col("airway")), _ident(F.col("point"))
    row = F.concat(css(2), F.lit("<td>"), ident, F.lit("</td><td>"), lat, F.lit(" "), lon, F.lit("</td></tr>"))
    parts = D.route_points(spark, d).groupBy("airway").agg(_joined("seq", row).alias("rows")).withColumn("group", F.floor(F.col("airway") / 2000))
    one = F.concat(css(1), F.lit("<td>"), name, F.lit("</td></tr>"), "rows")
    pages = parts.groupBy("group").agg(F.concat(F.lit("<table>"), _joined("airway", one), F.lit("</table>")).alias("html"))
    return pages.select(F.concat(F.lit("enr_3_"), F.lpad(F.col("group").cast("string"), 8, "0")).alias("document"), "html")


_LEGS = f"""{_PLACES}, st AS (SELECT airway, seq, point, lag(point) OVER (PARTITION BY airway ORDER BY seq) AS before FROM route_points), kept AS (SELECT airway, row_number() OVER (PARTITION BY airway ORDER BY seq) AS n, point FROM st WHERE before IS DISTINCT FROM point),
legs AS (SELECT a.airway, CAST(a.n AS INT) AS sequence, x.ident AS a, y.ident AS b, {q(D.hav_nm('x.lat', 'x.lon', 'y.lat', 'y.lon'), 2)} AS nm FROM kept a JOIN kept b ON a.airway = b.airway AND b.n = a.n + 1 JOIN pl x ON x.point = a.point JOIN pl y ON y.point = b.point)"""


def _legs(t: C.Tables) -> DataFrame:
    ids = t.points.select("uid", "ident")
    j = t.segments.join(t.airways.select(F.col("uid").alias("airway_uid"), "designator"), "airway_uid")
    j = j.join(ids.toDF("from_uid", "a"), "from_uid").join(ids.toDF("to_uid", "b"), "to_uid")
    return j.select("designator", "sequence", "a", "b", F.col("distance_nm").alias("nm"))


@query(sql(f"WITH {_LEGS} SELECT {_NAME} AS designator, sequence, a, b, nm FROM legs WHERE airway IN (SELECT airway FROM kept GROUP BY 1 HAVING count(DISTINCT point) > 1)", "route_points"))
def publication_by_rows(spark: SparkSession, d: str) -> DataFrame:
    """Legs of the airways of publications that tell a row by its look."""
    return _legs(publications.tables(_publication(spark, d, False), "uk"))


@query(sql(f"WITH {_LEGS}, every AS (SELECT a.airway, CAST(a.n AS INT) AS sequence, x.ident AS a, y.ident AS b, {q(D.hav_nm('x.lat', 'x.lon', 'y.lat', 'y.lon'), 2)} AS nm FROM (SELECT airway, seq AS n, point FROM route_points) a JOIN route_points b ON a.airway = b.airway AND b.seq = a.n + 1 JOIN pl x ON x.point = a.point JOIN pl y ON y.point = b.point) SELECT {_NAME} AS designator, sequence, a, b, nm FROM every", "route_points"))
def publication_by_classes(spark: SparkSession, d: str) -> DataFrame:
    """Legs of the airways of publications that tell a row by its class."""
    return _legs(publications.tables(_publication(spark, d, True), "korea"))


@query(sql(f"WITH {_LEGS}, w AS (SELECT airway FROM kept GROUP BY 1 HAVING count(DISTINCT point) > 1) SELECT 'points' AS part, count(DISTINCT point) AS n FROM route_points UNION ALL SELECT 'airways', count(*) FROM w UNION ALL SELECT 'segments', count(*) FROM legs JOIN w USING (airway) UNION ALL SELECT 'airports', 0", "route_points"))
def built_source(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each canonical table of a source that is built from its configuration."""
    path = scratch(spark, "pages")
    pages = _publication(spark, d, False)
    pages.select("document", F.col("html").alias("value")).write.partitionBy("document").text(path)
    t = build.build(spark, {"source": "uk", "raw_files": {"pages": path}})
    return build.summary(t).where("part <> 'issues'")


# ---- fixed columns, pipes, navigation data --------------------------------------------------------------

_CODE = "chr(CAST(65 + {0} // 1679616 % 26 AS INT)) || to_base({0} % 1679616, 36, 4)"


def _code(k: Column) -> Column:
    """A point's ident in a field of five columns: a letter and four digits to base 36, so that 43 million points have idents of their own."""
    return F.concat(F.char((65 + F.floor(k / 1_679_616) % 26).cast("int")), F.lpad(F.conv((k % 1_679_616).cast("string"), 10, 36), 4, "0"))


@query(sql(f"WITH {_PLACES} SELECT {_CODE.format('point')} AS ident, floor(lat * 1e6 + 0.5e0) / 1e6 AS lat, floor(lon * 1e6 + 0.5e0) / 1e6 AS lon, upper(p_name) AS name FROM pl JOIN part ON p_partkey = point"))
def fixed_width_points(spark: SparkSession, d: str) -> DataFrame:
    """Waypoints through records of 132 columns."""
    k = F.col("p_partkey")
    lat, lon = _place(k)
    place = F.concat(F.lit("N"), F.left(lat, F.lit(6)), F.lit("00E"), F.left(lon, F.lit(7)), F.lit("00"))
    line = F.concat(F.lit("SUSAEA       "), _code(k), F.lit(" K1"), F.lit(" " * 11), place, F.lit(" " * 44), F.rpad("p_name", 28, " "), F.lit(" " * 9))
    lines = D.table(spark, d, "part").select(k.alias("ord"), line.alias("line"))
    t = fixed_width.records(materialize(lines, "records"), "faa")
    return t.points.select("ident", geo.quantise(F.col("lat"), 6).alias("lat"), geo.quantise(F.col("lon"), 6).alias("lon"), "name")


@query(sql(f"WITH {_PLACES} SELECT ident, floor(lat * 1e6 + 0.5e0) / 1e6 AS lat, CASE WHEN point % 3 = 0 THEN 'NAVAID' ELSE 'FIX' END AS kind FROM pl"))
def piped_points(spark: SparkSession, d: str) -> DataFrame:
    """Points through pipe-delimited records with comments."""
    k = F.col("p_partkey")
    lat, lon = _place(k)
    line = F.concat_ws("|", F.when(k % 3 == 0, "NAVAID").otherwise("FIX"), _ident(k), "p_name", F.concat(lat, F.lit(" "), lon), F.lit("XX"), F.lit("F"))
    lines = D.table(spark, d, "part").select(k.alias("ord"), F.when(k % 50 == 0, F.concat(line, F.lit(" "))).otherwise(line).alias("line"))
    t = fixed_width.piped(lines.unionByName(spark.createDataFrame([(-1, "# points")], "ord long, line string")), "fixture")
    return t.points.select("ident", geo.quantise(F.col("lat"), 6).alias("lat"), F.col("point_type").alias("kind"))


@query(sql("SELECT 'X' || lpad(CAST(uid AS VARCHAR), CAST(greatest(5, length(CAST(uid AS VARCHAR))) AS INT), '0') AS ident, 'R' || CAST(uid % 7 AS VARCHAR) AS region, floor(lat * 100 + 0.5e0) / 100e0 AS lat, floor(lon * 100 + 0.5e0) / 100e0 AS lon, 'SIGNIFICANT_POINT' AS kind FROM nav_points WHERE uid % 4 <> 0 UNION ALL SELECT 'X' || lpad(CAST(uid AS VARCHAR), CAST(greatest(5, length(CAST(uid AS VARCHAR))) AS INT), '0'), 'R' || CAST(uid % 7 AS VARCHAR), floor(lat * 100 + 0.5e0) / 100e0, floor(lon * 100 + 0.5e0) / 100e0, CASE uid % 3 WHEN 0 THEN 'NDB' WHEN 1 THEN 'VOR' ELSE 'DME' END FROM nav_points WHERE uid % 4 = 0", "nav_points"))
def navdata_points(spark: SparkSession, d: str) -> DataFrame:
    """Fixes and navaids through simulator files, merged by ident and region."""
    path = scratch(spark, "navdata")
    u = F.col("uid")
    p = D.nav_points(spark, d).select("uid", "lat", "lon", F.concat(F.lit("X"), F.lpad(u.cast("string"), F.greatest(F.lit(5), F.length(u.cast("string"))), F.lit("0"))).alias("ident"), F.concat(F.lit("R"), (u % 7).cast("string")).alias("region"))
    p.where("uid % 4 <> 0").select(F.format_string(" %.2f  %.2f %s ENRT %s", "lat", "lon", "ident", "region").alias("value")).write.text(f"{path}/fix")
    code = F.when(u % 3 == 0, 2).when(u % 3 == 1, 3).otherwise(12)
    p.where("uid % 4 = 0").select(F.format_string("%d %.2f %.2f 0 11000 100 0 %s ENRT %s", code, F.col("lat"), F.col("lon"), F.col("ident"), F.col("region")).alias("value")).write.text(f"{path}/nav")
    return navdata.merged(navdata.fixes(spark, f"{path}/fix", "*.txt"), navdata.navaids(spark, f"{path}/nav", "*.txt")).select("ident", "region", "lat", "lon", "kind")


@query(sql("SELECT s.airway, s.seq, 'X' || lpad(CAST(src AS VARCHAR), 5, '0') AS from_ident, floor(a.lat * 100 + 0.5e0) / 100e0 AS from_lat, 'X' || lpad(CAST(dst AS VARCHAR), 5, '0') AS to_ident, floor(b.lon * 100 + 0.5e0) / 100e0 AS to_lon, CAST(s.airway % 60 * 100 AS INT) AS base_ft FROM segments s JOIN nav_points a ON a.uid = src JOIN nav_points b ON b.uid = dst", "segments", "nav_points"))
def navdata_airways(spark: SparkSession, d: str) -> DataFrame:
    """Legs of airways through simulator files with inline coordinates."""
    path = scratch(spark, "awy")
    p = D.nav_points(spark, d).select("uid", "lat", "lon", F.concat(F.lit("X"), F.lpad(F.col("uid").cast("string"), 5, "0")).alias("ident"))
    s = D.segments(spark, d).join(p.toDF("src", "alat", "alon", "a"), "src").join(p.toDF("dst", "blat", "blon", "b"), "dst")
    s.select(F.format_string("%s %.2f %.2f %s %.2f %.2f 1 %d 450 W%dN%d", "a", "alat", "alon", "b", "blat", "blon", F.col("airway") % 60, "airway", "seq").alias("value")).write.text(path)
    a = navdata.airways_inline(spark, path, "*.txt")
    part = lambda i: F.regexp_extract("route", r"W(\d+)N(\d+)", i).cast("long")
    return a.select(part(1).alias("airway"), part(2).alias("seq"), "from_ident", "from_lat", "to_ident", "to_lon", "base_ft")


# ---- journeys, packs, archives, reports ------------------------------------------------------------------


@query(sql("SELECT CAST(journey AS VARCHAR) AS journey, count(*) AS n_points, date_trunc('second', min(ts)) AS start_ts, CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS n_events, floor(sum(floor(lat * 1e4 + 0.5e0))) AS lat_sum FROM points GROUP BY 1", "points"))
def journey_documents(spark: SparkSession, d: str) -> DataFrame:
    """Journeys written as portable JSON documents and read again."""
    p = D.points(spark, d).withColumn("journey", F.col("journey").cast("string"))
    events = p.where("event_type = 'signup'").withColumn("title", F.col("event_type"))
    path = scratch(spark, "journeys")
    docs.portable(p, events).select(F.col("json").alias("value")).write.text(path)
    t = journeys.tables(spark.read.text(path).withColumnRenamed("value", "json"))
    replay = t.points.where("route = 'derivedReplay'").groupBy("journey").agg(F.count("*").alias("n_points"), F.min("ts").cast("timestamp_ntz").alias("start_ts"), F.floor(F.sum(F.floor(F.col("lat") * 1e4 + 0.5))).cast("double").alias("lat_sum"))
    n = t.events.groupBy("journey").agg(F.count("*").alias("n_events"))
    return replay.join(n, "journey", "left").select("journey", "n_points", "start_ts", F.coalesce("n_events", F.lit(0)).alias("n_events"), "lat_sum")


def _canonical(spark: SparkSession, d: str) -> C.Tables:
    """The domain's tables as those of a source."""
    text_id = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    p = D.nav_points(spark, d).withColumn("uid", text_id("uid"))
    w = D.table(spark, d, "orders").select(text_id("o_orderkey").alias("uid"), F.concat(F.lit("W"), F.col("o_orderkey").cast("string")).alias("designator"), F.lit("ATS").alias("route_type"), F.lit(None).cast("string").alias("country"), F.lit("src0").alias("source_id"))
    s = D.segments(spark, d).select(F.concat_ws("-", "airway", "seq").alias("uid"), text_id("airway").alias("airway_uid"), F.col("seq").alias("sequence"), text_id("src").alias("from_uid"), text_id("dst").alias("to_uid"))
    a = D.airports(spark, d).select(text_id("id").alias("uid"), "icao", "iata", "name", "lat", "lon", "country", F.lit("src1").alias("source_id"))
    return C.Tables(C.shaped(a, C.AIRPORT), C.shaped(p, C.POINT), C.shaped(w, C.AIRWAY), C.shaped(s, C.SEGMENT), C.empty(spark, C.ISSUE))


_ALLOWED = "('src0', 'src1')"


@query(sql(f"""WITH ids AS (SELECT uid, row_number() OVER (ORDER BY ident, uid) - 1 AS i FROM nav_points WHERE source_id IN {_ALLOWED})
SELECT 'points' AS part, i AS a, CAST(NULL AS BIGINT) AS b, ident AS label FROM ids JOIN nav_points USING (uid) UNION ALL SELECT 'segments', x.i, y.i, '' FROM segments JOIN ids x ON x.uid = src JOIN ids y ON y.uid = dst""", "nav_points", "segments"))
def pack_file(spark: SparkSession, d: str) -> DataFrame:
    """Points and segments of a pack that is written to gzipped files and read again."""
    path = scratch(spark, "pack")
    sources = spark.createDataFrame([("src0", "public", True), ("src1", "public", True), ("src2", "private", True)], "source_id string, status string, bundle boolean")
    packs.write_pack(packs.pack_rows(_canonical(spark, d), sources, None), path)
    got = packs.read_pack(spark, path)
    # one pass over the lines for both parts
    is_point, field = F.col("part") == "points", lambda i: F.col("fields")[i]
    a, b = F.when(is_point, F.col("idx")).otherwise(field(0).cast("long")), F.when(~is_point, field(1).cast("long"))
    return got.where("part IN ('points', 'segments')").select("part", a.alias("a"), b.alias("b"), F.when(is_point, field(0)).otherwise("").alias("label"))


@query(sql("SELECT journey, count(*) AS n, md5(string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ts, ord)) AS digest FROM points GROUP BY journey", "points"))
def archive_members(spark: SparkSession, d: str) -> DataFrame:
    """Journeys packed as stored archives and taken out of them again."""
    order = F.array_sort(F.collect_list(F.struct("ts", "ord")))
    p = D.points(spark, d).groupBy("journey").agg(F.count("*").alias("n"), F.array_join(F.transform(order, lambda s: s.ord.cast("string")), ",").alias("list"))
    files = p.select("journey", F.explode(F.array(F.struct(F.lit("n.txt").alias("name"), F.col("n").cast("string").alias("content")), F.struct(F.lit("list.txt").alias("name"), F.col("list").alias("content")))).alias("f")).select("journey", "f.*")
    packed = packs.archives(files).select(F.col("journey").alias("path"), F.col("archive").alias("content"))
    got = archives.as_text(archives.zip_members(packed, r"\.txt$", stored_only=True))
    return got.groupBy(F.col("path").cast("long").alias("journey")).agg(F.max(F.when(F.col("member") == "n.txt", F.col("text"))).cast("long").alias("n"), F.max(F.when(F.col("member") == "list.txt", F.md5("text"))).alias("digest"))


@query(sql("""SELECT 'error' AS severity, 'point-empty-ident' AS code, count(*) AS n FROM part WHERE p_partkey % 211 = 0 UNION ALL SELECT 'error', 'point-coordinate-range', count(*) FROM nav_points WHERE uid % 307 = 0 AND lat + 200 > 90"""  , "nav_points"))
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Issues of points, written as a report and counted from it."""
    from .airways import defective

    points, _, _ = defective(spark, d)
    path = scratch(spark, "report")
    packs.write_report(quality.point_issues(points), path)
    report = spark.read.schema("severity string, code string, entity string").json(path)
    return report.groupBy("severity", "code").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS k, max(c_custkey) AS last FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1 UNION ALL SELECT c_nationkey, max(c_custkey) FROM customer WHERE c_nationkey % 2 = 1 AND c_custkey % 3 = 0 GROUP BY 1")
def keyed_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written by key: the last row of a key stays, and a second write replaces those that it brings."""
    c = D.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("last"))
    old = packs.write_keyed(c.where("last % 3 = 0"), scratch(spark, "old"), ["k"], "last")
    return packs.write_keyed(c.where("k % 2 = 0"), scratch(spark, "new"), ["k"], "last", old)


@query("SELECT s_nationkey AS nation, count(*) AS n FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1 UNION ALL SELECT s_nationkey, 2 * count(*) FROM supplier WHERE s_nationkey % 3 = 0 AND s_nationkey % 2 = 0 GROUP BY 1")
def saved_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Journeys saved in place of their former versions, and some deleted."""
    path = scratch(spark, "saved")
    s = D.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    packs.write_partitioned(s, path, "nation")
    third = s.where("nation % 3 = 0")
    packs.write_partitioned(third.unionByName(third), path, "nation")
    packs.delete_partitions(spark, path, "nation", third.where("nation % 2 = 1").select("nation").distinct())
    return spark.read.parquet(path).groupBy(F.col("nation").cast(s.schema["nation"].dataType).alias("nation")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 THEN 'new' ELSE 'old' END AS state, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN 'new' END, CAST(NULL AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 2 = 0")
def saved_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Source metadata with the columns that an update fills in."""
    s, k = D.table(spark, d, "supplier"), F.col("s_suppkey")
    old = s.where("s_suppkey % 5 <> 0").select(k.alias("k"), F.lit("old").alias("state"), F.col("s_name").alias("name"))
    new = s.where("s_suppkey % 2 = 0").select(k.alias("k"), F.when(k % 6 != 0, "new").alias("state"))
    return packs.save_metadata(old, new, "k")


@query(sql("SELECT journey, md5(string_agg(printf('%.5f', lon) || ',' || printf('%.5f', lat) || ',' || printf('%.1f', alt), ' ' ORDER BY ts, ord)) AS line FROM points GROUP BY journey", "points"))
def kml_lines(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the line in each journey's KML document."""
    p = D.points(spark, d)
    k = docs.kml(p, p.select("journey").distinct().withColumn("title", F.lit("A & B")))
    return k.select("journey", F.md5(F.regexp_extract("kml", "<coordinates>([^<]*)</coordinates>", 1)).alias("line"))


# ---- streams ---------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, transform, write=None) -> str:
    """Run a stream over the events to its end; returns the folder of its output."""
    path = scratch(spark, "stream")
    schema = D.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = transform(rows).writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    run = (out.foreachBatch(write(f"{path}/table")) if write else out.format("parquet").option("path", f"{path}/out")).start()
    run.awaitTermination()
    return path


def _signals(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").cast("string").alias("journey"), F.col("event_id").alias("ord"), F.expr("timestamp_micros(unix_micros(cast(ts AS timestamp)) - event_id % 7 * 7200000000)").alias("ts"))


@query("SELECT CAST(user_id AS VARCHAR) AS journey, event_id AS ord FROM (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT *, epoch_us(ts) - event_id % 7 * 7200000000 AS t FROM events)) WHERE top IS NULL OR t > top")
def stream_late_drop(spark: SparkSession, d: str) -> DataFrame:
    """Late points of a stream dropped, in order of arrival."""
    path = _stream(spark, d, lambda e: S.drop_late(_signals(e)).select("journey", "ord"))
    return spark.read.parquet(f"{path}/out")


@query("SELECT user_id AS journey, event_type, max(event_id) AS last FROM events GROUP BY 1, 2")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A table that a stream keeps with the last row of each key."""
    path = _stream(spark, d, lambda e: e.select(F.col("user_id").alias("journey"), "event_type", F.col("event_id").alias("last")), lambda at: S.upsert_batches(at, ["journey", "event_type"], "last"))
    return S.latest(spark, f"{path}/table")


@query("SELECT CAST(user_id AS VARCHAR) AS journey, event_id AS ord, lag(event_id, 20) OVER (PARTITION BY user_id ORDER BY event_id) AS dropped FROM events")
def stream_buffer(spark: SparkSession, d: str) -> DataFrame:
    """What falls out of a stream's buffer of the latest 20 points."""
    path = _stream(spark, d, lambda e: S.recent(_signals(e), 20))
    return spark.read.parquet(f"{path}/out")


@query(sql(f"SELECT journey, count(*) AS n, {q('CAST(sum(step_mm) AS DOUBLE) / 1e3', 0)} AS length_m FROM steps GROUP BY journey", "steps"))
def recording_completion(spark: SparkSession, d: str) -> DataFrame:
    """Journeys whose three planned routes are replaced by a recording: here the replay route's size and length."""
    p = D.points(spark, d)
    plan = p.groupBy("journey").agg(F.min("ts").alias("ts"), F.min("lat").alias("lat"), F.min("lon").alias("lon")).select(F.col("journey").cast("string").alias("journey"), F.lit("s").alias("segment"), F.explode(F.array(*map(F.lit, ("raw", "processed", "derivedReplay")))).alias("route"), F.lit(0).cast("long").alias("ord"), "ts", "lat", "lon")
    recorded = p.select(F.concat(F.lit("r"), F.col("journey").cast("string")).alias("recording"), "ord", "ts", "lat", "lon")
    links = p.select(F.col("journey").cast("string").alias("journey"), F.concat(F.lit("r"), F.col("journey").cast("string")).alias("recording")).distinct()
    done = journeys.complete(plan, links, recorded).where("route = 'derivedReplay'").withColumn("journey", F.col("journey").cast("long"))
    return T.with_steps(done).groupBy("journey").agg(F.count("*").alias("n"), geo.quantise(F.sum("step_mm") / 1e3, 0).alias("length_m"))
