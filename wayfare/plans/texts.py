"""Queries of text extraction: coordinates, anchors, aircraft types, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import angles, geo, text
from . import domain as D
from .domain import q, sql


@query(sql(f"SELECT uid, {q('floor(abs(lat) * 3600e0 + 0.5e0) / 3600e0 * sign(lat)', 6)} AS lat, {q('floor(abs(lon) * 3600e0 + 0.5e0) / 3600e0 * sign(lon)', 6)} AS lon FROM nav_points", "nav_points"))
def dms_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates written as compact DMS text and parsed again."""

    def dms(c: str, digits: int, sides: str):
        s = F.floor(F.abs(F.col(c)) * 3600.0 + 0.5).cast("bigint")
        part = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat(part(F.floor(s / 3600), digits), part(F.floor(s / 60) % 60, 2), part(s % 60, 2), F.when(F.col(c) < 0, sides[1]).otherwise(sides[0]))

    t = D.nav_points(spark, d).select("uid", F.concat(dms("lat", 2, "NS"), F.lit(" "), dms("lon", 3, "EW")).alias("t"))
    lat, lon = text.coordinate_pair(F.col("t"))
    return t.select("uid", geo.quantise(lat, 6).alias("lat"), geo.quantise(lon, 6).alias("lon"))


#: Ways to write a place, by name: how an angle looks, whether hemispheres stand in front, what is between the two, and the parts of a degree that it can hold.
_WAYS = {
    "packed": ("{d}{m}{s}", False, " ", 3600),
    "packed-line": ("{d}{m}{s}", False, "\n", 3600),
    "packed-close": ("{d}{m}{s}", False, "", 3600),
    "packed-front": ("{d}{m}{s}", True, " ", 3600),
    "packed-fraction": ("{d}{m}{s}.{f}", False, " ", 360000),
    "packed-hundredths": ("{d}{m}{s}{f}", True, "", 360000),
    "packed-minutes": ("{d}{m}", False, " ", 60),
    "marked": ("{d}°{m}'{s}.{f}\"", False, " ", 360000),
    "marked-typeset": ("{d}° {m}’ {s}” ", False, " / ", 3600),
    "marked-doubled": ("{d}°{m}'{s}''", False, " ", 3600),
    "marked-front": ("{d}°{m}′{s}″", True, ", ", 3600),
    "marked-minutes": ("{d}º{m}'", False, " ", 60),
    "apart": ("{d} {m} {s}", False, " ", 3600),
    "apart-comma": ("{d} {m} {s},{f} ", False, "; ", 360000),
    "dashes": ("{d}-{m}-{s}", False, " ", 3600),
    "colons-front": ("{d}:{m}:{s}", True, " ", 3600),
    "decimal": ("{d}.{h}", False, ", ", 100),
    "decimal-marked": ("{d}.{h}°", False, " ", 100),
}


def _written(units: Column, digits: int, sides: str) -> Column:
    """An angle, given in parts of a degree, as text that looks as a row's way says."""
    parts, size = F.col("parts"), F.abs(units)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minute = F.greatest(F.floor(parts / 60), F.lit(1))
    second = F.greatest(F.floor(parts / 3600), F.lit(1))
    values = {
        "{d}": F.lpad(F.floor(size / parts).cast("string"), digits, "0"),
        "{m}": two(F.floor(size % parts / minute)),
        "{s}": two(F.floor(size % minute / second)),
        "{f}": two(size % second),
        "{h}": two(size % 100),
    }
    body = reduce(lambda c, v: F.replace(c, F.lit(v[0]), v[1]), values.items(), F.col("look"))
    side = F.when(units < 0, sides[1]).otherwise(sides[0])
    return F.when(F.col("front"), F.concat(side, body)).otherwise(F.concat(body, side))


def _units(axis: int, parts: int | str) -> str:
    """SQL of a part's latitude (90) or longitude (180) in parts of a degree, from arithmetic on its key."""
    step = 7919 if axis == 90 else 104729
    return f"CAST((p_partkey * {step} + 13) % (2 * {axis} * {parts} + 1) - {axis} * {parts} AS BIGINT)"


@query(" UNION ALL ".join(f"SELECT p_partkey, '{w}' AS way, CAST(i AS INT) AS pos, {q(f'(CASE WHEN i = 0 THEN 1 ELSE -1 END * {_units(90, v[3])}) / {v[3]}e0', 6)} AS lat, {q(f'{_units(180, v[3])} / {v[3]}e0', 6)} AS lon FROM part, (VALUES (0), (1)) t(i)" for w, v in _WAYS.items()))
def coordinate_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Two places a text, written in every way among levels, routes and distances, and found again."""
    # a small file is one task to the reader, and each of its rows becomes many long texts
    p = D.table(spark, d, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    ways = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("way", "look", "front", "between", "parts"), (w, *v), strict=True))) for w, v in _WAYS.items()))
    rows = p.select("p_partkey", F.inline(ways)).withColumns({"lat": F.expr(_units(90, "parts")), "lon": F.expr(_units(180, "parts"))})
    rows = rows.withColumns({"n": _written(F.col("lat"), 2, "NS"), "s": _written(-F.col("lat"), 2, "NS"), "e": _written(F.col("lon"), 3, "EW")})
    rows = rows.withColumn("t", F.concat(F.lit("UN123 FL 245 WEST 12 NM (TOR) "), "n", "between", "e", F.lit("\nR7 12.5 NM 090°/270° SOUTHERN "), "s", "between", "e", F.lit(" 5000 FT, B12")))
    found = rows.select("p_partkey", "way", F.posexplode(angles.pairs(F.col("t"))).alias("pos", "place"))
    return found.select("p_partkey", "way", "pos", geo.quantise(F.col("place.lat"), 6).alias("lat"), geo.quantise(F.col("place.lon"), 6).alias("lon"))


@query("SELECT page_id, i AS pos, regexp_extract(a, '<a href=\"([^\"]*)\"', 1) AS href, regexp_replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&', 'g') AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>'), 1) AS i FROM pages)")
def html_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of pages with their text, by pattern; wayfare.sources.html parses nested ones."""
    tag = r'<a href="([^"]*)">([^<]*)</a>'
    p = D.table(spark, d, "pages")
    z = F.arrays_zip(F.regexp_extract_all("html", F.lit(tag), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(tag), F.lit(2)).alias("label"))
    rows = p.select("page_id", F.posexplode(z).alias("i", "a"))
    return rows.select("page_id", (F.col("i") + 1).cast("bigint").alias("pos"), F.col("a.href").alias("href"), F.replace("a.label", F.lit("&amp;"), F.lit("&")).alias("label"))


_TYPES = ["Boeing 737-800", "B77W", "A21N", "787 Dreamliner", "Airbus A350-900", "A388", "crj-900", "DC-3"]


@query("WITH t AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['Boeing 737-800', 'B77W', 'A21N', '787 Dreamliner', 'Airbus A350-900', 'A388', 'crj-900', 'DC-3']) AS raw), n AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest(['B737', 'B777', 'A321', 'B787', 'A350', 'A380', 'CRJ900', 'DC3']) AS family) SELECT p_partkey, family FROM part JOIN n ON i = p_partkey % 8 JOIN t USING (i)")
def aircraft_type_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Aircraft families of untidy type names."""
    raw = F.array(*(F.lit(x) for x in _TYPES))
    return D.table(spark, d, "part").select("p_partkey", text.aircraft_type(F.get(raw, (F.col("p_partkey") % 8).cast("int"))).alias("family"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, len(string_split(text, chr(10))) AS n_lines, sha256(upper(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), 'ß', 'SS'))) AS upper_sha256 FROM documents")
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = D.table(spark, d, "documents")
    return t.select("doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("n_words"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.sha2(text.normalise_ident(F.col("text")), 256).alias("upper_sha256"))


_KINDS = ["flightTakeoff", "flightTopOfDescent", "flightLanding", "quickGps"]


@query("SELECT event_id, ['takeoff', 'topOfDescent', 'landing', 'cruise'][event_id % 4 + 1] AS kind, ['flight Takeoff', 'flight Top Of Descent', 'flight Landing', 'quick Gps'][event_id % 4 + 1] AS words, CAST(event_id * 37 % 100000 // 3600 AS VARCHAR) || 'h' AS hours FROM events")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and readable names of event types."""
    k = F.get(F.array(*(F.lit(x) for x in _KINDS)), (F.col("event_id") % 4).cast("int"))
    return D.table(spark, d, "events").select("event_id", text.event_kind(k).alias("kind"), text.camel_words(k).alias("words"), F.concat(F.floor(F.col("event_id") * 37 % 100000 / 3600).cast("string"), F.lit("h")).alias("hours"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS file, regexp_matches(lower(left(html, 4096)), 'captcha|radware|bot-protection') AS wall FROM (SELECT page_id, url, CASE page_id % 9 WHEN 1 THEN '<title>RadWare</title>' WHEN 2 THEN 'Bot-Protection' WHEN 3 THEN 'access denied' ELSE '' END || html AS html FROM pages)")
def page_files(spark: SparkSession, d: str) -> DataFrame:
    """File names of pages, and whether they are bot walls."""
    k = F.col("page_id") % 9
    mark = F.when(k == 1, "<title>RadWare</title>").when(k == 2, "Bot-Protection").when(k == 3, "access denied").otherwise("")
    p = D.table(spark, d, "pages").withColumn("html", F.concat(mark, "html"))
    return p.select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)).alias("host"), text.file_name(F.col("url")).alias("file"), text.is_bot_wall(F.col("html")).alias("wall"))
