"""Line deduplication by site-relative frequency, with DataFrame functions only.

Lines are grouped by host. The pages of a host that contain a line, divided by all pages of the host,
tell boilerplate (menus, licence lines, footers) from text; boilerplate lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A boilerplate table of at most so many rows (48 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
SALTS = 32


def host_of(url: Column) -> Column:
    """Host of a URL, lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def line_key(line: Column) -> Column:
    """What identifies a line: its trimmed characters."""
    return F.trim(F.regexp_replace(line, r"[\x09-\x0D]", " "))


def _hashes(line: Column) -> Column:
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def boilerplate_lines(pages: DataFrame, host: str, lines: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines that over ratio of a host's pages contain.

    lines: an array column of 128-bit line hashes. A page counts once for each of its distinct lines.
    Both counts are partially aggregated before they are shuffled, so no task gathers a host.
    """
    per_line = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(lines)).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    per_host = pages.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    joined = per_line.alias("l").join(per_host.alias("h"), F.col("l.host").eqNullSafe(F.col("h.host"))).select("l.host", "line", "n_pages", "host_pages")
    return joined.where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """docs with boilerplate lines cut from its text, and the columns n_lines and n_dropped.

    Lines end at \\n and are compared without surrounding white space. A line is boilerplate of its host
    where more than ratio of the host's pages, and at least min_pages of them, contain it; every
    occurrence goes. Blank lines stay. Null texts stay null, empty ones empty; a null host is a host of
    its own; repeated rows count as pages of their own; an empty table stays empty.
    """
    old = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    rows = docs.select(*old).withColumn("__host", host).withColumn("__id", F.monotonically_increasing_id())
    split = F.split(F.col(text_col), "\n", -1)
    solid = F.filter(split, lambda x: line_key(x) != "")
    found = boilerplate_lines(rows.withColumn("__lines", F.transform(solid, _hashes)), "__host", "__lines", ratio, min_pages)
    found = materialize(found.select("host", "line"), "boilerplate")
    per_host = found.groupBy("host").agg(F.collect_list("line").alias("__bad")).withColumnRenamed("host", "__bad_host")
    if found.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(per_host), F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    else:
        # a host's boilerplate holds at most 1 / ratio times the lines of a page; hosts are salted since one may hold a third of all pages
        salts = per_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__of", F.pmod(F.col("__id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(salts, F.col("__host").eqNullSafe(F.col("__bad_host")) & (F.col("__of") == F.col("__salt")), "left").drop("__salt", "__of")
    kept = F.filter(split, lambda x: (line_key(x) == "") | ~F.array_contains("__bad", _hashes(x)))
    has = F.col("__bad").isNotNull()
    joined = joined.withColumn("__kept", F.when(has & F.col(text_col).isNotNull(), kept))
    n_lines = F.coalesce(F.size(split), F.lit(0)).cast("long")
    n_dropped = F.when(F.col("__kept").isNull(), 0).otherwise(F.size(split) - F.size("__kept")).cast("long")
    text = F.when(F.col("__kept").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    return joined.withColumn("__n", n_lines).withColumn("__d", n_dropped).withColumn("__t", text).select(
        *(F.col("__t").alias(c) if c == text_col else F.col(c) for c in old), F.col("__n").alias("n_lines"), F.col("__d").alias("n_dropped")
    )
