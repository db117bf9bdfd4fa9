"""Queries over what leaves the engine in steps: swapped revisions, public packs, the outbound queue."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.tables import materialize
from ..sinks import lifecycle, packs, public_pack, versions
from ..streaming import outbox
from . import domain as D
from .domain import sql
from .files import _canonical, _stream, scratch


@query(sql("""SELECT 'held' AS seen, country, CAST(count(*) AS BIGINT) AS n FROM nav_points WHERE source_id = 'src0' GROUP BY ALL UNION ALL SELECT 'after failure', country, count(*) FROM nav_points WHERE source_id = 'src0' GROUP BY ALL
UNION ALL SELECT 'after refusal', country, count(*) FROM nav_points WHERE source_id = 'src0' GROUP BY ALL UNION ALL SELECT 'after swap', country, count(*) FROM nav_points GROUP BY ALL""", "nav_points"))
def pack_staged_swap(spark: SparkSession, d: str) -> DataFrame:
    """Points by country as readers see them: one that opened the first revision before the swap, and ones that came after a stage that broke off, a refused one and a swap."""
    root = scratch(spark, "revisions")
    p = D.nav_points(spark, d).select("uid", "country", "source_id", "lat")
    read = lambda: spark.read.schema(p.schema).parquet(versions.current(spark, root))
    seen = lambda name, df: df.groupBy(F.lit(name).alias("seen"), "country").agg(F.count("*").alias("n"))
    versions.refresh(spark, root, "r1", lambda: p.where("source_id = 'src0'"), "staged")
    held = read()
    broken = p.withColumn("uid", F.when(F.col("uid") % 50 == 7, F.raise_error(F.lit("a source that breaks off"))).otherwise(F.col("uid")))
    parts = []
    for name, rows, checks in (("after failure", broken, None), ("after refusal", p, {"northern": F.col("lat") > 0})):
        try:
            versions.refresh(spark, root, name.replace(" ", "-"), lambda rows=rows: rows, "staged", checks)
        except Exception:  # noqa: BLE001  what readers see afterwards is the point
            parts.append(seen(name, read()))
    versions.refresh(spark, root, "r2", lambda: p, "staged")
    out = seen("held", held)
    for x in (*parts, seen("after swap", read())):
        out = out.unionByName(x)
    return out


@query(sql("""WITH ends AS (SELECT s.* FROM segments s JOIN nav_points a ON a.uid = s.src JOIN nav_points b ON b.uid = s.dst WHERE a.source_id = 'src0' AND b.source_id = 'src0'), n AS (SELECT (SELECT count(*) FROM nav_points WHERE source_id = 'src0') AS p, (SELECT count(*) FROM orders) AS w, (SELECT count(*) FROM ends) AS s, (SELECT count(*) FROM nav_points WHERE source_id = 'src1') AS other, (SELECT count(*) FROM airports) AS a)
SELECT 'manifest' AS file, unnest(['points', 'airways', 'segments', 'airports']) AS key, unnest([p, w, s, 0]) AS n FROM n UNION ALL SELECT 'coverage', unnest(['points', 'airways', 'segments', 'airports']), unnest([p, w, s, 0]) FROM n UNION ALL SELECT 'validation', unnest(['points', 'airways', 'segments']), unnest([p, w, s]) FROM n
UNION ALL SELECT 'files', unnest(['points', 'airways', 'segments']), unnest([p, w, s]) FROM n UNION ALL SELECT 'refused', 'onlySourcePoints', other FROM n UNION ALL SELECT 'refused', 'noMixedAirportRows', a FROM n""", "nav_points", "segments", "airports"))
def public_pack_files(spark: SparkSession, d: str) -> DataFrame:
    """What the papers of a public pack count, what its files hold, and why a pack of mixed sources is refused in its place."""
    root = scratch(spark, "public")
    about = public_pack.About("airgraph", "1", "src0", "public", "GPL-2.0-or-later", "GNU General Public License version 2", "open navigation data", notices={"NOTICE.txt": "Derived from open data.\n"})
    sources = spark.createDataFrame([("src0", "public", True), ("src1", "public", True)], "source_id string, status string, bundle boolean")
    t = _canonical(spark, d)
    t = t._replace(segments=materialize(t.segments, "pack-segments"))  # two packs are made of them
    lines = packs.pack_rows(t, sources.where("source_id = 'src0'"), None)
    public_pack.publish(materialize(lines, "pack-lines"), root, about, "2024-01-01T00:00:00Z")
    try:
        public_pack.publish(materialize(packs.pack_rows(t, sources, None), "pack-lines"), root, about, "2024-01-02T00:00:00Z")
        refused = {}
    except versions.Refused as e:
        refused = e.rows
    path = versions.current(spark, root)
    paper = lambda name: json.loads(versions.read_file(spark, f"{path}/{name}"))
    counted = {"manifest": paper(public_pack.MANIFEST)["regions"][0], "coverage": paper(public_pack.COVERAGE)["regions"][public_pack.REGION], "validation": paper(public_pack.VALIDATION)["checks"], "refused": refused}
    rows = [(f, k, n) for f, c in counted.items() for k, n in c.items() if type(n) is int]
    held = spark.read.schema("value string, part string").option("pathGlobFilter", "*.gz").text(path).groupBy(F.lit("files").alias("file"), F.col("part").alias("key")).agg(F.count("*").alias("n"))
    return spark.createDataFrame(rows, "file string, key string, n long").unionByName(held)


def _messages(e: DataFrame) -> DataFrame:
    """Every event as a message; two of three are acknowledged, after 90 seconds or 10 minutes."""
    k = F.col("event_id")
    later = F.when(k % 3 == 0, 90).when(k % 3 == 1, 600)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    sent = F.struct(F.lit("message").alias("kind"), F.col("event_type").alias("payload"), F.timestamp_micros(us).alias("ts"))
    back = F.when(later.isNotNull(), F.struct(F.lit("ack").alias("kind"), F.lit(None).cast("string").alias("payload"), F.timestamp_micros(us + later * 1_000_000).alias("ts")))
    return e.select(F.col("user_id").cast("string").alias("session"), k.alias("id"), F.inline(F.array_compact(F.array(sent, back))))


_ATTEMPTS = """m AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS id, event_type AS payload, epoch_us(ts) AS t, CASE event_id % 3 WHEN 0 THEN 90000000 WHEN 1 THEN 600000000 END AS wait FROM events),
w AS (SELECT max(t + coalesce(wait, 0)) // 1000 * 1000 - 600000000 AS mark FROM m), s AS (SELECT session, max(t + coalesce(wait, 0)) AS last FROM m GROUP BY 1),
a AS (SELECT session, id, CAST(k AS INT) AS attempt, CASE WHEN k > 5 THEN 'dead' ELSE 'sent' END AS status, t + 60000000 * ((1 << CAST(k - 1 AS INT)) - 1) AS at_us, payload FROM m JOIN s USING (session), w, range(1, 7) r(k)
WHERE (wait IS NULL OR 60000000 * ((1 << CAST(k - 1 AS INT)) - 1) < wait) AND (k = 1 OR t + 60000000 * ((1 << CAST(k - 1 AS INT)) - 1) < greatest(last, mark)))"""


def _outbox(spark: SparkSession, d: str) -> str:
    return _stream(spark, d, lambda e: outbox.attempts(_messages(e)), outbox.ledger) + "/table"


@query(f"WITH {_ATTEMPTS} SELECT session, id, attempt, status, CAST(at_us AS BIGINT) AS at_us FROM a")
def outbox_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Every sending of a stream of messages: those without an acknowledgement come again after one minute, two, four, eight."""
    return outbox.ledger_rows(spark, _outbox(spark, d)).select("session", "id", "attempt", "status", "at_us")


@query(f"WITH {_ATTEMPTS} SELECT session, id, payload, max(attempt) AS tries, CAST(min(at_us) AS BIGINT) AS at_us FROM a WHERE status = 'sent' GROUP BY session, id, payload")
def outbox_delivered(spark: SparkSession, d: str) -> DataFrame:
    """Each message of a stream once."""
    return outbox.delivered(spark, _outbox(spark, d))


@query("""SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 = 2 THEN CAST(s_nationkey AS VARCHAR) ELSE 'unknown' END AS note, CASE WHEN s_suppkey % 3 = 0 THEN length(s_name) ELSE CAST(floor(s_acctbal) AS BIGINT) END AS size FROM supplier""")
def migrated_table(spark: SparkSession, d: str) -> DataFrame:
    """A table of three versions, each with a column more, read as the newest; a row of the first gets its size from its name."""
    path = scratch(spark, "versions")
    added = [lifecycle.Added(2, "size", "long", F.length("name")), lifecycle.Added(3, "note", "string", F.lit("unknown"))]
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.floor("s_acctbal").cast("long").alias("size"), F.col("s_nationkey").cast("string").alias("note"))
    for version, columns in ((1, ["k", "name"]), (2, ["k", "name", "size"]), (3, ["k", "name", "size", "note"])):
        lifecycle.append(s.where(F.col("k") % 3 == version - 1).select(*columns), path, version)
    return lifecycle.read(spark, path, "k long, name string", added).select("k", "name", "note", "size")


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 0), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 1 AS step, 'lineitem' AS name, count(*) AS stay FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT 2, 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o) UNION ALL SELECT 3, 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)""")
def cascaded_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays in each table, in the order of deletion, as some customers go with all that belongs to them."""
    columns = {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"]}
    tables = {n: D.table(spark, d, n).select(*c) for n, c in columns.items()}
    references = [lifecycle.Reference("orders", "o_custkey", "customer", "c_custkey"), lifecycle.Reference("lineitem", "l_orderkey", "orders", "o_orderkey"), lifecycle.Reference("customer", "c_nationkey", "nation", "n_nationkey")]
    out = None
    for step, (name, rows) in enumerate(lifecycle.cascade(tables, references, "customer", F.col("c_nationkey") % 5 == 0), 1):
        n = rows.agg(F.count("*").alias("stay")).select(F.lit(step).alias("step"), F.lit(name).alias("name"), "stay")
        out = n if out is None else out.unionByName(n)
    return out
