import gzip
import hashlib
import io
import json
import zipfile

from pyspark.sql import functions as F

from wayfare.sinks import documents, packs
from wayfare.sources import fixed_width


def dataset(spark):
    lines = ["APT|ZZAA|AAA|First, \"x\"|400000N 1000000W|US", "FIX|ALPHA|A|400000N 1000000W|US|F", "FIX|BRAVO|B|410000N 1000000W|US|F", "FIX|CANAD|B|420000N 1000000W|CA|F", "AIRWAY|V1|1|ALPHA|US|F", "AIRWAY|V1|2|BRAVO|US|F", "AIRWAY|V1|3|CANAD|US|F"]
    return fixed_width.piped(spark.createDataFrame(list(enumerate(lines, 1)), "ord int, line string"), "s")


def test_pack(spark, tmp_path):
    t = dataset(spark)
    sources = spark.createDataFrame([("s", "public", True)], "source_id string, status string, bundle boolean")
    rows = packs.pack_rows(t, sources, ["US"])
    docs = {r.part: r for r in packs.documents(rows).collect()}
    assert json.loads(docs["points"].document) == [["ALPHA", 40.0, -100.0, "FIX", "s"], ["BRAVO", 41.0, -100.0, "FIX", "s"]]
    assert json.loads(docs["segments"].document) == [[0, 1, 0, 60.04, ""]]
    assert json.loads(docs["airways"].document) == [["V1", "ENROUTE", "s"]]
    assert json.loads(docs["airports"].document) == [["ZZAA", "AAA", 'First, "x"', 40.0, -100.0, "US"]]
    assert gzip.decompress(docs["points"].gzipped).decode() == docs["points"].document and hashlib.sha256(docs["points"].gzipped).hexdigest() == docs["points"].sha256
    manifest = {r.part: r.n for r in packs.write_pack(rows, str(tmp_path / "pack")).collect()}
    assert manifest == {"points": 2, "segments": 1, "airways": 1, "airports": 1}
    assert spark.read.text(str(tmp_path / "pack")).where("part = 'points'").count() == 2
    private = spark.createDataFrame([("s", "private", True)], "source_id string, status string, bundle boolean")
    assert packs.pack_rows(t, private, ["US"]).count() == 0 and packs.pack_rows(t, private, None, private=True).count() == 7


def test_archives(spark):
    files = spark.createDataFrame([("j", "b.json", "{}"), ("j", "a.txt", "é"), ("k", "a.txt", "")], "journey string, name string, content string")
    got = {r.journey: zipfile.ZipFile(io.BytesIO(r.archive)) for r in packs.archives(files).collect()}
    assert got["j"].namelist() == ["a.txt", "b.json"] and got["j"].read("a.txt").decode() == "é" and got["j"].testzip() is None
    assert all(m.compress_type == zipfile.ZIP_STORED for m in got["j"].infolist())


def test_tables(spark, tmp_path):
    x = lambda rows: spark.createDataFrame(rows, "k string, v int, w int")
    old = packs.write_keyed(x([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]), str(tmp_path / "a"), ["k"], "v")
    new = packs.write_keyed(x([("b", 3, 3)]), str(tmp_path / "b"), ["k"], "v", old)
    assert sorted(map(tuple, new.collect())) == [("a", 2, 2), ("b", 3, 3)]
    saved = packs.save_metadata(x([("a", 1, 1), ("b", 1, 1)]), x([("a", None, 5), ("c", 7, None)]), "k")
    assert sorted(map(tuple, saved.collect())) == [("a", 1, 5), ("b", 1, 1), ("c", 7, None)]
    packs.write_partitioned(x([("a", 1, 1), ("b", 1, 1)]), str(tmp_path / "p"), "k")
    packs.write_partitioned(x([("b", 2, 2)]), str(tmp_path / "p"), "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", 1), ("b", 2)]


def test_gpx_and_kml(spark):
    import xml.etree.ElementTree as ET

    p = spark.createDataFrame([("j", 1, "2026-07-10 02:15:00", 25.0, 121.0, 40.0), ("j", 2, "2026-07-10 02:16:00", 25.1, 121.1, None)], "journey string, ord int, ts string, lat double, lon double, alt double").withColumn("ts", F.to_timestamp("ts"))
    titles = spark.createDataFrame([("j", "A & <B>")], "journey string, title string")
    text = documents.gpx(p, p.limit(1).withColumn("title", F.lit("x>y")), titles).first().gpx
    root = ET.fromstring(text)
    ns = {"g": "http://www.topografix.com/GPX/1/1"}
    assert len(root.findall(".//g:trkpt", ns)) == 2 and root.find(".//g:metadata/g:name", ns).text == "A & <B>" and root.find(".//g:wpt/g:name", ns).text == "x>y"
    line = ET.fromstring(documents.kml(p, titles).first().kml).find(".//{http://www.opengis.net/kml/2.2}coordinates").text
    assert line == "121.00000,25.00000,40.0 121.10000,25.10000,0.0"


def test_lines_of_files_keep_their_ids(spark, tmp_path):
    """Several files a part, more lines than an Arrow batch holds, parts behind each other in a task."""
    n = {"points": 25_000, "airways": 11}
    lines = spark.createDataFrame([(p, i, json.dumps([str(i)] * packs.SHAPES[p])) for p, k in n.items() for i in range(k)], "part string, idx long, json string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a file for each range
    try:
        manifest = {r.part: (r.n, r.sha256) for r in packs.write_pack(lines.repartition(3), str(tmp_path / "pack")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(list((tmp_path / "pack" / "part=points").glob("*.gz"))) > 1
    got = packs.read_pack(spark, str(tmp_path / "pack"))
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == n
    assert got.where("fields[0] <> idx").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # a place takes no sort of all lines
    for p, k in n.items():
        block = lambda i: hashlib.sha256("".join(hashlib.sha256(json.dumps([str(j)] * packs.SHAPES[p]).encode()).hexdigest() for j in range(i, min(i + 4096, k))).encode()).hexdigest()  # noqa: B023, E731
        assert manifest[p] == (k, hashlib.sha256("".join(block(i) for i in range(0, k, 4096)).encode()).hexdigest())


def test_ids_take_one_sort(spark):
    """Dense ids come from places in a range that is written sorted: no window sorts the rows again."""
    from wayfare.operators.rows import dense_index

    rows = dense_index(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5), ["k"])
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert rows.where("k <> idx").count() == 0 and rows.count() == 1000
