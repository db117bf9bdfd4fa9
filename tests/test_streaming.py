"""Streams give the rows that the batch operators give, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from wayfare.operators import live
from wayfare.plans import domain as D
from wayfare.streaming import positions as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    """Points in files by order of arrival, as a batch table and as a folder to stream from."""
    path = str(tmp_path_factory.mktemp("points") / "p")
    p = D.points(spark, SF).select(F.col("journey").cast("string").alias("journey"), "ord", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon", "alt", "course", "speed", "accuracy", "source")
    cuts = [0, *(int(x) for x in p.approxQuantile("ord", [0.33, 0.66], 0.01)), 1 << 60]
    for lo, hi in zip(cuts, cuts[1:], strict=False):  # one file after the other, the order in which they are streamed
        p.where((F.col("ord") >= lo) & (F.col("ord") < hi)).coalesce(1).sortWithinPartitions("ord").write.mode("append").parquet(path)
    return spark.read.parquet(path), path


def run(spark, path, build, tmp_path, schema=S.POINT):
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_late(spark, points, tmp_path):
    batch, path = points
    late = lambda x: x.withColumn("ts", F.expr("timestamp_micros(unix_micros(ts) - (ord % 7) * 7200000000)"))
    got = run(spark, path, lambda s: S.drop_late(late(s)).select("journey", "ord"), tmp_path)
    same(got, live.drop_late(late(batch), ["ord"]).select("journey", "ord"))
    assert 0 < got.count() < batch.count()


def test_thinning(spark, points, tmp_path):
    batch, path = points
    same(run(spark, path, S.thin, tmp_path), live.thin(batch))


def test_recorder(spark, points, tmp_path):
    batch, path = points
    signals = lambda x: x.select("journey", "ord", "ts", (F.col("ord") * 101 % 4000).cast("double").alias("home_m"), (F.col("speed") - 10).alias("speed"))
    same(run(spark, path, lambda s: S.recorder_states(signals(s)), tmp_path), live.recorder_states(signals(batch)))


def test_buffer(spark, points, tmp_path):
    batch, path = points
    got = run(spark, path, lambda s: S.recent(s, 3), tmp_path)
    kept = got.join(got.where("dropped IS NOT NULL").select("journey", F.col("dropped").alias("ord")), ["journey", "ord"], "left_anti")
    same(kept.select("journey", "ord"), live.recent(batch, 3).select("journey", "ord"))


def test_notices_and_trips(spark, points, tmp_path):
    batch, path = points
    noted = lambda x: x.withColumn("storage_left", F.col("ord") * 7919 % 1000 * 1_000_000)
    (tmp_path / "a").mkdir()
    got = run(spark, path, lambda s: S.notices_once(noted(s), ["journey"], "60 days").select("journey", "id"), tmp_path / "a")
    same(got, live.notifications(noted(batch), ["journey"]).select("journey", "id"))
    (tmp_path / "b").mkdir()
    trips = run(spark, path, lambda s: S.trips(s, "2 hours", "0 seconds"), tmp_path / "b")
    assert 0 < trips.count() <= batch.count()  # trips still open at the end are not out yet


def test_messages(spark, tmp_path):
    good = '{"timestamp":"2026-07-10T02:15:00Z","latitude":25.0,"longitude":121.0,"horizontalAccuracyMeters":10,"courseDegrees":-90,"source":"gps"}'
    texts = ['{"type":"location.update","payload":%s}' % good, '{"type":"location.update","payload":%s}' % __import__("json").dumps(good), "no json", '{"type":"other","payload":{}}', '{"type":"location.update","payload":%s}' % good.replace("25.0", "95.0"), '{"type":"location.update","payload":%s}' % good.replace(":10", ":600")]
    spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "journey string, ord long, value string").write.parquet(str(tmp_path / "in"))
    got = run(spark, str(tmp_path / "in"), S.positions, tmp_path, "journey string, ord long, value string")
    assert sorted((r.journey, r.lat, r.course) for r in got.collect()) == [("0", 25.0, 270.0), ("1", 25.0, 270.0)]


def test_upserts(spark, tmp_path):
    merge, at = S.upsert_batches(str(tmp_path / "t"), ["k"], "v"), str(tmp_path / "t")
    x = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert S.latest(spark, at) is None
    merge(x([("a", 1), ("a", 2), ("b", 1)]), 0)
    merge(x([("b", 5), ("c", 1)]), 1)
    merge(x([("b", 5), ("c", 1)]), 1)  # the same batch again
    assert sorted(map(tuple, S.latest(spark, at).collect())) == [("a", 2), ("b", 5), ("c", 1)]


def test_gaps(spark):
    rows = [("a", 0, 25.0, 121.0, 90.0, 10.0), ("b", 60, 25.0, 121.0, 90.0, 10.0), ("c", 60, 25.0, 121.0, 90.0, 0.1), ("d", 600, 25.0, 121.0, 90.0, 10.0)]
    t = spark.createDataFrame(rows, "journey string, s int, lat double, lon double, course double, speed double").select("*", F.timestamp_seconds(F.lit(1000)).alias("received"), F.timestamp_seconds(F.col("s") + 1000).alias("tick"))
    got = {r.journey: (r.status, round(r.est_lon, 4)) for r in S.gap_states(t).collect()}
    assert got == {"a": ("live", 121.0), "b": ("estimated", 121.006), "c": ("lost", 121.0), "d": ("lost", 121.0)}
