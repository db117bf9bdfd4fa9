"""Cell joins at size: nothing that was put in many cells is broadcast, and places that share a spot change no result."""

from pyspark.sql import functions as F

from wayfare import catalog
from wayfare.functions import geo
from wayfare.operators import grid


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    p = spark.range(40).select(F.col("id").alias("ord"), (F.col("id") * 1.7 - 30).alias("lat"), (F.col("id") * 3.1 - 60).alias("lon"), F.lit(10.0).alias("heading"))
    q = spark.range(600).select(F.col("id").alias("place"), (F.col("id") % 50 * 1.3 - 30).alias("plat"), (F.col("id") % 50 * 2.9 - 60).alias("plon"), F.when(F.col("id") % 3 == 0, "airport").otherwise("landmark").alias("kind"), (F.col("id") % 7 / 7.0).alias("importance"))
    return p, q


def test_no_broadcast_of_cells(spark):
    p, q = _rows(spark)
    m = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    near = _plan(grid.distance_join(p, q.withColumnsRenamed({"plat": "lat", "plon": "lon"}), 450.0))
    assert "SortMergeJoin" in near and "BroadcastExchange" not in near
    assert "SortMergeJoin [pr" in _plan(grid.ring_nearest(p, q, "ord", "place", m))
    assert "SortMergeJoin" in _plan(grid.route_places(p.withColumnRenamed("ord", "journey"), q, "journey", "place", 650_000.0))


def test_places_at_one_spot(spark):
    p, q = _rows(spark)
    pairs = p.crossJoin(q).withColumn("m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
    score = geo.quantise(geo.proximity_score(F.col("m"), F.col("kind"), F.col("importance")), 2)
    every = {}
    for r in pairs.select("ord", score.alias("score"), "place").collect():
        every.setdefault(r.ord, []).append((r.score, r.place))
    for n in (1, 3):
        got = {(r.ord, r.rank): r.place for r in grid.nearest_scored(p, q, "ord", "place", n).collect()}
        assert got == {(o, i + 1): place for o, found in every.items() for i, (_, place) in enumerate(sorted(found)[:n])}


def test_texts_in_many_tasks(spark):
    df = catalog.QUERIES["coordinate_dialects"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
