import math
import random

from wayfare.operators import grid

EARTH_M = 6_371_008.8


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def test_places_near_routes_equal_a_plain_search(spark):
    """Samples at every latitude, on edges of cells and at the ends of the grid; places all around them."""
    rnd = random.Random(5)
    samples = [(i % 7, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(80)]
    samples += [(7, 0.0, 0.0), (7, 5.0, 5.0), (7, 84.99, 10.0), (8, 89.9, -179.9), (8, -90.0, 179.9), (8, 4.999, -175.0)] * 2
    places = []
    for _, lat, lon in samples:
        for _ in range(25):
            places.append((len(places), max(-90.0, min(90.0, lat + rnd.uniform(-7, 7))), max(-180.0, min(179.999, lon + rnd.uniform(-13, 13)))))
    row = lambda x: min(35, math.floor((x + 90) / 5))
    col = lambda x: min(71, math.floor((x + 180) / 5))
    want = {
        (k, p)
        for k, a, b in samples
        for p, c, d in places
        if abs(row(a) - row(c)) <= 2 and abs(col(b) - col(d)) <= 2 and metres(a, b, c, d) <= 650_000
    }
    s = spark.createDataFrame(samples, "k int, lat double, lon double")
    p = spark.createDataFrame(places, "p int, plat double, plon double")
    got = grid.route_places(s, p, "k", "p", 650_000.0).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and want


def test_routes_and_places_in_parts(spark, monkeypatch):
    """Crowded cells are several groups; places at one spot, named twice, without a place, just within and just beyond the limit."""
    monkeypatch.setattr(grid, "_PLACES_AT_ONCE", 20)
    monkeypatch.setattr(grid, "_SAMPLES_AT_ONCE", 15)
    rnd = random.Random(7)
    samples = [(f"r{i % 9}", rnd.uniform(1, 9), rnd.uniform(1, 9)) for i in range(90)] + [(None, 3.0, 3.0), ("r1", None, 3.0), ("r2", float("nan"), 3.0)]
    places = [(i, rnd.uniform(-6, 14), rnd.uniform(-6, 14)) for i in range(150)]
    places += [(200 + i, *places[i][1:]) for i in range(60)] + [(300, None, 3.0), (301, 3.0, float("nan"))]
    places += [(400 + i, 3.0 + math.degrees((300_000 + off) / EARTH_M), 3.0) for i, off in enumerate((-1e-3, 1e-3))] + [(0, 3.0, 3.0)]
    whole = lambda *x: all(v is not None and not math.isnan(v) for v in x)
    want = {(k, p) for k, a, b in samples for p, c, d in places if whole(a, b, c, d) and metres(a, b, c, d) <= 300_000}
    s, p = spark.createDataFrame(samples, "k string, lat double, lon double"), spark.createDataFrame(places, "p int, plat double, plon double")
    got = [tuple(r) for r in grid.route_places(s, p, "k", "p", 300_000.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(None, 400)} <= want and (None, 401) not in want


def test_samples_of_a_route_travel_together(spark):
    """Places meet all samples of a route at once, so there is a row for a route and a cell, not for each sample and place."""
    s = spark.range(400).selectExpr("id % 4 AS k", "1 + id % 100 / 100.0D AS lat", "1 + id % 100 / 100.0D AS lon")
    p = spark.range(300).selectExpr("id AS p", "1.5D + id / 1000.0D AS plat", "1.5D AS plon")
    plan = grid.route_places(s, p, "k", "p", 650_000.0)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan.split("FlatMapGroupsInArrow")[0]
