"""Distance joins on a sphere: candidates by grid cells, then the exact distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tables import materialize


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a join b by cells, in all shuffle partitions and without a broadcast: small files become many pairs, so their sizes say nothing."""
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys, how)


def distance_join(left: DataFrame, right: DataFrame, nm: float, lat: str = "lat", lon: str = "lon", how: str = "inner") -> DataFrame:
    """Pairs of rows within nm nautical miles, with dist_nm; or the rows of left with a partner (how='left_semi').

    Columns of right other than its coordinates must not clash with left's. Both sides get cells of a
    height just over the radius; the right side is put in its own and the neighbouring ones. Columns of
    cells wrap around the antimeridian and widen with latitude, up to a single one at the poles.
    Neither side is broadcast, since a small file may become many rows of cells.
    """
    height = nm / 60.0 * 1.0005 + 1e-9

    def cols(row):
        # columns of a band of cells: as many as fit at its edge nearer the pole, two bands on
        edge = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * height - 90.0), F.abs((row + 2) * height - 90.0)))
        return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / (height * 1.01))).cast("int")

    def cell(row, lon_):
        n = cols(row)
        return F.pmod(F.floor((lon_ + 180.0) / (360.0 / n)).cast("int"), n)

    mine = left.withColumn("__row", F.floor((F.col(lat) + 90.0) / height).cast("int")).withColumn("__col", cell(F.col("__row"), F.col(lon)))
    other = right.withColumnsRenamed({lat: "__lat", lon: "__lon"})
    own = F.floor((F.col("__lat") + 90.0) / height).cast("int")
    other = other.withColumn("__row", F.explode(F.sequence(own - 1, own + 1)))
    here, n = cell(F.col("__row"), F.col("__lon")), cols(F.col("__row"))
    other = other.withColumn("__col", F.explode(F.array_distinct(F.array(*(F.pmod(here + k, n) for k in (-1, 0, 1))))))
    d = geo.haversine_nm(F.col(lat), F.col(lon), F.col("__lat"), F.col("__lon"))
    if how == "left_semi":
        m, o = mine.alias("m"), other.alias("o")
        on = (F.col("m.__row") == F.col("o.__row")) & (F.col("m.__col") == F.col("o.__col")) & (geo.haversine_nm(F.col(f"m.{lat}"), F.col(f"m.{lon}"), F.col("o.__lat"), F.col("o.__lon")) <= nm)
        return m.join(o.hint("merge"), on, "left_semi").drop("__row", "__col")
    joined = _met(mine, other, ["__row", "__col"]).withColumn("dist_nm", d).where(F.col("dist_nm") <= nm)
    return joined.drop("__row", "__col", "__lat", "__lon")


def cell_size(places: DataFrame, k: int, metres: float = 0.0) -> float:
    """Height in degrees of cells that hold about k places on average over the box of all places and are at least so many metres high, a whole part of 180."""
    box = places.agg(F.count("*").alias("n"), F.min("plat").alias("s"), F.max("plat").alias("n_"), F.min("plon").alias("w"), F.max("plon").alias("e")).first()
    area = max((box.n_ or 0) - (box.s or 0), 1.0) * max((box.e or 0) - (box.w or 0), 1.0)
    rows = math.ceil(180.0 / min(15.0, max(0.02, math.degrees(metres / geo.EARTH_M), math.sqrt(k * area / max(box.n, 1)))))
    while 180.0 / (180.0 / rows) != rows or 360.0 / (180.0 / rows) != 2 * rows:  # the cells' numbers must come out whole
        rows += 1
    return 180.0 / rows


def _in_rings(points: DataFrame, places: DataFrame, within: list[str], degrees: float, rings: int, spread: str) -> DataFrame:
    """Pairs of points and places (plat, plon) whose cells are at most so many rings apart, with dist_m; within: columns that both share and that must agree.

    spread: the side ('points' or 'places') that is put in all cells around its own. It is many rows of
    a file that may be small, so it is never broadcast.
    """
    rows, cols = round(180 / degrees), round(360 / degrees)
    span = F.sequence(F.lit(-rings), F.lit(rings))

    def celled(df: DataFrame, lat: str, lon: str, around: bool) -> DataFrame:
        row, col = geo.cell_row(F.col(lat), degrees), geo.cell_col(F.col(lon), degrees)
        if not around:
            return df.withColumn("__row", row).withColumn("__col", col)
        df = df.withColumn("__row", F.explode(F.transform(span, lambda x: row + x))).where(f"__row BETWEEN 0 AND {rows - 1}")
        return df.withColumn("__col", F.explode(F.array_distinct(F.transform(span, lambda x: F.pmod(col + x, F.lit(cols))))))

    p, q = celled(points, "lat", "lon", spread == "points"), celled(places, "plat", "plon", spread == "places")
    d = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return _met(p, q, [*within, "__row", "__col"]).withColumn("dist_m", d).drop("__row", "__col")


def _by_rings(points: DataFrame, places: DataFrame, key: str, place_key: str, k: int, score: Column, slack: float, within: list[str], degrees: float | None) -> DataFrame:
    """For each point the k places of least score (ties by place key), with rank and the columns of both sides.

    A score must be at least the distance less slack. A ring of r cells around a point reaches r *
    degrees in latitude at least, and in longitude so many metres as that spans at the farthest latitude
    of the ring; points whose k-th score is not below what the ring proves go on to a larger one, so few
    are left after the first rounds. Cells are at least as high as the slack, or no first ring would
    prove anything. The side of fewer rows is put in all cells of a ring: the pairs of a point are then
    mostly in one task, which passes on k of them. Each round is written to the shared folder.
    """
    places = materialize(places, "places")
    degrees = degrees or (5.0 if within else cell_size(places, k, slack))
    left, done, rings, most = points, None, 1, round(360 / degrees)
    n_places, n_left = places.count(), points.count()
    metre = math.pi / 180 * geo.EARTH_M
    while True:
        last_round = 2 * rings + 1 >= most
        w = Window.partitionBy(key).orderBy("score", place_key)
        found = _in_rings(left, places, within, degrees, rings, "points" if n_left < n_places else "places").withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        edge = F.least(F.lit(90.0), F.abs(F.col("lat")) + (rings + 1) * degrees)
        proof = F.lit(rings * degrees * metre) * F.cos(F.radians(edge)) * 0.99 - slack
        whole = Window.partitionBy(key)
        enough = (F.count("*").over(whole) >= k) & (F.max("score").over(whole) <= proof)
        found = found.withColumn("__done", F.lit(True) if last_round else enough)
        found = materialize(found, "rings")
        settled = found.where("__done").drop("__done")
        done = settled if done is None else done.unionByName(settled)
        if last_round:
            return done
        left = materialize(left.join(settled.select(key).distinct().hint("merge"), key, "left_anti"), "left")
        n_left = left.count()
        if not n_left:
            return done
        rings = min(rings * 3, most // 2)


def nearest_scored(points: DataFrame, places: DataFrame, key: str, place_key: str, n: int = 1, degrees: float | None = None) -> DataFrame:
    """The n places of least score for each point, with rank and the sector of the view in which each lies.

    points: key, lat, lon, heading; places: place_key, plat, plon, kind, importance (0 to 1). The score is
    the distance less a bonus by kind and importance, so no bonus is above the sum of the largest two.
    """
    score = geo.quantise(geo.proximity_score(F.col("dist_m"), F.col("kind"), F.col("importance")), 2)
    # of the places at one spot, those of clearly less bonus than n others are never named
    spot, alone = Window.partitionBy("plat", "plon"), geo.proximity_score(F.lit(0.0), F.col("kind"), F.col("importance"))
    places = places.withColumn("__alone", alone).withColumn("__nth", F.row_number().over(spot.orderBy("__alone")))
    places = places.withColumn("__most", F.max(F.when(F.col("__nth") <= n, F.col("__alone"))).over(spot)).where("coalesce(__alone <= __most + 0.02, true)").drop("__alone", "__nth", "__most")
    found = _by_rings(points, places, key, place_key, n, score, geo.MOST_BONUS_M, [], degrees)
    b = geo.bearing(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    return found.withColumn("direction", geo.window_direction(F.col("heading"), b))


def knn_exact(points: DataFrame, places: DataFrame, key: str, place_key: str, k: int, within: list[str] | None = None, degrees: float | None = None) -> DataFrame:
    """The k nearest places of each point: (key, place_key, dist_m, rank), among those that share the columns of within."""
    # of the places at one spot, only the first k count
    spot = Window.partitionBy(*(within or []), "plat", "plon").orderBy(place_key)
    places = places.withColumn("__nth", F.row_number().over(spot)).where(F.col("__nth") <= k).drop("__nth")
    found = _by_rings(points, places, key, place_key, k, geo.quantise(F.col("dist_m"), 2), 0.0, within or [], degrees)
    return found.select(*(within or []), key, place_key, F.col("score").alias("dist_m"), "rank")


#: Places and samples that meet at once in a task, and the distances worked out together.
_PLACES_AT_ONCE, _SAMPLES_AT_ONCE, _PAIRS_AT_ONCE = 4_000, 200_000, 2_000_000


def _spots(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points of the unit sphere."""
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _metres(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """As geo.haversine_m."""
    a, b, c, d = map(np.radians, (a, b, c, d))
    up, aside = np.sin((c - a) / 2), np.sin((d - b) / 2)
    h = up * up + np.cos(a) * np.cos(c) * aside * aside
    return 2 * geo.EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.abs(1 - h)))


def _met_in_cell(t: pa.Table, metres: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Routes and places of a cell, each pair once, of which a sample and the place lie within so many metres: rows of samples (key) and of places (place).

    A dot product tells most pairs; those about at the limit are measured.
    """
    of = lambda held: t.filter(pc.equal(t["held"], held)).combine_chunks()
    places, samples = of(True), of(False)
    # places at one spot are measured once
    spot, same = np.unique(np.stack([places["lat"].to_numpy(), places["lon"].to_numpy()], axis=1), axis=0, return_inverse=True)
    names = samples["key"].combine_chunks().dictionary_encode(null_encoding="encode")
    lats, lons = samples["lats"].combine_chunks(), samples["lons"].combine_chunks()
    codes = names.indices.to_numpy()[pc.list_parent_indices(lats).to_numpy()]
    order = np.argsort(codes, kind="stable")
    codes, lat, lon = codes[order], pc.list_flatten(lats).to_numpy()[order], pc.list_flatten(lons).to_numpy()[order]
    at, there = _spots(lat, lon), _spots(spot[:, 0], spot[:, 1]).T
    limit = math.cos(metres / geo.EARTH_M)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(codes)]
    step, first = max(1, _PAIRS_AT_ONCE // max(1, len(spot))), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, side="right")))
        rows = slice(starts[first], ends[last - 1])
        dots = at[rows] @ there
        near = dots > limit
        i, j = np.nonzero(np.abs(dots - limit) < 1e-12)
        near[i, j] = _metres(lat[rows][i], lon[rows][i], spot[j, 0], spot[j, 1]) <= metres
        hit = np.logical_or.reduceat(near, starts[first:last] - starts[first], axis=0)
        route, place = np.nonzero(hit[:, same.ravel()])
        yield names.dictionary.take(pa.array(codes[starts[first:last]][route])), places["place"].take(pa.array(place)).combine_chunks()
        first = last


def route_places(samples: DataFrame, places: DataFrame, key: str, place_key: str, metres: float, degrees: float = 5.0) -> DataFrame:
    """(key, place_key) of the places within so many metres of any sampled point of a route, among those in the 5 x 5 cells around it.

    Samples should be few for each route, as every_kth takes them: those in one cell travel together, to the
    cells that their radius reaches and that hold places. All samples of a route that meet places are in
    one group with them, so each pair is found once; a cell of many places or samples is several groups.
    """
    span = F.sequence(F.lit(-2), F.lit(2))
    reach = metres / geo.EARTH_M * 1.001
    somewhere = (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))

    def gap(side: str, number: Column, least: float) -> Column:
        """Degrees from the samples' coordinates to a row or column of cells."""
        low = number * degrees + least
        return F.greatest(F.lit(0.0), low - F.col(f"most_{side}"), F.col(f"least_{side}") - low - degrees)

    cell = ["__row", "__col"]
    p = places.select(F.col(place_key).alias("place"), F.col("plat").cast("double").alias("lat"), F.col("plon").cast("double").alias("lon")).where(somewhere)
    p = p.withColumns({"__row": geo.cell_row(F.col("lat"), degrees), "__col": geo.cell_col(F.col("lon"), degrees)})
    s = samples.select(F.col(key).alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(somewhere)
    s = s.groupBy("key", geo.cell_row(F.col("lat"), degrees).alias("r"), geo.cell_col(F.col("lon"), degrees).alias("c"))
    s = s.agg(F.collect_list("lat").alias("lats"), F.collect_list("lon").alias("lons"), *(F.min(x).alias(f"least_{x}") for x in ("lat", "lon")), *(F.max(x).alias(f"most_{x}") for x in ("lat", "lon")))
    s = materialize(s, "samples")
    s = s.withColumn("__row", F.explode(F.transform(span, lambda x: F.col("r") + x))).where(F.radians(gap("lat", F.col("__row"), -90.0)) <= reach)
    # the nearest point of a meridian that lies so many degrees off
    s = s.withColumn("__col", F.explode(F.transform(span, lambda x: F.col("c") + x)))
    aside, pole = F.least(F.lit(90.0), gap("lon", F.col("__col"), -180.0)), F.greatest(F.abs("least_lat"), F.abs("most_lat"))
    s = s.where(F.asin(F.sin(F.radians(aside)) * F.cos(F.radians(pole))) <= reach)
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    held = p.groupBy(*cell).agg(F.count("*").alias("n")).join(s.groupBy(*cell).agg(F.sum(F.size("lats")).alias("m")).hint("merge"), cell)
    held = materialize(held.select(*cell, parts("n", _PLACES_AT_ONCE).alias("blocks"), parts("m", _SAMPLES_AT_ONCE).alias("shares")), "cells")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n).cast("long")).cast("int")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    known = [none(s, c) for c in ("key", "lats", "lons")]
    q = p.join(held.hint("merge"), cell).select(*cell, dealt("place", "blocks").alias("block"), each("shares").alias("share"), F.lit(True).alias("held"), *known, "place", "lat", "lon")
    # one row for each cell of the globe that is in reach
    s = s.join(F.broadcast(held), cell).select(*cell, each("blocks").alias("block"), dealt("key", "shares").alias("share"), F.lit(False).alias("held"), "key", "lats", "lons", *(none(p, c) for c in ("place", "lat", "lon")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for route, place in _met_in_cell(pa.Table.from_batches(batches), metres):
            yield pa.RecordBatch.from_arrays([route, place], names=[key, place_key])

    group = [*cell, "block", "share"]
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [f"`{name}` {df.schema[c].dataType.simpleString()}" for name, df, c in ((key, s, "key"), (place_key, p, "place"))]
    found = q.unionByName(s).repartition(n, *group).groupBy(*group).applyInArrow(run, ", ".join(kinds))
    twice = p.groupBy("place").count().where("count > 1")
    return found if twice.isEmpty() else found.distinct()


def ring_nearest(points: DataFrame, places: DataFrame, key: str, place_key: str, measure: Column, degrees: float = 5.0, rings: int = 2) -> DataFrame:
    """(key, place_key, ring, measure) of the place of least measure (ties by place key) in the first ring of plain cells that holds any.

    Which ring that is follows from the cells alone, which are few; points meet only the places of its
    cells, and of places at one spot only the first. Cells don't wrap.
    """
    cell = lambda lat, lon: (F.floor(F.col(lat) / degrees).alias("r"), F.floor(F.col(lon) / degrees).alias("c"))
    p = points.select(key, "lat", "lon", *cell("lat", "lon"))
    s = places.groupBy("plat", "plon").agg(F.min(place_key).alias(place_key)).select("*", *cell("plat", "plon"))
    span = F.sequence(F.lit(-rings), F.lit(rings))
    around = p.select("r", "c").distinct().withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
    around = around.select("r", "c", (F.col("r") + F.col("dr")).alias("pr"), (F.col("c") + F.col("dc")).alias("pc"), F.greatest(F.abs("dr"), F.abs("dc")).cast("bigint").alias("ring"))
    held = around.join(s.select(F.col("r").alias("pr"), F.col("c").alias("pc")).distinct(), ["pr", "pc"])
    first = held.withColumn("least", F.min("ring").over(Window.partitionBy("r", "c"))).where("ring = least").drop("least")
    # at most 25 rows for each of the 2,592 cells of the globe
    pairs = _met(p.join(F.broadcast(first), ["r", "c"]).drop("r", "c"), s.withColumnsRenamed({"r": "pr", "c": "pc"}), ["pr", "pc"])
    best = pairs.groupBy(key).agg(F.min(F.struct(measure.alias("measure"), F.col(place_key), "ring")).alias("s"))
    return best.select(key, f"s.{place_key}", "s.ring", "s.measure")


def cells_of(features: DataFrame, feature_key: str, degrees: float = 5.0) -> DataFrame:
    """Cells with the sorted ids of their features."""
    cell = F.concat_ws(":", geo.cell_row(F.col("lat"), degrees), geo.cell_col(F.col("lon"), degrees))
    return features.groupBy(cell.alias("cell")).agg(F.array_sort(F.collect_set(feature_key)).alias("ids"))
