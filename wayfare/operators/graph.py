"""Airway graphs: edges, components, largest component, shortest paths."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .tables import drop_table, materialize

#: Edges by which a round of a path search extends its frontier.
HOPS = 6

#: A component of at most so many vertices has all its distances worked out in one task, for at most about so many pairs of places at once.
ALONE, PAIRS = 512, 200_000

#: Goals of one place that travel together.
GOALS = 1000

#: A graph of at most so many edges and vertices is broadcast to the searches; they then need one shuffle a round.
LOCAL_WAYS = 1_000_000


def undirected(segments: DataFrame, src: str = "src", dst: str = "dst", weight: str = "w", missing: float = 1.0) -> DataFrame:
    """Edges (src, dst, w) both ways, the lightest of parallel ones; a missing or zero weight counts as 1 (or as missing says)."""
    w = F.coalesce(F.nullif(F.col(weight), F.lit(0)), F.lit(missing)).alias("w")
    one = segments.select(F.col(src).alias("src"), F.col(dst).alias("dst"), w).where("src <> dst")
    both = one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.min("w").alias("w"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component), component the least vertex reachable, by alternating large and small stars.

    edges: (src, dst) in any direction. A vertex's least neighbour is found with partial aggregation
    and joined back, so hubs are not gathered in one task; each round is written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u")
        moved = moved.where("v > u") if large else moved.unionAll(least.select("u", F.col("u").alias("v"), "m"))
        return moved.where("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct()

    now = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        large = materialize(star(now, True), "edges")
        before, now = now, materialize(star(large, False), "edges")
        drop_table(large)
        drop_table(before)
        got = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if got == mark:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        mark = got
    raise RuntimeError("components did not settle")


def largest_component(members: DataFrame) -> DataFrame:
    """(vertex, component) of the component with most vertices, the one of the least id among equals."""
    top = members.groupBy("component").count().agg(F.max(F.struct("count", (-F.col("component")).alias("c"))).alias("t")).select((-F.col("t.c")).alias("component"))
    return members.join(F.broadcast(top), "component", "left_semi")


def shortest_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int | None = None, paths: bool = True) -> DataFrame:
    """(query, dist, path, goal) of the lightest path of each query from any of its starts to any of its goals.

    edges: (src, dst, w), weights not negative; starts and goals: (query, vertex, cost), the cost of the
    connector to the graph; they are read in each round, so they should be tables. With a column component
    in both, starts meet only goals of their component. Queries that start at
    one vertex share its search, so there are never more searches than vertices, and all of them are
    relaxed together: a round extends the vertices that got better in the last one by HOPS edges, drops
    ways no better than what any query of the search still needs, and writes only vertices that got
    better, whatever the number of hops. A vertex holds its weight, its number of hops (of equal ways the
    one of fewer hops, then the old one) and the stretch from the vertex that its round began at; paths
    are put together from stretches at the end, or not at all (paths=False: no column path). Queries
    without a path are missing. max_hops: more hops than that are an error.
    """
    key, state = ["source", "vertex"], ["dist", "hops", "new", "fresh", "anchor", "stretch"]
    lightest = F.min(F.struct(*state)).alias("s")
    meet = ["query", *(c for c in ("component",) if c in starts.columns and c in goals.columns)]
    first = starts.groupBy(*meet, F.col("vertex").alias("source")).agg(F.min("cost").alias("first"))
    ends = goals.groupBy(*meet, F.col("vertex").alias("goal")).agg(F.min("cost").alias("last"))
    asked = materialize(first.join(ends, meet).drop("component").withColumn("least", F.min("last").over(Window.partitionBy("query"))), "asked")
    begin = asked.select("source").distinct().select("source", F.col("source").alias("vertex"), F.lit(0).cast(edges.schema["w"].dataType).alias("dist"), F.lit(0).alias("hops"))
    begin = begin.select("*", F.lit(True).alias("new"), F.lit(True).alias("fresh"), F.col("source").alias("anchor"), F.slice(F.array("source"), 1, 0).alias("stretch"))
    written = [materialize(begin, "paths")]

    def reached() -> DataFrame:
        known = reduce(DataFrame.unionAll, written).select("source", F.col("vertex").alias("goal"), "dist")
        return asked.join(known, ["source", "goal"]).withColumn("dist", F.col("dist") + F.col("first") + F.col("last"))

    # a loop at each vertex keeps what was reached while the rest is extended
    ways = edges.select("src", "dst", "w", F.lit(False).alias("loop"))
    ways = ways.unionAll(edges.select("src").union(edges.select("dst")).union(asked.select("source")).distinct().select("src", F.col("src").alias("dst"), F.lit(0).cast(edges.schema["w"].dataType).alias("w"), F.lit(True).alias("loop")))
    ways = materialize(ways, "ways")
    small = ways.limit(LOCAL_WAYS + 1).count() <= LOCAL_WAYS
    kept = F.col("loop")
    while not written[-1].where("fresh").isEmpty():
        best = reached().groupBy("query").agg(F.min("dist").alias("best"))
        need = asked.join(best, "query", "left").groupBy("source").agg(F.when(F.count("*") == F.count("best"), F.max(F.col("best") - F.col("first") - F.col("least"))).alias("bound"))
        step = reduce(DataFrame.unionAll, [*(x.withColumn("fresh", F.lit(False)) for x in written[:-1]), written[-1]]).withColumn("new", F.lit(False))
        step = step.join(need, "source").withColumn("fresh", F.col("fresh") & (F.col("bound").isNull() | (F.col("dist") < F.col("bound"))))
        # the searches of a small graph stay where they are for all hops of a round
        step = step.repartition("source") if small else step
        step = step.withColumn("going", F.max("fresh").over(Window.partitionBy("source"))).where("going")
        for hop in range(HOPS):
            # whatever a hop made better goes on; of a round's ways only those that its last hop made remain fresh
            step = step.join(F.broadcast(ways) if small else ways, (F.col("vertex") == F.col("src")) & (kept | F.col("fresh"))).where("loop OR bound IS NULL OR dist + w < bound")
            anchor, stretch = (F.col("anchor"), F.concat("stretch", F.array("dst"))) if hop else (F.col("vertex"), F.array("dst"))
            step = step.select(
                "source", F.col("dst").alias("vertex"), "bound", (F.col("dist") + F.col("w")).alias("dist"), F.when(kept, F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"), (~kept | F.col("new")).alias("new"), (~kept).alias("fresh"),
                F.when(kept, F.col("anchor")).otherwise(anchor).alias("anchor"), F.when(kept, F.col("stretch")).otherwise(stretch).alias("stretch"),
            )
            step = step.groupBy(*key).agg(lightest, F.first("bound").alias("bound")).select(*key, "bound", "s.*")
        written.append(materialize(step.where("new").select(*key, *state), "paths"))
        if max_hops is not None and not written[-1].where(F.col("hops") > max_hops).isEmpty():
            raise RuntimeError("shortest_paths did not settle")
    done = materialize(reached().groupBy("query").agg(F.min(F.struct("dist", "source", "goal")).alias("s")).select("query", "s.*"), "reached")
    if paths:
        tree = materialize(reduce(DataFrame.unionAll, written).groupBy(*key).agg(lightest).select(*key, "s.anchor", "s.stretch"), "tree")
    for old in (asked, ways, *written):
        drop_table(old)
    if not paths:
        return done.select("query", "dist", "goal")
    return done.join(_walked(tree, done.select("source", "goal").distinct()), ["source", "goal"]).select("query", "dist", "path", "goal")


def _walked(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, goal, path) of the wanted (source, goal), put together backwards from the stretches of the tree (source, vertex, anchor, stretch)."""
    back = tree.withColumnsRenamed({"vertex": "at", "anchor": "before", "stretch": "part"})
    left = wanted.select("source", "goal", F.col("goal").alias("at"), F.slice(F.array("goal"), 1, 0).alias("path"))
    done = None
    while True:
        for _ in range(HOPS):
            left = left.join(back, ["source", "at"]).select("source", "goal", F.col("before").alias("at"), F.concat("part", "path").alias("path"))
        left = materialize(left, "walked")
        ended = left.where("at = source").select("source", "goal", F.concat(F.array("source"), "path").alias("path"))
        done = ended if done is None else done.unionAll(ended)
        left = left.where("at <> source")
        if left.isEmpty():
            return done


def _distances(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, paths: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Distances between all n vertices, and with paths the vertex before each goal on its way (of equal ways one of fewest edges)."""
    far = np.inf if w.dtype.kind == "f" else np.int64(2**61)
    d = np.full((n, n), far, w.dtype)
    np.minimum.at(d, (src, dst), w)
    np.fill_diagonal(d, 0)
    if not paths:
        for k in range(n):
            np.minimum(d, d[:, k, None] + d[None, k], out=d)
        return d, None
    near = d < far
    hops, before = near.astype(np.int32), np.where(near, np.arange(n)[:, None], -1)
    np.fill_diagonal(hops, 0)
    for k in range(n):
        via, steps = d[:, k, None] + d[None, k], hops[:, k, None] + hops[None, k]
        better = (via < d) | ((via == d) & (steps < hops) & (via < far))
        d, hops, before = np.where(better, via, d), np.where(better, steps, hops), np.where(better, before[None, k], before)
    return d, before


def _component_paths(t: pa.Table, number: type, paths: bool) -> tuple[pa.Array, pa.Array, np.ndarray, list | None]:
    """Origins, goals, lengths (and paths) of the pairs of places in one component: rows of edges (kind 0), connectors (1) and origins with goals (2)."""
    of = lambda k: t.filter(pc.equal(t["kind"], k)).combine_chunks()
    plain = lambda rows, c: rows[c].to_numpy()
    edges, near, asked = of(0), of(1), of(2)
    vertices, ends = np.unique(np.concatenate([plain(edges, "src"), plain(edges, "dst")]), return_inverse=True)
    src, dst = ends.reshape(2, -1)
    d, before = _distances(len(vertices), src, dst, plain(edges, "w").astype(number), paths)
    at = np.argsort(plain(near, "place"), kind="stable")
    places, vertex, cost = plain(near, "place")[at], np.searchsorted(vertices, plain(near, "src")[at]), plain(near, "w")[at].astype(number)
    goals = asked["goals"].combine_chunks()
    origin, goal = asked["place"].take(pc.list_parent_indices(goals)), pc.list_flatten(goals)
    o, g = np.searchsorted(places, origin.to_numpy()), np.minimum(np.searchsorted(places, goal.to_numpy(zero_copy_only=False)), len(places) - 1)
    way = d[vertex[o], vertex[g]]
    kept = np.flatnonzero((places[g] == goal.to_numpy(zero_copy_only=False)) & (way < (np.inf if number is np.float64 else 2**61)))
    o, g, way = o[kept], g[kept], way[kept]
    found = None
    if paths:
        found = []
        for a, b in zip(vertex[o].tolist(), vertex[g].tolist(), strict=True):
            path = [b]
            while path[-1] != a:
                path.append(before[a, path[-1]])
                if len(path) > len(vertices):
                    raise RuntimeError("a path does not end")
            found.append(vertices[path[::-1]])
    return origin.take(pa.array(kept)), goal.take(pa.array(kept)), cost[o] + way + cost[g], found


def paths_between(edges: DataFrame, members: DataFrame, connectors: DataFrame, asked: DataFrame, paths: bool = True) -> DataFrame:
    """(origin, goal, dist[, path]) of the lightest way between each two places of asked (origin, goal), over any component that both have a connector to.

    edges: (src, dst, w), weights not negative; members: (vertex, component) of all vertices; connectors:
    (place, component, vertex, cost), one for each place and component. All should be tables. A component
    of at most ALONE vertices has its distances worked out in one task, or in several if over PAIRS pairs
    of places meet in it; larger ones are searched by shortest_paths. Paths are only put together in the
    component that is best, the least of equals. Pairs without a way are missing.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = all(isinstance(t, IntegralType) for t in (edges.schema["w"].dataType, connectors.schema["cost"].dataType))
    number, sql = (np.int64, "long") if whole else (np.float64, "double")
    kinds = {c: f.dataType.simpleString() for c, f in (("place", connectors.schema["place"]), ("vertex", edges.schema["src"]), ("component", members.schema["component"]))}
    pairs = materialize(asked.select("origin", "goal").where("origin IS NOT NULL AND goal IS NOT NULL").distinct(), "pairs")
    sizes = materialize(members.groupBy("component").agg(F.count("*").alias("size")), "sizes")

    def alone(pairs: DataFrame, by: list[str], paths: bool) -> DataFrame:
        """Ways within small components; by: what pairs share with connectors besides their origin."""
        near = connectors.withColumnRenamed("place", "origin")
        load = near.join(pairs.groupBy("origin", *by).count(), ["origin", *by]).groupBy("component").agg(F.sum("count").alias("load"))
        parts = sizes.where(F.col("size") <= ALONE).join(load, "component").select("component", F.ceil(F.col("load") / PAIRS).cast("int").alias("parts"))
        each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        blocks = pairs.withColumn("__n", F.count("*").over(Window.partitionBy("origin", *by))).withColumn("block", F.pmod(F.xxhash64("goal"), F.ceil(F.col("__n") / GOALS)))
        blocks = blocks.groupBy("origin", *by, "block").agg(F.collect_list("goal").alias("goals"))
        null = lambda kind: F.lit(None).cast(kind)
        shape = lambda kind, place, src, dst, w, goals: [F.lit(kind).alias("kind"), place.alias("place"), src.alias("src"), dst.alias("dst"), w.cast(sql).alias("w"), goals.alias("goals")]
        at, vertex, listed = null(kinds["place"]), null(kinds["vertex"]), null(f"array<{kinds['place']}>")
        rows = edges.join(members.withColumnRenamed("vertex", "src"), "src").join(parts, "component").select("component", each, *shape(0, at, F.col("src"), F.col("dst"), F.col("w"), listed))
        rows = rows.unionByName(connectors.join(parts, "component").select("component", each, *shape(1, F.col("place"), F.col("vertex"), vertex, F.col("cost"), listed)))
        part = F.pmod(F.xxhash64("origin", "block"), F.col("parts").cast("long")).cast("int").alias("part")
        rows = rows.unionByName(near.join(blocks, ["origin", *by]).join(parts, "component").select("component", part, *shape(2, F.col("origin"), vertex, vertex, null(sql), F.col("goals"))))

        def run(key: tuple, t: pa.Table) -> pa.Table:
            origin, goal, dist, found = _component_paths(t, number, paths)
            out = {"origin": origin, "goal": goal, "dist": pa.array(dist), "component": pa.repeat(key[0], len(dist))}
            return pa.table(out | ({"path": pa.array([x.tolist() for x in found], pa.list_(t.schema.field("src").type))} if paths else {}))

        # so many tasks whatever the size of the rows, for their work is in the distances
        grouped = rows.repartition(n, "component", "part").groupBy("component", "part")
        return grouped.applyInArrow(run, f"origin {kinds['place']}, goal {kinds['place']}, dist {sql}, component {kinds['component']}" + (f", path array<{kinds['vertex']}>" if paths else ""))

    least = lambda df: df.groupBy("origin", "goal").agg(F.min(F.struct("dist", "component", *(["path"] if "path" in df.columns else []))).alias("s"))
    if paths:
        best = materialize(least(alone(pairs, [], False)).select("origin", "goal", "s.component"), "best")
        found = alone(best, ["component"], True)
    else:
        found = alone(pairs, [], False).select("origin", "goal", "dist")
    large = sizes.where(F.col("size") > ALONE)
    if not large.isEmpty():
        near = connectors.join(large, "component")
        asks = pairs.select(F.struct("origin", "goal").alias("query"), "origin", "goal")
        starts, goals = (materialize(asks.join(near, F.col(c) == F.col("place")).select("query", "component", "vertex", "cost"), c) for c in ("origin", "goal"))
        far = shortest_paths(edges.join(members.withColumnRenamed("vertex", "src").join(large, "component"), "src", "left_semi"), starts, goals, paths=paths)
        far = far.select("query.origin", "query.goal", F.col("dist").cast(sql).alias("dist"), *([F.lit(None).cast(kinds["component"]).alias("component"), "path"] if paths else []))
        found = found.unionByName(far)
    if not paths:
        return found.groupBy("origin", "goal").agg(F.min("dist").alias("dist"))
    return least(found).select("origin", "goal", "s.dist", "s.path")


def nearest_per_component(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """The nearest connector of each query in each component: candidates (query, vertex, cost), ties by vertex."""
    named = candidates.join(members, "vertex")
    best = named.groupBy("query", "component").agg(F.min(F.struct("cost", "vertex")).alias("s"))
    return best.select("query", "component", "s.vertex", "s.cost")


def nearest_of_components(candidates: DataFrame, low: int, high: int, most: int) -> DataFrame:
    """The nearest connector of each query in each component, ties by vertex: candidates (query, component, vertex, cost), vertices from low to high and whole costs from 0 to most.

    Candidates are many times their results. Cost and vertex are put in one number where it holds them,
    since the least number is kept in a hash table and the least of two columns is found by sorting.
    """
    span = high - low + 1
    if (most + 1) * span >= 2**62:
        best = candidates.groupBy("query", "component").agg(F.min(F.struct("cost", "vertex")).alias("s"))
        return best.select("query", "component", "s.vertex", "s.cost")
    best = candidates.groupBy("query", "component").agg(F.min(F.col("cost") * span + (F.col("vertex") - low)).alias("s"))
    return best.select("query", "component", (F.expr(f"s % {span}L") + low).alias("vertex"), F.expr(f"s div {span}L").alias("cost"))


def remap(points: DataFrame, segments: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and segments of the given vertices with dense new ids from 0, in the order of the old ones."""
    from .rows import dense_index

    kept = dense_index(points.join(members.select(F.col("vertex").alias("uid")), "uid", "left_semi"), ["uid"], "idx")
    ids = kept.select("uid", "idx")
    both = segments.join(ids.select(F.col("uid").alias("src"), F.col("idx").alias("src_idx")), "src").join(ids.select(F.col("uid").alias("dst"), F.col("idx").alias("dst_idx")), "dst")
    return kept, both
