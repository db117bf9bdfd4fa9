import heapq
import inspect
import random

import pytest

from wayfare import catalog
from wayfare.operators import graph


def _ends(spark, rows):
    return spark.createDataFrame(rows, "query long, vertex long, cost long")


def lengths(out, start):
    """Distances from a vertex by a heap."""
    best, heap = {}, [(0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for u, w in out.get(v, {}).items():
                heapq.heappush(heap, (d + w, u))
    return best


def test_paths_end_by_settling_or_by_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(4)], "src long, dst long, w double")
    end = lambda v: spark.createDataFrame([(1, v, 0.0)], "query long, vertex long, cost double")
    assert inspect.signature(graph.shortest_paths).parameters["max_hops"].default is None
    assert [(r.dist, r.path) for r in graph.shortest_paths(edges, end(0), end(4)).collect()] == [(4.0, [0, 1, 2, 3, 4])]
    assert graph.shortest_paths(edges, end(0), end(4), max_hops=4).count() == 1
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, end(0), end(4), max_hops=2)


def test_paths_equal_a_heap_search(spark):
    """One way, weights of zero and ties, several starts and goals, queries of one start, goals out of reach."""
    rnd = random.Random(1)
    out = {}
    for _ in range(150):
        a, b = rnd.randrange(70), rnd.randrange(70)
        if a != b:
            out.setdefault(a, {})[b] = rnd.choice([0, 0, 1, 1, 2, 3, 20])
    for a in range(100, 124):  # a chain longer than several rounds, with a heavy short cut
        out.setdefault(a, {})[a + 1] = 1
    out[100][124] = 30
    starts, goals = [], []
    for q in range(60):
        starts += [(q, rnd.choice([3, 5, rnd.randrange(70)]), rnd.randrange(4)) for _ in range(rnd.randint(1, 3))]
        goals += [(q, rnd.randrange(75), rnd.randrange(4)) for _ in range(rnd.randint(1, 3))]
    starts += [(60, 100, 0), (61, 100, 0), (62, 7, 1), (63, 200, 0)]
    goals += [(60, 124, 0), (61, 101, 5), (62, 7, 2), (64, 3, 0)]
    edges = spark.createDataFrame([(a, b, w) for a, m in out.items() for b, w in m.items()], "src long, dst long, w long")
    want = {}
    for q, v, c in starts:
        d = lengths(out, v)
        for p, g, k in goals:
            if p == q and g in d:
                want[q] = min(want.get(q, 10**9), c + d[g] + k)
    cost = lambda rows, q, v: min(c for p, u, c in rows if (p, u) == (q, v))
    got = graph.shortest_paths(edges, _ends(spark, starts), _ends(spark, goals)).collect()
    assert {r["query"]: r.dist for r in got} == want and len(got) == len(want)
    for r in got:
        walked = sum(out[a][b] for a, b in zip(r.path, r.path[1:]))
        assert r.path[-1] == r.goal and r.dist == cost(starts, r["query"], r.path[0]) + walked + cost(goals, r["query"], r.goal)
    bare = graph.shortest_paths(edges, _ends(spark, starts), _ends(spark, goals), paths=False)
    assert {r["query"]: r.dist for r in bare.collect()} == want and bare.columns == ["query", "dist", "goal"]


def test_paths_of_no_queries(spark):
    edges = spark.createDataFrame([(1, 2, 1)], "src long, dst long, w long")
    assert graph.shortest_paths(edges, _ends(spark, []), _ends(spark, [])).collect() == []


@pytest.mark.parametrize("name, kind", [("x", "long"), ("y", "double"), ("z", "string")])
def test_ways_between_places_equal_a_heap_search(spark, monkeypatch, name, kind):
    """Components searched in one task, in several and in rounds; ties, weights of zero, places off a component, with themselves, unknown and null."""
    monkeypatch.setattr(graph, "ALONE", 30)
    monkeypatch.setattr(graph, "PAIRS", 25)
    monkeypatch.setattr(graph, "GOALS", 3)
    rnd = random.Random(3)
    label = (lambda v: f"v{v:03}") if kind == "string" else (lambda v: v)
    weight = float if kind == "double" else int
    out = {}
    for low, high in ((0, 12), (20, 48), (60, 110)):
        for a in range(low, high - 1):
            for b in (a + 1, rnd.randrange(low, high)):
                if a != b:
                    w = weight(rnd.choice([0, 0, 1, 2, 5]))
                    out.setdefault(label(a), {})[label(b)] = out.setdefault(label(b), {})[label(a)] = w
    parts = {label(v): label(low) for low, high in ((0, 12), (20, 48), (60, 110)) for v in range(low, high)}
    near = {(f"p{p}", label(low)): (label(rnd.randrange(low, high)), weight(rnd.randrange(4))) for p in range(14) for low, high in ((0, 12), (20, 48), (60, 110)) if rnd.random() < 0.6}
    asked = [(f"p{rnd.randrange(15)}", f"p{rnd.randrange(15)}") for _ in range(120)] + [("p1", None), (None, "p1")]
    v, w = ("string", "long") if kind == "string" else ("long", kind)
    edges = spark.createDataFrame([(a, b, x) for a, m in out.items() for b, x in m.items()], f"src {v}, dst {v}, w {w}")
    members = spark.createDataFrame(list(parts.items()), f"vertex {v}, component {v}")
    connectors = spark.createDataFrame([(p, c, u, x) for (p, c), (u, x) in near.items()], f"place string, component {v}, vertex {v}, cost {w}")
    want = {}
    for (p, c), (u, x) in near.items():
        d = lengths(out, u)
        for a, b in set(asked):
            if a == p and (b, c) in near:
                end, y = near[b, c]
                want[a, b] = min(want.get((a, b), 10**9), x + d[end] + y)
    ask = spark.createDataFrame(asked, "origin string, goal string")
    got = graph.paths_between(edges, members, connectors, ask).collect()
    assert len(got) == len(want) and {(r.origin, r.goal): r.dist for r in got} == want
    for r in got:
        (first,), (last,) = ([x for (p, _), (u, x) in near.items() if (p, u) == at] for at in ((r.origin, r.path[0]), (r.goal, r.path[-1])))
        assert first + sum(out[a][b] for a, b in zip(r.path, r.path[1:])) + last == r.dist
    assert {(r.origin, r.goal): r.dist for r in graph.paths_between(edges, members, connectors, ask, paths=False).collect()} == want


def test_nearest_of_components(spark):
    rows = [(q, c, v, v * 7 % 5) for q in range(4) for c in range(3) for v in range(-4, 9)]
    df = spark.createDataFrame(rows, "query long, component long, vertex long, cost long")
    want = {(q, c): min((k, v) for p, d, v, k in rows if (p, d) == (q, c)) for q in range(4) for c in range(3)}
    for high in (8, 2**61):  # one number holds both, or doesn't
        got = graph.nearest_of_components(df, -4, high, 10).collect()
        assert {(r["query"], r["component"]): (r["cost"], r["vertex"]) for r in got} == want and len(got) == 12


@pytest.mark.parametrize("name", ["route_with_fallback"])
def test_requests_meet_connectors_of_one_component(spark, monkeypatch, name):
    """Small components are never searched by requests, which would meet all pairs of their ends' connectors."""
    monkeypatch.setattr(graph, "shortest_paths", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").where("method = 'airway_graph'").count() > 0
