import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import queries
from wayfare.llm import vector_search as V


def brute(ids, vectors, queries_, k=20):
    out = {}
    for q in queries_:
        score = (vectors * vectors[ids == q][0]).sum(1)
        rows = np.flatnonzero(ids != q)
        best = rows[np.lexsort((ids[rows], -score[rows]))][:k]
        out[int(q)] = [(int(ids[i]), float(score[i])) for i in best]
    return out


@pytest.mark.parametrize("block", [4096, 60])
def test_recall_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(V, "CANDIDATE_BLOCK", block)
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(np.float64)
    asked = ids[ids % 20 == 0]
    want = brute(ids, vectors, asked)
    got = {}
    for r in queries.op7_vector_search(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:], strict=False))
        for _, v, s in found:
            assert abs(s - float((vectors[place[v]] * vectors[place[q]]).sum())) < 1e-12
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_bad_vectors_ties_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 2.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (20, [-1.0, 0.0]), (40, [0.0, 0.0]), (None, [3.0, 3.0]), (10, [1.0, 2.0, 3.0])]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit("x"), "shard": F.lit(0), "score": F.lit(2)})
    got = sorted(map(tuple, V.nearest(x, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (0, 4, 20, -1.0), (20, 1, 3, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0), (20, 4, 2, -1.0)]
    assert V.nearest(x.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert V.nearest(x, F.col("vec_id") < 0).collect() == []


def test_repeated_vectors_spread_over_blocks(spark, monkeypatch):
    """A third of all rows may be one vector: its cell is dealt in blocks, and nothing is lost."""
    monkeypatch.setattr(V, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    vectors = np.concatenate([np.tile(rng.standard_normal(6), (100, 1)), rng.standard_normal((200, 6))])
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in V.nearest(x, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(np.arange(300), vectors, range(0, 300, 20))
    assert set(got) == set(want)
    assert sum(len({v for _, v in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_cells_cover_the_space():
    points = np.random.default_rng(1).standard_normal((5000, 8))
    cells = V.Cells(points[:1000], 13)
    assert cells.n == 13 and np.bincount(cells.of(points), minlength=13).min() > 200
    assert V.Cells(np.zeros((50, 8)), 5).of(points).max() == 0


def test_chi_square():
    x = np.random.default_rng(1).chisquare(8, 200_000)
    for at in (2.0, 8.0, 15.0):
        assert abs(V.chi_square_cdf(np.array(at)) - (x <= at).mean()) < 0.01
