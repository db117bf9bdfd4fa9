import numpy as np
import pytest

import brute
from wayfare.llm import simhash


def rows_of(df):
    return sorted(((r.doc_id, r.fp0 & (2**64 - 1), r.component_id) for r in df.collect()), key=str)


def expected(rows):
    fp = [(r.doc_id, brute.fingerprint(r.text, 3)) for r in rows]
    least = {}
    for i, f in fp:
        least[f] = min(x for x in (least.get(f), i) if x is not None) if (least.get(f), i) != (None, None) else None
    group = brute.classes(least, lambda a, b: (a ^ b).bit_count() <= 2)
    names = {}
    for f, g in group.items():
        if least[f] is not None:
            names[g] = min(names.get(g, least[f]), least[f])
    return sorted(((i, f, names.get(group[f])) for i, f in fp), key=str)


@pytest.mark.parametrize("hot", [4000, 2])
def test_equals_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    assert rows_of(simhash.simhash_components(documents)) == expected(documents.collect())


def test_hard_rows_and_empty_table(hard, empty):
    assert rows_of(simhash.simhash_components(hard)) == expected(hard.collect())
    assert simhash.simhash_components(empty).collect() == []


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (4, 52)])
def test_tree_finds_all_pairs(words, radius):
    rng = np.random.default_rng(words)
    base = rng.integers(0, 1 << 63, (40, words)).astype(np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, base.shape).astype(np.uint64)) for _ in range(4))])
    fps = np.unique(near, axis=0)
    shard = np.sort(rng.integers(0, 3, len(fps)))
    got = {(int(x), int(y)) for a, b in simhash.Forest(fps, shard).pairs(radius) for x, y in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(i) if shard[i] == shard[j] and simhash.distance(fps[i : i + 1], fps[j : j + 1])[0] <= radius}
    assert got == want


@pytest.mark.parametrize("hot", [4000, 3])
def test_near_copies_share_a_class(spark, monkeypatch, hot):
    """Texts alike by 0.9 of their shingles and chains of them share a class; unrelated ones don't."""
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    rng = np.random.default_rng(5)
    rows = []
    for group in range(12):
        text = [f"w{x}" for x in rng.integers(0, 4000, 300)]
        for k in range(5):
            copy = list(text)
            copy[int(rng.integers(0, 300))] = f"new{group}{k}"
            rows.append((group * 10 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(docs).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == list(range(0, 120, 10))


def test_near_duplicates_of_hard_rows(hard, empty):
    kept = simhash.drop_near_duplicates(hard).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {0, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 50}
    assert sum(r.doc_id is None for r in kept) == 2
    assert simhash.drop_near_duplicates(empty).collect() == []
