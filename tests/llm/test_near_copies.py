"""Near copies are exactly the pairs alike by 0.8 of their shingles, whatever the size of their group."""

import numpy as np
import pytest

import brute
from wayfare.llm import simhash


def variants(seed, base, group, n):
    """Texts whose shingles are alike by 0.5 to 0.95 to one text's, and so by all shares to each other's."""
    rng = np.random.default_rng(seed)
    text = [f"w{x}" for x in rng.integers(0, 4000, 300)]
    rows = []
    for k in range(n):
        copy = list(text)
        for at in rng.integers(0, 300, int(rng.integers(1, 18))).tolist():
            copy[at] = f"new{group}x{k}x{at}"
        rows.append((base + k, " ".join(copy)))
    return rows


def expected(rows):
    sets = {i: brute.shingles(t) for i, t in rows}
    return brute.classes(sets, lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("block", [512, 8])
def test_links_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_SETS", block)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    rows = [row for g in range(4) for row in variants(g, 100 * g, g, 40)]
    want = expected(rows)
    assert len(set(want.values())) > 20  # the groups hold pairs on both sides of 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_components(docs).collect()} == want
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(want.values())


def test_repeated_passages_do_not_hide_a_copy(spark):
    """A passage said over and over adds no shingles, so it leaves the similarity as it is."""
    rng = np.random.default_rng(3)
    text, loop = " ".join(f"w{x}" for x in rng.integers(0, 4000, 300)), " ".join(f"r{x}" for x in range(20))
    docs = spark.createDataFrame([(1, f"{text} {loop}"), (2, " ".join([text, *[loop] * 60]))], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicate_components(docs).collect()} == {1}


@pytest.mark.parametrize("hot", [4000, 6])
def test_hot_shards_link_the_same_pairs(spark, monkeypatch, hot):
    """Fingerprints 45 to 66 bits apart that share one band's key are linked, however many others share it."""
    monkeypatch.setattr(simhash, "HOT_SHARD", hot)
    masks = simhash.band_masks()[:1]
    monkeypatch.setattr(simhash, "band_masks", lambda: masks)
    mask = np.array(masks[0][-4:], np.int64).view(np.uint64)
    free = np.array([i for i in range(256) if not int(mask[i // 64]) >> (i % 64) & 1])
    rng = np.random.default_rng(11)
    flip = lambda x, bits: x ^ np.packbits(np.isin(np.arange(256), bits), bitorder="little").view(np.uint64)
    fps = []
    for k in range(20):
        first = rng.integers(0, 1 << 63, 4).astype(np.uint64) & ~mask
        fps += [first, flip(first, rng.choice(free, 45 + k, replace=False))]
    docs = spark.createDataFrame([(i, *map(int, f.view(np.int64))) for i, f in enumerate(fps)], "id long, fp0 long, fp1 long, fp2 long, fp3 long")
    got = {r.id: r.component_id for r in simhash.candidate_classes(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)}


def test_shared_ids_lose_no_text(spark):
    """Unrelated texts of one id all stay; of rows that share id and words one stays, and which one does not change."""
    rows = variants(1, 10, 1, 12)
    shared = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (1, "quite another text with words of its own"), (2, "ONE two three four five  six seven"), (1, "one  two three four five six seven")]
    alike = [(5, rows[0][1]), (5, "nothing like it at all in this one"), (5, "nothing like it at all in this one")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate([*rows, *shared, *alike, (None, "one two three four five six seven")])], "doc_id long, text string, n int")
    sets = {}
    for r in docs.where("doc_id IS NOT NULL").collect():
        key = frozenset(brute.shingles(r.text))
        sets[key] = min(sets.get(key, r.doc_id), r.doc_id)
    keys = sorted(sets, key=lambda k: (sets[k], len(k)))
    group = brute.classes(range(len(keys)), lambda a, b: 10 * len(keys[a] & keys[b]) >= 8 * len(keys[a] | keys[b]))
    want = {}
    for k, g in group.items():
        want.setdefault(g, []).append(sets[keys[k]])
    kept = sorted((r.doc_id, frozenset(brute.shingles(r.text))) for r in simhash.drop_near_duplicates(docs).where("doc_id IS NOT NULL").collect())
    assert [i for i, _ in kept] == sorted(min(ids) for ids in want.values()) and len({k for _, k in kept}) == len(kept)
    again = {tuple(r) for r in simhash.drop_near_duplicates(docs.repartition(6)).collect()}
    assert again == {tuple(r) for r in simhash.drop_near_duplicates(docs).collect()} and any(r[0] is None for r in again)
    named = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_components(docs).collect()}
    assert (2, 1) in named and (1, 1) in named and (5, 5) in named
