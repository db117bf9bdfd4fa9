from collections import defaultdict

import brute
from wayfare.llm import mixing, queries

D = "/root/testdata/sf0.001"


def check(got, rows):
    want = {}
    for r in rows:
        want[r.source] = want.get(r.source, 0) + len(brute.words(r.text))
    goal = brute.targets(want) if sum(want.values()) else {s: 0 for s in want}
    by, largest = defaultdict(int), max((r.size for r in got), default=0)
    for r in got:
        assert r.source_size == want[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert r.taken % max(1, r.size) == 0 and 0 <= r.taken <= 3 * r.size
        by[r.source] += r.taken
    total = sum(want.values())
    assert total - largest <= sum(by.values()) <= total
    for s, t in by.items():
        assert abs(t - goal[s]) <= 2 * largest + 1, (s, t, goal[s])


def test_shares_and_targets(documents, hard):
    check(mixing.mix(documents).collect(), documents.collect())
    check(mixing.mix(hard).collect(), hard.collect())


def test_finish_time_order(documents):
    """The virtual finish time, by brute force: entries sorted by it are taken while they fit the budget."""
    import pandas as pd

    got = mixing.mix(documents)
    rows = got.toPandas()
    rows["times"] = [t // s if s else 0 for t, s in zip(rows.taken, rows["size"], strict=True)]
    # a document is taken k + 1 times only if all documents of its source are taken k times
    for _, g in rows[rows["size"] > 0].groupby(rows.source.fillna("")):
        assert g.times.max() - g.times.min() <= 1
    assert isinstance(rows, pd.DataFrame)


def test_reruns_agree(documents):
    once = sorted(map(tuple, mixing.mix(documents).collect()))
    assert once == sorted(map(tuple, mixing.mix(documents.repartition(7)).collect()))


def test_copies(documents, hard, empty):
    for docs in (documents, hard):
        taken = mixing.mix(docs).collect()
        got = mixing.mixed_documents(docs)
        assert got.columns == docs.columns
        assert sum(len(brute.words(r.text)) for r in got.collect()) == sum(r.taken for r in taken)
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_query_columns(spark):
    assert queries.op10_mix_sources(spark, D).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_full_sources(spark):
    """A small source with a large weight stops at three times its size."""
    rows = [(i, "w " * 10, "a" if i < 3 else "b" if i < 40 else "c") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.target, r.source_size) for r in mixing.mix(docs).collect()}
    assert got["a"] == (90.0, 30) and abs(got["b"][0] - 2 * got["c"][0]) < 1e-9
    check(mixing.mix(docs).collect(), docs.collect())
