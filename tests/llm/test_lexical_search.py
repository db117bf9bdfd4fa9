import math
import random
import re
from collections import Counter

import pytest

from compare import connect, differences
from wayfare.llm import lexical_search, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    """Every score of every document, sorted."""
    held = [(r.doc_id, Counter(terms(r.text))) for r in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item in items:
        scores = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(item.text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(str(item.item_id), rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(docs, items, k=20):
    return sorted(((str(r.item_id), r.rank, r.doc_id, r.score) for r in lexical_search.ranked(docs, items, k).collect()), key=str)


def test_equals_sql(spark):
    assert differences(queries.op13_lexical_search(spark, SF), connect(SF), queries.ORACLE_SQL["op13_lexical_search"]) == []


@pytest.fixture
def items(spark):
    rows = [(1, "the same Footer line, the word word WORD"), (2, None), (3, ""), (4, "!? --"), (5, "Grüße 東京 one two"), (6, "nothing-of-this occurs"), (None, "first page"), (1, "one"), (1, "one")]
    return spark.createDataFrame([(*r, 3, "d") for r in rows], "item_id long, text string, doc_id long, score string")


def test_hard_rows(hard, empty, items):
    assert got(hard, items) == plain(hard.collect(), items.collect())
    assert got(hard, items, 2) == plain(hard.collect(), items.collect(), 2)
    assert got(empty, items) == [] and got(hard, items.limit(0)) == []


def test_stops_early_with_the_same_result(spark, monkeypatch):
    """Shards of different sizes, blocks of few items and texts with rare terms: the same rows, though not all postings are read."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randint(1, 80)))) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(500)]  # copies tie
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=4))) for i in range(30)] + [(99, rows[7][1])], "item_id long, text string")
    want = plain(docs.collect(), items.collect(), 5)
    assert got(docs, items, 5) == want
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 100)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 7)
    assert got(docs, items, 5) == want


def test_bounds_end_the_search():
    """With a few documents far ahead, the search ends before the postings of the common term."""
    import numpy as np

    n = 2000
    term = np.array([t for i in range(n) for t in ([0, 1] if i < 3 else [0])])
    width = np.array([2 if i < 3 else 1 for i in range(n)])
    shard = lexical_search.Shard(np.full(n, 10) + np.arange(n) % 7, width, term, np.ones(len(term), np.int64), np.array([1, 9000]), n, 13 * n)
    found, score = shard.search(np.array([0, 1]), np.array([1, 2]), 3, 0)
    assert sorted(found.tolist()) == [0, 1, 2]
    want = [int(shard.impact[2 * i] + 2 * shard.impact[2 * i + 1]) for i in range(3)]
    assert score[np.argsort(found)].tolist() == want
