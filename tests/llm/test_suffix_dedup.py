import hashlib

import numpy as np
import pytest

import brute
from wayfare.llm import queries
from wayfare.llm import suffix_dedup as S


def check(docs):
    rows = docs.collect()
    want = sorted(((r.doc_id, *w) for r, w in zip(rows, brute.repeats([r.text for r in rows], S.WINDOW), strict=True)), key=str)
    got = sorted(((r.doc_id, bytes(r.kept), r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect()), key=str)
    assert got == want


@pytest.mark.parametrize("hot", [2500, 1])
def test_equals_brute_force(documents, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_ANCHOR", hot)
    check(documents)


def test_hard_rows_and_empty_table(spark, hard, empty):
    small = hard.where("length(text) < 5000 OR text IS NULL")
    check(small)
    check(spark.createDataFrame([(1, "ab" * 150), (2, "b" + "ab" * 120), (3, "x" * 199), (4, "x" * 199), (5, "ü" * 130)], "doc_id long, text string"))
    got = {r.doc_id: r for r in S.remove_repeats(hard).where("doc_id IN (9, 10)").collect()}
    assert got[9].n_removed == got[9].n_bytes and got[10].n_removed == got[10].n_bytes and got[10].n_spans == 1
    assert S.remove_repeats(empty).collect() == []


def test_many_equal_rows(spark):
    """Hundreds of equal rows of one id, and of ids of their own, beside texts that share a passage with them or an id."""
    rng = np.random.default_rng(7)
    text, other = (" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(2))
    rows = [(1, text)] * 500 + [(k, other) for k in range(10, 60)] + [(1, other[:900]), (2, f"lead {text[300:700]} tail"), (2, "short"), (None, text), (None, text)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("letters", [1, 2, 4, 200])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 3, 4, 5, 30, 257):
        s = rng.integers(1, letters + 1, n)
        s[rng.random(n) < 0.05] = 0
        ranks = S.suffix_keys(s, n + 3)
        order = sorted(range(n), key=lambda i: s[i:].tolist() + [0] * (n + 6))
        for a, b in zip(order, order[1:], strict=False):
            assert ranks[a] <= ranks[b]
            x, y = s[a:].tolist() + [0] * n, s[b:].tolist() + [0] * n
            if x[:n] != y[:n]:
                assert ranks[a] < ranks[b]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = {r.doc_id: (len(brute.raw(r.text)), n, k, hashlib.sha256(kept).hexdigest()) for r, (kept, n, k) in zip(docs, brute.repeats([r.text for r in docs], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op8_suffix_dedup(spark, d).collect()} == want
