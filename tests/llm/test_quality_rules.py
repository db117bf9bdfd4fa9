import numpy as np

import brute
from wayfare.llm import quality_rules as Q
from wayfare.llm import queries


def check(got, rows):
    want = sorted(((r.doc_id, *brute.base_traits(r.text)) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_query_equals_brute_force(spark, documents):
    check(queries.op5_quality_rules(spark, "/root/testdata/sf0.001").collect(), documents.collect())


def test_hard_rows_and_empty_table(hard, empty):
    check(Q.quality_verdicts(hard).collect(), hard.collect())
    assert Q.quality_verdicts(empty).collect() == [] and Q.keep_good(empty).collect() == []
    assert Q.keep_good(hard).columns == hard.columns


def test_keep_good_keeps_what_the_verdicts_keep(documents):
    kept = {r.doc_id for r in Q.quality_verdicts(documents).where("kept").collect()}
    got = Q.keep_good(documents)
    assert {r.doc_id for r in got.collect()} == kept and got.columns == documents.columns


def test_labelled_documents(spark):
    """Documents marked good that pass the base rules stay; those marked bad mostly go."""
    d = "/root/testdata/sf0.01"
    x = queries.op5_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in x if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in x if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_em_recovers_accuracies():
    """Votes drawn from known rates: the posterior separates the classes, although the rates are not given."""
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.7
    votes = []
    for bad_on_bad, bad_on_good, good_on_bad, good_on_good in ((0.8, 0.02, 0.0, 0.0), (0.5, 0.05, 0.1, 0.6), (0.6, 0.1, 0.05, 0.7)):
        x = rng.random(20_000)
        bad, fine = np.where(good, bad_on_good, bad_on_bad), np.where(good, good_on_good, good_on_bad)
        votes.append(np.where(x < bad, 0, np.where(x > 1 - fine, 2, 1)))
    pattern = votes[0] * 9 + votes[1] * 3 + votes[2]
    found, counts = np.unique(pattern, return_counts=True)
    post = dict(zip(found.tolist(), Q.fit_votes(found, counts, 3), strict=True))
    said = np.array([post[p] for p in pattern.tolist()]) >= 0.5
    assert (said == good).mean() > 0.85  # the rates themselves allow 0.9


def test_no_votes_are_no_evidence():
    post = Q.fit_votes(np.array([13, 4]), np.array([900, 100]), 3)  # all abstain; the first says bad
    assert post[0] >= 0.5 > post[1]
