import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import quality_neighbours, queries, toxicity

D = "/root/testdata/sf0.1"


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("name", "column", "divisor", "remainder", "threshold"), [("op6_toxicity", "toxic", 3, 1, 0.7), ("op9_quality_classifier", "quality", 5, 0, 0.3)])
def test_held_out_accuracy(spark, name, column, divisor, remainder, threshold):
    got = queries.QUERIES[name](spark, D)
    rows = got.join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % divisor == remainder for i in rows.doc_id[rows.held_out]) and not any(zlib.crc32(str(i).encode()) % divisor == remainder for i in rows.doc_id[~rows.held_out])
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= threshold)).all()
    out = rows[rows.held_out]
    assert auc(out[column].to_numpy(), out.score.to_numpy()) > 0.94
    assert (out.predicted == out[column]).mean() > 0.94
    assert got.count() == spark.read.parquet(f"{D}/documents.parquet").count()


@pytest.mark.parametrize(("f", "column"), [(toxicity.toxicity, "toxic"), (quality_neighbours.quality, "quality")])
def test_edge_cases(spark, hard, empty, documents, labels, f, column):
    marks = spark.createDataFrame([(0, 1), (1, 0), (3, 1), (4, 0), (7, None), (None, 1), (11, 1), (11, 0)], f"doc_id long, {column} int")
    rows = f(hard, marks).collect()
    assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2
    assert f(empty, marks).collect() == []
    same = {r.score for r in f(hard, marks.limit(0)).collect()}
    assert len(same) == 1  # nothing learned: one score for all
    assert len(f(hard, marks.limit(0)).where("doc_id = 3").select("score").distinct().collect()) == 1


@pytest.mark.parametrize(("f", "column"), [(toxicity.toxicity, "toxic"), (quality_neighbours.quality, "quality")])
def test_scores_come_from_texts_alone(documents, labels, f, column):
    """Other sources, languages and held-out labels change no score; nor does the partitioning."""
    base = {r.doc_id: r.score for r in f(documents, labels).collect()}
    held = toxicity.held_out(F.col("doc_id"), *((3, 1) if column == "toxic" else (5, 0)))
    other = documents.withColumn("source", F.lit("z")).withColumn("lang", F.lit("q")).repartition(5)
    again = f(other, labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)).cast("int")))
    assert {r.doc_id: r.score for r in again.collect()} == base


def test_risk_learns_from_unlabelled_text():
    """A fifth of the unlabelled documents are toxic, and still only toxic words score high."""
    rng = np.random.default_rng(2)
    doc = lambda toxic: np.unique(np.concatenate([rng.integers(1000, 3000, 40), [rng.integers(0, 20)] if toxic else []])).astype(np.int32)
    model = toxicity.fit([doc(True) for _ in range(300)], [doc(k % 5 == 0) for k in range(1000)], 0.2)
    scores = np.array([model.score(doc(k % 2 == 0)) for k in range(400)])
    assert auc(np.arange(400) % 2 == 0, scores) > 0.95


def plain_terms(text):
    """Term counts of a text by dictionaries: classes of bytes in runs of three, and four counts of words."""
    kind = lambda b: ord("a") if 97 <= b <= 122 else ord("A") if 65 <= b <= 90 else ord("0") if 48 <= b <= 57 else min(b, 128)
    c = [kind(b) for b in (text or "").encode("utf-8", "surrogatepass")]
    counts = {}
    for a, b, d in zip(c, c[1:], c[2:], strict=False):
        t = ((a * 131 + b) * 131 + d) * 2654435761 % 2**32 // 2**11 % (quality_neighbours.TERMS - 8)
        counts[t] = counts.get(t, 0) + 1
    words = (text or "").split()
    last = quality_neighbours.TERMS - 1
    for at, n in ((last, int(not words)), (last - 1, sum(a == b for a, b in zip(words, words[1:], strict=False))), (last - 2, len(words) - len(set(words))), (last - 3, len(words))):
        if n:
            counts[at] = n
    return counts


def test_quality_query_equals_brute_force(spark):
    """Every score of the query by sorting all exact cosines of plain whole numbers."""
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    counts = {i: plain_terms(t) for i, t in docs.items()}
    seen = np.zeros(quality_neighbours.TERMS)
    for c in counts.values():
        for t in c:
            seen[t] += 1
    idf = np.log((1 + len(docs)) / (1 + seen)) + 1
    known = sorted(i for i in marks if i in docs and zlib.crc32(str(i).encode()) % 5 != 0)
    dense = np.zeros((len(known), quality_neighbours.TERMS))
    for k, i in enumerate(known):
        for t, n in counts[i].items():
            dense[k, t] = n
    basis = quality_neighbours.fit(dense, np.array([float(marks[i]) for i in known]), idf).basis.astype(int).tolist()

    def scaled(x, length):
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        return [round(v * (length / max(norm, 1))) for v in x]

    def vector(c):
        terms = sorted(c)
        x = scaled([round(math.log1p(c[t]) * idf[t] * 1024) for t in terms], 1 << 18)
        return scaled([round(sum(v * basis[t][j] for v, t in zip(x, terms, strict=True)) / (1 << 16)) for j in range(len(basis[0]))], 1 << 20)

    vectors = [(vector(counts[i]), marks[i]) for i in known]
    for r in queries.op9_quality_classifier(spark, d).collect():
        v = vector(counts[r.doc_id])
        near = sorted(((-(sum(a * b for a, b in zip(v, w, strict=True)) >> 1), k, mark) for k, (w, mark) in enumerate(vectors)))[: quality_neighbours.NEIGHBOURS]
        weights = [math.exp(20 * (-s / 2**39 - 1)) for s, _, _ in near]
        want = sum(w * mark for w, (_, _, mark) in zip(weights, near, strict=True)) / sum(weights)
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3)


def plain_buckets(text):
    import xxhash

    words = {w.strip(toxicity._STRIP) for w in (text or "").lower().split()} - {""}
    return {xxhash.xxh32_intdigest(w) % toxicity.BUCKETS for w in words | {w[:5] + "~" for w in words if len(w) > 5}}


def test_toxicity_query_equals_brute_force(spark):
    """Every score of the query from the model's weights by hand, and word rates counted by hand over all rows that may be learned from."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    sets = {r.doc_id: plain_buckets(r.text) for r in docs.collect()}
    for r in queries.op6_toxicity(spark, d).collect():
        z = sum(model.weights[b] for b in sets[r.doc_id]) + model.bias
        assert abs(r.score - 1 / (1 + math.exp(-max(-500, min(500, z))))) < 1e-9 and r.predicted == (r.score >= 0.7)
    mine = [s for i, s in sets.items() if zlib.crc32(str(i).encode()) % 3 != 1]
    wanted = np.array(sorted(set.union(*mine)))[:500]
    rates = toxicity.bucket_rates(docs.where(~toxicity.held_out(F.col("doc_id"), 3, 1)), wanted)
    assert all(abs(rates[b] - sum(b in s for s in mine) / len(mine)) < 1e-12 for b in wanted) and np.count_nonzero(rates) == len(wanted)


def test_toxicity_training_minimises_the_risk():
    """The non-negative risk of plain sums, with the shrinking of weights, does not fall when any weight or the bias moves a little."""
    rng = np.random.default_rng(4)
    doc = lambda toxic: np.unique(np.concatenate([rng.integers(1000, 1400, 30), rng.integers(0, 12, 2) if toxic else []])).astype(np.int32)
    toxic, other, prior = [doc(True) for _ in range(120)], [doc(k % 6 == 0) for k in range(500)], 0.17
    model = toxicity.fit(toxic, other, prior, rounds=1500, rate=0.05)

    def risk(weights, bias):
        z = lambda x: sum(weights[b] for b in x) + bias
        clean = lambda x: math.log1p(math.exp(z(x)))
        first = prior * sum(math.log1p(math.exp(-z(x))) for x in toxic) / len(toxic)
        return first + max(0.0, sum(map(clean, other)) / len(other) - prior * sum(map(clean, toxic)) / len(toxic)) + 1e-4 * weights.sum()

    base = risk(model.weights, model.bias)
    used = np.flatnonzero(model.weights)
    assert len(used) >= 10 and base < risk(np.zeros_like(model.weights), math.log(prior / (1 - prior)))
    for b in used[:12]:
        for move in (-0.1, 0.1):
            moved = model.weights.copy()
            moved[b] = max(0, moved[b] + move)
            assert risk(moved, model.bias) > base - 1e-4
    assert min(risk(model.weights, model.bias + m) for m in (-0.1, 0.1)) > base - 1e-4


@pytest.mark.parametrize("start", [12_000, 10])
def test_toxicity_risk_covers_all_rows(spark, monkeypatch, start):
    """A training of its own, by plain projected gradient steps over every unlabelled row, finds no lower risk, however few rows the first weights came from."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    mine = [(i, plain_buckets(t)) for i, t in docs.select("doc_id", "text").collect() if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    toxic, other = [s for i, s in mine if marks.get(i) == 1], [s for i, s in mine if marks.get(i) != 1]
    prior = sum(marks.values()) / len(marks)
    often = lambda sets, b: sum(b in s for s in sets) / len(sets)
    counts = {b: sum(b in s for s in toxic) for b in set.union(*toxic)}
    used = sorted(b for b, n in counts.items() if n >= max(min(3, len(toxic)), len(toxic) / 200) and n / len(toxic) >= 2 * often([s for _, s in mine], b))
    dense = lambda sets: np.array([[b in s for b in used] for s in sets], float)
    a, u = dense(toxic), dense(other)

    def risk(x, bias):
        za, zu = a @ x + bias, u @ x + bias
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, za).mean()
        return prior * np.logaddexp(0, -za).mean() + max(clean, 0) + 1e-4 * x.sum(), clean

    x, bias = np.zeros(len(used)), math.log(prior / (1 - prior))
    best = risk(x, bias)[0]
    for k in range(3000):
        pa, pu = 1 / (1 + np.exp(-(a @ x + bias))), 1 / (1 + np.exp(-(u @ x + bias)))
        sa, su = (prior * (pa - 1) - prior * pa, pu) if risk(x, bias)[1] >= 0 else (prior * pa, -pu)
        x, bias = np.maximum(x - 5 / (1 + k) ** 0.3 * (a.T @ sa / len(a) + u.T @ su / len(u) + 1e-4), 0), bias - 0.5 / (1 + k) ** 0.3 * (sa.mean() + su.mean())
        best = min(best, risk(x, bias)[0])
    monkeypatch.setattr(toxicity, "START_UNLABELLED", start)
    model = toxicity.train(docs, labels)
    assert set(np.flatnonzero(model.weights)) <= set(used)
    assert risk(model.weights[used], model.bias)[0] < best + (0.003 if start > 10 else 0.03)


@pytest.mark.parametrize(("f", "column"), [(toxicity.toxicity, "toxic"), (quality_neighbours.quality, "quality")])
def test_very_many_rows_of_one_id(spark, monkeypatch, f, column):
    """Rows that share a labelled id are one document in training, so bounds hold; each row has its own score."""
    monkeypatch.setattr(quality_neighbours, "MAX_LABELLED", 5)
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 3)
    monkeypatch.setattr(toxicity, "START_UNLABELLED", 5)
    docs = spark.createDataFrame([(2 if k % 3 else k, f"some words about thing {k % 7}") for k in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(0, 300, 3)] + [(2, 1)], f"doc_id long, {column} int")
    got = f(docs, marks).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)
