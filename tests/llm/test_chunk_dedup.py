from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from wayfare.llm import chunk_dedup as C


def slow_chunks(raw):
    """Chunks by rolling the gear hash byte by byte."""
    out, h, start = [], 0, 0
    for i, b in enumerate(raw):
        h = (2 * h + int(C._GEAR[b])) & 0xFFFF
        if h >> (16 - C.CUT_BITS) == 0 or i == len(raw) - 1:
            piece = raw[start : i + 1]
            out += [piece[k : k + C.MAX_CHUNK] for k in range(0, len(piece), C.MAX_CHUNK)]
            start = i + 1
    return out


def expected(rows, order):
    """(kept, repeated, removed, spans) of each distinct (id, text) by a dictionary of chunks; order: that of texts with one id."""
    docs = {(r.doc_id, r.text): slow_chunks(brute.raw(r.text)) for r in rows if r.doc_id is not None}
    counts = Counter(c for r in rows if r.doc_id is not None for c in docs[r.doc_id, r.text])
    first, out = {}, {}
    for (i, t), chunks in sorted(docs.items(), key=lambda x: (x[0][0], order.get(x[0], 0))):
        for at, c in enumerate(chunks):
            first.setdefault(c, (i, t, at))

    def runs(flags, chunks):
        keep, at = [False] * len(flags), 0
        while at < len(flags):
            end = at
            while end < len(flags) and flags[end] == flags[at]:
                end += 1
            if flags[at] and sum(map(len, chunks[at:end])) >= C.MIN_RUN:
                keep[at:end] = [True] * (end - at)
            at = end
        return keep

    for (i, t), chunks in docs.items():
        rep = runs([counts[c] > 1 for c in chunks], chunks)
        later = runs([counts[c] > 1 and first[c] != (i, t, at) for at, c in enumerate(chunks)], chunks)
        kept = b"".join(c for c, g in zip(chunks, later, strict=True) if not g)
        out[i, t] = (kept, sum(len(c) for c, g in zip(chunks, rep, strict=True) if g), sum(len(c) for c, g in zip(chunks, later, strict=True) if g), sum(g and not (k and later[k - 1]) for k, g in enumerate(later)))
    return out


def check(docs):
    rows = docs.collect()
    want = expected(rows, {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()})
    got = {}
    for r in C.dedup_chunks(docs).collect():
        got.setdefault(r.doc_id, []).append((bytes(r.kept), r.n_repeated, r.n_removed, r.n_spans))
    for r in rows:
        assert (want[r.doc_id, r.text] if r.doc_id is not None else (brute.raw(r.text), 0, 0, 0)) in got[r.doc_id]
    assert sum(map(len, got.values())) == len(rows)


@pytest.mark.parametrize("held", [100_000, 3])
def test_equals_brute_force(documents, hard, empty, monkeypatch, held):
    monkeypatch.setattr(C, "HELD", held)
    check(documents.repartition(3))
    check(hard)
    assert C.dedup_chunks(empty).collect() == []


def test_shared_ids(spark, documents):
    """Rows that share an id are told apart by their texts; very many rows may be alike in both."""
    texts = [r.text for r in documents.where("length(text) > 2000").orderBy("doc_id").limit(12).collect()]
    rows = [(k // 4, t) for k, t in enumerate(texts)] + [(1, texts[0]), (2, "short"), (2, None), (None, texts[1])] + [(7, texts[2][:700])] * 60
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_chunks_resist_shifts():
    rng = np.random.default_rng(3)
    raw = rng.integers(32, 127, 20_000).astype(np.uint8).tobytes()
    moved = raw[:5000] + b"an insertion in the middle" + raw[5000:]
    cut = lambda x: {x[a:b] for a, b in zip([0, *C.chunk_ends(x).tolist()], C.chunk_ends(x).tolist(), strict=False)}
    assert cut(raw) == set(slow_chunks(raw))
    assert len(cut(raw) - cut(moved)) <= 2


def test_shared_passage_goes_from_all_but_the_first(spark):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, n))
    passage = word(60)
    docs = spark.createDataFrame([(k, f"{word(80)} {passage} {word(80)}") for k in range(4)], "doc_id long, text string")
    got = {r.doc_id: r for r in C.dedup_chunks(docs).collect()}
    assert got[0].n_removed == 0 and all(got[k].n_removed > 0.7 * len(passage) for k in (1, 2, 3))
