import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from wayfare.llm import packing, queries

SF = "/root/testdata/sf0.001"


def best_fit(lengths, capacity):
    """Best-fit decreasing, document by document over a list of open sequences: how full each gets. Ties between equally full ones don't show in that."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if sum(b) + n <= capacity]
        if fits:
            max(fits, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(map(sum, bins))


def fills(plan, counts):
    """How full each sequence gets by a plan, whose pieces must lie gapless."""
    bins = {}
    for length, n in counts.items():
        for rank in range(n):
            _, lo, _, first, each, offset = next(r for r in plan if r[0] == length and r[1] <= rank < r[2])
            bins.setdefault(first + (rank - lo) // each, []).append((offset + (rank - lo) % each * length, length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
    return sorted(sum(n for _, n in b) for b in bins.values())


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 64, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else max(1, capacity // 3) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    assert fills(packing.best_fit_plan(counts, capacity), counts) == best_fit(lengths, capacity)


def test_plan_size_has_a_bound():
    for counts in ({n: 10**7 for n in range(1, 2049)}, {n: 10**9 // n**2 + 1 for n in range(1, 2049)}):
        assert len(packing.best_fit_plan(counts)) <= 90_112


def check(got, rows, end=0):
    """Pieces, digests and places of all rows against whole texts in the tokenizer."""
    tokenizer, want = Tokenizer.from_file(packing.public_tokenizer()), []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, end]
        for k in range(0, len(ids), 2048):
            cut = ids[k : k + 2048]
            want.append((str(r.doc_id), k // 2048, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0]
        for offset, length in sorted(b):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(bins) == len(best_fit([w[3] for w in want], 2048))


def test_documents(spark, documents, hard, empty):
    for docs in (documents, hard):
        check(packing.pack(docs).collect(), docs.collect())
        check(packing.pack(docs.repartition(7)).collect(), docs.collect())
    assert packing.pack(empty).collect() == []
    assert queries.op12_best_fit_packing(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


ODD = ["It's he'd 'sword (word) \"'re\" don't!!", "<|endoftext|> a<|startoftext|>b <|x|>", "Straße ΣΊΣΥΦΟΣ İstanbul ŉa Ångström é ́x ẞ", "a b c\x1cd\x85e", "ﬁ Ⅷ ½ ٣ हिन्दी 東京 👩‍👩‍👧 a1b2 x_y e-mail@x.de", "A" * 70_000 + " tail", "$$$!!! ... --- '' '", "퟿� \x00\x01\x7f"]


def test_odd_words(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    check(packing.pack(rows).collect(), rows.collect())


def test_stretches(monkeypatch):
    """Texts cut into stretches, and a memory that is emptied, give the same ids."""
    words = packing.Words(packing.public_tokenizer())
    text = " ".join(ODD * 3)
    whole = np.array(words.all.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert b"".join(words.stretches(text)) == whole
    monkeypatch.setattr(packing, "STRETCH", 50)
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    assert b"".join(packing.Words(packing.public_tokenizer()).stretches(text)) == whole


def test_sequences(documents):
    """Joined sequences hold each piece's ids at its place."""
    packed = packing.pack(documents, with_ids=True)
    pieces = packed.collect()
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for r in pieces:
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
