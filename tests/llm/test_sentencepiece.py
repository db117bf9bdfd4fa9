import pytest
from pyspark.sql import functions as F

from wayfare.llm import queries
from wayfare.llm import sentencepiece_viterbi as S


@pytest.fixture(scope="module")
def vocabulary():
    return S.Vocabulary.read()


def slow(vocabulary, text):
    """Best segmentation by trying every piece at every position of the whole text; the longer last piece wins ties."""
    text = " " + text
    pieces = {}
    for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.plain, strict=True)):
        if ok and p:
            pieces.setdefault(p, (vocabulary.scores[i], i))
    unknown = min(s for s, ok in zip(vocabulary.scores, vocabulary.plain, strict=True) if ok) - 10
    most = max(map(len, pieces))
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        ways = []
        for start in range(max(0, end - most), end):
            if text[start:end] in pieces:
                score, i = pieces[text[start:end]]
                ways.append((best[start][0] + score, best[start][1] + [i]))
        if text[end - 1] not in pieces:
            ways.append((best[end - 1][0] + unknown, best[end - 1][1] + [vocabulary.bytes_at + b for b in text[end - 1].encode("utf-8", "surrogatepass")]))
        top = max(w[0] for w in ways)
        best.append(next(w for w in ways if w[0] == top))
    return best[-1]


def score(vocabulary, ids):
    lo, unknown = vocabulary.bytes_at, min(s for s, ok in zip(vocabulary.scores, vocabulary.plain, strict=True) if ok) - 10
    total, raw = 0.0, bytearray()
    for i in ids:
        if lo <= i < lo + 256:
            raw.append(i - lo)
        else:
            total += vocabulary.scores[i]
    return total + unknown * len(raw.decode("utf-8", "surrogatepass"))


def test_best_score_of_whole_texts(vocabulary, documents):
    codec = S.Codec(vocabulary)
    texts = ["hello world", "a  b\n\nc ", " leading", "東京 ▁ x", "unhappiness-antidisestablishmentarianism", "\t\ttabs", "aaaaaaaaaaaaaaaaaaaaaaaa", "❤️🙂"]
    texts += [r.text[:400] for r in documents.where("text IS NOT NULL").orderBy("doc_id").limit(25).collect()]
    for t in texts:
        if t:
            want, _ = slow(vocabulary, t)
            got = codec.encode(t)
            assert abs(score(vocabulary, got) - want) < 1e-6 * max(1, abs(want)), t
            assert codec.decode(got) == t


def test_round_trip(documents, hard, empty, vocabulary):
    for docs in (documents, hard):
        got = S.decode(S.encode(docs, vocabulary), vocabulary)
        assert got.where(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0
        assert got.where("(text IS NULL) <> (ids IS NULL)").count() == 0
        assert got.where("text = '' AND size(ids) > 0").count() == 0
        assert got.count() == docs.count()
    got = S.encode(empty, vocabulary)
    assert got.collect() == [] and got.columns == [*(c for c in empty.columns if c != "ids"), "ids"]


def test_query(spark):
    got = queries.op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert all(r.round_trip for r in got) and {r.doc_id for r in got} == {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
