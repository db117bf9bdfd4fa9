"""Quality by nearest-neighbour voting over latent-semantic vectors.

Documents are counted as terms (three-character runs over character classes, and words that repeat the
one before), weighted by tf-idf and projected on the leading singular vectors. The labelled vectors are
broadcast, each document's exact cosine with all of them is computed in blocks, and the nearest ones
vote with weights by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import held_out

#: Terms, latent dimensions, neighbours that vote, and labelled documents used (those least by a hash of their id).
TERMS, LATENT, NEIGHBOURS, MAX_LABELLED = 2048, 48, 9, 3000
BLOCK = 256


def _classes() -> np.ndarray:
    """Class of each byte: small and capital letters, digits and bytes beyond ASCII share one each, others stand for themselves."""
    c = np.arange(256, dtype=np.int64)
    c[ord("a") : ord("z") + 1] = ord("a")
    c[ord("A") : ord("Z") + 1] = ord("A")
    c[ord("0") : ord("9") + 1] = ord("0")
    c[128:] = 128
    return c


_CLASS = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """Counts of a text's terms, as float64 of length TERMS; null and empty texts count one term of their own."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    c = _CLASS[raw]
    runs = ((c[:-2] * 131 + c[1:-1]) * 131 + c[2:]) * 2654435761 % 4294967296 // (1 << 11) % (TERMS - 8) if len(c) > 2 else np.empty(0, np.int64)
    counts = np.bincount(runs, minlength=TERMS).astype(np.float64)
    words = (text or "").split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    counts[TERMS - 1] = not words
    counts[TERMS - 2] = same
    counts[TERMS - 3] = len(words) - len(set(words))
    counts[TERMS - 4] = len(words)
    return counts


# Weighted counts, bases and vectors are held as whole numbers: their products stay below 2**53, so sums of them are
# exact in float64 and a score is the same in whatever block, order or machine it is computed.


def _whole_rows(x: np.ndarray, length: int) -> np.ndarray:
    """Rows of whole numbers below 2**22, scaled to about the given length and rounded; zero rows stay zero."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.rint(x * (length / np.maximum(norm, 1)))


@dataclass(frozen=True)
class Space:
    """Term weights, the projection to latent dimensions, and the labelled vectors with their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """tf-idf rows of about length 2**18."""
        return _whole_rows(np.rint(np.log1p(counts) * self.idf * (1 << 10)), 1 << 18)

    def project(self, counts: np.ndarray) -> np.ndarray:
        """Latent rows of about length 2**20."""
        return _whole_rows(np.rint((self.weighted(counts) @ self.basis) / (1 << 16)), 1 << 20)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of good labels among the nearest labelled vectors, weighted by similarity; ties by the order of the vectors."""
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        # similarity, then place: one whole number orders both
        n = len(self.vectors)
        cosine = self.project(counts) @ self.vectors.T
        keyed = (cosine.astype(np.int64) >> 1) * n + np.arange(n - 1, -1, -1)
        k = min(neighbours, n)
        top = -np.sort(-np.partition(keyed, n - k, axis=1)[:, n - k :], axis=1)
        near = n - 1 - top % n
        weight = np.exp(20 * ((top // n) * (2.0 / (1 << 40)) - 1))
        good = total = np.zeros(len(counts))
        for j in range(k):  # summed by rank, so that the order of addition is fixed
            good, total = good + weight[:, j] * self.labels[near[:, j]], total + weight[:, j]
        return np.clip(good / np.maximum(total, 1e-300), 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, seed: int = 7) -> Space:
    """Latent basis from the labelled documents' term counts (a randomised singular value decomposition)."""
    n = len(counts)
    space = Space(idf, np.eye(TERMS, 1), np.empty((0, 1)), labels, float(labels.mean()) if n else 0.5)
    if not n:
        return space
    x = space.weighted(counts) / (1 << 18)
    y = x @ np.random.default_rng(seed).standard_normal((TERMS, min(n, LATENT) + 16))
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    small = np.linalg.qr(y)[0].T @ x
    space = replace(space, basis=np.rint(np.linalg.svd(small, full_matrices=False)[2][:LATENT].T * (1 << 18)))
    return replace(space, vectors=space.project(counts))


def term_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequencies of the terms over all documents; a task gives one row of sums for its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(TERMS, np.int64)
        for b in batches:
            for text in b.column(0):
                seen += term_counts(text.as_py()) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.append(n, seen))], names=["term", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in sums.collect()}  # TERMS + 1 rows at most
    seen = np.array([found.get(t, 0) for t in range(TERMS)], np.float64)
    return np.log((1 + found.get(-1, 0)) / (1 + seen)) + 1


def quality(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    labels: (doc_id, quality); at most MAX_LABELLED labelled documents outside the held-out fifth are
    used, so their vectors can be broadcast; of rows with one id, the one whose text comes first is the
    labelled document. Term weights come from all rows of docs. score: 0 to 1 from the text alone; null
    and empty texts are vectors of their own and vote like any other. Equal texts get equal scores, in
    any partitioning. Without labels every score is 0.5. predicted: 1 if score >= 0.3.
    """
    order = F.xxhash64("doc_id", F.lit("quality"))
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(marked.orderBy(order, "doc_id").limit(MAX_LABELLED))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([term_counts(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["doc_id", "quality", "counts"])

    rows = docs.select("doc_id", text_col).join(chosen, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(count, "doc_id long, quality int, counts binary").groupBy("doc_id").agg(F.min(F.struct("counts", "quality")).alias("row"))
    got = sorted(rows.collect(), key=lambda r: r.doc_id)  # at most MAX_LABELLED rows of 16 kB
    counts = np.stack([np.frombuffer(r.row.counts, np.float64) for r in got]) if got else np.empty((0, TERMS))
    shared = docs.sparkSession.sparkContext.broadcast(fit(counts, np.array([float(r.row.quality) for r in got]), term_weights(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                found = space.scores(np.stack([term_counts(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
