"""Toxicity by non-negative positive-unlabelled learning.

A numpy logistic model is trained from confirmed toxic documents and from unlabelled text. Unlabelled
text holds toxic documents too; the risk on clean text is therefore the risk of calling unlabelled text
toxic, less the share that the class prior lays to toxic text, and never below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 18
_STRIP = ".,;:!?\"'()[]{}<>*_-#$%&|/\\~`+=¡¿«»"
#: At most so many documents labelled toxic are learned from, those least by a hash of their id.
MAX_TOXIC = 4000
#: The first weights come from so many unlabelled documents; then the risk over all of them is minimised.
START_UNLABELLED = 12000
#: Steps over all unlabelled documents, and the length of the first.
STEPS, STEP_RATE = 16, 0.1
#: Scores and losses are summed as whole numbers of these shares, so sums are the same in any order.
GRAIN, LOSS_GRAIN = 2.0**-30, 2.0**-20


def buckets_of(text: str | None) -> np.ndarray:
    """Hash buckets of the distinct words of a text, in lower case and without punctuation around them, and of the first five letters of longer ones."""
    words = {w.strip(_STRIP) for w in set((text or "").lower().split())}
    words.discard("")
    words |= {f"{w[:5]}~" for w in words if len(w) > 5}
    hash32 = xxhash.xxh32_intdigest
    return np.unique(np.fromiter((hash32(w) % BUCKETS for w in words), np.int32, len(words)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one for each bucket, most of them zero
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets].sum() + self.bias, -500, 500))))


def common_buckets(toxic: list[np.ndarray]) -> np.ndarray:
    """Buckets in at least 3 toxic documents and 1 in 200 of them, in order."""
    if not toxic:
        return np.empty(0, np.int64)
    seen = np.bincount(np.concatenate(toxic), minlength=BUCKETS)
    return np.flatnonzero(seen >= max(min(3, len(toxic)), len(toxic) / 200))


def telling_buckets(toxic: list[np.ndarray], rates: np.ndarray) -> np.ndarray:
    """The common buckets of toxic documents that have twice the rate there as in unlabelled text."""
    used = common_buckets(toxic)
    seen = np.bincount(np.concatenate(toxic), minlength=BUCKETS) / max(len(toxic), 1) if toxic else np.zeros(BUCKETS)
    return used[seen[used] >= 2 * rates[used]]


def fit(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rates: np.ndarray | None = None, rounds: int = 400, rate: float = 0.1, sparsity: float = 1e-4) -> Model:
    """Train on bucket sets with the logistic loss and Adam steps.

    The risk is prior * R(toxic as toxic) + max(0, R(unlabelled as clean) - prior * R(toxic as clean));
    where the second part falls below zero, its gradient is followed upwards instead. Only buckets that
    speak for toxicity get a weight: the common ones of toxic documents that have twice the rate there
    as in unlabelled text (rates: share of all unlabelled documents with the bucket; None: of those
    given). Weights are kept from falling below zero and shrink a little with each step, so that chance
    words of long texts don't add up.
    """
    weights = np.zeros(BUCKETS)
    base = float(np.log(prior / (1 - prior)))
    if not toxic or not unlabelled:
        return Model(weights, base)
    n_toxic, n_other = len(toxic), len(unlabelled)
    rates = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS) / n_other if rates is None else rates
    used = telling_buckets(toxic, rates)
    if not len(used):
        return Model(weights, base)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    kept = [x[x >= 0] for x in (place[d] for d in (*toxic, *unlabelled))]
    row, column = np.repeat(np.arange(len(kept), dtype=np.int32), [len(x) for x in kept]), np.concatenate(kept)
    is_toxic = np.arange(len(kept)) < n_toxic
    share = np.where(is_toxic, 1 / n_toxic, 1 / n_other)
    steps = Steps(np.zeros(len(used)), base, rate, sparsity)
    for _ in range(rounds):
        p, loss = _as_clean(row, column, len(kept), steps.x, steps.bias)
        toxic_sums = Sums.of(row, column, share * is_toxic, p, loss, len(used))
        other_sums = Sums.of(row, column, share * ~is_toxic, p, loss, len(used))
        steps.take(*risk_slope(toxic_sums, other_sums, prior)[1:])
    weights[used] = steps.x
    return Model(weights, steps.bias)


@dataclass
class Sums:
    """Weighted sums over documents: the loss of calling them clean, their scores in all and by bucket, and how many have a bucket."""

    loss: float
    score: float
    by_bucket: np.ndarray
    rows: np.ndarray  # weight of the documents with a bucket; last of all documents

    @classmethod
    def of(cls, row, column, weight, p, loss, n: int) -> Sums:
        return cls(float((weight * loss).sum()), float((weight * p).sum()), np.bincount(column, (weight * p)[row], n), np.append(np.bincount(column, weight[row], n), weight.sum()))


def _as_clean(row: np.ndarray, column: np.ndarray, n: int, x: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores of n documents and the losses of calling them clean."""
    z = np.clip(np.bincount(row, x[column], n) + bias, -500, 500)
    return 1 / (1 + np.exp(-z)), np.logaddexp(0, z)


def risk_slope(toxic: Sums, other: Sums, prior: float) -> tuple[float, np.ndarray, float]:
    """The risk but for the losses of toxic documents as toxic, and its slope by weight and by bias; toxic and other are averages."""
    clean = other.loss - prior * toxic.loss
    slope = other.by_bucket - prior * toxic.by_bucket, other.score - prior * toxic.score
    if clean < 0:
        return clean, -slope[0], -slope[1]
    # a toxic document's loss as toxic has the slope score - 1
    return clean, slope[0] + prior * (toxic.by_bucket - toxic.rows[:-1]), slope[1] + prior * (toxic.score - toxic.rows[-1])


class Steps:
    """Adam steps of weights that stay at zero or above, and of a bias."""

    def __init__(self, x: np.ndarray, bias: float, rate: float, sparsity: float):
        self.x, self.bias, self.rate, self.sparsity, self.n = x, bias, rate, sparsity, 0
        self.moment, self.spread = np.zeros(len(x) + 1), np.zeros(len(x) + 1)

    def take(self, slope: np.ndarray, bias_slope: float) -> None:
        self.n += 1
        grad = np.append(slope + self.sparsity, bias_slope)
        self.moment = 0.9 * self.moment + 0.1 * grad
        self.spread = 0.999 * self.spread + 0.001 * grad**2
        move = self.rate * (self.moment / (1 - 0.9**self.n)) / (np.sqrt(self.spread / (1 - 0.999**self.n)) + 1e-8)
        self.x = np.maximum(self.x - move[:-1], 0)
        self.bias -= float(move[-1])


def word_patterns(docs: DataFrame, used: np.ndarray, text_col: str = "text") -> DataFrame:
    """(pattern, n): which of the used buckets (places, 32-bit numbers) texts have, and how many texts have just these."""
    shared = docs.sparkSession.sparkContext.broadcast(used)  # BUCKETS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for b in batches:
            found = [place[buckets_of(t.as_py())] for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[x >= 0].tobytes() for x in found], pa.binary())], names=["pattern"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pattern binary").groupBy("pattern").agg(F.count("*").alias("n"))


def _sums_of_all(patterns: DataFrame, x: np.ndarray, bias: float) -> Sums:
    """Averages over all documents of the patterns at some weights; a task gives one row of whole numbers for each bucket."""
    n = len(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n + 2), np.int64)
        for b in batches:
            held = [np.frombuffer(t.as_py(), np.int32) for t in b.column(0)]
            if not held:
                continue
            row, column = np.repeat(np.arange(len(held)), [len(h) for h in held]), np.concatenate(held)
            p, loss = _as_clean(row, column, len(held), x, bias)
            times = b.column(1).to_numpy()
            score, lost = (np.rint(v / g).astype(np.int64) * times for v, g in ((p, GRAIN), (loss, LOSS_GRAIN)))
            np.add.at(sums[0], column, score[row])
            np.add.at(sums[1], column, times[row])
            sums[0, n:] += (score.sum(), lost.sum())
            sums[1, n] += times.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 2)), pa.array(sums[0]), pa.array(sums[1])], names=["at", "score", "n"])

    total = patterns.mapInArrow(run, "at long, score long, n long").groupBy("at").agg(*(F.sum(F.col(c).cast("decimal(38, 0)")).alias(c) for c in ("score", "n")))
    score, rows = np.zeros(n + 2), np.zeros(n + 2)
    for r in total.collect():  # a row for each used bucket
        score[r["at"]], rows[r["at"]] = float(r.score) * GRAIN, float(r.n)
    every = max(rows[n], 1.0)
    return Sums(score[n + 1] / GRAIN * LOSS_GRAIN / every, score[n] / every, score[:n] / every, rows[: n + 1] / every)


def refine(model: Model, toxic: list[np.ndarray], patterns: DataFrame, used: np.ndarray, prior: float, steps: int = STEPS, rate: float = STEP_RATE, sparsity: float = 1e-4) -> Model:
    """The model with the least risk over all unlabelled documents among the given one and those of some steps from it."""
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    kept = [x[x >= 0] for x in (place[d] for d in toxic)]
    row, column, share = np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate(kept), np.full(len(kept), 1 / len(kept))
    walk, best = Steps(model.weights[used], model.bias, rate, sparsity), None
    for k in range(steps + 1):
        p, loss = _as_clean(row, column, len(kept), walk.x, walk.bias)
        ours = Sums.of(row, column, share, p, loss, len(used))
        clean, slope, bias_slope = risk_slope(ours, _sums_of_all(patterns, walk.x, walk.bias), prior)
        z = np.clip(np.bincount(row, walk.x[column], len(kept)) + walk.bias, -500, 500)
        risk = prior * float(np.logaddexp(0, -z).mean()) + max(clean, 0.0) + sparsity * float(walk.x.sum())
        if best is None or risk < best[0]:
            best = risk, walk.x, walk.bias
        walk.rate = rate / (1 + k) ** 0.5
        walk.take(slope, bias_slope)
    weights = np.zeros(BUCKETS)
    weights[used] = best[1]
    return Model(weights, best[2])


def held_out(id_col: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of an id as text has the remainder; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % divisor == remainder, F.lit(False))


def _bucket_sets(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([buckets_of(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], names=["doc_id", "toxic", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, toxic int, buckets binary")


def bucket_rates(docs: DataFrame, wanted: np.ndarray, text_col: str = "text") -> np.ndarray:
    """Share of all rows of docs whose text has each of the wanted buckets (zero for others); a task gives one row of sums for each bucket it met."""
    rates = np.zeros(BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(np.append(wanted, BUCKETS))  # BUCKETS + 1 numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS + 1, -1, np.int64)
        place[shared.value] = np.arange(len(shared.value))
        seen = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for text in b.column(0):
                at = place[buckets_of(text.as_py())]
                seen[at[at >= 0]] += 1
            seen[-1] += b.num_rows
        met = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[met]), pa.array(seen[met])], names=["bucket", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = {r.bucket: r.n for r in sums.collect()}  # one row a bucket
    total = found.pop(BUCKETS, 0)
    rates[list(found)] = np.array(list(found.values()), np.float64) / max(total, 1)
    return rates


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> Model:
    """Fit the model on documents outside the held-out third.

    labels: (doc_id, toxic); documents marked toxic are the positives, MAX_TOXIC of them at most, and all
    others, marked or not, are unlabelled text. The prior is the toxic share of the marked documents. Word
    rates and the risk count every unlabelled row outside the held-out third, the risk by the patterns of
    telling words that rows have; START_UNLABELLED of them give the weights from which its steps begin. Of
    rows that share an id, the text with the least word set stands for them among the positives.
    """
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(max(share or 0.0, 0.01), 0.9)
    positives = marked.where("toxic = 1").orderBy(order, "doc_id").limit(MAX_TOXIC).select("doc_id", F.lit(1).alias("toxic"))
    others = docs.select("doc_id").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), 3, 1)).distinct().orderBy(order, "doc_id").limit(START_UNLABELLED).join(F.broadcast(positives), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("toxic"))
    chosen = F.broadcast(positives.union(others))
    sets = _bucket_sets(docs.select("doc_id", text_col).join(chosen, "doc_id"), text_col).groupBy("doc_id").agg(F.min(F.struct("toxic", "buckets")).alias("row")).select("row.*").collect()  # at most MAX_TOXIC + START_UNLABELLED
    pick = lambda kind: [np.frombuffer(x, np.int32) for x in sorted((bytes(r.buckets) for r in sets if r.toxic == kind), key=lambda x: (len(x), x))]
    toxic, unlabelled = pick(1), pick(0)
    learned = docs.where(~held_out(F.col("doc_id"), 3, 1))
    rates = bucket_rates(learned, common_buckets(toxic), text_col)
    model, used = fit(toxic, unlabelled, prior, rates), telling_buckets(toxic, rates)
    if not toxic or not unlabelled or not len(used):
        return model
    others = learned.join(F.broadcast(positives.select("doc_id")), "doc_id", "left_anti")
    patterns = materialize(word_patterns(others, used, text_col), "word-patterns")
    return refine(model, toxic, patterns, used, prior)


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    score: 0 to 1 from the words alone; null, empty and wordless texts get the score of no evidence.
    Equal texts get equal scores. Without labels every score is the prior. predicted: 1 if score >= 0.7.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(buckets_of(t.as_py())) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
