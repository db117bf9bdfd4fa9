"""Ranked lexical search, score at a time over postings in order of their impact.

One pass over the texts keeps, for each document, its number of terms and how often it has those that
the queries ask for. Once the counts over all documents are known, each term has a weight and each
posting an exact impact, a whole number. Documents are searched in shards: a shard's postings are
grouped by term and impact, and a query takes the groups of its terms in descending order of impact
until what is left of every term cannot lift any further document into the best; the scores of those
still in question are then completed. The best of the shards meet in one ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Queries are searched in blocks of about so many items and so many terms, each in a pass of its own.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 500_000
#: Documents and postings of a shard, at about which it is searched.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Candidates, as a multiple of the documents wanted, whose scores are completed.
COMPLETED = 4
#: A-Z in lower case, other ASCII letters and digits and all beyond ASCII as they are, anything else a space.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: maximal runs of ASCII letters and digits and of anything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, item_id, terms, repeats): the distinct terms of each row of items that has any; key numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(terms_of(t.as_py())) for t in b.column(2)]
            at = pa.array([i for i, c in enumerate(counts) if c], pa.int64())
            counts = [c for c in counts if c]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))], names=["key", "item_id", "terms", "repeats"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"key long, item_id {kind}, terms array<binary>, repeats array<long>")


def document_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and the places in vocabulary of those in it with how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for b in batches:
            n, found = [], []
            for text in b.column(1):
                terms = terms_of(text.as_py())
                held = Counter(map(place, terms))
                held.pop(None, None)
                n.append(len(terms))
                found.append(held)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([list(h) for h in found], pa.list_(pa.int32())), pa.array([list(h.values()) for h in found], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Documents with their postings, ordered by term and descending impact and cut into groups of one impact."""

    def __init__(self, size: np.ndarray, width: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int):
        self.end = np.cumsum(width)
        self.start = self.end - width
        doc = np.repeat(np.arange(len(width)), width)
        m = 100 - 25 + 25 * size * n_docs // max(n_terms, 1)
        self.term, self.impact = term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((-self.impact, term))
        order = order[self.impact[order] > 0]
        self.doc, term, impact = doc[order], term[order], self.impact[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])))) if len(order) else np.empty(0, np.int64)
        self.group_term, self.group_impact, self.group_start = term[first], impact[first], first
        self.group_size = np.diff(np.append(first, len(order)))
        self.repeats = np.zeros(len(weight), np.int64)

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold all of the shard's k best with a score of floor or more, and their scores."""
        lo, hi = np.searchsorted(self.group_term, terms), np.searchsorted(self.group_term, terms, "right")
        width = hi - lo
        group = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
        owner = np.repeat(np.arange(len(terms)), width)
        impact = self.group_impact[group] * repeats[owner]
        order = np.argsort(-impact, kind="stable")
        group, owner, impact = group[order], owner[order], impact[order]
        score, upto = np.zeros(len(self.end), np.int64), np.cumsum(self.group_size[group])
        stops = np.searchsorted(upto, upto[-1:] // 2 ** np.arange(4, 0, -1)) if len(upto) else []
        at = 0
        for stop in [*np.unique(stops).tolist(), len(group)]:
            size, first = self.group_size[group[at:stop]], self.group_start[group[at:stop]]
            posting = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(score, self.doc[posting], np.repeat(impact[at:stop], size))
            at = stop
            if at == len(group):
                break
            left = np.zeros(len(terms), np.int64)
            np.maximum.at(left, owner[at:], impact[at:])
            kth = np.partition(score, -k)[-k] if len(score) >= k else 0
            possible = np.flatnonzero(score + left.sum() >= max(kth, floor, 1))
            if len(possible) <= COMPLETED * k and max(kth, floor) > 0:
                self.repeats[terms] = repeats
                complete = [int((self.repeats[self.term[a:b]] * self.impact[a:b]).sum()) for a, b in zip(self.start[possible], self.end[possible], strict=True)]
                self.repeats[terms] = 0
                return possible, np.array(complete, np.int64)
        kth = np.partition(score, -k)[-k] if len(score) >= k else 0
        found = np.flatnonzero(score >= max(kth, floor, 1))
        return found, score[found]


def search_shards(postings: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(key, doc_id, score): for each query (key, terms, repeats) the k best documents of every task."""
    shared = postings.sparkSession.sparkContext.broadcast((queries, weight))
    last = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        none = (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        best = [none] * len(queries)
        held: list[pa.RecordBatch] = []

        def search() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, nameless = rows.column("doc_id").fill_null(last).to_numpy(), rows.column("doc_id").is_null().to_numpy()
            terms, counts = (rows.column(c).chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int64())) for c in ("terms", "counts"))
            width = terms.value_lengths().to_numpy().astype(np.int64)
            shard = Shard(rows.column("n").to_numpy(), width, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy(), weight, n_docs, n_terms)
            for i, (_, q, repeats) in enumerate(queries):
                floor = best[i][2][-1] if len(best[i][2]) == k else 0
                found, score = shard.search(q, repeats, k, floor)
                if len(found):
                    new = [np.concatenate(x) for x in zip(best[i], (ids[found], nameless[found], score), strict=True)]
                    first = np.lexsort((new[0], new[1], -new[2]))[:k]
                    best[i] = tuple(x[first] for x in new)

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= SHARD_DOCS or sum(len(x.column(2).flatten()) for x in held) >= SHARD_POSTINGS:
                search()
                held = []
        if held:
            search()
        keys = np.repeat([q[0] for q in queries], [len(x[0]) for x in best]).astype(np.int64)
        ids, nameless, score = (np.concatenate(x) for x in zip(none, *best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, mask=nameless), pa.array(score)], names=["key", "doc_id", "score"])

    return postings.mapInArrow(run, "key long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0.

    Equal scores go by ascending doc_id, rows without an id last. Every row of docs is a document and
    every row of items an item of its own, so repeated rows are ranked each; items and documents
    without terms (null, empty or only punctuation) give no rows, nor does an empty table on either
    side. Items are searched in blocks, each in one pass over all documents, so what tasks share has a
    bound; a single item's text is held whole.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items, item_col, item_text_col), "item-terms")
    size = asked.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    n_blocks = max(1, math.ceil(size["items"] / BLOCK_ITEMS), math.ceil(size.terms / BLOCK_TERMS))
    found = []
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(n_blocks)) == block).select("key", "terms", "repeats").collect()
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r.terms}))}
        queries = [(r.key, np.array([vocabulary[bytes(t)] for t in r.terms], np.int64), np.array(r.repeats, np.int64)) for r in rows]
        postings = materialize(document_terms(docs, vocabulary, id_col, text_col), "postings")
        total = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        weight = np.zeros(max(1, len(vocabulary)), np.int64)
        # one row for each term of the block
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
            weight[r.term] = term_weight(total.docs, r.df)
        found.append(search_shards(postings, queries, weight, total.docs, total.terms, k))
    best = found[0]
    for more in found[1:]:
        best = best.unionAll(more)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
