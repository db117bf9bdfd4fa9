"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised where they lie; what travels is a row for each piece. Pieces of one length are
alike to the packing, so the table of lengths and their counts, which the capacity bounds, decides it
all: lengths are taken in decreasing order, a segment tree over remaining capacities finds the tightest
open sequence that still holds the length, and all documents of that length that the search would send
to sequences of that remaining capacity go there at once. The outcome is that of asking the tree
document by document. It is written down as ranges of places among the pieces of a length, and every
piece looks its own place up.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 2048
#: A worker remembers the ids of so many words of at most so many bytes, and forgets all of them when it has more.
MEMO_WORDS, MEMO_BYTES = 500_000, 64
#: Long texts are tokenised in stretches of about so many bytes, cut at white space.
STRETCH = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
#: Letters around which the tokenizer does nothing but lower them, between ASCII punctuation that it keeps in one run.
_PLAIN = re.compile("([!-&(-/:-@\\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-įı-ɏ]*)([!-/:-@\\[-`{-~]*)")
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the characters from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _numbers(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words:
    """Token ids of texts, word by word: no token of this vocabulary crosses white space, which it drops."""

    kept: dict[str, Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.model = self.all.model
        self.memo: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        """This worker's tokenizer for a vocabulary file."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _run(self, run: bytes, shown: str) -> bytes:
        """Ids of a lower-case run of letters or of punctuation; shown: the run in the byte-level alphabet."""
        if (found := self.runs.get(run)) is None:
            found = _numbers([t.id for t in self.model.tokenize(shown)])
            if len(self.runs) >= MEMO_WORDS:
                self.runs.clear()
            self.runs[run] = found
        return found

    def _word(self, raw: bytes) -> bytes | None:
        """Ids of a word of plain runs; None: it takes the whole tokenizer."""
        if len(raw) > MEMO_BYTES:
            return None
        if raw.isalpha():  # ASCII letters alone
            run = raw.lower()
            return self._run(run, run.decode())
        plain = _PLAIN.fullmatch(raw.decode("utf-8", "replace"))
        if not plain or b"<|" in raw:
            return None
        runs = [x.lower().encode() for x in plain.groups() if x]
        return b"".join([self._run(x, x.decode("latin-1").translate(_ALPHABET)) for x in runs])

    def _new(self, words: set[bytes]) -> dict[bytes, bytes]:
        found = {w: self._word(w) for w in words}
        rest = [w for w, x in found.items() if x is None]
        if rest:
            coded = self.all.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
            found.update((w, _numbers(x.ids)) for w, x in zip(rest, coded, strict=True))
        return found

    def stretches(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text as little-endian 32-bit numbers, a stretch at a time."""
        raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
        while at < len(raw):
            cut = _SPACE.search(raw, at + STRETCH) if len(raw) - at > STRETCH else None
            words = raw[at : cut.start()].split() if cut else (raw[at:] if at else raw).split()
            at = cut.end() if cut else len(raw)
            ids = list(map(self.memo.get, words))
            if None in ids:
                new = self._new({w for w, x in zip(words, ids, strict=True) if x is None})
                ids = [new[w] if x is None else x for w, x in zip(words, ids, strict=True)]
                if len(self.memo) + len(new) > MEMO_WORDS:
                    self.memo.clear()
                self.memo.update((w, x) for w, x in new.items() if len(w) <= MEMO_BYTES)
            yield b"".join(ids)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): each document's ids and the id end, cut only where longer than capacity.

    part and nth: the partition that a piece was read in, and its place there among those of its length.
    with_ids: the column ids (binary, little-endian unsigned 32-bit numbers) too.
    """
    kinds = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    kinds += [("ids", pa.binary())] * with_ids
    full, last = 4 * capacity, int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = Words.of(tokenizer), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            at, rows = [], []

            def add(doc: int, piece: int, ids: bytes) -> None:
                n = len(ids) // 4
                at.append(doc)  # noqa: B023
                rows.append((piece, piece * capacity, n, zlib.crc32(ids), part, seen[n], *([ids] if with_ids else [])))  # noqa: B023
                seen[n] += 1

            for i, text in enumerate(b.column(1)):
                piece, left = 0, b""
                for ids in words.stretches(text.as_py()):
                    left += ids
                    cut = 0
                    while len(left) - cut >= full:
                        add(i, piece, left[cut : cut + full])
                        piece, cut = piece + 1, cut + full
                    left = left[cut:]
                add(i, piece, left + last)
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True))], names=["doc_id", *(n for n, _ in kinds)])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Tightest:
    """A segment tree over the capacities 0 to n: which of them some open sequence has left."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, left: int, is_open: bool) -> None:
        at = left + self.leaves
        self.any[at] = is_open
        while at := at // 2:
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def find(self, length: int) -> int | None:
        """The least capacity of at least length that is open."""
        at = length + self.leaves
        while not self.any[at]:
            while at & 1:  # a right child: what follows lies beside its parent
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, sequence, each, offset): where the pieces of a length go, by their rank.

    The piece of rank r goes to sequence + (r - rank_from) // each, at offset + (r - rank_from) % each * length.
    Open sequences with the same content lie in runs; a length adds four runs at most, and going into a
    run at least halves what is left in it, so that there are at most 4 * capacity * log2(capacity)
    rows (90,112 for 2048), however many documents there are.
    """
    tree, runs, n, plan = Tightest(capacity), [[] for _ in range(capacity + 1)], 0, []

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            runs[left].append((first, count))
            tree.set(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.find(length)
            if left is None:
                left = capacity
                first, count = n, -(-todo // (capacity // length))
                n += count
            else:
                first, count = runs[left].pop()
                tree.set(left, bool(runs[left]))
            each = left // length  # a sequence stays the tightest one until the length no longer fits
            whole = min(count, todo // each)
            if whole:
                plan.append((length, rank, rank + whole * each, first, each, capacity - left))
                put(left - each * length, first, whole)
                rank, todo, first, count = rank + whole * each, todo - whole * each, first + whole, count - whole
            if count and todo:
                plan.append((length, rank, rank + todo, first, todo, capacity - left))
                put(left - todo * length, first, 1)
                todo, first, count = 0, first + 1, count - 1
            put(left, first, count)
    return plan


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each document; with_ids: and ids.

    Null and empty texts are the id end alone. Repeated rows and rows without an id are documents of
    their own. The number of sequences is that of best-fit decreasing over all pieces, in any
    partitioning; which of the pieces of one length share a sequence follows the partitions. An empty
    table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer or public_tokenizer(), capacity, end, id_col, text_col, with_ids), "pieces")
    counts = materialize(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    plan = best_fit_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # a piece's rank among all of its length: those of earlier partitions, and its place in its own
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(ahead, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("ahead"))
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        starts = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = plan[np.searchsorted(starts, (length << 44) + rank, "right") - 1]
            over = rank - row[:, 1]
            sequence, offset = row[:, 3] + over // row[:, 4], row[:, 5] + over % row[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*names).schema)
    return ranked.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces packed with their ids: each sequence's ids, joined, as binary. A sequence has at most capacity pieces."""
    joined = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("of")).select("sequence_id", "length", F.aggregate("of.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))
