"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of every text; where its leading bits are zero, a chunk ends, so chunk
ends depend on the 16 bytes before them alone and an insertion moves only the chunks it touches. Chunks
are deduplicated by digest, and runs of repeated chunks that are long enough are cut from all documents
but the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the gear hash that end a chunk when zero: chunks of 32 bytes on average, and none over MAX_CHUNK.
CUT_BITS, MAX_CHUNK = 5, 256
#: A run of repeated chunks shorter than this many bytes stays: about half of 50 words, since the ends of a passage lie in chunks that hold other text too.
MIN_RUN = 160
#: Rows of one digest that a task holds while it looks for the digest's end, digests at the ends of sorted partitions that are broadcast, and parts into which rows of one id are dealt.
HELD, EDGE_BROADCAST, SALTS = 100_000, 1_000_000, 16

_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256).astype(np.uint16)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i-1] + gear[byte i] in 16 bits at every position, by doubling the window four times."""
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8):
        h = np.concatenate((h[:shift], h[shift:] + (h[:-shift] << np.uint16(shift))))
    return h


def chunk_ends(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the last one its length."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    ends = np.flatnonzero(gear_hash(np.frombuffer(raw, np.uint8)) >> np.uint16(16 - CUT_BITS) == 0) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    widths = np.diff(ends, prepend=0)
    if widths.max() > MAX_CHUNK:  # a long chunk is cut at multiples of MAX_CHUNK from its start
        parts = -(-widths // MAX_CHUNK)
        starts = np.repeat(ends - widths, parts)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        ends = np.minimum(starts + step * MAX_CHUNK, np.repeat(ends, parts))
    return ends


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(rows: DataFrame) -> DataFrame:
    """(d1, d2, id, rk, at, u) from (id, rk, text): a 96-bit digest of every chunk, its document, its place among the chunks, and a number that spreads rows alike in all else."""
    names = ["d1", "d2", "id", "rk", "at", "u"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            digests, ids, keys, places, spread = [], [], [], [], []
            for i, rk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = _bytes(text.as_py())
                ends = chunk_ends(raw).tolist()
                digests += [xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip([0, *ends], ends, strict=False)]
                ids.append(np.full(len(ends), i, np.int64))
                keys.append(np.full(len(ends), rk, np.int64))
                places.append(np.arange(len(ends), dtype=np.int32))
                n += 1
                spread.append(np.full(len(ends), n * 0x9E3779B1 % (1 << 31) if rk else 0, np.int32))
            if digests:
                words = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                columns = [words[:, 0], words[:, 1].astype(np.int32), *(np.concatenate(x) for x in (ids, keys, places, spread))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    return rows.mapInArrow(run, "d1 long, d2 int, id long, rk long, at int, u int")


def repeated_chunks(every: DataFrame) -> DataFrame:
    """(id, rk, mark) of the chunks whose digest occurs more than once: twice the place, plus 1 if it isn't the digest's first place.

    All chunks are sorted once over range partitions, by digest, document and place, so that a digest
    with very many occurrences spreads over several partitions; a digest is compared with its
    neighbours in the order. Runs at the ends of a partition, which may go on in the next one, are
    settled by one row for each such digest.
    """
    keys = ["d1", "d2", "id", "rk", "at", "u"]
    names = ["id", "rk", "at", "later", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: pa.Table, last: bool, open_digest: tuple | None) -> pa.RecordBatch:
            """The repeated rows of whole runs; those of runs that may lie in other partitions too carry their digest."""
            d1, d2, ids, rk, at = (rows.column(i).to_numpy() for i in range(5))
            lead = np.flatnonzero(np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))))
            size = np.diff(lead, append=len(d1))
            first = np.repeat(lead, size)
            later = (ids != ids[first]) | (rk != rk[first]) | (at != at[first])
            edge = np.zeros(len(lead), bool)
            edge[0] = open_digest == (d1[0], d2[0])
            edge[-1] |= last
            edge = np.repeat(edge, size)
            keep = edge | (np.repeat(size, size) > 1)
            arrays = [pa.array(ids[keep]), pa.array(rk[keep]), pa.array(at[keep]), pa.array(later[keep].astype(np.int32)), *(pa.array(x[keep], mask=~edge[keep]) for x in (d1, d2))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        held: list[pa.RecordBatch] = []
        open_digest = None  # of the partition's first run, or of one that was too long to hold
        for b in batches:
            if not b.num_rows:
                continue
            if open_digest is None:
                open_digest = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
            d1, d2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            other = np.flatnonzero((d1 != d1[-1]) | (d2 != d2[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            ahead = held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (d1[-1], d2[-1])
            if cut or ahead:
                yield settled(pa.Table.from_batches([*held, b.slice(0, cut)]), False, open_digest)
                held = []
            held.append(b.slice(cut))
            if sum(x.num_rows for x in held) > HELD:
                open_digest = (d1[-1], d2[-1])
                yield settled(pa.Table.from_batches(held), True, open_digest)
                held = []
        if held:
            yield settled(pa.Table.from_batches(held), True, open_digest)

    found = every.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, "id long, rk long, at int, later int, d1 long, d2 int")
    found = materialize(found, "repeated-chunks")
    at_ends = found.where("d1 IS NOT NULL")
    totals = at_ends.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("id", "rk", "at")).alias("first")).where("n > 1")
    totals = F.broadcast(totals) if totals.count() <= EDGE_BROADCAST else totals
    at_ends = at_ends.join(totals, ["d1", "d2"]).select("id", "rk", "at", F.when(F.struct("id", "rk", "at") == F.col("first"), 0).otherwise(1).alias("later"))
    return found.where("d1 IS NULL").select("id", "rk", "at", "later").union(at_ends).select("id", "rk", (F.col("at") * 2 + F.col("later")).cast("int").alias("mark"))


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_chunks, n_repeated, n_removed, n_spans) for every row of docs.

    n_repeated: bytes in runs of chunks that occur anywhere else too, the same document included; n_removed:
    bytes in runs of chunks that occur before, in the order of id, text hash and place; n_spans: maximal removed
    runs; kept: the other bytes. Runs under MIN_RUN bytes don't count. A null text is empty; rows without
    an id take no part and stay whole; rows that share an id are told apart by their texts, and rows with
    one id and one text count as one document, whose chunks each of them repeats.
    """
    ids = docs.agg(F.count(id_col).alias("n"), F.countDistinct(id_col).alias("ids")).first()
    shared = ids.n > ids.ids
    rk = F.coalesce(F.nullif(F.xxhash64(text_col), F.lit(0)), F.lit(1)) if shared else F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), rk.cast("long").alias("key"), F.col(text_col).alias("text"))
    every = chunks(rows.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").alias("id"), F.col("key").alias("rk"), "text"))
    marks = repeated_chunks(every).groupBy("id", "rk").agg(F.collect_set("mark").alias("marks"))
    if shared:  # rows with one id and text may be very many
        marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        same = (F.col("doc_id") == F.col("id")) & (F.col("key") == F.col("rk")) & (F.col("part") == F.col("salt"))
    else:
        same = F.col("doc_id") == F.col("id")
    joined = rows.join(marks, same, "left").select("doc_id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, marks in zip(b.column(1), b.column(2), strict=True):
                raw = _bytes(text.as_py())
                out.append(_cut(raw, np.sort(marks.values.to_numpy()) if marks.is_valid else None))
            kept, *counts = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "kept", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_chunks long, n_repeated long, n_removed long, n_spans long")


def _long_runs(flags: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The flagged chunks whose run of flagged neighbours holds MIN_RUN bytes or more."""
    run = np.cumsum(np.append(True, flags[1:] != flags[:-1])) - 1
    return flags & (np.bincount(run, widths)[run] >= MIN_RUN)


def _cut(raw: bytes, marks: np.ndarray | None) -> tuple[bytes, int, int, int, int, int]:
    ends = chunk_ends(raw)
    if marks is None or not len(marks):
        return raw, len(raw), len(ends), 0, 0, 0
    widths = np.diff(ends, prepend=0)
    repeated, later = np.zeros(len(ends), bool), np.zeros(len(ends), bool)
    repeated[marks // 2] = True
    later[marks[marks % 2 == 1] // 2] = True
    repeated, later = _long_runs(repeated, widths), _long_runs(later, widths)
    removed = np.repeat(later, widths)
    spans = int((later & ~np.append(False, later[:-1])).sum())
    return np.frombuffer(raw, np.uint8)[~removed].tobytes(), len(raw), len(ends), int(widths[repeated].sum()), int(widths[later].sum()), spans

