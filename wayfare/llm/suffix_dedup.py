"""Removal of repeated byte strings by suffix sorting with the difference-cover algorithm, in groups dealt by Spark.

Every window of 200 bytes has an anchor, the run of 32 bytes in it with the least hash (the leftmost one
of equal ones), so equal windows have equal anchors. The stretch of a text whose windows share an anchor
is a context. Contexts of anchors that occur once can't repeat and drop out; equal contexts are counted
once, with their number; all others are dealt to tasks by anchor. There the suffixes of a group's
contexts are sorted with the difference-cover algorithm: sampled triples get names, the string of names
is sorted recursively, the other suffixes are merged in, and neighbours in the order compare their first
200 bytes. Repeated windows then go back to all documents that hold the context. A group too large for
a task is cut into bands of windows at like distances from the anchor, which share a longer core and are
dealt by that; the narrowest band is one window, so no group stays large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a repeated string and of an anchor.
WINDOW, ANCHOR = 200, 32
#: Different contexts of one anchor that a task sorts; beyond, they are cut into bands of so many windows, then narrower ones.
HOT_ANCHOR, BANDS = 2500, (24, 3, 1)
#: A key is hot if it holds over one in so many rows, so hot keys are fewer than that and are broadcast; parts into which other possibly large groups are dealt.
HOT_SHARE, SALTS = 5000, 16
#: Symbols sorted at a time, few enough for a processor's cache (three keys of 20 bits fit a word), and window starts looked at at a time.
SORTED, BLOCK = 120_000, 1 << 22

_TABLE = np.random.default_rng(200).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _run_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ANCHOR bytes."""
    h, width = _TABLE[raw], 1
    while width < ANCHOR:
        h = h[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def contexts(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, windows, anchor's place behind that start) of a text's contexts, by blocks of bounded size."""
    found = []
    every = np.frombuffer(raw, np.uint8)
    for at in range(0, len(raw) - WINDOW + 1, BLOCK):
        part = every[at : at + BLOCK + WINDOW - 1]
        h = _run_hashes(part)
        keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        least, width, reach = keyed, 1, WINDOW - ANCHOR + 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(part) - WINDOW + 1
        anchor = (np.minimum(least[:n], least[reach - width : reach - width + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        found.append((h[anchor[first]].view(np.int64), first + at, np.diff(first, append=n), anchor[first] - first))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- the difference-cover suffix sort ----------------------------------------------------------------


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the keys, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def _between(among: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """How many of among are below each rank, plus how many are not above it; all are small whole numbers from 1."""
    upto = np.cumsum(np.bincount(among, minlength=int(ranks.max(initial=0)) + 1))
    return upto[ranks - 1] + upto[ranks]


def suffix_keys(s: np.ndarray, depth: int) -> np.ndarray:
    """Keys whose order is that of the suffixes of s (symbols from 1, fewer than 2**20, 0 ends a string).

    Suffixes that differ in their first depth symbols are in lexicographic order; those that agree in
    them stand together.
    """
    n = len(s)
    padded = np.concatenate((s, np.zeros(3, np.int64)))
    triple = lambda i: (padded[i] << 40) | (padded[i + 1] << 20) | padded[i + 2]
    if depth <= 3 or n < 3:
        return triple(np.arange(n))
    one, two, none = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    # names of the sampled triples, and the ranks of the sampled suffixes from the string of names
    names = _dense(triple(np.concatenate((one, two))))
    if names.max() < len(names):
        deeper = _dense(suffix_keys(np.concatenate((names[: len(one)], [0], names[len(one) :])), -(-depth // 3)))
        names = np.concatenate((deeper[: len(one)], deeper[len(one) + 1 :]))
    rank = np.zeros(n + 3, np.int64)
    rank[one], rank[two] = names[: len(one)], names[len(one) :]
    # the rest against the ones at 1 mod 3, by a symbol and the rank behind it ...
    wide = int(names.max()) + 1
    by_one = _dense(np.concatenate((padded[none] * wide + rank[none + 1], padded[one] * wide + rank[one + 1])))
    place = np.zeros(n + 3, np.int64)
    place[none], place[one] = by_one[: len(none)], by_one[len(none) :]
    # ... and against those at 2 mod 3, by a symbol and the place of the suffix behind it
    wide = int(by_one.max()) + 1
    none_two, two_two = padded[none] * wide + place[none + 1], padded[two] * wide + place[two + 1]
    by_two = _dense(np.concatenate((two_two, none_two)))
    among_one, among_two = np.empty(n, np.int64), np.empty(n, np.int64)
    among_one[none], among_two[none] = _between(place[one], place[none]), _between(by_two[: len(two)], by_two[len(two) :])
    for x in (one, two):
        among_one[x], among_two[x] = _between(rank[one], rank[x]), _between(rank[two], rank[x])
    among_three = np.zeros(n, np.int64)
    among_three[none] = place[none]
    merged = among_one * (2 * len(two) + 1) + among_two
    return merged * (int(among_three.max()) + 1) + among_three


def repeated_windows(pieces: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """For each piece, the starts of its WINDOW-byte strings that occur elsewhere in the pieces or whose piece counts over once."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"\0".join(pieces) + b"\0" * WINDOW, np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = text[: int(starts[-1] + lengths[-1])].astype(np.int64) + 1
    symbols[starts[1:] - 1] = 0
    owner = np.repeat(np.arange(len(pieces)), lengths - WINDOW + 1)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths - WINDOW + 1) - (lengths - WINDOW + 1), lengths - WINDOW + 1)
    where = starts[owner] + at
    order = np.argsort(suffix_keys(symbols, WINDOW)[where], kind="stable")
    windows = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    same = np.zeros(len(order), bool)  # whether a suffix agrees with the one before
    for lo in range(1, len(order), 1 << 15):
        a = where[order[lo - 1 : lo - 1 + (1 << 15)]]
        b = where[order[lo : lo + (1 << 15)]]
        same[lo : lo + len(b)] = (windows[a[: len(b)]] == windows[b]).all(1)
    group = np.cumsum(~same) - 1
    often = np.bincount(group, counts[owner[order]])[group] >= 2
    hit = np.zeros(len(order), bool)
    hit[order[often]] = True
    cuts = np.cumsum(lengths - WINDOW + 1)[:-1]
    return [np.flatnonzero(x) for x in np.split(hit, cuts)]


def runs_of(starts: np.ndarray) -> np.ndarray:
    """first, last, first, last, ... of the runs of consecutive starts."""
    if not len(starts):
        return np.empty(0, np.int32)
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return np.column_stack((starts[np.concatenate(([0], breaks + 1))], starts[np.concatenate((breaks, [len(starts) - 1]))])).ravel().astype(np.int32)


# ---- Spark jobs --------------------------------------------------------------------------------------


def _anchors(rows: DataFrame) -> DataFrame:
    """(g, copies): the anchors of each text, and how many rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [contexts(_bytes(t.as_py()))[0] for t in b.column(0)]
            copies = np.repeat(b.column(1).to_numpy(), [len(g) for g in got])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got or [np.empty(0, np.int64)])), pa.array(copies)], names=["g", "copies"])

    return rows.select("text", "copies").mapInArrow(run, "g long, copies long")


def _occurrences(rows: DataFrame) -> DataFrame:
    """(g, c1, c2, id, at, n, p, copies): anchor, context digest, document, first window, number of windows, the anchor's place and the rows that have the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, columns = [], []
            for i, text, copies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                raw = _bytes(text.as_py())
                g, at, n, p = contexts(raw)
                digests += [xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(at.tolist(), (at + n + WINDOW - 1).tolist(), strict=True)]
                columns.append((g, np.full(len(g), i, np.int64), at.astype(np.int32), n.astype(np.int32), p.astype(np.int32), np.full(len(g), copies, np.int64)))
            if columns:
                g, ids, at, n, p, k = (np.concatenate(x) for x in zip(*columns, strict=True))
                words = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, words[:, 0], words[:, 1], ids, at, n, p, k)], names=["g", "c1", "c2", "id", "at", "n", "p", "copies"])

    return rows.select("id", "text", "copies").mapInArrow(run, "g long, c1 long, c2 long, id long, at int, n int, p int, copies long")


def _with_texts(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """(text, want): the contexts of wanted, listed with the document that they are cut from."""
    per_doc = wanted.groupBy(F.col("id").alias("from")).agg(F.collect_list(F.struct(*columns)).alias("want"))
    return rows.join(per_doc, F.col("id") == F.col("from")).select("text", "want")


def _context_bytes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, c1, c2, times, piece) for the contexts of wanted, cut from one document that holds them."""
    joined = _with_texts(rows, wanted, ["g", "c1", "c2", "times", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, want in zip(b.column(0), b.column(1), strict=True):
                raw, (g, c1, c2, times, at, n) = _bytes(text.as_py()), want.values.flatten()
                pieces = [raw[a : a + k + WINDOW - 1] for a, k in zip(at.to_pylist(), n.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([g, c1, c2, times, pa.array(pieces, pa.binary())], names=["g", "c1", "c2", "times", "piece"])

    return joined.mapInArrow(run, "g long, c1 long, c2 long, times long, piece binary")


def _sorted_groups(pieces: DataFrame) -> DataFrame:
    """(g, c1, c2, runs) of the contexts with repeated windows, by suffix sorting whole groups together."""

    def find(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        found = repeated_windows(rows.column("piece").to_pylist(), rows.column("times").to_numpy())
        hit = np.fromiter((len(x) > 0 for x in found), bool, len(found))
        runs = pa.array([runs_of(x) for x in found if len(x)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().filter(pa.array(hit)) for c in ("g", "c1", "c2")), runs], names=["g", "c1", "c2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            g = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
            sizes = np.add.reduceat(np.fromiter((len(p) + 1 for p in b.column(4).to_pylist()), np.int64, b.num_rows), edges[:-1])
            for lo, hi, k in zip(edges[:-1].tolist(), edges[1:].tolist(), sizes.tolist(), strict=True):
                if held and size + k > SORTED and g[lo] != last:
                    yield find(held)
                    held, size = [], 0
                held.append(b.slice(lo, hi - lo))
                size, last = size + k, g[lo]
        if held:
            yield find(held)

    return pieces.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, c1 long, c2 long, runs array<int>")


def band_pieces(raw: bytes, at: int, n: int, p: int, width: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(band, core, first window, windows) of a context: windows whose starts are alike far before the anchor, to width bytes, and the bytes that all of them cover."""
    anchor = at + p
    while n > 0:
        band = (anchor - at) // width
        k = min(n, anchor - band * width - at + 1)
        yield band, raw[anchor - band * width : anchor + WINDOW - (band + 1) * width + 1], at, k
        at, n = at + k, n - k


def _bands(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The contexts of wanted cut into bands: (pg, pc1, pc2, shift) of the context, and the band as a context (g, c1, c2, times, id, at, n, p) whose anchor is its core."""
    joined = _with_texts(rows, wanted, ["g", "c1", "c2", "times", "id", "at", "n", "p"])
    names = ["pg", "pc1", "pc2", "shift", "g", "c1", "c2", "times", "id", "at", "n", "p"]
    kinds = [pa.int32() if x in ("shift", "at", "n", "p") else pa.int64() for x in names]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, want in zip(b.column(0), b.column(1), strict=True):
                raw, out = _bytes(text.as_py()), []
                for w in want.values.to_pylist():
                    for band, core, at, k in band_pieces(raw, w["at"], w["n"], w["p"], width):
                        digest = np.frombuffer(xxhash.xxh3_128_digest(raw[at : at + k + WINDOW - 1]), np.int64)
                        out.append((w["g"], w["c1"], w["c2"], at - w["at"], signed(xxhash.xxh3_64_intdigest(core, band)), int(digest[0]), int(digest[1]), w["times"], w["id"], at, k, w["at"] + w["p"] - at))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, ", ".join(f"{x} {'int' if x in ('shift', 'at', 'n', 'p') else 'long'}" for x in names))


def _hot_bound(total: int) -> int:
    return max(total // HOT_SHARE, 1000)


def _join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows (id, at, ...) joined to keyed, whose column n says how many rows have the key; n goes.

    Keys of over total / HOT_SHARE rows, of which there can be HOT_SHARE at most, are known to every
    task and dealt to as many parts as they hold that number of rows, so no task gets all rows of one.
    """
    bound = _hot_bound(total)
    parts = F.ceil(F.col(n) / bound).cast("int")
    hot = keyed.where(F.col(n) > bound).select(*on, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "at"), "__parts")).cast("int")).drop("__parts")
    return dealt.join(keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n), [*on, "__part"], how).drop("__part")


def _salted(rows: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    """rows semi- or anti-joined to keyed by g, each g dealt to SALTS parts by the context."""
    keyed = keyed.select("g", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int")).join(keyed, ["g", "salt"], how).drop("salt")


def _repeated(rows: DataFrame, wanted: DataFrame, widths: tuple[int, ...] = BANDS) -> DataFrame:
    """(g, c1, c2, runs) of the contexts of wanted (g, c1, c2, times, id, at, n, p) that have repeated windows."""
    hot = materialize(wanted.groupBy("g").count().where(f"count > {HOT_ANCHOR}").select("g"), "hot-anchors")
    if not widths or hot.isEmpty():  # bands of one window are alike if their cores are, so none of their groups is hot
        return _sorted_groups(_context_bytes(rows, wanted))
    parts = materialize(_bands(rows, _salted(wanted, hot, "left_semi"), widths[0]), "bands")
    inner = parts.groupBy("g", "c1", "c2").agg(F.sum("times").alias("times"), F.min(F.struct("id", "at", "n", "p")).alias("of")).select("g", "c1", "c2", "times", "of.*")
    often = inner.groupBy("g").agg(F.sum("times").alias("all")).where("all > 1").select("g")
    inner = materialize(_salted(inner, often, "left_semi"), "band-contexts")
    found = parts.join(_repeated(rows, inner, widths[1:]), ["g", "c1", "c2"])
    found = found.groupBy("pg", "pc1", "pc2").agg(F.flatten(F.collect_list(F.transform("runs", lambda x: x + F.col("shift")))).alias("runs")).toDF("g", "c1", "c2", "runs")
    return _sorted_groups(_context_bytes(rows, _salted(wanted, hot, "left_anti"))).unionByName(found)


def _once(texts: DataFrame) -> DataFrame:
    """texts (id, text, copies) with one row for each id, which here stands for one text; copies: the rows that have it."""
    often = materialize(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "repeated-rows")
    several = texts.join(often, "id").groupBy("id").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    return materialize(texts.join(often, "id", "left_anti").unionByName(several), "distinct-texts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans) for every row of docs.

    A byte goes if a string of WINDOW bytes that covers it starts anywhere else too, in the same text or
    another; strings are judged on the input. n_spans: maximal removed runs; kept: the other bytes.
    Null texts are empty. Repeated rows are copies of each other; where ids are null or shared, id and
    text tell rows apart. An empty table gives an empty result.
    """
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(id_col).alias("ids")).first()
    key = F.col(id_col).cast("long") if ids.n == ids.ids else F.xxhash64(F.lit(1), id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("id"), F.col(text_col).alias("text"))
    texts = rows.select("id", "text").withColumn("copies", F.lit(1).cast("long"))
    if ids.n != ids.ids:
        texts = _once(texts)
    long_ones = texts.where(F.octet_length("text") >= WINDOW)

    shared = materialize(_anchors(long_ones).groupBy("g").agg(F.sum("copies").alias("count")).where("count > 1"), "shared-anchors")
    total = shared.agg(F.sum("count")).first()[0] or 0
    found = materialize(_join_counted(_occurrences(long_ones), shared, ["g"], "count", total, "left_semi"), "occurrences")
    wanted = found.groupBy("g", "c1", "c2").agg(F.sum("copies").alias("times"), F.min(F.struct("id", "at", "n", "p")).alias("of"))
    wanted = materialize(wanted.select("g", "c1", "c2", "times", "of.*"), "contexts")
    often = wanted.where(F.col("times") > _hot_bound(total)).select("g", "c1", "c2", "times")  # HOT_SHARE rows at most
    flags = _repeated(long_ones, wanted).join(F.broadcast(often), ["g", "c1", "c2"], "left").fillna(1, "times")
    flags = materialize(flags, "flags")
    hits = _join_counted(found, flags, ["g", "c1", "c2"], "times", total).groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("at", "runs")).alias("hits"))
    joined = rows.join(hits, F.col("id") == F.col("of"), "left").select("doc_id", "text", "hits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_cut(_bytes(t.as_py()), h) for t, h in zip(b.column(1), b.column(2), strict=True)]
            kept, *counts = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def _cut(raw: bytes, hits: pa.Scalar) -> tuple[bytes, int, int, int]:
    if not hits.is_valid:
        return raw, len(raw), 0, 0
    at, runs = hits.values.flatten()
    flat, offsets = runs.flatten().to_numpy().astype(np.int64), np.diff(runs.offsets.to_numpy())
    base = np.repeat(at.to_numpy().astype(np.int64), offsets // 2)
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, base + flat[0::2], 1)
    np.add.at(change, base + flat[1::2] + WINDOW, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int((gone & ~np.append(False, gone[:-1])).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), spans
