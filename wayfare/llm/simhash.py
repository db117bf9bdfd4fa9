"""SimHash near-duplicates found with BK-trees.

Documents become 64-bit fingerprints (or several 64-bit words). Fingerprints that may lie within the
radius meet in shards; each shard's fingerprints form a BK-tree, whose children are keyed by their
integer Hamming distance to the parent, and each search follows only the edges whose key lies within
the radius of the distance to the node. Trees are dealt to the tasks by shard key rather than
broadcast, since all of them together grow with the corpus.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, words_of
from .components import components

#: Shards above this many distinct fingerprints are split by finer keys.
HOT_SHARD = 4000
#: Hot shards whose keys and first members are broadcast; more are joined by shuffle.
HOT_BROADCAST = 10_000
#: Pairs of query and node that are looked at together.
FRONTIER = 1 << 19


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; fewer words than width: of the whole sequence; no words: empty."""
    words = words_of((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hash64(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    return np.fromiter((hash64(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted."""
    return np.unique(shingle_hashes(text, 5))


def set_digest(hashes: np.ndarray) -> np.ndarray:
    """128 bits that stand for a sorted set of hashes, as two words."""
    return np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _mix(x: np.ndarray) -> np.ndarray:
    """Another 64-bit hash of a hash, for further fingerprint words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def set_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp0 .. fp3, s0, s1, n) of each row: the fingerprint, the digest and the size of its set of five-word shingles."""
    out = pa.schema([(name, pa.int64()) for name in ("id", *_NEAR, "s0", "s1", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.zeros((NEAR_WORDS + 3, b.num_rows), np.uint64)
            for i, text in enumerate(b.column(1)):
                hashes = shingle_set(text.as_py())
                got[NEAR_WORDS : NEAR_WORDS + 2, i] = set_digest(hashes)
                got[NEAR_WORDS + 2, i] = len(hashes)
                for k in range(NEAR_WORDS):
                    hashes = _mix(hashes) if k else hashes
                    got[k, i] = fingerprint_of(hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.view(np.int64)) for x in got)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{f.name} long" for f in out))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n_words: int = 1) -> DataFrame:
    """(id, fp0 .. fp{n_words-1}), the fingerprint words of each row as longs. Null and empty texts get zeros."""
    out = pa.schema([("id", pa.int64()), *((f"fp{i}", pa.int64()) for i in range(n_words))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.zeros((n_words, b.num_rows), np.uint64)
            for i, text in enumerate(b.column(1)):
                hashes = shingle_hashes(text.as_py(), width)
                for k in range(n_words):
                    hashes = _mix(hashes) if k else hashes
                    got[k, i] = fingerprint_of(hashes)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.view(np.int64)) for x in got)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{f.name} long" for f in out))


# ---- BK-trees ----------------------------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of fingerprint words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """A BK-tree for each shard; all trees grow level by level with array operations.

    fps: (n, words) uint64, distinct within a shard; shard: (n,) non-decreasing. The first
    fingerprint of a shard is its root. Edges are kept sorted by (parent, distance).
    """

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps, self.bits = fps, 64 * fps.shape[1] + 1
        first = np.concatenate(([True], shard[1:] != shard[:-1]))
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1]
        items = np.flatnonzero(~first)
        at = self.root[items]
        keys, children = [], []
        while len(items):
            key = at * self.bits + distance(fps[items], fps[at])
            found, lead, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(found)
            children.append(items[lead])
            rest = np.ones(len(items), bool)
            rest[lead] = False
            items, at = items[rest], items[lead][back[rest]]
        self.key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(self.key, kind="stable")
        self.key = self.key[order]
        self.child = (np.concatenate(children) if children else np.empty(0, np.int64))[order]

    def pairs(self, radius: int, rest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (larger, smaller index) within the radius and one shard, in blocks of bounded size.

        rest: only pairs of one of these (sorted indices) and any other, the one of rest first.
        """
        every = rest is None
        rest = np.arange(len(self.fps)) if every else rest
        todo = [rest[i : i + 4096] for i in range(0, len(rest), 4096)][::-1]
        stack = [(q, self.root[q]) for q in todo]
        while stack:
            query, node = stack.pop()
            d = distance(self.fps[query], self.fps[node])
            hit = (d <= radius) & ((node < query) if every else (node != query))
            if hit.any():
                yield query[hit], node[hit]
            lo = np.searchsorted(self.key, node * self.bits + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, node * self.bits + np.minimum(d + radius, self.bits - 1), "right")
            width = hi - lo
            keep = width > 0
            query, lo, width = query[keep], lo[keep], width[keep]
            if not len(query):
                continue
            cuts = np.searchsorted(np.cumsum(width), np.arange(FRONTIER, int(width.sum()), FRONTIER))
            for q, a, w in zip(np.split(query, cuts), np.split(lo, cuts), np.split(width, cuts), strict=True):
                if len(q):
                    offset = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                    stack.append((np.repeat(q, w), self.child[np.repeat(a, w) + offset]))


def _roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = label[x]
    while True:
        up = label[x]
        if (up == x).all():
            return x
        x = up


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the classes of a[i] and b[i]; a class is named by its least index."""
    while len(a):
        a, b = _roots(label, a), _roots(label, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def shard_links(fps: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for each class of linked fingerprints of a shard: indices (member, least member)."""
    label = np.arange(len(fps))
    forest = Forest(fps, shard)
    # those within the radius of their root need not be searched for each other
    near = distance(fps, fps[forest.root]) <= radius
    label[near] = forest.root[near]
    for a, b in forest.pairs(radius, np.flatnonzero(~near)):
        join_labels(label, a, b)
    label = _roots(label, label)
    member = np.flatnonzero(label != np.arange(len(fps)))
    return member, label[member]


def _links_of_groups(links):
    """A mapInArrow function over rows sorted by their first column, the key: rows (a, b) of what links(rows of whole keys) finds."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(rows: pa.Table) -> pa.RecordBatch:
            a, b = links(rows)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield found(pa.Table.from_batches(held))
                held = []
            if last:
                yield found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _links_of_sorted(radius: int, n_words: int):
    """A mapInArrow function over rows (key, id, fp0..) sorted by key: rows (a, b) of linked ids."""

    def links(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        key, ids, *words = (rows.column(i).to_numpy() for i in range(2 + n_words))
        fps = np.column_stack([w.view(np.uint64) for w in words])
        shard = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        a, b = shard_links(fps, shard, radius)
        return ids[a], ids[b]

    return _links_of_groups(links)


def _bits(word: str, lo: int, n: int) -> Column:
    return F.shiftrightunsigned(F.col(word), lo).bitwiseAND(F.lit((1 << n) - 1))


def _packed(at: int, value: Column, width: int) -> Column:
    return F.lit(at << width) + value


def block_keys() -> list[Column]:
    """Three blocks of 22, 21 and 21 bits: fingerprints at 2 differing bits or fewer agree on one at least."""
    return [_packed(i, _bits("fp0", lo, n), 22) for i, (lo, n) in enumerate(((0, 22), (22, 21), (43, 21)))]


def fine_keys() -> list[Column]:
    """Each choice of 6 of 8 bytes: fingerprints at 2 differing bits or fewer agree on one choice at least.

    The bits left over bound a shard at 2**16 distinct fingerprints, whatever the corpus.
    """
    keys = []
    for i, chosen in enumerate(itertools.combinations(range(8), 6)):
        value = F.lit(0).cast("long")
        for at, byte in enumerate(chosen):
            value = value.bitwiseOR(F.shiftleft(_bits("fp0", 8 * byte, 8), 8 * at))
        keys.append(_packed(i, value, 48))
    return keys


def _keyed(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select(F.explode(F.array(*keys)).alias("key"), *[c for c in rows.columns if c != "key"])


def link_within_two(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b) between the ids of distinct fingerprints (id, fp0) at 2 differing bits or fewer.

    Every link within a shard is found through its BK-tree; of each class of linked fingerprints a
    spanning star is returned, so that no more rows than members leave a shard. Shards over HOT_SHARD
    fingerprints are dealt anew by finer keys, whose shards have a fixed bound.
    """
    keyed = _keyed(distinct_fps.select("id", "fp0"), block_keys())
    sizes = keyed.groupBy("key").count().where("count > 1")
    sizes = materialize(sizes, "shards")
    run = _links_of_sorted(2, 1)

    def search(x: DataFrame) -> DataFrame:
        return x.select("key", "id", "fp0").repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")

    links = search(keyed.join(sizes.where(f"count <= {HOT_SHARD}").select("key"), "key", "left_semi"))
    hot = sizes.where(f"count > {HOT_SHARD}")
    if not hot.isEmpty():
        members = keyed.join(hot.select("key"), "key", "left_semi").select("id", "fp0").distinct()
        finer = _keyed(members, fine_keys())
        shared = finer.groupBy("key").count().where("count > 1").select("key")
        links = links.union(search(finer.join(shared, "key", "left_semi")))
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp0, component_id) for every row of docs: 3-word shingles, links at 2 differing bits or fewer.

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows whose id is
    repeated stay separate rows; a null id stays null and links like any other, but never names a
    component: one without any id is null. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp0").agg(F.min("id").alias("id")), "distinct-fps")
    # a fingerprint goes by its least id, so that the least vertex of a component is its name
    known = distinct.agg(F.max("id").alias("top"), F.count_if(F.col("id").isNull()).alias("nameless")).first()
    if known.nameless:
        above = F.lit(known.top or 0) + 1 + F.monotonically_increasing_id()
        distinct = materialize(distinct.withColumn("id", F.coalesce("id", above)), "named-fps")
    members = materialize(components(link_within_two(distinct)), "components").withColumnRenamed("vertex", "id")
    classes = distinct.join(members, "id", "left").select("fp0", F.coalesce("component", "id").alias("component_id"))
    if known.nameless:
        classes = classes.withColumn("component_id", F.when(F.col("component_id") <= (known.top if known.top is not None else -1), F.col("component_id")))
    return fps.join(classes, "fp0").select(F.col("id").alias("doc_id"), "fp0", "component_id")


# ---- near copies of whole documents, for the pipeline --------------------------------------------

#: Fingerprint words of a document, bands of sampled bits, and bits of a band.
NEAR_WORDS, N_BANDS, BAND_BITS = 4, 128, 13
#: Candidates differ in so many of the 256 bits at most.
NEAR_RADIUS = 66
#: Distinct sets and shingles of a block, the unit in which candidates are compared; sets that a candidate group of several blocks is first compared with.
BLOCK_SETS, BLOCK_SHINGLES, PIVOTS = 512, 1 << 19, 16
_MASKS = [f"m{w}" for w in range(NEAR_WORDS)]
_NEAR = [f"fp{w}" for w in range(NEAR_WORDS)]


def _bit_masks(bits: np.ndarray) -> list[int]:
    """Masks of the words of a fingerprint that select the given bits, as signed longs."""
    return [int(np.bitwise_or.reduce(np.uint64(1) << (bits[bits // 64 == w] % 64).astype(np.uint64), initial=np.uint64(0)).view(np.int64)) for w in range(NEAR_WORDS)]


def band_masks() -> list[tuple[int, ...]]:
    """Rows (band, masks) of fixed random choices of bits, one for each band."""
    rng = np.random.default_rng(20)
    return [(band, *_bit_masks(rng.permutation(64 * NEAR_WORDS)[:BAND_BITS])) for band in range(N_BANDS)]


def _band_keys(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """rows with a key for each of the masks."""
    names = ["band", *_MASKS]
    each = rows.withColumn("m", F.explode(F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for v, n in zip(m, names, strict=True))) for m in masks)))).select("*", "m.*")
    return each.select(F.xxhash64(F.col("band").cast("int"), *(F.col(w).bitwiseAND(F.col(m)) for w, m in zip(_NEAR, _MASKS, strict=True))).alias("key"), "id", *_NEAR)


def candidate_classes(fps: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """(fp0 .. fp3, id, component_id) of the distinct fingerprints of fps (id, fp0 .. fp3): their least id and that of their class.

    Classes of candidates, in which near copies are then looked for: sets of Jaccard similarity 0.8 differ
    in about 39 of the 256 bits of a SimHash (standard deviation 6), so the radius of 66 takes in all but
    some in a million of them. Candidates meet in shards keyed by 128 choices of 13 bits, and BK-trees
    find the links within a shard. In a shard over HOT_SHARD, members within the radius of its least
    fingerprint are linked to that one directly; the others meet each other and those in blocks, so that
    every pair within the radius is linked as in a smaller shard and no task holds more than two blocks.
    """
    distinct = materialize(fps.groupBy(*_NEAR).agg(F.min("id").alias("id")).where("id IS NOT NULL"), "distinct-fps")
    # ids of documents stand for their fingerprints from here on
    keyed = _band_keys(distinct, band_masks())
    hot = materialize(keyed.groupBy("key").count().where(f"count > {HOT_SHARD}").select("key"), "hot-shards")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= HOT_BROADCAST else hot
    run = _links_of_sorted(radius, NEAR_WORDS)

    def search(x: DataFrame) -> DataFrame:
        return x.select("key", "id", *_NEAR).repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")

    links = search(keyed.join(hot, "key", "left_anti") if n_hot else keyed)
    if n_hot:
        members = keyed.join(hot, "key")
        pivots = members.groupBy("key").agg(F.min(F.struct("id", *_NEAR)).alias("pivot"))
        members = members.join(F.broadcast(pivots) if n_hot <= HOT_BROADCAST else pivots, "key")
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"pivot.{w}"))) for w in _NEAR), F.lit(0))
        members = materialize(members.select(F.col("key").alias("shard"), "id", *_NEAR, F.col("pivot.id").alias("pivot"), (apart <= radius).alias("main")), "hot-members")
        links = links.union(members.where("main AND id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
        blocks = lambda main: F.ceil(F.count_if(F.col("main") == main) / (HOT_SHARD / 2)).cast("int")
        sizes = materialize(members.groupBy("shard").agg(blocks(False).alias("n_rest"), blocks(True).alias("n_main")), "hot-blocks")
        links = links.union(search(block_pairs(members.drop("pivot"), "shard", sizes)))
    linked = components(links.distinct()).withColumnRenamed("vertex", "id")
    return distinct.join(linked, "id", "left").select(*_NEAR, "id", F.coalesce("component", "id").alias("component_id"))


def alike_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices (larger, smaller) of all pairs of distinct sorted hashes with a Jaccard similarity of 0.8 or more."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    token, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    shared = np.zeros(n * n, np.int32)
    # at: places whose run of equal hashes goes on for another step
    at = np.arange(len(token) - 1)
    step = 1
    while len(at):
        at = at[at + step < len(token)]
        at = at[token[at] == token[at + step]]
        np.add.at(shared, owner[at + step] * n + owner[at], 1)
        step += 1
    found = np.flatnonzero(shared)
    a, b = found // n, found % n
    near = 9 * shared[found].astype(np.int64) >= 4 * (size[a] + size[b])  # shared >= 0.8 * (both - shared)
    return a[near], b[near]


def _alike_of_groups(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the near copies in each run of rows (key, id, hashes) of one key."""
    key, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    hashes = rows.column(2)
    cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for lo, hi in itertools.pairwise(cuts.tolist()):
        label = np.arange(hi - lo)
        join_labels(label, *alike_pairs([np.frombuffer(hashes[i].as_py(), np.uint64) for i in range(lo, hi)]))
        label = _roots(label, label)
        out.append((ids[lo:hi], ids[lo:hi][label]))
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a[a != b], b[a != b]


def _alike(dealt: DataFrame) -> DataFrame:
    """(a, b): links between ids of near copies that share a key of dealt (key, id, hashes)."""
    return dealt.select("key", "id", "hashes").repartition("key").sortWithinPartitions("key", "id").mapInArrow(_links_of_groups(_alike_of_groups), "a long, b long")


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _to(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def block_pairs(rows: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """rows with a key for each pair of blocks in which they meet the others of their group.

    rows: (group, id, main, ...); sizes: (group, n_rest, n_main), the numbers of blocks. Any two rows of
    a group meet under a key unless both are main ones, which need not meet. No block grows with the group.
    """
    rows = rows.join(F.broadcast(sizes) if sizes.count() <= HOT_BROADCAST else sizes, group)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("n_main")).otherwise(F.greatest("n_rest", F.lit(1)))).cast("int"))
    keep = [c for c in rows.columns if c not in ("n_rest", "n_main", "block")]
    key = lambda kind, i, j: F.xxhash64(F.col(group), F.lit(kind), i, j).alias("key")
    rest, main = rows.where("NOT main"), rows.where("main AND n_rest > 0")
    own = rest.withColumn("other", _to(F.col("n_rest"))).select(key("rest", F.least("block", "other"), F.greatest("block", "other")), *keep)
    cross = rest.where("n_main > 0").withColumn("other", _to(F.col("n_main"))).select(key("main", F.col("block"), F.col("other")), *keep)
    return own.union(cross).union(main.withColumn("other", _to(F.col("n_rest"))).select(key("main", F.col("other"), F.col("block")), *keep))


def distinct_sets(prints: DataFrame) -> tuple[DataFrame, bool]:
    """(vertex, id, s0, s1, n, fp0 .. fp3): each distinct shingle set by its least id, and whether different sets share ids.

    vertex names a set in graphs: the id, or a number of its own where ids are shared.
    """
    sets = materialize(prints.where("id IS NOT NULL").groupBy("s0", "s1").agg(F.min("id").alias("id"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in _NEAR)), "sets")
    ids = sets.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).first()
    if ids.n == ids.ids:
        return sets.withColumn("vertex", F.col("id")), False
    return materialize(sets.withColumn("vertex", F.monotonically_increasing_id()), "numbered-sets"), True


def _hashed(texts: DataFrame, keep: list[str]) -> DataFrame:
    """texts (text, ...) as the columns to keep, the digest s0, s1 and the sorted hashes of each text's shingle set."""
    own = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(0)]
            digests = np.array([set_digest(h) for h in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([h.tobytes() for h in sets], pa.binary())], names=[*keep, "t0", "t1", "hashes"])

    return texts.select("text", *keep).mapInArrow(run, f"{own + ', ' if own else ''}t0 long, t1 long, hashes binary")


def near_duplicate_links(docs: DataFrame, sets: DataFrame, shared: bool, id_col: str, text_col: str, radius: int = NEAR_RADIUS) -> DataFrame:
    """(a, b): links that connect all near copies among the distinct_sets, by vertex.

    Candidate groups come from SimHash; within a group every pair of sets is settled by its exact
    Jaccard similarity, all in one block if the group is small. A larger group is first compared with
    PIVOTS of its sets; then all pairs of its blocks meet, but for those within the class that came out
    largest, which the pivots have linked already.
    """
    sets = sets.select(F.col("id").alias("doc"), F.col("vertex").alias("id"), "s0", "s1", "n", *_NEAR)
    classes = candidate_classes(sets, radius)
    grouped = sets.join(classes.select(*_NEAR, F.col("component_id").alias("group")), _NEAR)
    grouped = materialize(grouped.select("group", "doc", "id", "s0", "s1", "n"), "candidates")
    several = materialize(grouped.groupBy("group").agg(F.count("*").alias("count"), F.sum("n").alias("total")).where("count > 1").select("group", _blocks(F.col("count"), F.col("total")).alias("blocks")), "groups")
    wanted = grouped.join(several, "group")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    columns = ["group", "id", "n", "hashes", "blocks"]
    if shared:  # an id does not tell which text it is, but the digest does
        found = _hashed(texts.where("doc IS NOT NULL"), []).groupBy("t0", "t1").agg(F.min("hashes").alias("hashes"))
        members = wanted.join(found, (F.col("s0") == F.col("t0")) & (F.col("s1") == F.col("t1"))).select(*columns)
    else:
        keep = ["group", "id", "s0", "s1", "n", "blocks"]
        found = _hashed(texts.join(wanted.hint("merge"), "doc").select("text", *keep), keep)
        members = found.where("s0 = t0 AND s1 = t1").select(*columns)
    members = materialize(members, "candidate-sets")
    links = _alike(members.where("blocks = 1").withColumnRenamed("group", "key"))
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("id"), "id"))
    pivots = materialize(large.select("group", "id", "n", "blocks").withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("group", "id"), "pivots")
    led = large.join(F.broadcast(pivots) if pivots.count() <= HOT_BROADCAST else pivots, ["group", "id"], "left_semi")
    dealt = large.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).union(led.withColumn("block", _to(F.col("blocks"))))
    first = materialize(_alike(dealt.withColumn("key", F.xxhash64("group", "block"))), "pivot-links")
    labels = large.select("group", "id", "n").join(components(first).withColumnRenamed("vertex", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    labels = materialize(labels.select("group", "id", "n", "label"), "labels")
    largest = labels.groupBy("group", "label").count().groupBy("group").agg(F.max(F.struct("count", F.col("label"))).getField("label").alias("largest"))
    labels = labels.join(largest, "group").withColumn("main", F.col("label") == F.col("largest"))
    labels = materialize(labels.select("group", "id", "n", "main"), "labels")
    total = lambda main: [F.count_if(F.col("main") == main), F.coalesce(F.sum(F.when(F.col("main") == main, F.col("n"))), F.lit(0))]
    blocks = lambda main: F.when(total(main)[0] == 0, 0).otherwise(_blocks(*total(main)))
    sizes = materialize(labels.groupBy("group").agg(blocks(False).alias("n_rest"), blocks(True).alias("n_main")), "block-counts")
    dealt = block_pairs(large.select("group", "id", "hashes").join(labels.select("group", "id", "main"), ["group", "id"]), "group", sizes)
    return links.union(first).union(_alike(dealt))


def _named(docs: DataFrame, id_col: str, text_col: str, radius: int) -> tuple[DataFrame, DataFrame, bool]:
    """The prints of docs; (s0, s1, id, component_id, leads) of each distinct set that has an id; whether sets share ids.

    component_id is the least id of a class, leads tells the one set that stands for it.
    """
    prints = materialize(set_prints(docs, id_col, text_col), "fingerprints")
    sets, shared = distinct_sets(prints)
    linked = components(near_duplicate_links(docs, sets, shared, id_col, text_col, radius)).withColumnRenamed("vertex", "v")
    classes = sets.join(linked, F.col("vertex") == F.col("v"), "left").select("s0", "s1", "id", F.coalesce("component", "vertex").alias("component_id"))
    if not shared:
        return prints, classes.withColumn("leads", F.col("id") == F.col("component_id")), False
    classes = materialize(classes, "classes")
    first = classes.groupBy("component_id").agg(F.min(F.struct("id", "s0", "s1")).alias("first"))
    classes = classes.join(first, "component_id").select("s0", "s1", "id", F.col("first.id").alias("component_id"), (F.struct("id", "s0", "s1") == F.col("first")).alias("leads"))
    return prints, materialize(classes, "named-classes"), True


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = NEAR_RADIUS) -> DataFrame:
    """(doc_id, component_id) for documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and chains of them.

    Documents without words have no shingles and link only to each other. Rows that share an id are told
    apart by their shingles; a component is named by the least id in it. A null id stays null and links
    nothing, unless another document has the same shingles.
    """
    prints, classes, _ = _named(docs, id_col, text_col, radius)
    return prints.join(classes.drop("id", "leads"), ["s0", "s1"], "left").select(F.col("id").alias("doc_id"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = NEAR_RADIUS) -> DataFrame:
    """One row of docs for each group of near copies: that of the least id. Null ids stay.

    Rows that share an id are told apart by their shingles, so unrelated texts of one id all stay; of rows
    that share both, the one whose text, then whose other columns have the least hash stays.
    """
    prints, classes, shared = _named(docs, id_col, text_col, radius)
    keep = materialize(classes.where("leads").select(F.col("id").alias("__kept_id"), F.col("s0").alias("__s0"), F.col("s1").alias("__s1")), "kept-ids")
    nameless = docs.where(F.col(id_col).isNull())
    if shared or not prints.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        row = F.struct(*(F.col(c) for c in docs.columns))
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("__id"), F.struct(F.xxhash64(text_col), F.xxhash64(*docs.columns)).alias("__order"), row.alias("__row"))
        rows = _hashed(rows, ["__id", "__order", "__row"]).drop("hashes")
        same = (F.col("__id") == F.col("__kept_id")) & (F.col("t0") == F.col("__s0")) & (F.col("t1") == F.col("__s1"))
        kept = rows.join(keep.hint("merge"), same, "left_semi").groupBy("__id", "t0", "t1").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")
    else:
        # kept ids grow with the corpus, so they are never broadcast; the same join serves every size
        kept = docs.join(keep.hint("merge"), F.col(id_col) == F.col("__kept_id"), "left_semi")
    return kept.unionByName(nameless) if not prints.where("id IS NULL").isEmpty() else kept
