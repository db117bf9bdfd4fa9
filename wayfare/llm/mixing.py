"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document waits in its source's queue, in an order shuffled by a hash. Its virtual finish time is
the source's cumulative size up to and with it, divided by the source's target weight; a source that is
short of its target queues up again, up to a maximal number of passes. All queued entries are sorted by
finish time over range partitions, whose sums tell in which one the total budget is spent; entries up to
there are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Documents of a source are counted in so many hash buckets, so that no task holds a whole source.
BUCKETS = 4096
#: A table of at most so many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_passes: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row a source.

    Sources in code-point order, null last, take the weights in turn. Targets share the total size by
    weight, but stop at max_passes times their source's size; the excess goes to the others by weight.
    With the sources sorted by size over weight, the full ones are a prefix of them: the level at which
    each source would be the last full one decides which they are. One row a source reaches the
    windows here, never one a document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = F.row_number().over(order) - 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", (max_passes * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the common level if all sources before this one, and none from it on, are full
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_weight"))
        .withColumn("holds", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level")))
        .withColumn("level", F.first("holds", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _place(doc_id: Column, size: Column, seed: str) -> tuple[Column, Column]:
    """Shuffle key and bucket of a row: its place in its source's queue."""
    shuffled = F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size)
    return shuffled, F.pmod(F.shiftright(shuffled, 40), F.lit(BUCKETS)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_passes: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for every row of docs.

    size: words of the text (null: 0). The budget is the sum of all sizes. taken: size times the number
    of passes that end within the budget, at most max_passes. Null sources form one source, last in
    order. Rows of size 0 are never taken. Ties in finish time fall to the smaller shuffle key and id;
    rows alike in all of these are interchangeable, and the same rows give the same result on each
    run, whatever their partitions. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"))
    shuffled, bucket = _place(F.col("doc_id"), F.col("size"), seed)
    rows = materialize(rows.withColumns({"shuffled": shuffled, "bucket": bucket}), "mix-rows")

    # cumulative sizes in two steps: over the buckets of a source, then within a bucket
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("source").orderBy("bucket")
    buckets = buckets.withColumn("ahead", F.sum("bucket_size").over(upto) - F.col("bucket_size"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_passes)
    ahead = buckets.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "ahead", "source_size", "weight", "target")
    within = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("upto", F.sum("size").over(within))
    queued = queued.alias("q").join(ahead.alias("a"), F.col("q.source").eqNullSafe(F.col("a.source")) & (F.col("q.bucket") == F.col("a.bucket")))
    queued = queued.select("doc_id", "size", "q.source", "source_size", "target", "weight", "shuffled", (F.col("upto") + F.col("ahead")).alias("upto"))
    queued = materialize(queued, "mix-queue")

    # virtual finish time of each pass; a global range sort by it, cut off where the budget is spent
    finish = [(F.col("upto") + k * F.col("source_size")) / F.col("weight") for k in range(max_passes)]
    entries = queued.where("size > 0").select("size", "shuffled", "doc_id", F.explode(F.array(*finish)).alias("time"))
    order = ["time", "shuffled", "doc_id", "size"]
    spread = materialize(entries.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    budget = queued.agg(F.sum("size").alias("budget")).first().budget or 0
    parts = spread.groupBy("part").agg(F.sum("size").alias("n"))  # one row a partition
    ahead = parts.withColumn("ahead", F.sum("n").over(Window.orderBy("part")) - F.col("n")).where(F.col("ahead") <= budget)
    last = ahead.agg(F.max(F.struct("part", "ahead")).alias("last")).first().last
    cut = None
    if last is not None:
        # partitions before the last one are within the budget; of that one, the entries up to the cut
        running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(last.ahead)
        inside = spread.where(F.col("part") <= last.part)
        here = inside.where(F.col("part") == last.part).withColumn("sum", running).where(F.col("sum") <= budget)
        cut = here.agg(F.max(F.struct("time", "shuffled", "doc_id")).alias("cut")).first().cut
        if cut is None:
            cut = inside.where(F.col("part") < last.part).agg(F.max(F.struct("time", "shuffled", "doc_id")).alias("cut")).first().cut
    if cut is None:
        taken = [F.lit(0) for _ in finish]
    else:
        end = F.struct(F.lit(cut.time), F.lit(cut.shuffled), F.lit(cut.doc_id).cast(docs.schema[id_col].dataType))
        taken = [F.when(F.struct(t, F.col("shuffled"), F.col("doc_id")) <= end, 1).otherwise(0) for t in finish]
    passes = sum(taken[1:], taken[0])
    return queued.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, passes * F.col("size")).otherwise(0).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_passes: int = 3, seed: str = "mix-1") -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken; rows without words are not taken.

    In a source's queue the mix takes every row so many times, and those up to a place once more. With
    ids of their own, rows find that out from their own place and one row about their source, so texts
    are not shuffled.

    Rows that share an id are told apart by their size and source; of rows alike in all three, as many
    are taken as the mix takes, those first by a hash of the text.
    """
    taken = mix(docs, weights, max_passes, seed=seed).where("size > 0").select("doc_id", "size", "source", (F.col("taken") / F.col("size")).cast("int").alias("passes"))
    taken = materialize(taken, "mix-taken")
    ids = taken.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    if ids.n == ids.ids:
        shuffled, bucket = _place(F.col("doc_id"), F.col("size"), seed)
        per_source = taken.withColumn("at", F.struct(bucket.alias("b"), shuffled.alias("s"), F.col("doc_id").alias("i")))
        per_source = per_source.groupBy(F.col("source").alias("__source")).agg(F.max("passes").alias("__most"), F.min("passes").alias("__least"), F.max_by("at", F.struct("passes", "at")).alias("__last"))
        per_source = materialize(per_source, "mix-sources")
        per_source = F.broadcast(per_source) if per_source.count() <= BROADCAST_ROWS else per_source
        rows = docs.withColumn("__n", word_count(F.col("text"))).where("__n > 0").join(per_source, F.col("source").eqNullSafe(F.col("__source")))
        shuffled, bucket = _place(F.col("doc_id"), F.col("__n"), seed)
        here = F.struct(bucket.alias("b"), shuffled.alias("s"), F.col("doc_id").alias("i"))
        rows = rows.withColumn("__times", F.when(here <= F.col("__last"), F.col("__most")).otherwise(F.col("__least"))).where("__times > 0")
    else:
        passes = taken.where("passes > 0").groupBy(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source")).agg(F.sort_array(F.collect_list("passes"), asc=False).alias("__passes"))
        each = Window.partitionBy("doc_id", "__n", "source").orderBy(F.xxhash64("text"))
        rows = docs.withColumn("__n", word_count(F.col("text"))).withColumn("__at", F.row_number().over(each).cast("int"))
        rows = rows.join(passes, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("__size")) & F.col("source").eqNullSafe(F.col("__source")))
        rows = rows.withColumn("__times", F.try_element_at("__passes", F.col("__at"))).where("__times > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns)
