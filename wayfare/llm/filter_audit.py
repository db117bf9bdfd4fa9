"""How filters of a corpus interact: what each removes, repeats or alone catches, in every order of applying them.

Each document becomes one bit mask of the filters that it fails; only counts of masks go on. The mask
cells are unpivoted against the steps of every order, running bit-or windows tell what an earlier step
has removed already, conditional sums make the counts of a step, and a window over each filter's steps
adds up what it removes in all orders.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: One letter a filter, in the order of their bits.
FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """Bits 0 to 3 of the filters that look at one text: too short, repetitive, shouting, with symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.octet_length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long")
    conditions = (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.char_length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic), one row an id: whether any of its labels says so."""
    any_is = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(any_is("quality").alias("good"), any_is("toxic").alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents of each part by the filters that they fail.

    The fifth filter fails all but the smallest id of equal texts. Rows are first added up by id and
    text, then by text and part with their smallest id, so equal texts never meet row by row: a window
    over a text sees a few sums for each part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), failures(F.col("text")).alias("mask"))
    per_id = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    labelled = per_id.join(label_flags(labels), "doc_id", "left").fillna(False, ["good", "toxic"])
    # rows without an id fail nothing by it and take no text from others
    key = ["digest", "part", "mask", "good", "toxic"]
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    sums = labelled.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), least.alias("least"))
    first = F.col("least.doc_id") == F.min("least.doc_id").over(Window.partitionBy("digest"))
    sums = sums.withColumn("stay", F.col("nameless") + F.when(first, F.col("least.n")).otherwise(0))
    parts = F.array(F.struct(F.col("mask").alias("mask"), F.col("stay").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    cells = sums.select("part", "good", "toxic", F.inline(parts))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each language, order of the five filters and step, zeros included. docs: (doc_id, text,
    lang); labels: (doc_id, quality, toxic); further columns don't matter. Null texts are empty, a null
    lang is the empty part. Repeated rows count as often as they stand; equal texts under one id fail
    the fifth filter only if a smaller id has the text too, and rows without an id never fail it. Of
    several labels of an id, one that says 1 suffices; labels of ids without documents don't count. An
    empty table gives an empty result.
    """
    cells = materialize(mask_cells(docs, labels), "mask-cells")
    orders = F.array(*(F.lit("".join(p)) for p in itertools.permutations(FILTERS)))
    steps = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    steps = steps.withColumn("step", F.col("at") + 1).withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', filter) - 1)"))
    fails = F.col("mask").bitwiseAND(F.col("bit"))
    upto = Window.partitionBy("part", "mask", "filter_order").orderBy("step")
    before = F.coalesce(F.bit_or(fails).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("fails", fails > 0).withColumn("gone", before > 0)
    here = F.col("fails") & ~F.col("gone")
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0))
    done = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"),
        total(here).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    done = done.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return done.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
