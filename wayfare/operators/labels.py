"""Labels on a view: which features may have one, and a greedy choice without overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Padding of a label's box, the part of its height to each side, and the room of its mark to the left.
PADDING, HALF, MARK = 8.0, 0.65, 8.0


def renderable(kind: Column, importance: Column, min_zoom: Column) -> Column:
    """Whether a feature is labelled on the globe."""
    return F.when(kind == "airport", True).when(kind == "majorCity", (importance >= 0.76) & (min_zoom <= 8)).otherwise((importance >= 0.9) & (min_zoom <= 1))


def priority(kind: Column, importance: Column, distance_m: Column) -> Column:
    boost = F.when(kind == "airport", 1.55).when(kind == "landmark", 1.15).otherwise(1.0)
    return importance * boost - F.least(F.lit(1.8), distance_m / 450_000.0)


def select_visible(candidates: DataFrame, most: int) -> DataFrame:
    """(frame, label, place): labels in order of priority whose boxes don't overlap one chosen before, at most so many a frame.

    candidates: (frame, label, kind, importance, distance_m, x, y, width, height); equal priorities go by
    label. Rows are sorted by frame and priority and read as a stream that remembers only the boxes
    chosen in the current frame, so a frame may have any number of candidates.
    """
    rows = candidates.select("frame", "label", (-priority(F.col("kind"), F.col("importance"), F.col("distance_m"))).alias("p"), "x", "y", "width", "height")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame, chosen = None, np.empty((0, 4))
        for b in batches:
            frames, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            x, y, width, height = (b.column(i).to_numpy() for i in range(3, 7))
            box = np.column_stack([x - MARK - PADDING, x + width + PADDING, y - height * HALF - PADDING, y + height * HALF + PADDING])
            out = []
            for i, f in enumerate(frames):
                if f != frame:
                    frame, chosen = f, np.empty((0, 4))
                if len(chosen) >= most:
                    continue
                left, right, top, bottom = box[i]
                over = (np.maximum(chosen[:, 0], left) < np.minimum(chosen[:, 1], right)) & (np.maximum(chosen[:, 2], top) < np.minimum(chosen[:, 3], bottom))
                if not over.any():
                    chosen = np.vstack([chosen, box[i]])
                    out.append((f, names[i], len(chosen)))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["frame", "label", "place"])

    rows = rows.select(F.col("frame").cast("long").alias("frame"), "label", "p", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")))
    return rows.repartition("frame").sortWithinPartitions("frame", "p", "label").mapInArrow(run, "frame long, label string, place int")
