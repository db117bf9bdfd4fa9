"""Live positions on streams: decoding, late data, gaps, thinning, trip state, notices and upserts.

Every operator takes and gives streaming DataFrames. What depends on the last row kept is state of a
journey; the rules are those of wayfare.operators.live, so a stream and a batch give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import live, rows
from ..sources import messages

POINT = "journey string, ord long, ts timestamp, lat double, lon double, alt double, course double, speed double, accuracy double, source string"


def positions(stream: DataFrame, column: str = "value") -> DataFrame:
    """Accepted measured positions of a stream of messages (journey, ord, a JSON message): malformed and inaccurate ones go."""
    return live.accepted(messages.locations(stream, column))


def _stateful(stream: DataFrame, out: str, state: str, start: tuple, step: Callable[[tuple, Any], tuple[tuple, list[tuple]]]) -> DataFrame:
    """Fold each journey's rows in order of arrival: step(state, row) gives the next state and the rows to emit.

    A batch's rows of a journey come in order of ord, their order of arrival.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        emitted: list[tuple] = []
        for row in pd.concat(list(batches)).sort_values("ord", kind="stable").itertuples(index=False):
            now, some = step(now, row)
            emitted += [(key[0], *x) for x in some]
        held.update(now)
        yield pd.DataFrame(emitted, columns=names)

    return stream.groupBy("journey").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def _micros(ts: pd.Timestamp) -> int:
    return ts.value // 1000


def drop_late(stream: DataFrame) -> DataFrame:
    """(journey, ord, ts) of the points later than every one of their journey that arrived before; equal times are late."""

    def step(state: tuple, x: Any) -> tuple[tuple, list[tuple]]:
        t = _micros(x.ts)
        return ((t,), [(x.ord, x.ts)]) if t > state[0] else (state, [])

    return _stateful(stream.select("journey", "ord", "ts"), "journey string, ord long, ts timestamp", "top long", (-(1 << 62),), step)


def thin(stream: DataFrame) -> DataFrame:
    """(journey, ord) of the measured points to save, each held against the last saved one of its journey."""
    gps = stream.where("source = 'gps'").select("journey", "ord", "ts", "lat", "lon", "alt", "course")
    return _stateful(gps, "journey string, ord long", "seen int, t double, lat double, lon double, alt double, course double", live.NOT_SAVED, lambda last, x: live.save_step(last, x.ord, _micros(x.ts) / 1e6, x.lat, x.lon, x.alt, x.course))


def recorder_states(stream: DataFrame) -> DataFrame:
    """(journey, ord, state) after each signal (journey, ord, home_m, speed), from Idle on; the first rule that fits counts."""

    def step(state: tuple, x: Any) -> tuple[tuple, list[tuple]]:
        now, out = live.recorder_step(state[0], x.ord, x.home_m, x.speed)
        return (now,), out

    return _stateful(stream.select("journey", "ord", "home_m", "speed"), "journey string, ord long, state string", "state string", ("Idle",), step)


def recent(stream: DataFrame, n: int = 5000) -> DataFrame:
    """(journey, ord, dropped): every point, with the ord that falls out of the journey's buffer of the latest n points, if any."""

    def step(state: tuple, x: Any) -> tuple[tuple, list[tuple]]:
        held = [*state[0], int(x.ord)]
        return (held[-n:],), [(x.ord, held[0] if len(held) > n else None)]

    return _stateful(stream.select("journey", "ord"), "journey string, ord long, dropped long", "held array<bigint>", ([],), step)


def gap_states(ticks: DataFrame) -> DataFrame:
    """Ticks (journey, tick time, last position and its time of receipt) with status and the position moved on by dead reckoning."""
    gap = F.unix_micros("tick") / 1e6 - F.unix_micros("received") / 1e6
    return live.dead_reckon(ticks.withColumn("gap_s", gap))


def notices_once(stream: DataFrame, session: list[str], delay: str = "1 hour") -> DataFrame:
    """Each notice of a session once; state is kept for delay beyond the watermark."""
    found = F.array_compact(F.array(F.when(F.col("source").isin("estimated", "interpolated"), F.lit("gps-estimated")), F.when(F.col("storage_left") < live.LOW_STORAGE, F.lit("storage-low"))))
    due = stream.withWatermark("ts", delay).select(*session, "ts", "ord", F.explode(found).alias("id"))
    return due.dropDuplicatesWithinWatermark([*session, "id"])


def trips(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Extension: positions of a journey less than a gap apart as one trip, by session windows over a watermark."""
    s = stream.withWatermark("ts", delay).groupBy("journey", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("speed").alias("max_speed"))
    return s.select("journey", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n", "max_speed")


def upsert_batches(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a Parquet table at path with the last row of each key.

    Each batch writes a new version next to the old ones, named by its number, so that a batch that is
    run again after a failure replaces its own version only; latest() reads the newest.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = rows.last_wins(batch, keys, order)
        old = latest(spark, path, number)
        merged = new if old is None else rows.upsert(old, new, keys)
        merged.write.mode("overwrite").parquet(f"{path}/v{number:012d}")

    return run


def latest(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of an upserted table, or of those before a number; None where there is none."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(top) if f.getPath().getName().startswith("v"))
    done = [n for n in names if (before is None or int(n[1:]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None
