"""An outbound queue that delivers at least once: messages are sent again, ever more rarely, until they are acknowledged.

What is unacknowledged is state of a session, with the time of each next attempt. Time is that of the
events: a session's own rows move it on, and so do timers when the watermark passes the next attempt, so
a stream gives the same attempts however it is cut into batches. Attempts go to a ledger, a folder for
each batch; a batch that runs again after a failure replaces its own folder, and reading the ledger
keeps one row a message.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ATTEMPT = "session string, id long, attempt int, status string, at_us long, payload string"
_STATE = "id array<bigint>, attempt array<int>, due array<bigint>, payload array<string>"


class Pending:
    """The unacknowledged messages of a session, and the order in which they are due."""

    def __init__(self, held: tuple, first_s: float, attempts: int):
        self.first, self.attempts = int(first_s * 1e6), attempts
        self.of = {i: (attempt, due, payload) for i, attempt, due, payload in zip(*held, strict=True)}
        self.queue = [(due, i, attempt) for i, (attempt, due, _) in self.of.items()]
        heapq.heapify(self.queue)

    def _wait(self, message: int, attempt: int, at: int, payload: str | None) -> None:
        due = at + (self.first << (attempt - 1))
        self.of[message] = (attempt, due, payload)
        heapq.heappush(self.queue, (due, message, attempt))

    def send(self, message: int, at: int, payload: str | None) -> list[tuple]:
        if message in self.of:  # it is on its way
            return []
        self._wait(message, 1, at, payload)
        return [(message, 1, "sent", at, payload)]

    def acknowledge(self, message: int) -> None:
        self.of.pop(message, None)

    def until(self, now: int) -> list[tuple]:
        """Attempts due before now, in order; after the last one a message is given up."""
        out = []
        while self.queue and self.queue[0][0] < now:
            due, message, attempt = heapq.heappop(self.queue)
            held = self.of.get(message)
            if held is None or held[:2] != (attempt, due):  # acknowledged meanwhile
                continue
            if attempt < self.attempts:
                self._wait(message, attempt + 1, due, held[2])
                out.append((message, attempt + 1, "sent", due, held[2]))
            else:
                del self.of[message]
                out.append((message, attempt + 1, "dead", due, held[2]))
        return out

    def state(self) -> tuple:
        return ([*self.of], [x[0] for x in self.of.values()], [x[1] for x in self.of.values()], [x[2] for x in self.of.values()])


def attempts(stream: DataFrame, first_s: float = 60, most: int = 5, delay: str = "10 minutes") -> DataFrame:
    """(session, id, attempt, status, at_us, payload): every sending of the messages of a stream.

    stream: session string, id long, kind ('message' or 'ack'), payload string, ts timestamp. A message is
    sent when it comes and again first_s seconds later, then after twice, four times ... that wait, most
    times in all, unless its acknowledgement comes before; then its status is 'dead'. Rows of a session
    in one batch are taken in order of ts, messages first; rows without a session, id or ts are left out,
    and a message that is still waiting is not queued twice.
    """
    names = [x.split()[0] for x in ATTEMPT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        pending, out = Pending(held.get if held.exists else ([], [], [], []), first_s, most), []
        mark = held.getCurrentWatermarkMs()
        if held.hasTimedOut:
            out += pending.until(mark * 1000)
        else:
            # sorted as tuples: most sessions have few rows, for which a sort of columns costs more than the rest
            rows = [r for b in batches for r in zip(b["us"].tolist(), b["is_ack"].tolist(), b["id"].tolist(), b["payload"].tolist(), strict=True)]
            for us, ack, i, payload in sorted(rows, key=lambda r: r[:3]):
                out += pending.until(us)
                if ack:
                    pending.acknowledge(i)
                else:
                    out += pending.send(i, us, payload)
        if pending.of:
            held.update(pending.state())
            held.setTimeoutTimestamp(max(min(x[1] for x in pending.of.values()) // 1000, mark + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame([(key[0], *x) for x in out], columns=names)

    rows = stream.where("session IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("session", "id", (F.col("kind") == "ack").alias("is_ack"), F.unix_micros("ts").alias("us"), "payload", "ts")
    return rows.groupBy("session").applyInPandasWithState(run, ATTEMPT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ledger(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes a batch's attempts to a folder of its number."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return run


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """All attempts in a ledger's complete folders, with their batch."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(top)) if fs.exists(top) else []
    done = [f"{path}/{n}" for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], f"{ATTEMPT}, batch long")
    return spark.read.schema(f"{ATTEMPT}, batch long").option("basePath", path).parquet(*done)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(session, id, payload, tries, at_us): each message once, with the number of its sendings and the time of the first."""
    sent = ledger_rows(spark, path).where("status = 'sent'")
    return sent.groupBy("session", "id").agg(F.min_by("payload", "attempt").alias("payload"), F.max("attempt").alias("tries"), F.min("at_us").alias("at_us"))
