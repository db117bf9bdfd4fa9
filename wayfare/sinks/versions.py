"""Tables that change as a whole: each revision is a folder of its own, and a small file names the one that counts.

A revision is staged beside the others, checked, and becomes the current one when the pointer file is
replaced by an atomic rename. A reader takes the pointer's folder and keeps it, so it sees the old or
the new revision, never parts of both; a stage that breaks off is never pointed to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
Write = Callable[[DataFrame, str], None]


class Refused(ValueError):
    """A staged revision that its checks refuse; rows: how many broke each of them."""

    def __init__(self, rows: dict[str, int]):
        super().__init__(f"refused: {rows}")
        self.rows = rows


def _hadoop(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file in one step: readers see its old content or all of the new one."""
    jvm = spark.sparkContext._jvm
    target, fs = _hadoop(spark, path)
    beside, _ = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(target), over)


def read_file(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where there is none."""
    target, fs = _hadoop(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def stage(df: DataFrame, root: str, revision: str, checks: dict[str, Column] | None = None, measures: dict[str, Column] | None = None, write: Write = _parquet) -> tuple[str, dict]:
    """Write df as a folder of its own under root: its name, and the measures taken while it was written.

    checks: conditions that every row must meet; a row for which one is null breaks it. They and the
    measures (aggregates) are observed in the pass that writes. If any row breaks a check, the folder is
    deleted and Refused is raised; the current revision stays as it was.
    """
    spark, name = df.sparkSession, f"{revision}-{uuid.uuid4().hex}"
    asked = {f"check {k}": F.count_if(~F.coalesce(c, F.lit(False))) for k, c in (checks or {}).items()} | {f"measure {k}": c for k, c in (measures or {}).items()}
    seen = Observation(name)
    watched = df.observe(seen, *(c.alias(k) for k, c in asked.items())) if asked else df
    try:
        write(watched, f"{root}/{name}")
    except BaseException:
        delete(spark, f"{root}/{name}")
        raise
    got = seen.get if asked else {}
    broken = {k.removeprefix("check "): n for k, n in got.items() if k.startswith("check ") and n}
    if broken:
        delete(spark, f"{root}/{name}")
        raise Refused(broken)
    return name, {k.removeprefix("measure "): v for k, v in got.items() if k.startswith("measure ")}


def swap(spark: SparkSession, root: str, name: str) -> None:
    """Make a staged revision the current one; one whose files are not complete is refused."""
    done, fs = _hadoop(spark, f"{root}/{name}/_SUCCESS")
    if not fs.exists(done):
        raise FileNotFoundError(f"{root}/{name} is not a complete revision")
    write_file(spark, f"{root}/{POINTER}", name)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current revision; None before the first swap. What is read from it does not change by later swaps."""
    name = read_file(spark, f"{root}/{POINTER}")
    return f"{root}/{name}" if name else None


def sweep(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete stages that broke off and all complete revisions but the current one and the keep newest besides; their names.

    A stage that is being written now counts as broken off, so writers of a root take turns. Readers that
    still hold a former revision are served as long as it is among those kept.
    """
    top, fs = _hadoop(spark, root)
    now = read_file(spark, f"{root}/{POINTER}")
    folders = [f for f in fs.listStatus(top) if f.isDirectory() and f.getPath().getName() != now]
    whole = [f for f in folders if fs.exists(_hadoop(spark, f"{root}/{f.getPath().getName()}/_SUCCESS")[0])]
    kept = {f.getPath().getName() for f in sorted(whole, key=lambda f: -f.getModificationTime())[:keep]}
    gone = sorted(f.getPath().getName() for f in folders if f.getPath().getName() not in kept)
    for name in gone:
        delete(spark, f"{root}/{name}")
    return gone


def delete(spark: SparkSession, path: str) -> None:
    found, fs = _hadoop(spark, path)
    fs.delete(found, True)


def refresh(spark: SparkSession, root: str, offered: str, build: Callable[[], DataFrame], action: str, checks: dict[str, Column] | None = None) -> str | None:
    """Follow an update check's action ('throttled', 'current' or 'staged'): stage and swap in what build() gives; the current folder."""
    if action == "staged":
        name, _ = stage(build(), root, offered, checks)
        swap(spark, root, name)
        sweep(spark, root)
    return current(spark, root)
