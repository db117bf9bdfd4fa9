"""Members of ZIP archives, read in the tasks that hold the archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, content) of whole files below a path that fit a glob pattern."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (read.option("pathGlobFilter", pattern) if pattern else read).load(path).select("path", "content")


def zip_members(archives: DataFrame, pattern: str = ".*", stored_only: bool = False) -> DataFrame:
    """(path, member, content) of the members whose name fits a pattern; archives: (path, content).

    Folders are left out. stored_only: an archive with a compressed member is an error. A broken archive
    gives no members.
    """
    names = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    continue
                with z:
                    for m in z.infolist():
                        if m.is_dir() or not names.search(m.filename):
                            continue
                        if stored_only and m.compress_type != zipfile.ZIP_STORED:
                            raise ValueError(f"{m.filename} is compressed")
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([m.filename]), pa.array([z.read(m)], pa.binary())], names=["path", "member", "content"])

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def as_text(df: DataFrame, column: str = "content", name: str = "text") -> DataFrame:
    """Bytes as UTF-8 text, or as Latin-1 where they are no UTF-8."""
    return df.withColumn(name, F.coalesce(F.try_validate_utf8(F.col(column).cast("string")), F.decode(column, "ISO-8859-1"))).drop(column)
