"""dBASE tables and shapefile lines, parsed file by file in tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def dbf_records(content: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str]]:
    """Records of a dBASE table as texts by field name; records marked as deleted are left out."""
    count, start, width = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while at < start - 1 and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    for i in range(count):
        record = content[start + i * width : start + (i + 1) * width]
        if len(record) < width or record[:1] == b"*":
            continue
        out, at = {}, 1
        for name, size in fields:
            out[name] = record[at : at + size].decode(encoding, "replace").rstrip("\0").strip()
            at += size
        yield out


def dbf(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(path, ord, record map) of dBASE files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = [list(r.items()) for r in dbf_records(content.as_py(), encoding)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, kind)], names=["path", "ord", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, ord long, record map<string,string>")


def shape_parts(content: bytes) -> Iterator[tuple[int, int, list[tuple[float, float]]]]:
    """(record number, part, [(lat, lon)]) of the lines (type 3) and rings (type 5) of a shapefile."""
    at = 100
    while at + 8 <= len(content):
        number, words = struct.unpack_from(">ii", content, at)
        body, at = at + 8, at + 8 + 2 * words
        if at > len(content) or struct.unpack_from("<i", content, body)[0] not in (3, 5):
            continue
        parts, points = struct.unpack_from("<ii", content, body + 36)
        starts = [*struct.unpack_from(f"<{parts}i", content, body + 44), points]
        first = body + 44 + 4 * parts
        for part in range(parts):
            xy = struct.unpack_from(f"<{2 * (starts[part + 1] - starts[part])}d", content, first + 16 * starts[part])
            yield number, part, list(zip(xy[1::2], xy[0::2], strict=True))


def shapes(files: DataFrame) -> DataFrame:
    """(path, record, part, ord, lat, lon): the vertices of shapefiles (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for record, part, points in shape_parts(content.as_py()):
                    n = len(points)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), pa.array([record] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([p[0] for p in points], pa.float64()), pa.array([p[1] for p in points], pa.float64())],
                        names=["path", "record", "part", "ord", "lat", "lon"],
                    )

    return files.select("path", "content").mapInArrow(run, "path string, record int, part int, ord int, lat double, lon double")
