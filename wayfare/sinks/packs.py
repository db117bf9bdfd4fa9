"""Offline packs and tables: regions as compact JSON lines with a manifest, and keyed tables that are written again."""

from __future__ import annotations

import gzip
import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.rows import dense_index, last_wins, upsert
from ..operators.tables import materialize
from ..sources.canonical import Tables


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _array(*columns: Column) -> Column:
    """A JSON array of columns of different types, in order, nulls included."""
    parts = [F.substring(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), F.lit(6), F.length(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})) - 6) for c in columns]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def pack_rows(tables: Tables, sources: DataFrame, countries: list[str] | None, private: bool = False) -> DataFrame:
    """(part, idx, json): points, airways, segments and airports of a region as JSON arrays by position.

    sources: (source_id, status, bundle); without private, only rows whose source may be given away and
    bundled count. Segments name their ends and airway by the ids that points and airways have here;
    those without all three are left out. Ids follow the order of ident or designator and uid.
    """
    allowed = sources if private else sources.where("status = 'public' AND bundle")
    mine = lambda df: (df.where(F.col("country").isin(countries)) if countries is not None else df).join(allowed.select("source_id"), "source_id", "left_semi")
    points = dense_index(mine(tables.points), ["ident", "uid"])
    airways = dense_index(mine(tables.airways).distinct(), ["designator", "uid"])
    airports = dense_index(mine(tables.airports).withColumn("code", F.coalesce("iata", "icao", F.lit(""))), ["code", "uid"])
    ids = points.select("uid", "idx")
    ends = tables.segments.join(ids.toDF("from_uid", "a"), "from_uid").join(ids.toDF("to_uid", "b"), "to_uid")
    s = ends.join(airways.select(F.col("uid").alias("airway_uid"), F.col("idx").alias("w")), "airway_uid")
    segments = dense_index(s.select("w", "sequence", "uid", "a", "b", F.coalesce("distance_nm", F.lit(0.0)).alias("nm"), F.coalesce("direction", F.lit("")).alias("direction")), ["w", "sequence", "uid"])
    six = lambda c: geo.quantise(F.col(c), 6)
    parts = [
        ("points", points, _array(F.col("ident"), six("lat"), six("lon"), F.col("point_type"), F.col("source_id"))),
        ("airways", airways, _array(F.col("designator"), F.col("route_type"), F.col("source_id"))),
        ("segments", segments, _array(F.col("a"), F.col("b"), F.col("w"), geo.quantise(F.col("nm"), 2), F.col("direction"))),
        ("airports", airports, _array(F.col("icao"), F.col("iata"), F.col("name"), six("lat"), six("lon"), F.col("country"))),
    ]
    out = None
    for name, df, line in parts:
        got = df.select(F.lit(name).alias("part"), F.col("idx").cast("long").alias("idx"), line.alias("json"))
        out = got if out is None else out.unionByName(got)
    return out


def part_digests(lines: DataFrame) -> DataFrame:
    """(part, n, bytes, sha256) of pack_rows lines: the digest of a part is that of its blocks' digests in order."""
    block = F.floor(F.col("idx") / 4096)
    blocks = lines.groupBy("part", block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.octet_length("json") + 1).alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "json"))), lambda s: F.sha2(s.json, 256)), ""), 256).alias("d"))
    return blocks.groupBy("part").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda s: s.d), ""), 256).alias("sha256"))


def write_pack(lines: DataFrame, path: str) -> DataFrame:
    """Write pack_rows as gzipped JSON lines, a folder for each part in order of ids; returns the manifest (part, n, bytes, sha256).

    The digest of a part is that of its lines' digests in order, so it is found without gathering the lines.
    The lines are read three times (ranges, files, digests), so they are written down first.
    """
    lines = materialize(lines, "pack-lines")
    lines.repartitionByRange("part", "idx").sortWithinPartitions("part", "idx").select("part", F.col("json").alias("value")).write.partitionBy("part").option("compression", "gzip").mode("overwrite").text(path)
    manifest = part_digests(lines)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}-manifest")
    return manifest


def documents(lines: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(part, document, gzipped, sha256): each part as one JSON array, for packs small enough to be one file.

    A part over most_bytes is an error; write_pack has no such limit. The gzip header holds no time, so
    equal packs are equal bytes.
    """
    sizes = lines.groupBy("part").agg(F.sum(F.octet_length("json") + 1).alias("bytes"))
    fits = sizes.select("part", F.when(F.col("bytes") <= most_bytes, True).otherwise(F.raise_error(F.concat("part", F.lit(" is too large for one document")))).alias("ok"))
    joined = lines.join(F.broadcast(fits), "part").where("ok")
    whole = joined.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "json"))), lambda s: s.json), ","), F.lit("]")).alias("document"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [gzip.compress(d.as_py().encode(), mtime=0) for d in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string())], names=["part", "document", "gzipped", "sha256"])

    return whole.mapInArrow(run, "part string, document string, gzipped binary, sha256 string")


def archives(files: DataFrame, key: str = "journey") -> DataFrame:
    """(key, archive): the files (key, name, content) of each key as one stored ZIP archive, in order of name and without times."""
    grouped = files.groupBy(F.col(key).cast("string").alias(key)).agg(F.array_sort(F.collect_list(F.struct("name", F.col("content").cast("binary").alias("content")))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for members in b.column(1).to_pylist():
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
                    for m in members:
                        z.writestr(zipfile.ZipInfo(m["name"]), bytes(m["content"]))
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "archive"])

    return grouped.mapInArrow(run, f"{key} string, archive binary")


def write_keyed(new: DataFrame, path: str, keys: list[str], order: str, old: DataFrame | None = None) -> DataFrame:
    """Write a table in which the last row of each key stays: of new by order, else of old, which must not lie at path."""
    rows = last_wins(new, keys, order)
    done = rows if old is None else upsert(old, rows, keys)
    done.write.mode("overwrite").parquet(path)
    return new.sparkSession.read.parquet(path)


def save_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the columns that new fills in for its key, and new's other rows."""
    named = new.select(*(F.col(c).alias(f"__{c}") for c in new.columns))
    joined = old.join(named, F.col(key) == F.col(f"__{key}"), "full")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def write_partitioned(rows: DataFrame, path: str, column: str) -> None:
    """Replace only the partitions of the keys in rows: a saved journey takes the place of its former version."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def delete_partitions(spark: SparkSession, path: str, column: str, keys: DataFrame) -> None:
    """Delete the partitions of the keys in a table of one column: one folder a key, by name."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for row in keys.toLocalIterator():
        folder = hadoop(f"{path}/{column}={row[0]}")
        folder.getFileSystem(conf).delete(folder, True)


#: Fields of a line of each part of a pack.
SHAPES = {"points": 5, "airways": 3, "segments": 5, "airports": 6}


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """(part, idx, fields) of a pack that write_pack has written, the fields as text; a line of another shape is an error.

    Lines are in order of their ids within and across the files of a part, so their places are the ids.
    A gzipped file is one task's, line by line, so a line's place is counted as it is read.
    """
    lines = spark.read.schema("value string, part string").text(path).select("part", F.input_file_name().alias("file"), "value")
    sizes = lines.groupBy("part", "file").agg(F.count("*").alias("n"))
    before = sizes.select("part", "file", (F.sum("n").over(Window.partitionBy("part").orderBy("file")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            parts, firsts = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy()
            starts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (firsts[1:] != firsts[:-1])) + 1)]
            idx = np.empty(b.num_rows, np.int64)
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
                file = (b.column(0)[start].as_py(), firsts[start])
                place = place if file == last else 0
                idx[start:end] = firsts[start] + place + np.arange(end - start)
                last, place = file, place + end - start
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(idx), b.column(2)], names=["part", "idx", "value"])

    rows = lines.join(F.broadcast(before), ["part", "file"]).select("part", "before", "value").mapInArrow(run, "part string, idx long, value string")
    fields = F.from_json("value", "array<string>")
    size = F.create_map(*(F.lit(x) for kv in SHAPES.items() for x in kv))[F.col("part")]
    return rows.select("part", "idx", F.when(F.size(fields) == size, fields).otherwise(F.raise_error(F.concat(F.lit("no line of a pack: "), "value"))).alias("fields"))


def write_report(rows: DataFrame, path: str) -> None:
    """Issues or coverage as JSON lines, in order of their columns."""
    rows.repartitionByRange(*rows.columns).sortWithinPartitions(*rows.columns).write.option("ignoreNullFields", False).mode("overwrite").json(path)
