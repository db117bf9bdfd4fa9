"""From a source's configuration to canonical tables: which files, which reader, and what is wrong with the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..operators.tables import materialize
from . import archives, charts, fixed_width, header_tables, navdata, pdf, publications
from . import canonical as C

Config = dict[str, object]


def configured_files(config: Config) -> dict[str, str]:
    """Paths by document: raw_files as they stand, and a file in raw_route_dir for each URL of official_route_documents."""
    found = {str(k): str(v) for k, v in (config.get("raw_files") or {}).items()}
    folder = config.get("raw_route_dir")
    if isinstance(folder, str):
        for route, url in (config.get("official_route_documents") or {}).items():
            found[f"route_{route}"] = f"{folder.rstrip('/')}/{unquote(urlparse(str(url)).path).rsplit('/', 1)[-1]}"
    return found


def missing_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some paths, patterns allowed, where there is nothing."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = hadoop(path)
        return bool(p.getFileSystem(conf).globStatus(p))

    return [p for p in paths if not there(p)]


def documents(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(document, text) of all files; a document is named by its key and its path, so that either may tell what it lists."""
    out = None
    for name, path in sorted(files.items()):
        df = archives.as_text(archives.files(spark, path)).select(F.concat(F.lit(f"{name}:"), "path").alias("document"), "text")
        out = df if out is None else out.unionByName(df)
    return out


def _web(spark: SparkSession, source: str, files: dict[str, str]) -> C.Tables:
    return publications.tables(documents(spark, files).withColumnRenamed("text", "html"), source)


def _headed(spark: SparkSession, source: str, files: dict[str, str]) -> C.Tables:
    return header_tables.tables(documents(spark, files).withColumnRenamed("text", "html"), source)


def _pdf_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """(path, content) of PDF files, the path led by the document's key."""
    found = [pdf.read(spark, path).withColumn("path", F.concat(F.lit(f"{name}:"), "path")) for name, path in sorted(files.items())]
    return reduce(DataFrame.unionByName, found)


def _chart(spark: SparkSession, source: str, files: dict[str, str]) -> C.Tables:
    """Charts as PDF files, or as text that was taken from them before."""
    printed = {k: v for k, v in files.items() if v.lower().endswith(".pdf")}
    plain = {k: v for k, v in files.items() if k not in printed}
    texts = [charts.pdf_text(_pdf_files(spark, printed)).withColumnRenamed("path", "document")] if printed else []
    return charts.tables(reduce(DataFrame.unionByName, texts + ([documents(spark, plain)] if plain else [])), source)


def _blocks(spark: SparkSession, source: str, files: dict[str, str]) -> C.Tables:
    """Charts whose rows follow from where their blocks of text stand."""
    blocks = pdf.blocks(_pdf_files(spark, files)).withColumnRenamed("path", "document")
    return charts.block_tables(materialize(blocks, "pdf-blocks"), source, *charts.BLOCK_PUBLISHERS[source])


def _records(spark: SparkSession, source: str, files: dict[str, str]) -> C.Tables:
    return C.union(*(fixed_width.read(spark, path, source) for _, path in sorted(files.items())))


def _navdata(spark: SparkSession, source: str, files: dict[str, str]) -> C.Tables:
    return C.union(*(navdata.tables(spark, path, source) for _, path in sorted(files.items())))


#: The reader of each source.
READERS: dict[str, Callable[[SparkSession, str, dict[str, str]], C.Tables]] = {**dict.fromkeys(publications.DIALECTS, _web), **dict.fromkeys(charts.DIALECTS, _chart), **dict.fromkeys(charts.BLOCK_PUBLISHERS, _blocks), "taiwan": _headed, "faa": _records, "flightgear": _navdata}


def build(spark: SparkSession, config: Config) -> C.Tables:
    """Canonical tables of a configured source; unknown sources and missing files are errors."""
    source = str(config["source"])
    if source not in READERS:
        raise ValueError(f"no reader for {source}")
    files = configured_files(config)
    gone = missing_files(spark, list(files.values()))
    if gone or not files:
        raise FileNotFoundError(f"{source}: no raw files at {', '.join(gone) or 'any path'}")
    return READERS[source](spark, source, files)


def validated(tables: C.Tables) -> DataFrame:
    """(severity, code, entity) of all quality rules over canonical tables."""
    points = tables.points.select("uid", "ident", "lat", "lon")
    segments = tables.segments.select("uid", "airway_uid", "from_uid", "to_uid")
    return quality.issues(points, tables.airways.select("uid", "designator"), segments)


def summary(tables: C.Tables) -> DataFrame:
    """(part, n): the rows of each table."""
    out = None
    for part, df in zip(C.Tables._fields, tables, strict=True):
        n = df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def fingerprint(files: DataFrame) -> DataFrame:
    """(n, sha256) of files (path, content): a digest of their digests in order of path, taken in blocks by the first three digits of a path's digest.

    No task reads more than its own files, so the digest is not that of the files end to end.
    """
    each = files.select("path", F.sha2("content", 256).alias("d"), F.left(F.sha2("path", 256), F.lit(3)).alias("block"))
    listed = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "d"))), lambda s: s.d), ""), 256)
    blocks = each.groupBy("block").agg(F.count("*").alias("n"), listed("path").alias("d"))
    return blocks.agg(F.sum("n").alias("n"), listed("block").alias("sha256"))
