"""The life of stored tables: columns that later versions add, and deletes that never leave a row without its parent."""

from __future__ import annotations

from collections.abc import Iterator
from graphlib import TopologicalSorter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.tables import materialize


class Added(NamedTuple):
    """A column that a version adds, and what rows of older versions have in it."""

    version: int
    name: str
    kind: str
    default: Column | None = None


def migrated(rows: DataFrame, version: int, added: list[Added]) -> DataFrame:
    """Rows of an older version with the columns added since, in order of the additions.

    Only additions are known: rows that have a column already, under any version, keep it, so migrating
    twice changes nothing. A default may name columns that the row has by then.
    """
    for a in sorted(added):
        if a.version > version and a.name not in rows.columns:
            rows = rows.withColumn(a.name, (a.default if a.default is not None else F.lit(None)).cast(a.kind))
    return rows


def append(rows: DataFrame, path: str, version: int) -> None:
    """Add rows to a table as they are in a version, in a folder of that version; nothing that stands there is written again."""
    rows.write.mode("append").parquet(f"{path}/version={version}")


def read(spark: SparkSession, path: str, schema: str, added: list[Added]) -> DataFrame:
    """All rows of a table in the newest version: schema is that of version 1, and each folder is brought up on reading.

    A version without a folder has no rows, so a table that nobody has written yet is empty.
    """
    newest = max((a.version for a in added), default=1)
    out = migrated(spark.createDataFrame([], schema), 1, added)
    for v in range(1, newest + 1):
        own = ", ".join([schema, *(f"{a.name} {a.kind}" for a in sorted(added) if a.version <= v)])
        try:
            found = spark.read.schema(own).parquet(f"{path}/version={v}")
        except AnalysisException:  # no such folder
            continue
        out = out.unionByName(migrated(found, v, added))
    return out


class Reference(NamedTuple):
    """Rows of child name one of parent: child.column = parent.key."""

    child: str
    column: str
    parent: str
    key: str


def deletion_order(tables: list[str], references: list[Reference]) -> list[str]:
    """The tables, each before those that it refers to; a circle of references is an error."""
    sorter = TopologicalSorter({t: set() for t in tables})
    for r in references:
        if r.child != r.parent:
            sorter.add(r.parent, r.child)
    return list(sorter.static_order())


def cascade(tables: dict[str, DataFrame], references: list[Reference], table: str, doomed: Column) -> Iterator[tuple[str, DataFrame]]:
    """(table, rows that stay) in an order of deletion in which no step leaves a row whose parent is gone.

    Rows of table that doomed holds for go, and with them all rows that refer to them, directly or through
    others. Keys of doomed rows are written once for each table and joined by shuffle, whatever their
    number. A table in which nothing goes is not named; rows with a null reference refer to nothing.
    """
    order = deletion_order(list(tables), references)
    gone: dict[str, DataFrame] = {table: tables[table].where(doomed)}
    for name in reversed(order):  # parents first
        for r in references:
            if r.child == name and r.parent in gone and r.parent != name:
                keys = gone[r.parent].select(F.col(r.key).alias("__key")).distinct()
                mine = tables[name].join(keys.hint("merge"), F.col(r.column) == F.col("__key"), "left_semi")
                gone[name] = mine if name not in gone else gone[name].unionByName(mine).distinct()
        if name in gone:
            gone[name] = materialize(gone[name], f"doomed-{name}")
    for name in order:
        if name in gone:
            columns = tables[name].columns
            same = [tables[name][c].eqNullSafe(F.col(f"__{c}")) for c in columns]
            match = same[0]
            for s in same[1:]:
                match = match & s
            yield name, tables[name].join(gone[name].distinct().toDF(*(f"__{c}" for c in columns)).hint("merge"), match, "left_anti")
