"""Row-level operators: which row of a key wins, overlays, upserts, ranked lists, neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import drop_table, materialize


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    best = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return best.withColumnRenamed("__rn", rank) if rank else best.drop("__rn")


def first_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in an order that must be total within a key."""
    return _ranked(df, keys, [F.col(o) if isinstance(o, str) else o for o in order], 1)


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    return _ranked(df, keys, [F.col(o).desc() for o in order], 1)


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str | None = None) -> DataFrame:
    """The first n rows of each key, with their place as column rank if it is named."""
    return _ranked(df, keys, list(order), n, rank)


def drop_consecutive(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in their key (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("__keep", first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("__keep").drop("__keep")


def with_next(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with columns of the row behind it: a join of neighbours without a self join."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in columns})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows that new replaces by key, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_partial(old: DataFrame, new: DataFrame, key: str, keys: list[str], keep: list[str]) -> DataFrame:
    """Upsert on a key that may be null: rows with a null key are appended, others replace their match but keep its columns in keep."""
    keyed = new.where(F.col(key).isNotNull())
    names = {c: f"__{c}" for c in keep}
    held = old.where(F.col(key).isNotNull()).select(*keys, *(F.col(c).alias(n) for c, n in names.items()))
    merged = keyed.join(held, keys, "left").withColumns({c: F.coalesce(F.col(n), F.col(c)) for c, n in names.items()}).select(*old.columns)
    rest = old.join(keyed.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(merged).unionByName(new.where(F.col(key).isNull()).select(*old.columns))


def overlay(base: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the columns that edits fills in with more than blanks; edits has one row a key."""
    named = edits.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(named, base[key] == F.col("__key"), "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(f"__{c}")), F.lit("")), F.col(c)) for c in columns}).select(*base.columns)


def every_kth(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Every k-th row of a key, with the least k that keeps about most of them, and always the last."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(*order)) - 1
    step = F.greatest(F.lit(1), F.ceil(n / float(most)).cast("int"))
    return df.withColumns({"__at": at, "__n": n, "__step": step}).where("__at % __step = 0 OR __at = __n - 1").drop("__at", "__n", "__step")


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Rows numbered from 0 in a total order, without gathering them in one task.

    Rows are range-partitioned by the order and sorted; a row's number is its place in its partition and
    the number of rows in those before. The partitions are written down with these places, since ranges
    are sampled anew each time that they are computed; the rows are written before, so that sampling
    doesn't compute them once more.
    """
    rows = materialize(df, "rows")
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    spread = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "ranges")
    drop_table(rows)
    spread = spread.withColumns({"__part": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND((1 << 33) - 1)})
    sizes = spread.groupBy("__part").count()
    before = sizes.select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count")).alias("__before"))
    return spread.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place")).drop("__at", "__part", "__place", "__before")


def fill_missing(target: DataFrame, sources: DataFrame, key: str, columns: list[str], priority: str = "priority") -> DataFrame:
    """target with missing columns filled from the source of least priority that has the key."""
    best = sources.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(priority)).alias("__best")).withColumnRenamed(key, "__key")
    joined = target.join(best, target[key] == F.col("__key"), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__best.{c}")) for c in columns}).select(*target.columns)
