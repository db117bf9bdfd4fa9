"""Ranked airport search: two rankings with tiers of their own, and lookups by several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers of the search (limit 40) and of the suggestions (limit 12).
SEARCH = {"empty": (50, 70, 90, 90), "iata": 0, "icao": 2, "ident": 2, "iata~": 10, "icao~": 10, "ident~": 10, "name~": 20, "inside": 40, "limit": 40}
SUGGEST = {"empty": (60, 70, 80, 95), "iata": 0, "icao": 1, "ident": 2, "iata~": 10, "icao~": 12, "ident~": 14, "name~": 20, "inside": 30, "limit": 12}

#: Query texts that are searched in one pass.
QUERY_BLOCK = 500


def rank(query: Column, tiers: dict) -> Column:
    """Tier of an airport row (iata, icao, ident, name, municipality, country, type, scheduled) for a query; null: no match."""
    q = F.upper(F.trim(query))
    up = {c: F.upper(F.coalesce(c, F.lit(""))) for c in ("iata", "icao", "ident", "name", "municipality", "country")}
    large, medium, scheduled, other = tiers["empty"]
    empty = F.when(F.col("scheduled") & (F.col("type") == "large_airport"), large).when(F.col("scheduled") & (F.col("type") == "medium_airport"), medium).when(F.col("scheduled"), scheduled).otherwise(other)
    rules = [(q == "", empty), *((up[k] == q, F.lit(tiers[k])) for k in ("iata", "icao", "ident")), *((up[k].startswith(q), F.lit(tiers[f"{k}~"])) for k in ("iata", "icao", "ident"))]
    rules += [(up["name"].startswith(q) | up["municipality"].startswith(q), F.lit(tiers["name~"])), (reduce(lambda a, b: a | b, (up[c].contains(q) for c in ("name", "municipality", "country"))), F.lit(tiers["inside"]))]
    return reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0]))


def search(airports: DataFrame, queries: DataFrame, tiers: dict = SEARCH) -> DataFrame:
    """(q, place, id, rank): the best airports of each distinct query text.

    Queries are taken in blocks of QUERY_BLOCK texts, each in one pass over the airports, so what a task
    holds has a bound; a text may match anywhere in a name, so no key could join them. A null text has
    no rows.
    """
    texts = [r.q for r in queries.select("q").where("q IS NOT NULL").distinct().orderBy("q").toLocalIterator()]
    kind = F.when(F.col("type") == "large_airport", "0").when(F.col("type") == "medium_airport", "1").otherwise("2")
    key = F.concat_ws("-", F.when(F.col("scheduled"), "0").otherwise("1"), kind, F.coalesce("iata", "icao", "ident", F.lit("")), "name")
    w = Window.partitionBy("q").orderBy("rank", key, "id")
    found = []
    for at in range(0, max(len(texts), 1), QUERY_BLOCK):
        block = F.array(*map(F.lit, texts[at : at + QUERY_BLOCK])).cast("array<string>")
        hits = airports.withColumn("q", F.explode(block)).withColumn("rank", rank(F.col("q"), tiers)).where("rank IS NOT NULL")
        found.append(hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= tiers["limit"]).select("q", "place", "id", "rank"))
    return reduce(DataFrame.unionAll, found)


def by_any_code(airports: DataFrame, codes: DataFrame) -> DataFrame:
    """The airport of each code by ICAO or IATA; an ICAO match comes first, then the smaller id."""
    keys = airports.select("id", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("icao").alias("code")), F.struct(F.lit(1).alias("by"), F.col("iata").alias("code")))).alias("k")).select("id", "k.*").where("code IS NOT NULL")
    return codes.join(keys, "code").groupBy("code").agg(F.min(F.struct("by", "id")).alias("s")).select("code", "s.id")


def key_index(airports: DataFrame) -> DataFrame:
    """(key, id) over IATA, ICAO and ident codes, upper case; the last airport of a key in id order wins."""
    keys = airports.select("id", F.explode(F.array("iata", "icao", "ident")).alias("key")).where("key IS NOT NULL").select(F.upper("key").alias("key"), "id")
    return keys.groupBy("key").agg(F.max("id").alias("id"))


def route_graph(routes: DataFrame) -> DataFrame:
    """(code, outgoing, incoming, airlines, aircraft) of each end of routes (origin, destination, airline, equipment array)."""
    both = routes.select(F.col("origin").alias("code"), F.lit(1).alias("out"), "airline", "equipment").unionAll(routes.select(F.col("destination").alias("code"), F.lit(0).alias("out"), "airline", "equipment"))
    counts = both.groupBy("code").agg(F.sum("out").alias("outgoing"), F.sum(1 - F.col("out")).alias("incoming"))
    for name, rows in (("airlines", both.select("code", F.col("airline").alias("x")).where("x <> ''")), ("aircraft", both.select("code", F.explode("equipment").alias("x")))):
        top = ranked(rows.groupBy("code", "x").count(), ["code"], "x", 12)
        counts = counts.join(top.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s.x).alias(name)), "code", "left")
    return counts


def ranked(counts: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """The n names of each key with most counts, ties by name, with their place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("count"), name)
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def destinations(routes: DataFrame, n: int | None = 12, kinds: int = 8) -> DataFrame:
    """(code, destination, count, place, aircraft) of each origin's most flown destinations."""
    counts = ranked(routes.groupBy(F.col("origin").alias("code"), "destination").count(), ["code"], "destination", n or 2**31 - 1)
    types = ranked(routes.select(F.col("origin").alias("code"), "destination", F.explode("equipment").alias("x")).groupBy("code", "destination", "x").count(), ["code", "destination"], "x", kinds)
    lists = types.groupBy("code", "destination").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s.x).alias("aircraft"))
    return counts.join(lists, ["code", "destination"], "left")


def locale_key(name: Column) -> Column:
    """A sort key for names as people order them: letters before accents before case, punctuation counted, by the root collation of Unicode."""
    return F.collate(name, "UNICODE")
