"""Lookups by untidy names: waypoints from registries of several sources, aircraft models by alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text

#: Sources in the order in which they are believed.
SOURCE_ORDER = ("official", "flightgear", "xplane", "openaip", "aixm")
#: Two sources agree under so many nautical miles, which adds to the confidence, and contradict each other over so many.
AGREE_NM, BONUS, FAR_NM = 0.1, 10, 50.0


def resolve(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, lat, lon, source, confidence, method, n_far) for each row of asked (key, ident, region).

    registry: (source, ident, region, lat, lon, confidence), one row for each of the first three; an
    empty region stands for any. Of a source, the record of the asked region comes before that of any;
    the first source in SOURCE_ORDER that knows the point gives its place, and each later one that
    agrees with it raises the confidence (to 100 at most). Unknown points have nulls.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source"))
    known = registry.withColumn("rank", rank).where("rank > 0").select("rank", "source", text.normalise_ident(F.col("ident")).alias("ident"), "region", "lat", "lon", "confidence")
    wanted = asked.select("key", text.normalise_ident(F.col("ident")).alias("ident"), F.posexplode(F.array_distinct(F.array(F.coalesce("region", F.lit("")), F.lit("")))).alias("far", "region"))
    per_source = wanted.join(known, ["ident", "region"]).groupBy("key", "rank").agg(F.min(F.struct("far", "source", "lat", "lon", "confidence")).alias("s")).select("key", "rank", "s.*")
    first = per_source.groupBy("key").agg(F.min(F.struct("rank", "source", "lat", "lon", "confidence")).alias("f"))
    nm = geo.haversine_nm(F.col("f.lat"), F.col("f.lon"), F.col("lat"), F.col("lon"))
    later = F.col("rank") > F.col("f.rank")
    checked = per_source.join(first, "key").groupBy("key").agg(F.first("f").alias("f"), F.count_if(later & (nm < AGREE_NM)).alias("n_agree"), F.count_if(later & (nm > FAR_NM)).alias("n_far"))
    found = checked.select("key", "f.lat", "f.lon", "f.source", F.least(F.lit(100), F.col("f.confidence") + BONUS * F.col("n_agree")).cast("int").alias("confidence"), F.when(F.col("n_agree") > 0, "cross_validated").otherwise(F.concat("f.source", F.lit("_exact"))).alias("method"), "n_far")
    return asked.select("key").join(found, "key", "left")


#: Licences and file formats that a model may have, and the least and most polygons of a budget.
LICENCES, FORMATS, LEAST_POLYGONS, MOST_POLYGONS = ("CC0", "CC BY"), ("glb", "gltf"), 500, 3_000_000


def model_ready() -> Column:
    """Whether a model (status, url, licence, commercial, derivatives, editorial, format, least, most, actual) may be shown and is within its polygon budget."""
    actual = F.coalesce("actual", "least")
    budget = (F.col("least") >= LEAST_POLYGONS) & (F.col("most") <= MOST_POLYGONS) & actual.between(F.col("least"), F.col("most"))
    allowed = F.col("licence").isin(*LICENCES) & F.col("commercial") & F.col("derivatives") & ~F.col("editorial")
    ready = (F.col("status") == "ready") & (F.length(F.trim("url")) > 0) & allowed & F.col("format").isin(*FORMATS) & budget
    return F.coalesce(ready, F.lit(False))


def select_model(requests: DataFrame, models: DataFrame, default: str) -> DataFrame:
    """(request, model, found) for each request (request, aircraft_type).

    models: (ord, model, names array, ready). A type names the first model that has it among its names,
    both without case and punctuation and by family. If that isn't ready, the model of the default type
    takes its place, or else the first one that is ready. The two fallbacks are single rows.
    """
    named = models.select("ord", "model", "ready", F.explode(F.transform("names", text.aircraft_type)).alias("name"))
    index = named.groupBy("name").agg(F.min(F.struct("ord", "model", "ready")).alias("m"))
    ready = lambda df: df.where("m.ready").select("m.model")
    fallback = ready(index.where(F.col("name") == text.aircraft_type(F.lit(default)))).first() or models.where("ready").agg(F.min_by("model", "ord").alias("model")).first()
    other = F.lit(fallback.model if fallback else None).cast("string")
    j = requests.withColumn("name", text.aircraft_type(F.col("aircraft_type"))).join(index, "name", "left")
    return j.select("request", F.coalesce(F.when(F.col("m.ready"), F.col("m.model")), other).alias("model"), F.col("m.model").alias("found"))


def first_of(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key of expressions, in an order that is total within a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
