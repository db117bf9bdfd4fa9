"""Delimited text files: quoted CSV, semicolon and tab files, headerless rows with typed columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", null: str = "") -> DataFrame:
    """Quoted CSV with a header; quotes are doubled inside quotes, and fields may span lines. A byte-order mark is dropped."""
    read = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, nullValue=null, encoding="UTF-8", enforceSchema=False)
    df = (read.schema(schema) if schema else read).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def rows(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "\\N", quote: str = '"') -> DataFrame:
    """Headerless rows in the order of the schema's columns; null marks absent values, quote='' keeps quotes as text."""
    return spark.read.options(header=False, sep=sep, quote=quote, escape='"', nullValue=null).schema(schema).csv(path)


def optional(read, spark: SparkSession, schema: str) -> DataFrame:
    """What read() gives, or an empty table where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def number(x: Column) -> Column:
    """Numeric text as double; blank or malformed text is null."""
    return F.trim(x).try_cast("double")


def number_or_zero(x: Column) -> Column:
    """Numeric text as double with 0 for blank text, and null for malformed text: how some sources count missing values."""
    return F.when(F.trim(F.coalesce(x, F.lit(""))) == "", 0.0).otherwise(number(x))


ROUTES = "airline string, airline_id string, origin string, origin_id string, destination string, destination_id string, codeshare string, stops int, equipment string"


def airline_routes(spark: SparkSession, path: str) -> DataFrame:
    """Direct flights between two IATA airports, with \\N for absent values."""
    r = rows(spark, path, ROUTES)
    return r.where(F.col("origin").rlike("^[A-Z]{3}$") & F.col("destination").rlike("^[A-Z]{3}$") & (F.coalesce("stops", F.lit(0)) == 0)).select("airline", "origin", "destination", "codeshare", "equipment")


CITIES = (
    "geonameid long, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, feature_code string, country string, cc2 string,"
    "admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, timezone string, modified string"
)


def cities(spark: SparkSession, path: str, least: int = 15_000) -> DataFrame:
    """Populated places of a tab-separated gazetteer with 19 columns and so many inhabitants at least."""
    c = rows(spark, path, CITIES, sep="\t", null="", quote="")
    return c.where((F.col("population") >= least) & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
