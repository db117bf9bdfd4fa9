"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import line_dedup, mixing, quality_rules, sentencepiece_viterbi, simhash
from wayfare.llm.common import drop_written, materialize, table, tables_written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text."""
    done = line_dedup.drop_boilerplate(docs, F.col("source"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, and whether decoding them gives the text again."""
    coded = sentencepiece_viterbi.round_trip(docs, sentencepiece_viterbi.Vocabulary.read())
    return coded.select("doc_id", "lang", "source", "n_chars", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the fitted rules nor the tree search nor the Viterbi segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote is deleted once the next one's table stands."""
    docs, since = table(spark, sf_dir, "documents"), tables_written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
