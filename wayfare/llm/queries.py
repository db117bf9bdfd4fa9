"""The queries of the corpus operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, filter_audit, lexical_search, line_dedup, mixing, packing, quality_neighbours, quality_rules, sentencepiece_viterbi, simhash, suffix_dedup, toxicity, vector_search
from .common import table

QUERIES = {}
ORACLE_SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate of their source, which is their site here."""
    docs = table(spark, sf_dir, "documents")
    done = line_dedup.drop_boilerplate(docs, F.col("source"))
    return done.select("doc_id", "source", "n_lines", "n_dropped", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g'), ' ') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)
), per_host AS (SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
  SELECT l.source, l.k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM lines WHERE k <> '' GROUP BY source, k) l
  JOIN per_host h ON l.source IS NOT DISTINCT FROM h.source WHERE n >= 2 AND n > 0.1 * pages
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.k IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.k IS NULL), '') AS text
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.k = b.k GROUP BY doc_id
)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CAST(octet_length(encode(k.text)) AS BIGINT) AS n_bytes, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as pieces and back: their number, a digest of the ids, and whether the text came back."""
    vocabulary = sentencepiece_viterbi.Vocabulary.read()
    coded = sentencepiece_viterbi.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    ids = F.array_join("ids", " ")
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), F.sha2(ids, 256).alias("ids_sha256"), "round_trip")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_neighbours.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_chunks", "n_repeated", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op11_filter_audit"] = r"""
WITH RECURSIVE traits AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), failed AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM traits
), flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, [a, b, c, d, e] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM failed LEFT JOIN flags USING (doc_id) GROUP BY ALL
), letters(x, i) AS (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, letters WHERE position(x IN o) = 0
), steps AS (
  SELECT o AS filter_order, s AS step, position(substr(o, s, 1) IN 'ABCDE') AS i, [position(y IN 'ABCDE') FOR y IN string_split(left(o, s - 1), '') IF y <> ''] AS earlier
  FROM orders, range(1, 6) r(s) WHERE length(o) = 5
), hit AS (
  SELECT part, filter_order, step, i, n, good, toxic, f[i] AS fails, len([y FOR y IN earlier IF f[y]]) > 0 AS gone, len([y FOR y IN f IF y]) AS fail_count
  FROM docs, steps
), done AS (
  SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE fails AND fail_count = 1), 0) AS unique_fails,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE fails AND NOT gone AND toxic), 0) AS toxic_lost
  FROM hit GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM done
"""


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op13_lexical_search"] = r"""
WITH held AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id
), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), tf AS (SELECT doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id
), best AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 20
"""
