"""The registered query of each corpus operator, and check SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm import (
    decontamination,
    filter_audit,
    lang_id,
    licenses,
    line_dedup,
    mixing,
    neighbours,
    quality,
    search,
    simhash,
    token_output,
    toxicity,
    whitening,
)
from wareloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document go, and which stay."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = table(spark, sf_dir, "documents")
    return lang_id.predictions(docs, lang_id.learn(docs))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("bits")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("sid", "at")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the token ids of all documents, read back from the written blocks."""
    return token_output.round_trip(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, with these items."""
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id 20 divides."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, asked)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors for every vector whose id 50 divides."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return neighbours.search(neighbours.build(vectors, keep=6), asked, k=5)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes in every order of the five, per source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of all vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4, weights="one")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality,
        op3_language,
        op4_simhash,
        op5_licenses,
        op6_toxicity,
        op7_mixing,
        op8_token_output,
        op9_decontamination,
        op10_search,
        op11_neighbours,
        op12_filter_audit,
        op13_whitening,
    )
}
_SETS = """
SELECT {id}, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}) words"""

CHECKS: dict[str, str] = {
    "op9_decontamination": f"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest(s) AS shingle FROM ({_SETS.format(id="doc_id", table="documents")}) x),
i AS MATERIALIZED (SELECT item_id, unnest(s) AS shingle, len(s) AS n FROM ({_SETS.format(id="item_id", table="benchmark")}) x)
SELECT doc_id, item_id, count(*) / n AS containment FROM d JOIN i ON d.shingle = i.shingle
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n""",
    "op12_filter_audit": """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, part, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first_id FROM t),
m AS (SELECT doc_id, part,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END ||
  CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END ||
  CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END ||
  CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END ||
  CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || f FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE strpos(filter_order, f) = 0),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[:step - 1] AS before
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
r AS MATERIALIZED (SELECT part, filter_order, step, f, fails, n, good, toxic, strpos(fails, f) > 0 AS hit, length(translate(fails, before, '')) < length(fails) AS earlier FROM s, c),
g AS MATERIALIZED (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN NOT hit AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN hit AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN hit AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN hit AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN hit AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, f),
p AS (SELECT part, f, CAST(sum(removed) AS BIGINT) AS shapley FROM g GROUP BY part, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley FROM g JOIN p USING (part, f)""",
}
