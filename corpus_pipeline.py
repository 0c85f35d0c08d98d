"""From raw documents to token blocks, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of the documents; the last writes
token blocks and returns what was read back from them. run() writes every
stage's result as Parquet to the shared folder and reads it again.

Null texts count as empty; a row with a null doc_id goes through all stages.
Columns beside those of the documents are dropped by the mix, kept before.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm import decontamination, mixing, quality, simhash, token_output
from wareloom.llm.common import BLANK, table
from wareloom.session import work_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network takes for good ones stay."""
    return quality.good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it whole; where the mix ends
    within a document, one more row has the first words, as many as it takes.

    Documents that the mix takes no word of, empty ones among them, go. Rows
    with the same doc_id and size stand as often as the one of them that is
    taken most.
    """
    taken = mixing.mix(docs).groupBy(F.col("doc_id").alias("d"), "size").agg(F.max("taken").alias("taken")).where("taken > 0")
    whole = (F.col("taken") / F.col("size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(None).cast("long"), whole), F.when(F.col("taken") % F.col("size") > 0, F.array(F.col("taken") % F.col("size"))).otherwise(F.array().cast("array<bigint>")))
    inner = F.regexp_replace("text", rf"^{BLANK}", "")
    rest = F.element_at(F.split(inner, BLANK, F.col("words").cast("int") + 1), -1)
    some = F.substring(inner, F.lit(1), F.length(inner) - F.length(rest))
    return (
        docs.select("doc_id", "text", "lang", "source", "n_chars")
        .join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & (mixing.word_count(F.col("text")) == F.col("size")))
        .withColumn("words", F.explode(parts))
        .withColumn("text", F.when(F.col("words").isNull(), F.col("text")).otherwise(some))
        .select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    )


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the written blocks."""
    return token_output.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_blocks", token_blocks),
]

#: SQL can express neither the network nor the tokenizer; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
