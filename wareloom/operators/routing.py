"""Choosing pages and extraction routes: url rules and stored decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import contains_any, first_hit
from ..session import staged
from .ordering import numbered

BATCH = 30
PAYLOAD = (
    "array<struct<url_number:int,category:string,relevance:string,confidence:double,"
    "has_configurator:boolean,name:string,page_type:string>>"
)


def tag_blog_urls(urls: DataFrame) -> DataFrame:
    return urls.withColumn("is_blog", contains_any(F.lower("url"), lex.BLOG_URL_PARTS))


def blog_prefilter(urls: DataFrame) -> DataFrame:
    """Urls that are no blog, FAQ or guide page."""
    return tag_blog_urls(urls).filter(~F.col("is_blog")).drop("is_blog")


def blog_counts(urls: DataFrame) -> DataFrame:
    return tag_blog_urls(urls).agg(
        F.count_if(~F.col("is_blog")).alias("kept"), F.count_if("is_blog").alias("skipped")
    )


def route_pages(urls: DataFrame) -> DataFrame:
    """Extraction route of each url, and the configurator guess by url alone."""
    low = F.lower("url")
    rules = [
        (contains_any(low, lex.BLOG_URL_PARTS), F.lit("SKIP")),
        (contains_any(low, lex.ROUTE_CONFIGURATOR_WORDS), F.lit("LAM")),
        (contains_any(low, lex.ROUTE_SEMANTIC_WORDS), F.lit("AI")),
    ]
    guess = contains_any(low, lex.STATIC_CONFIGURATOR_WORDS)
    return urls.withColumns(
        {
            "route": first_hit(rules, F.lit("STATIC")),
            "has_configurator": guess,
            "configurator_type": F.when(guess, "embedded").otherwise("none"),
            "confidence": F.when(guess, 0.7).otherwise(0.3),
        }
    )


def route_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_configurator").alias("n_configurators")
    )


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """Decision rows of raw batch answers (batch_no, payload); a broken answer gives none."""
    items = F.from_json("payload", PAYLOAD)
    return payloads.select("batch_no", F.inline(items))


def apply_decisions(urls: DataFrame, decisions: DataFrame, rule: str = "relevance", batch: int = BATCH) -> DataFrame:
    """Keep the urls that the numbered decisions of their batch accept.

    Urls are numbered in page order; decisions name them by batch and
    place. If no url is kept at all, every url without an excluded word is.
    """
    placed = numbered(urls.select("page_id", "url"), "page_id").select(
        "page_id",
        "url",
        F.floor(F.col("row_no") / batch).alias("batch_no"),
        (F.col("row_no") % batch + 1).alias("url_number"),
    )
    has = F.coalesce(F.col("has_configurator"), F.lit(False))
    if rule == "relevance":
        relevance = F.coalesce("relevance", F.lit("LOW"))
        keep = relevance.isin("HIGH", "MEDIUM") | ((relevance == "LOW") & has)
        base = F.coalesce("category", F.lit("OTHER"))
        category = F.when(has, F.concat(base, F.lit("_CONFIGURATOR"))).otherwise(base)
    else:
        keep = F.coalesce("category", F.lit("INFO")).isin("PRODUCT", "OFFERING") & (F.col("confidence") >= 0.6)
        category = F.col("category")
    kept = staged(
        placed.join(decisions.drop("page_id", "url"), ["batch_no", "url_number"])
        .filter(keep)
        .select(
            "page_id", "url", category.alias("category"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
        ),
        "kept-urls",
    )
    if not kept.isEmpty():
        return kept
    return urls.filter(~contains_any(F.lower("url"), lex.FALLBACK_EXCLUDED_WORDS)).select(
        "page_id", "url", F.lit("UNKNOWN").alias("category"), F.lit(0.5).alias("confidence")
    )


def category_counts(kept: DataFrame) -> DataFrame:
    """Kept urls per category, most frequent first, with the configurator share."""
    return (
        kept.groupBy("category")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("is_configurator", F.contains("category", F.lit("CONFIGURATOR")))
        .orderBy(F.desc("n"), "category")
    )


