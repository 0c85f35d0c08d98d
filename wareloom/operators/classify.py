"""Page classification: balanced scores at three strictness levels, and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.urls import crawl_skip_reason
from ..functions.text import (

    blocks,
    contains_any,
    count_contained,
    count_matches,
    count_matching,

    first_hit,
    lines,
    matches_any,
    strip,
    total,
    unnest,
)

KEYWORD_GROUPS = [
    ("product", lex.PRODUCT_WORDS),
    ("customization", lex.CUSTOMIZATION_WORDS),
    ("blog", lex.BLOG_WORDS),
    ("cta", lex.CTA_WORDS),
]
SHORT_PAGE = 200


def keyword_hits(pages: DataFrame) -> DataFrame:
    """Distinct keywords present per page and group, one column per group.

    The lists are a few dozen words, so they are part of the projection:
    no join, no shuffle, the text is read once.
    """
    low = pages.select("page_id", F.lower("markdown").alias("low"))
    return low.select("page_id", *[count_contained(F.col("low"), words).alias(g) for g, words in KEYWORD_GROUPS])


def keyword_totals(hits: DataFrame) -> DataFrame:
    """Pages that have any word of a group, and the sum of hits."""
    groups = [g for g, _ in KEYWORD_GROUPS]
    pairs = F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("hits")) for g in groups])
    return (
        hits.select(F.inline(pairs))
        .groupBy("grp")
        .agg(F.count_if(F.col("hits") > 0).alias("n_pages"), F.sum("hits").alias("n_hits"))
    )


def balanced_signals(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every signal the balanced score needs, independent of strictness.

    `keep` names further columns to pass on, so that a page body can be
    filtered by its own class without a join.
    """
    md, low, low_url = F.col("markdown"), F.col("low"), F.col("low_url")
    prepared = pages.withColumns({"low": F.lower("markdown"), "low_url": F.lower("url")})
    return prepared.select(
        "page_id",
        "url",
        *(keep or []),
        (F.length(md) < SHORT_PAGE).alias("too_short"),
        first_hit(
            [(F.contains(low_url, F.lit(p)), F.lit(p)) for p in lex.NON_PRODUCT_URL_PARTS], F.lit("")
        ).alias("blocked_by"),
        matches_any(low_url, lex.PRODUCT_URL_PATTERNS).alias("product_url"),
        matches_any(low_url, lex.CATEGORY_URL_PATTERNS).alias("category_url"),
        matches_any(low_url, lex.BLOG_URL_PATTERNS).alias("blog_url"),
        count_contained(low, lex.PRODUCT_WORDS).alias("product_words"),
        count_contained(low, lex.CUSTOMIZATION_WORDS).alias("custom_words"),
        total(count_matches(md, "(?i)" + p) for p in lex.BALANCED_PRICE_PATTERNS).alias("price_count"),
        md.rlike(r"(?i)base\s+price").alias("has_base_price"),
        count_matches(md, "(?m)" + lex.HEADER_LINE_PATTERN).alias("option_categories"),
        count_matches(md, lex.CHECKBOX_PATTERN).alias("checkbox_count"),
        count_contained(low, lex.SECTION_WORDS).alias("section_count"),
        count_contained(low, lex.CTA_WORDS).alias("cta_count"),
        count_contained(low, lex.BLOG_WORDS).alias("blog_words"),
        count_matching(low, lex.ARTICLE_PATTERNS).alias("article_count"),
    )


def _band(c: Column, bands: list[tuple[int, Column]]) -> Column:
    return first_hit([(c >= least, value) for least, value in bands], F.lit(0.0))


def _level(names: list[str]) -> Column:
    fields = ["strictness", "product_threshold", "blog_threshold", "keyword_weight", "price_weight", "structure_weight"]
    rows = [F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, level)]) for level in lex.STRICTNESS_LEVELS
            if level[0] in names]
    return F.array(*rows)


def score_balanced(signals: DataFrame, levels: list[str]) -> DataFrame:
    """Scores of each page at each level; signals are computed once per page."""
    s = signals.select("*", F.explode(_level(levels)).alias("level"))
    level = F.col("level")
    url_score = F.when(F.col("product_url"), 3.0).otherwise(0.0) - F.when(F.col("blog_url"), 5.0).otherwise(0.0)
    keyword_score = F.col("product_words") * level["keyword_weight"] + F.col("custom_words") * F.lit(0.5)
    weight = level["price_weight"]
    price_score = F.when(F.col("has_base_price"), weight).otherwise(0.0) + _band(
        F.col("price_count"), [(5, weight), (3, weight * 0.7), (1, weight * 0.4)]
    )
    weight = level["structure_weight"]
    structure_score = (
        _band(F.col("option_categories"), [(4, weight * 1.5), (3, weight), (2, weight * 0.7)])
        + _band(F.col("checkbox_count"), [(5, F.lit(1.5)), (3, F.lit(1.0))])
        + _band(F.col("section_count"), [(2, F.lit(1.5))])
    )
    cta_score = _band(F.col("cta_count"), [(2, F.lit(2.0)), (1, F.lit(1.0))])
    blog_penalty = _band(
        F.col("blog_words"), [(3, F.lit(10.0)), (2, F.lit(5.0)), (1, F.lit(2.0))]
    ) + _band(F.col("article_count"), [(2, F.lit(5.0))])
    scored = s.withColumns(
        {
            "stopped": F.col("too_short") | (F.col("blocked_by") != ""),
            "url_score": url_score,
            "keyword_score": keyword_score,
            "price_score": price_score,
            "structure_score": structure_score,
            "cta_score": cta_score,
            "blog_penalty": blog_penalty,
        }
    )
    total_score = (
        F.col("url_score") + F.col("keyword_score") + F.col("price_score") + F.col("structure_score")
        + F.col("cta_score") - F.col("blog_penalty")
    )
    scored = scored.withColumn("score", F.when(~F.col("stopped"), total_score).otherwise(0.0))
    page_type = first_hit(
        [
            (F.col("stopped"), F.lit("other")),
            (F.col("score") >= level["product_threshold"], F.lit("product")),
            (F.col("blog_penalty") >= level["blog_threshold"], F.lit("blog")),
            (F.col("category_url"), F.lit("category")),
        ],
        F.lit("other"),
    )
    return (
        scored.withColumn("page_type", page_type)
        .withColumn("is_product", F.col("page_type") == "product")
        .withColumn("confidence", F.least(F.greatest(F.col("score") / 15.0, F.lit(0.0)), F.lit(1.0)))
        .withColumn("strictness", level["strictness"])
        .withColumn("product_threshold", level["product_threshold"])
        .drop("level")
    )


def classify_balanced(pages: DataFrame, strictness: str = "balanced") -> DataFrame:
    """Type, confidence and scores of each page at one strictness level."""
    return score_balanced(balanced_signals(pages), [strictness])


def product_pages(pages: DataFrame, strictness: str = "balanced") -> DataFrame:
    """The pages (with text) that classify as products and no skip rule names."""
    scored = score_balanced(balanced_signals(pages, ["markdown"]), [strictness])
    return scored.filter("is_product").filter(crawl_skip_reason(F.col("url")) == "").select("page_id", "url", "markdown")


def strictness_sweep(pages: DataFrame) -> DataFrame:
    """Products and mean score at each strictness level."""
    levels = [level[0] for level in lex.STRICTNESS_LEVELS]
    scored = score_balanced(balanced_signals(pages), levels)
    return scored.groupBy("strictness").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("is_product").alias("n_products"),
        F.count_if(F.col("page_type") == "blog").alias("n_blogs"),
    )


def option_category_count(text: Column) -> Column:
    """Header lines followed by two or more bullets within 14 lines."""
    items = lambda block: F.filter(
        F.slice(lines(block), 2, 14), lambda x: strip(x).startswith("-") | strip(x).startswith("*")
    )
    header = r"(?:#{2,4}\s+)?[A-Z][^:\n]{2,40}:"
    tail = F.slice(blocks(text, header), 2, 1_000_000_000)
    return F.size(F.filter(tail, lambda block: F.size(items(block)) >= 2))


def option_categories(pages: DataFrame) -> DataFrame:
    """Option category count of each page."""
    return pages.select("page_id", "url", option_category_count(F.col("markdown")).alias("option_categories"))


def classify_rules(pages: DataFrame) -> DataFrame:
    """Url patterns first, then blog, product and list evidence."""
    md, low, low_url = F.col("markdown"), F.col("low"), F.col("low_url")
    prepared = pages.select(
        "page_id", "url", "markdown", F.lower("markdown").alias("low"), F.lower("url").alias("low_url")
    )
    add = lambda test, value: F.when(test, value).otherwise(0.0)
    blog = (
        add(md.rlike(lex.RULE_BLOG_DATE), 0.40)
        + add(md.rlike(lex.RULE_BLOG_AUTHOR), 0.30)
        + add(md.rlike(lex.RULE_BLOG_TAGS), 0.20)
        + count_contained(low, lex.RULE_BLOG_WORDS) * F.lit(0.10)
    )
    modifiers = count_matches(md, lex.RULE_PRICE_MODIFIER)
    product = (
        add(md.rlike(lex.RULE_BASE_PRICE), 0.30)
        + add(modifiers >= 3, 0.25)
        + _band(F.col("option_categories"), [(3, F.lit(0.30)), (2, F.lit(0.20))])
        + add(count_contained(low, lex.RULE_CUSTOM_WORDS) >= 3, 0.15)
        + add(count_contained(low, lex.RULE_PRODUCT_WORDS) >= 2, 0.10)
        + add(md.rlike(lex.RULE_PURCHASE_CTA), 0.10)
        + add(md.rlike(lex.RULE_CUSTOM_CTA), 0.10)
        + add(count_matches(md, lex.RULE_CHECKBOX) >= 3, 0.15)
    )
    phrases = total(count_matches(low, p) for p in lex.RULE_LIST_PHRASES)
    listing = _band(phrases, [(15, F.lit(0.60)), (8, F.lit(0.40)), (5, F.lit(0.20))]) + add(
        contains_any(low, lex.RULE_PAGING_WORDS), 0.25
    )
    cap = lambda c: F.least(c, F.lit(1.0))
    scored = (
        prepared.withColumn("option_categories", option_category_count(md))
        .select(
            "page_id",
            "url",
            (F.length(md) < SHORT_PAGE).alias("too_short"),
            first_hit(
                [
                    (matches_any(low_url, lex.STRONG_PRODUCT_URLS), F.lit("product")),
                    (matches_any(low_url, lex.STRONG_LIST_URLS), F.lit("list")),
                    (matches_any(low_url, lex.STRONG_BLOG_URLS), F.lit("blog")),
                ],
                F.lit(""),
            ).alias("url_type"),
            cap(blog).alias("blog_score"),
            cap(product).alias("product_score"),
            cap(listing).alias("list_score"),
        )
    )
    blog_score, product_score, list_score = F.col("blog_score"), F.col("product_score"), F.col("list_score")
    rules = [
        (F.col("too_short"), "other", F.lit(0.0)),
        (F.col("url_type") != "", None, F.lit(0.9)),
        (blog_score >= 0.6, "blog", blog_score),
        ((product_score >= 0.55) & (product_score > list_score), "product", product_score),
        (list_score >= 0.5, "list", list_score),
    ]
    return scored.select(
        "page_id",
        "url",
        first_hit(
            [(test, F.col("url_type") if name is None else F.lit(name)) for test, name, _ in rules], F.lit("other")
        ).alias("page_type"),
        first_hit([(test, value) for test, _, value in rules], F.lit(0.3)).alias("confidence"),
        "blog_score",
        "product_score",
        "list_score",
    )


def type_distribution(classified: DataFrame) -> DataFrame:
    """Count and percent by page type; the window runs over the few type rows."""
    from pyspark.sql import Window as W

    counts = classified.groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(W.partitionBy()) * 100)


def classification_reasons(classified: DataFrame) -> DataFrame:
    """Ordered reasons of each page: page_id, page_type, pos, reason."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    score = F.format_number("score", 1)
    verdict = F.when(F.col("is_product"), "PRODUCT").otherwise("NOT PRODUCT")
    scored_reasons = F.array_compact(
        F.array(
            F.when(F.col("product_url"), "Product URL pattern detected"),
            F.when(F.col("blog_url"), "Blog URL pattern detected"),
            F.when(F.col("product_words") > 0, text("Found ", F.col("product_words"), " product keywords")),
            F.when(F.col("has_base_price"), "Base price found"),
            F.when(F.col("price_count") >= 5, text("Multiple prices found (", F.col("price_count"), ")")),
            F.when(F.col("option_categories") >= 2, text("Found ", F.col("option_categories"), " option categories")),
            F.when(F.col("blog_words") >= 3, "Strong blog indicators detected"),
            F.concat(verdict, F.lit(" (score: "), score, F.lit(", threshold: "),
                     F.col("product_threshold").cast("string"), F.lit(")")),
        )
    )
    reasons = (
        F.when(F.col("too_short"), F.array(F.lit("Content too short")))
        .when(F.col("blocked_by") != "", F.array(text("Non-product URL pattern: ", F.col("blocked_by"))))
        .otherwise(scored_reasons)
    )
    return unnest(classified, ["page_id", "page_type"], reasons, item="reason")


def reason_counts(reasons: DataFrame) -> DataFrame:
    """How often each reason occurs per page type."""
    return reasons.groupBy("page_type", "reason").agg(F.count(F.lit(1)).alias("n"))


