"""Configurator detection and the source of a product's customizations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import urls as U
from ..functions.frames import union_rows
from ..functions.text import (

    blocks,
    contains_any,
    count_contained,
    count_matches,
    extract_all,
    first_hit,
    let,
    strip,
    total,
    unnest,
)

LINK_MIN_SCORE = 3
GROUP_HEADER = r"#+[^\S\n]+[^\n]*|[A-Z][^:\n]{3,30}:|\*\*[A-Z][^*\n]+\*\*"
GROUP_ITEM = r"(?m)^[^\S\n]*(?:[-*•][^\S\n]+\S|\d+\.[^\S\n]+\S|-[^\S\n]*\[[x ]\])"


def scored_links(text: Column, url: Column) -> Column:
    """Links that may lead to a configurator: array<struct(pos, link, text, score)>."""

    def parts(match: Column, i: Column) -> Column:
        link = F.regexp_extract(match, lex.LINK_MARKDOWN, 2)
        link_text = F.lower(F.regexp_extract(match, lex.LINK_MARKDOWN, 1))
        return F.struct(i.alias("pos"), link.alias("link"), F.lower(link).alias("low"), link_text.alias("text"))

    def score(x: Column) -> Column:
        points = (
            count_contained(x["text"], lex.ACTION_WORDS) * 3
            + count_contained(x["low"], lex.LINK_URL_WORDS) * 2
            + contains_any(x["text"], lex.BUTTON_PHRASES).cast("int") * 2
        )
        return F.struct(x["pos"].alias("pos"), x["link"].alias("link"), points.alias("score"))

    # one step after the other: inside a lambda, a text that several words look at would be cut out for each of them
    cut = F.transform(extract_all(text, lex.LINK_MARKDOWN), parts)
    found = F.filter(F.transform(cut, score), lambda x: x["score"] >= LINK_MIN_SCORE)
    return F.transform(
        found, lambda x: F.struct(x["pos"].alias("pos"), U.absolute(x["link"], url).alias("link"), x["score"].alias("score"))
    )


def configurator_links(pages: DataFrame) -> DataFrame:
    """Likely configurator links; the first one of a page is its target."""
    links = scored_links(F.col("markdown"), F.col("url"))
    rows = unnest(pages, ["page_id", "url"], links, "n", "hit")
    return rows.select(
        "page_id",
        "hit.pos",
        "hit.link",
        "hit.score",
        (F.col("n") == 0).alias("is_target"),
        (U.host(F.col("hit.link")) != U.host(F.col("url"))).alias("is_external"),
    )


def option_group_count(text: Column) -> Column:
    """Headers with two or more items before the next header or blank line."""
    tail = F.slice(blocks(text, GROUP_HEADER), 2, 1_000_000_000)
    first_part = lambda block: F.element_at(F.split(block, r"\n[^\S\n]*(?:\n|\z)", 2), 1)
    return F.size(F.filter(tail, lambda b: count_matches(first_part(b), GROUP_ITEM) >= 2))


def configurator_signals(pages: DataFrame) -> DataFrame:
    """The five signals of a page, with type, target and confidence."""
    md, low = F.col("markdown"), F.col("low")
    prepared = pages.select("page_id", "url", "markdown", F.lower("markdown").alias("low"))
    content = F.floor(
        count_contained(low, lex.ACTION_WORDS)
        + count_contained(low, lex.INDICATOR_WORDS) * F.lit(0.5)
        + F.when(count_matches(low, r"step\s+\d+") >= 2, 3).otherwise(0)
    ).cast("int")
    form = (
        F.least(F.floor(count_matches(md, lex.CHECKBOX_PATTERN) / 3), F.lit(3))
        + total(F.least(F.floor(count_matches(md, p) / 3), F.lit(2)) for p in lex.RADIO_PATTERNS)
        + count_contained(low, lex.DROPDOWN_WORDS)
    )
    prices = F.array_distinct(F.concat(*[extract_all(md, p) for p in lex.VARIANT_PRICE_PATTERNS]))
    counted = prepared.select(
        "page_id",
        "url",
        let(
            scored_links(md, F.col("url")),
            lambda hits: F.struct(F.size(hits).alias("n"), F.get(hits, 0)["link"].alias("target")),
        ).alias("hits"),
        content.alias("content_score"),
        F.least(form, F.lit(10)).cast("int").alias("form_elements"),
        option_group_count(md).alias("option_groups"),
        F.size(prices).alias("price_variants"),
    ).select(
        "page_id",
        "url",
        F.col("hits.n").alias("links"),
        F.col("hits.target").alias("configurator_url"),
        "content_score",
        "form_elements",
        "option_groups",
        "price_variants",
    )
    return with_confidence(counted)


def _bands(c: Column, bands: list[tuple[int, float]]) -> Column:
    return first_hit([(c >= least, F.lit(value)) for least, value in bands], F.lit(0.0))


def with_confidence(counted: DataFrame) -> DataFrame:
    """Add has_configurator, type and confidence to the five counts."""
    links, content, form = F.col("links"), F.col("content_score"), F.col("form_elements")
    groups, variants = F.col("option_groups"), F.col("price_variants")
    embedded = (content > 0) | (form > 0) | (groups >= 2)
    external = U.host(F.col("configurator_url")) != U.host(F.col("url"))
    confidence = (
        _bands(links, [(1, 0.35)])
        + _bands(content, [(3, 0.25), (1, 0.15)])
        + _bands(form, [(3, 0.20), (1, 0.10)])
        + _bands(groups, [(3, 0.15), (2, 0.10)])
        + _bands(variants, [(5, 0.15), (3, 0.10)])
    )
    return (
        counted.withColumn("has_configurator", (links > 0) | embedded | (variants >= 3))
        .withColumn(
            "configurator_type",
            first_hit(
                [
                    ((links > 0) & external, F.lit("external")),
                    ((links > 0) | embedded, F.lit("embedded")),
                ],
                F.lit("none"),
            ),
        )
        .withColumn(
            "confidence", F.when(F.col("has_configurator"), F.least(confidence, F.lit(1.0))).otherwise(0.0)
        )
    )


def configurator_decision(signals: DataFrame) -> DataFrame:
    """Whether to follow the configurator of a page, and why."""
    external = F.col("configurator_type") == "external"
    high = F.col("confidence") >= 0.5
    rules = [
        (~F.col("has_configurator"), F.lit("no_configurator_detected")),
        (F.col("confidence") < 0.25, F.lit("confidence_too_low")),
        (external & high, F.lit("external_configurator_high_confidence")),
        (external, F.lit("external_configurator_medium_confidence")),
        (high, F.lit("embedded_configurator_high_confidence")),
    ]
    reason = first_hit(rules, F.lit("embedded_configurator_medium_confidence"))
    return signals.withColumn(
        "should_scrape", F.col("has_configurator") & (F.col("confidence") >= 0.25)
    ).withColumn("reason", reason)


def decision_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def platform(url: Column) -> Column:
    """Configurator platform by host, 'generic_external' when none fits."""
    host = U.host(url)
    return first_hit([(F.contains(host, F.lit(k)), F.lit(p)) for k, p in lex.PLATFORM_OF], F.lit("generic_external"))


def script_heavy(text: Column) -> Column:
    """Two or more script markers, or too little text to be a rendered page."""
    return (count_contained(F.lower(text), lex.SCRIPT_HEAVY_MARKERS) >= 2) | (F.length(strip(text)) < 500)


def platform_report(pages: DataFrame) -> DataFrame:
    """Pages and script-heavy pages per platform of their configurator link."""
    first = F.slice(scored_links(F.col("markdown"), F.col("url")), 1, 1)
    rows = unnest(pages.select("url", "markdown", script_heavy(F.col("markdown")).alias("heavy")), ["heavy"], first)
    return (
        rows.filter(F.col("item.link").isNotNull())
        .groupBy(platform(F.col("item.link")).alias("platform"))
        .agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("heavy").alias("n_script_heavy"))
    )


def customization_source(
    decisions: DataFrame, pages: DataFrame, configurator_options: DataFrame, page_options: DataFrame
) -> DataFrame:
    """Which page gives the options of a product, and under what label.

    An external configurator page counts when it has options of its own
    kind, an embedded one when it is stored at all; otherwise the product
    page itself is used. Only keys are joined here, no page text, and by
    shuffles: keys of derived pages look as small as the table that the pages
    come from, and would be broadcast through the driver. A product without a
    configurator url meets no page; its id spreads such products.
    """
    stored = (
        pages.select(U.canonical(F.col("url")).alias("target"), "page_id")
        .groupBy("target")
        .agg(F.min("page_id").alias("target_id"))
    )
    own_kind = configurator_options.select(F.col("page_id").alias("target_id")).distinct().withColumn("own", F.lit(True))
    any_kind = page_options.select(F.col("page_id").alias("target_id")).distinct().withColumn("any", F.lit(True))
    known = stored.join(own_kind.hint("merge"), "target_id", "left").join(any_kind.hint("merge"), "target_id", "left")
    target = U.canonical(F.col("configurator_url"))
    asked = decisions.withColumn("asked", target).withColumn(
        "key", F.coalesce("asked", F.concat_ws(" ", F.lit(""), "page_id", "url"))
    )
    meets = F.col("asked").isNotNull() & (F.col("key") == F.col("target"))
    joined = asked.join(known.hint("merge"), meets, "left")
    external = F.col("configurator_type") == "external"
    has_url = F.col("configurator_url").isNotNull()
    has_options = F.coalesce("own", "any", F.lit(False))
    source = first_hit(
        [
            (~F.col("should_scrape"), F.lit("none")),
            (external & has_url & has_options, F.lit("external_configurator")),
            (external & has_url, F.lit("product_page_fallback")),
            (has_url & F.col("target_id").isNotNull(), F.lit("embedded_configurator_page")),
            (has_url, F.lit("product_page_fallback")),
        ],
        F.lit("product_page"),
    )
    chosen = joined.withColumn("customization_source", source)
    followed = F.col("customization_source").isin("external_configurator", "embedded_configurator_page")
    own = F.col("customization_source").isin("product_page", "product_page_fallback")
    return chosen.select(
        "page_id",
        "url",
        "customization_source",
        F.when(followed, F.col("target_id")).when(own, F.col("page_id")).alias("options_page_id"),
        F.when(
            F.col("customization_source") == "external_configurator", platform(F.col("configurator_url"))
        ).alias("external_platform"),
        ((F.col("customization_source") == "external_configurator") & F.col("own").isNotNull()).alias("own_kind"),
    )


def customizations(sources: DataFrame, configurator_options: DataFrame, page_options: DataFrame) -> DataFrame:
    """Options of every product from its chosen source page."""
    columns = ["category", "category_pos", "pos", "label", "price", "image"]
    page = F.col("page_id").alias("options_page_id")
    kinds = union_rows(
        configurator_options.select(page, F.lit(True).alias("own_kind"), *columns),
        page_options.select(page, F.lit(False).alias("own_kind"), *columns),
    )
    return sources.join(kinds, ["options_page_id", "own_kind"]).select("page_id", "customization_source", *columns)


