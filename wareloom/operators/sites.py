"""Site profiling: link mix, site signals, category hints, navigation, flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import urls as U
from ..functions.text import (
    any_of,
    contains_any,
    count_matches,
    extract,
    extract_all,
    first_hit,
    first_of_each,
    squeeze,
    strip,
    unnest,
)
from .urls import HREF, path_patterns, plain_text

NAV_BLOCKS = [
    (r"(?is)<nav[^>]*>(.*?)</nav>", 1),
    (r"(?is)<header[^>]*>(.*?)</header>", 1),
    (r"""(?is)<div[^>]*class=["'][^"']*(nav|menu|header-nav)[^"']["'][^>]*>(.*?)</div>""", 2),
    (r"""(?is)<ul[^>]*class=["'][^"']*(nav|menu|navigation)[^"']["'][^>]*>(.*?)</ul>""", 2),
]
NAV_LINK = r"""(?i)<a[^>]*href=["']([^"']+)["'][^>]*>([^<]+)</a>"""
TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
META_NAME_FIRST = r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']"""
META_CONTENT_FIRST = r"""(?i)<meta[^>]*content=["']([^"']+)["'][^>]*name=["']description["']"""


def _link_counts():
    links = extract_all(F.col("html"), HREF, 1)
    lowered = F.transform(links, F.lower)

    def like(words):
        return F.size(F.filter(lowered, lambda x: contains_any(x, words)))

    return [
        F.size(links).alias("link_count"),
        like(lex.PRODUCT_LINK_WORDS).alias("product_like_links"),
        like(lex.PROJECT_LINK_WORDS).alias("project_like_links"),
        like(lex.BLOG_LINK_WORDS).alias("blog_like_links"),
    ]


LINK_COUNTS = ["link_count", "product_like_links", "project_like_links", "blog_like_links"]


def link_mix(pages: DataFrame) -> DataFrame:
    """Links per site in total and by kind; a link may count in several."""
    counted = pages.select(U.host(F.col("url")).alias("host"), *_link_counts())
    return counted.groupBy("host").agg(*[F.sum(c).alias(c) for c in LINK_COUNTS])


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals of each page, computed in one pass over its html."""
    html = F.col("html")
    low = F.lower(html)
    script_heavy = contains_any(low, lex.SCRIPT_APP_MARKERS) | (count_matches(html, r"(?i)<script") > 15)
    tags = count_matches(html, r"<[^>]+>")
    density = first_hit([(tags < 100, F.lit("low")), (tags < 500, F.lit("medium"))], F.lit("high"))
    words = F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(i)) for i, w in enumerate(lex.SITE_KEYWORDS)])
    return pages.select(
        "page_id",
        "url",
        U.host(F.col("url")).alias("host"),
        *_link_counts(),
        script_heavy.alias("js_dependency"),
        contains_any(low, lex.FORM_MARKERS).alias("forms_detected"),
        density.alias("html_density"),
        F.array_compact(words).alias("keyword_numbers"),
        strip(F.coalesce(extract(html, TITLE), F.lit(""))).alias("page_title"),
        strip(
            F.coalesce(extract(html, META_NAME_FIRST), extract(html, META_CONTENT_FIRST), F.lit(""))
        ).alias("meta_description"),
        F.substring(plain_text("html"), 1, 500).alias("sample_text"),
    )


def site_signals(pages: DataFrame, patterns_top: int | None = None) -> DataFrame:
    """One row per site.

    Counts add up over the pages, flags hold when any page has them, and
    title, description, density and sample come from the site's first page.
    With `patterns_top` only so many path patterns of a site are listed.
    """
    signals = page_signals(pages)
    home = F.struct("page_id", "html_density", "page_title", "meta_description", "sample_text")
    found = [
        F.bool_or(F.array_contains("keyword_numbers", F.lit(i))).alias(f"keyword_{i}")
        for i in range(len(lex.SITE_KEYWORDS))
    ]
    sites = signals.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"),
        *[F.sum(c).alias(c) for c in LINK_COUNTS],
        F.bool_or("js_dependency").alias("js_dependency"),
        F.bool_or("forms_detected").alias("forms_detected"),
        F.min_by(home, "page_id").alias("home"),
        *found,
    )
    words = F.array_compact(
        F.array(*[F.when(F.col(f"keyword_{i}"), F.lit(w)) for i, w in enumerate(lex.SITE_KEYWORDS)])
    )
    patterns = (
        path_patterns(pages, patterns_top)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("pattern")).alias("url_patterns"))
    )
    return sites.join(patterns, "host", "left").select(
        "host",
        "n_pages",
        *LINK_COUNTS,
        F.coalesce("url_patterns", F.array().cast("array<string>")).alias("url_patterns"),
        "js_dependency",
        "forms_detected",
        "home.html_density",
        words.alias("keywords_found"),
        "home.page_title",
        "home.meta_description",
        "home.sample_text",
    )


def category_hints(pages: DataFrame, top: int | None = None) -> DataFrame:
    """Category rules that hold for a site, in rule order, the first `top` if given."""
    low_html, low_url = F.lower("html"), F.lower("url")
    rules = [(name, contains_any(low_html, terms)) for name, terms in lex.SITE_CATEGORY_TERMS]
    rules += [
        (name, contains_any(low_html, terms) | contains_any(low_url, terms)) for name, terms in lex.INDUSTRY_TERMS
    ]
    flagged = pages.select(
        U.host(F.col("url")).alias("host"), *[test.alias(f"rule_{i}") for i, (_, test) in enumerate(rules)]
    )
    sites = flagged.groupBy("host").agg(*[F.bool_or(f"rule_{i}").alias(f"rule_{i}") for i in range(len(rules))])
    hits = F.array_compact(F.array(*[F.when(F.col(f"rule_{i}"), F.lit(n)) for i, (n, _) in enumerate(rules)]))
    return sites.select("host", F.posexplode(hits if top is None else F.slice(hits, 1, top)).alias("rank", "category")).withColumn(
        "rank", F.col("rank") + 1
    )


def nav_links(pages: DataFrame, top: int | None = None, whole_page_chars: int | None = None) -> DataFrame:
    """Navigation links of each page: unique texts in order, the first `top` if given.

    A page without a navigation block is read as a whole, or its first
    `whole_page_chars` characters if given.
    """
    html, url = F.col("html"), F.col("url")
    nav = F.coalesce(
        *[F.get(extract_all(html, pattern, group), 0) for pattern, group in NAV_BLOCKS],
        html if whole_page_chars is None else F.substring(html, 1, whole_page_chars),
    )
    links = F.transform(
        extract_all(nav, NAV_LINK, 0),
        lambda m: F.struct(
            squeeze(strip(F.regexp_extract(m, NAV_LINK, 2))).alias("text"),
            F.regexp_extract(m, NAV_LINK, 1).alias("href"),
            U.absolute(F.regexp_extract(m, NAV_LINK, 1), url).alias("full_url"),
        ),
    )
    site = F.filter(
        links,
        lambda x: (F.length(x["text"]) >= 2)
        & ~contains_any(F.lower(x["href"]), lex.NAV_SKIP_MARKERS)
        & F.contains(url, U.raw_host(x["full_url"])),
    )
    unique = first_of_each(site, lambda x: F.lower(x["text"]))
    if top is not None:
        unique = F.slice(unique, 1, top)
    return unnest(pages, ["page_id", "url"], unique).select("page_id", "url", "pos", "item.*")


def recommend_flow(signals: DataFrame, nav: DataFrame) -> DataFrame:
    """Crawler, scraper and strictness per site from ordered rules.

    "Heavy" means: more project-like than product-like links for a
    portfolio, over half of all links for a blog, over half of the
    navigation texts for services.
    """
    text = F.lower("text")

    def has(words):
        return F.bool_or(contains_any(text, words))

    menus = nav.groupBy(U.host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_nav"),
        has(lex.NAV_CONFIGURATOR_WORDS).alias("nav_configurator"),
        has(lex.NAV_SHOP_WORDS).alias("nav_shop"),
        has(lex.NAV_PORTFOLIO_WORDS).alias("nav_portfolio"),
        F.count_if(contains_any(text, lex.NAV_SERVICE_WORDS)).alias("n_nav_services"),
    )
    s = signals.join(menus, "host", "left").fillna(False).fillna(0, ["n_nav", "n_nav_services"])
    words = any_of(F.array_contains("keywords_found", w) for w in lex.CONFIGURATOR_KEYWORDS)
    product, project, blog = F.col("product_like_links"), F.col("project_like_links"), F.col("blog_like_links")
    rules = [
        ("nav_configurator", F.col("nav_configurator"), ("unified", "lam", "balanced")),
        ("nav_shop", F.col("nav_shop"), ("web", "static", "lenient")),
        ("nav_portfolio", F.col("nav_portfolio"), ("unified", "ai", "strict")),
        ("nav_services", F.col("n_nav_services") * 2 > F.col("n_nav"), ("unified", "ai", "strict")),
        ("configurator_words", words, ("unified", "lam", "balanced")),
        ("script_heavy", F.col("js_dependency"), ("unified", "lam", "balanced")),
        ("project_links", project > product, ("unified", "ai", "strict")),
        ("blog_links", blog * 2 > F.col("link_count"), ("web", "static", "strict")),
        ("product_links", (product > 0) & (blog == 0), ("web", "static", "balanced")),
        ("mixed_links", (product > 0) & (blog > 0), ("web", "auto", "balanced")),
    ]
    default = ("web", "static", "balanced")

    def choose(i: int):
        return first_hit([(test, F.lit(out[i])) for _, test, out in rules], F.lit(default[i]))

    fallback = "unified/lam: if configurator detected; ai/ai: if semantic extraction needed"
    return s.select(
        "host",
        first_hit([(test, F.lit(name)) for name, test, _ in rules], F.lit("default")).alias("rule"),
        choose(0).alias("crawler"),
        choose(1).alias("scraper"),
        choose(2).alias("strictness"),
        F.lit(fallback).alias("fallback_plan"),
        F.lit(10).alias("max_pages"),
        F.lit(3).alias("max_depth"),
        F.lit(0.5).alias("crawl_delay"),
    )
