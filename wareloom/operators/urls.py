"""URLs, links, images and page text (row-local unless a result is per site)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicons as lex
from ..functions import urls as U
from ..functions.text import BLANKS, extract, extract_all, lines, squeeze, strip, unnest
from .ordering import numbered

HREF = r"""(?i)href=["']([^"']+)["']"""


def canonical_pages(pages: DataFrame, mode: str = "crawl") -> DataFrame:
    """First page per canonical url and how many pages share it.

    A partial aggregate runs before the only shuffle, so a url that holds a
    large part of all rows is folded on the map side.
    """
    keyed = pages.select("page_id", "url", U.canonical_by_mode(F.col("url"), mode).alias("canonical"))
    return (
        keyed.filter(F.col("canonical").isNotNull())
        .groupBy("canonical")
        .agg(
            F.min("page_id").alias("page_id"),
            F.min_by("url", "page_id").alias("url"),
            F.count(F.lit(1)).alias("n_pages"),
        )
        .withColumn("n_duplicates", F.col("n_pages") - 1)
    )


def skip_reasons(urls: DataFrame, profile: str = "crawl", base: str | None = None) -> DataFrame:
    """Tag each url with the first skip rule that hits ('' when none does)."""
    url = F.col("url")
    if profile == "crawl":
        reason = U.crawl_skip_reason(url)
    elif profile == "site":
        reason = U.site_skip_reason(url, F.col(base) if base else url)
    elif profile == "fetch":
        reason = F.when(U.fetch_blocked(url), "blocked").otherwise("")
    else:
        raise ValueError(f"unknown profile {profile}")
    return urls.withColumn("reason", reason)


def skip_histogram(tagged: DataFrame, top: int | None = None) -> DataFrame:
    """Skip reasons by falling frequency, the first `top` if given."""
    counted = (
        tagged.filter(F.col("reason") != "")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "reason")
    )
    return counted if top is None else counted.limit(top)


def _raw_links(body: str, kind: str):
    pattern, group = (HREF, 1) if kind == "html" else (lex.LINK_MARKDOWN, 2)
    return extract_all(F.col(body), pattern, group)


def link_edges(pages: DataFrame, kind: str = "markdown", host_mode: str = "raw") -> DataFrame:
    """Distinct same-site page links of every page: page_id, url, link."""
    body = "html" if kind == "html" else "markdown"
    base = F.col("url")
    found = F.transform(
        F.filter(_raw_links(body, kind), lambda x: ~x.startswith("#") & ~x.startswith("mailto:")),
        lambda x: U.absolute(x, base),
    )
    kept = F.filter(
        found,
        lambda x: (U.host_by_mode(x, host_mode) == U.host_by_mode(base, host_mode)) & U.is_page_link(x),
    )
    cleaned = F.array_distinct(F.transform(kept, U.without_query))
    return unnest(pages, ["page_id", "url"], cleaned, item="link").drop("pos")


def one_hop(edges: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Links of each page after normalizing, in order; the first max_urls per page if given.

    `edges` carries pos, the place of the link on its page.
    """
    normal = edges.withColumn("link", U.with_query(F.col("link"))).filter(F.col("link").isNotNull())
    same = normal.filter(U.host(F.col("link")) == U.host(F.col("url")))
    firsts = same.groupBy("page_id", "url", "link").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    ranked = firsts.withColumn("rank", rank).drop("pos")
    return ranked if max_urls is None else ranked.filter(F.col("rank") <= max_urls)


def page_links(pages: DataFrame, kind: str = "markdown") -> DataFrame:
    """All page links in text order, absolute: page_id, url, pos, link."""
    body = "html" if kind == "html" else "markdown"
    usable = F.filter(
        _raw_links(body, kind),
        lambda x: ~x.startswith("#")
        & ~x.startswith("mailto:")
        & ~F.lower(x).rlike(r"\.jpg|\.png|\.gif|\.svg|\.webp"),
    )
    return unnest(pages, ["page_id", "url"], usable, item="raw_link").select(
        "page_id", "url", "pos", U.absolute(F.col("raw_link"), F.col("url")).alias("link")
    )


def page_images(pages: DataFrame) -> DataFrame:
    """Distinct images per page without tracking pixels: page_id, image."""
    images = F.filter(
        extract_all(F.col("markdown"), lex.IMAGE_MARKDOWN, 2),
        lambda x: ~F.contains(F.lower(x), F.lit("pixel")) & ~F.contains(x, F.lit("g.gif")),
    )
    return unnest(pages, ["page_id"], F.array_distinct(images), item="image").drop("pos")


def image_inventory(pages: DataFrame) -> DataFrame:
    """How many pages show each image."""
    return page_images(pages).groupBy("image").agg(F.count(F.lit(1)).alias("n_pages"))


def url_info(pages: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Title, short title and snippet of each page, with its crawl depth if given."""
    md = F.col("markdown")
    trimmed = F.transform(lines(md), lambda x: strip(x))
    heads = F.filter(F.slice(trimmed, 1, 20), lambda x: x.startswith("# "))
    title = F.coalesce(strip(F.ltrim(F.get(heads, 0), F.lit("#"))), F.lit("Untitled Page"))
    first_h1 = strip(extract(md, r"(?m)^#\s+(.+)$"))
    plain = F.filter(trimmed, lambda x: (x != "") & ~x.startswith("[") & ~x.startswith("!"))
    short_title = F.coalesce(first_h1, F.substring(F.get(plain, 0), 1, 100), F.lit(""))
    info = pages.select(
        "page_id",
        "url",
        title.alias("title"),
        short_title.alias("short_title"),
        strip(F.substring(md, 1, 500)).alias("snippet"),
    )
    if discovered is None:
        return info
    depth = discovered.select("canonical", "depth")
    keyed = info.withColumn("canonical", U.canonical(F.col("url")))
    return keyed.join(depth, "canonical", "left").drop("canonical")


#: Letters of a pattern (with its slash) that cut a host's patterns into pieces.
PIECE_LETTERS = 4


def path_patterns(pages: DataFrame, top: int | None = None) -> DataFrame:
    """First path segments linked from each host, sorted, the first `top` if given.

    The distinct runs per (host, segment). With `top` the row limit is pushed
    below the shuffle; without it a host's segments are numbered in pieces by
    their first letters. Either way a very large host is not gathered in one task.
    """
    segments = F.array_distinct(F.transform(_raw_links("html", "html"), U.first_path_segment))
    found = unnest(pages, ["url"], segments, item="pattern").filter(F.col("pattern").isNotNull())
    distinct = found.select(U.host(F.col("url")).alias("host"), "pattern").distinct()
    if top is None:
        placed = numbered(distinct, "pattern", keys=["host"], name="rank", part=F.substring("pattern", 1, PIECE_LETTERS))
        return placed.withColumn("rank", F.col("rank") + 1)
    rank = F.row_number().over(W.partitionBy("host").orderBy("pattern"))
    return distinct.withColumn("rank", rank).filter(F.col("rank") <= top)


def plain_text(kind: str):
    """Plain text of a page body as a column."""
    if kind == "html":
        text = F.regexp_replace(F.col("html"), r"(?is)<script[^>]*>.*?</script>", "")
        text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", "")
        return strip(squeeze(F.regexp_replace(text, r"<[^>]+>", " ")))
    # Images go before links, or their alt texts would stay behind with a '!'.
    text = F.regexp_replace(F.col("markdown"), r"!\[([^\]]*)\]\([^\)]+\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^\)]+\)", "$1")
    text = F.regexp_replace(text, r"(?m)^#{1,6}\s+", "")
    text = F.regexp_replace(text, r"\*\*([^\*]+)\*\*", "$1")
    text = F.regexp_replace(text, r"\*([^\*]+)\*", "$1")
    text = F.regexp_replace(text, r"```[^`]*```", "")
    text = F.regexp_replace(text, r"`([^`]+)`", "$1")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"), BLANKS)


def page_text(pages: DataFrame, kind: str = "html") -> DataFrame:
    """Plain text of every page with its length and word count."""
    text = pages.select("page_id", "url", plain_text(kind).alias("text"))
    return text.withColumn("n_chars", F.length("text")).withColumn(
        "n_words", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", r"\s+")))
    )


def text_totals(texts: DataFrame) -> DataFrame:
    """Pages, characters and words per site."""
    return texts.groupBy(U.host(F.col("url")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("n_words").alias("n_words"),
    )


def page_lookup(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Body of each wanted url: by canonical form first, then by raw url, else ''.

    Keys are folded to their first page before the body is joined, so each
    side carries a page body at most once.
    """
    key = pages.select("page_id", "url", U.canonical(F.col("url")).alias("canonical"))
    by_canonical = key.groupBy("canonical").agg(F.min("page_id").alias("canonical_id"))
    by_url = key.groupBy(F.col("url").alias("wanted_url")).agg(F.min("page_id").alias("raw_id"))
    asked = wanted.select(F.col("url").alias("wanted_url")).withColumn("canonical", U.canonical(F.col("wanted_url")))
    found = (
        asked.join(by_canonical, "canonical", "left")
        .join(by_url, "wanted_url", "left")
        .select("wanted_url", F.coalesce("canonical_id", "raw_id").alias("page_id"))
    )
    body = "html" if "html" in pages.columns else "markdown"
    return found.join(pages.select("page_id", F.col(body).alias("body")), "page_id", "left").select(
        F.col("wanted_url").alias("url"), "page_id", F.coalesce("body", F.lit("")).alias("body")
    )


