"""Queries over urls, links, images, text and the crawl graph."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import urls as U
from ..operators import classify, crawl, urls
from . import sqltext as d
from .registry import cte, query

HREF = urls.HREF


def _canonical_check(key: str, source: str = "pages") -> str:
    return f"""
SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url, canonical, count(*) AS n_pages,
  count(*) - 1 AS n_duplicates
FROM (SELECT page_id, url, {key} AS canonical FROM {source}) k
WHERE canonical IS NOT NULL GROUP BY canonical"""


@query("canonical_pages", _canonical_check(d.canonical("url")))
def _(t):
    return urls.canonical_pages(t.pages())


NO_FRAGMENT = "split_part(url, '#', 1)"
KEEP_QUERY = (
    f"({d.scheme('url')} || '://' || {d.host('url')} || rtrim(regexp_replace({d.path('url')}, ';[^/]*$', ''), '/')"
    f" || {d.rx(d.path('url'), '(;[^/]*)$')} || {d.rx(NO_FRAGMENT, r'([?].+)$')})"
)


@query("canonical_pages_keep_query", _canonical_check(KEEP_QUERY))
def _(t):
    return urls.canonical_pages(t.pages(), "keep_query")


@query("canonical_pages_cut", _canonical_check(d.no_query("url")))
def _(t):
    return urls.canonical_pages(t.pages(), "cut")


@query("skip_reasons", f"SELECT page_id, url, {d.crawl_skip('url')} AS reason FROM product_pages", "product_pages")
def _(t):
    return urls.skip_reasons(t.product_pages().select("page_id", "url"))


cte(
    "md_links",
    f"""
SELECT DISTINCT page_id, url, {d.no_query('full_url')} AS link FROM (
  SELECT page_id, url, {d.absolute('raw', 'url')} AS full_url FROM (
    SELECT page_id, url, unnest({d.rx_all('markdown', lex.LINK_MARKDOWN, 2)}) AS raw FROM product_pages) a
  WHERE NOT starts_with(raw, '#') AND NOT starts_with(raw, 'mailto:')) b
WHERE {d.raw_host('full_url')} = {d.raw_host('url')} AND {d.page_link_ok('full_url')}""",
    "product_pages",
)
cte(
    "html_links",
    f"""
SELECT DISTINCT page_id, url, {d.no_query('full_url')} AS link FROM (
  SELECT page_id, url, {d.absolute('raw', 'url')} AS full_url FROM (
    SELECT page_id, url, unnest({d.rx_all('html', HREF, 1)}) AS raw FROM pages) a
  WHERE NOT starts_with(raw, '#') AND NOT starts_with(raw, 'mailto:')) b
WHERE {d.raw_host('full_url')} = {d.raw_host('url')} AND {d.page_link_ok('full_url')}""",
)


@query(
    "skip_reasons_site",
    f"""SELECT page_id, link AS url, {d.site_skip('link', 'url')} AS reason FROM (
  SELECT page_id, url, {d.absolute('raw', 'url')} AS link FROM (
    SELECT page_id, url, unnest({d.rx_all('markdown', lex.LINK_MARKDOWN, 2)}) AS raw FROM product_pages) a) b
WHERE NOT regexp_matches(lower(link), '\\.jpg|\\.png|\\.gif|\\.svg|\\.webp')""",
    "product_pages",
)
def _(t):
    links = urls.page_links(t.product_pages()).select("page_id", F.col("url").alias("base"), F.col("link").alias("url"))
    return urls.skip_reasons(links, "site", base="base").drop("base")


@query(
    "fetch_blocklist",
    f"""SELECT page_id, url, CASE WHEN {d.any_contained('lower(url)', lex.FETCH_BLOCKLIST)} THEN 'blocked' ELSE '' END
  AS reason FROM product_pages""",
    "product_pages",
)
def _(t):
    return urls.skip_reasons(t.product_pages().select("page_id", "url"), "fetch")


@query(
    "skip_histogram",
    f"""SELECT reason, count(*) AS n FROM (SELECT {d.crawl_skip('link')} AS reason FROM md_links) r
WHERE reason <> '' GROUP BY reason""",
    "md_links",
)
def _(t):
    links = urls.link_edges(t.product_pages()).select(F.col("link").alias("url"))
    return urls.skip_histogram(urls.skip_reasons(links))


@query("link_edges", "SELECT page_id, url, link FROM md_links", "md_links")
def _(t):
    return urls.link_edges(t.product_pages())


@query("html_link_edges", "SELECT page_id, url, link FROM html_links", "html_links")
def _(t):
    return urls.link_edges(t.pages(), "html")


cte("stored", f"SELECT DISTINCT {d.canonical('url')} AS canonical FROM product_pages", "product_pages")
cte(
    "graph",
    f"""SELECT DISTINCT {d.canonical('url')} AS src, {d.canonical('link')} AS dst
FROM md_links WHERE {d.crawl_skip('link')} = ''""",
    "md_links",
)
cte(
    "seeds",
    f"""SELECT DISTINCT canonical FROM (
  SELECT canonical, row_number() OVER (PARTITION BY host ORDER BY page_id, canonical) AS nth FROM (
    SELECT page_id, {d.canonical('url')} AS canonical, {d.host('url')} AS host FROM product_pages WHERE {d.crawl_skip('url')} = '') p
  WHERE canonical IS NOT NULL) f
WHERE nth = 1 OR canonical NOT IN (SELECT {d.canonical('link')} FROM md_links
  WHERE {d.crawl_skip('link')} = '' AND {d.crawl_skip('url')} = '' AND {d.canonical('url')} <> {d.canonical('link')})""",
    "product_pages md_links",
)


def _walk_cte(depth: int) -> str:
    return f"""
SELECT canonical, 0 AS depth FROM seeds
UNION
SELECT graph.dst, walk.depth + 1 FROM walk JOIN graph ON graph.src = walk.canonical WHERE walk.depth < {depth}"""


cte("walk", _walk_cte(3), "seeds graph")
DISCOVERED = """
SELECT w.canonical, w.depth, s.canonical IS NOT NULL AS fetched
FROM (SELECT canonical, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY canonical) w
LEFT JOIN stored s ON s.canonical = w.canonical"""


@query("discover", DISCOVERED, "walk stored", recursive=True)
def _(t):
    pages = t.product_pages()
    return crawl.discover(pages, urls.link_edges(pages), max_depth=3)


@query(
    "discover_stored_only",
    f"{DISCOVERED} WHERE s.canonical IS NOT NULL",
    "walk stored",
    recursive=True,
)
def _(t):
    pages = t.product_pages()
    return crawl.discover(pages, urls.link_edges(pages), max_depth=3, count_failed=False)


@query(
    "one_hop",
    f"""
SELECT page_id, url, link, rank FROM (
  SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM (
    SELECT page_id, url, link, min(pos) AS pos FROM (
      SELECT page_id, url, pos,
        {d.scheme('full_url')} || '://' || {d.host('full_url')}
        || rtrim({d.path('full_url')}, '/') || {d.rx("split_part(full_url, '#', 1)", '([?].+)$')} AS link
      FROM (SELECT page_id, url, pos, {d.absolute('raw', 'url')} AS full_url FROM (
        SELECT page_id, url, unnest(found) AS raw, generate_subscripts(found, 1) AS pos FROM (
          SELECT page_id, url, {d.rx_all('html', HREF, 1)} AS found FROM pages) x) y) z) n
    WHERE {d.host('link')} = {d.host('url')} GROUP BY page_id, url, link) u) r""",
)
def _(t):
    return urls.one_hop(urls.page_links(t.pages(), "html"))


@query(
    "page_images",
    f"""SELECT DISTINCT page_id, image FROM (
  SELECT page_id, unnest({d.rx_all('markdown', lex.IMAGE_MARKDOWN, 2)}) AS image FROM product_pages) i
WHERE NOT contains(lower(image), 'pixel') AND NOT contains(image, 'g.gif')""",
    "product_pages",
)
def _(t):
    return urls.page_images(t.product_pages())


@query(
    "image_inventory",
    f"""SELECT image, count(DISTINCT page_id) AS n_pages FROM (
  SELECT page_id, unnest({d.rx_all('markdown', lex.IMAGE_MARKDOWN, 2)}) AS image FROM product_pages) i
WHERE NOT contains(lower(image), 'pixel') AND NOT contains(image, 'g.gif') GROUP BY image""",
    "product_pages",
)
def _(t):
    return urls.image_inventory(t.product_pages())


@query(
    "url_info",
    f"""
SELECT p.page_id, p.url,
  coalesce({d.strip("ltrim(list_filter(heads, lambda x: starts_with(x, '# '))[1], '#')")}, 'Untitled Page') AS title,
  coalesce(nullif({d.strip(d.rx('markdown', '(?m)^#[ ]+(.+)$'))}, ''), '') AS short_title,
  {d.strip('substr(markdown, 1, 500)')} AS snippet, w.depth
FROM (SELECT *, list_transform(string_split(markdown, chr(10))[1:20], lambda x: {d.strip('x')}) AS heads
      FROM product_pages) p
LEFT JOIN ({DISCOVERED}) w ON w.canonical = {d.canonical('p.url')}""",
    "product_pages walk stored",
    recursive=True,
)
def _(t):
    pages = t.product_pages()
    found = crawl.discover(pages, urls.link_edges(pages), max_depth=3)
    return urls.url_info(pages, found)


@query(
    "path_patterns",
    f"""
SELECT host, pattern, row_number() OVER (PARTITION BY host ORDER BY pattern) AS rank FROM (
    SELECT DISTINCT {d.host('url')} AS host, '/' || regexp_extract({d.no_query('raw')}, '^/+([^/]+)', 1) || '/' AS pattern
    FROM (SELECT url, unnest({d.rx_all('html', HREF, 1)}) AS raw FROM pages) l
    WHERE regexp_extract({d.no_query('raw')}, '^/+([^/]+)', 1) <> '') p""",
)
def _(t):
    return urls.path_patterns(t.pages())


@query(
    "path_segments",
    f"""SELECT page_id, list_filter(string_split({d.path('url')}, '/'), lambda s: s <> '')[-1] AS last_segment,
  coalesce(list_filter(string_split({d.path('url')}, '/'), lambda s: s <> '')[1], '') AS first_segment FROM pages""",
)
def _(t):
    url = F.col("url")
    return t.pages().select(
        "page_id", U.path_segment(url).alias("last_segment"), U.path_segment(url, 0).alias("first_segment")
    )


HTML_TEXT = d.strip(
    d.squeeze(
        "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),"
        " '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"
    )
)
cte(
    "html_text",
    f"""SELECT page_id, url, text, length(text) AS n_chars,
  CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\\s+')) END AS n_words
FROM (SELECT page_id, url, {HTML_TEXT} AS text FROM pages) x""",
)


@query("page_text", "SELECT page_id, url, text, n_chars, n_words FROM html_text", "html_text")
def _(t):
    return urls.page_text(t.pages(), "html")


@query(
    "markdown_text",
    r"""
SELECT page_id, url, text, length(text) AS n_chars,
  CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '\s+')) END AS n_words FROM (
SELECT page_id, url, trim(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    markdown, '!\[([^\]]*)\]\([^\)]+\)', '', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'),
    '\*\*([^\*]+)\*\*', '\1', 'g'), '\*([^\*]+)\*', '\1', 'g'), '```[^`]*```', '', 'g'), '`([^`]+)`', '\1', 'g'),
    '\n{3,}', chr(10) || chr(10), 'g'), """
    + d.BLANKS
    + ") AS text FROM detail_pages) x",
    "detail_pages",
)
def _(t):
    return urls.page_text(t.detail_pages(), "markdown")


@query(
    "text_totals",
    f"""SELECT {d.host('url')} AS host, count(*) AS n_pages, CAST(sum(n_chars) AS BIGINT) AS n_chars,
  CAST(sum(n_words) AS BIGINT) AS n_words FROM html_text GROUP BY 1""",
    "html_text",
)
def _(t):
    return urls.text_totals(urls.page_text(t.pages(), "html"))


cte(
    "wanted",
    f"""SELECT CASE WHEN page_id % 3 = 0 THEN {d.canonical('url')} WHEN page_id % 3 = 1 THEN url
  ELSE url || '/none' END AS url FROM pages""",
)


@query(
    "page_lookup",
    f"""
SELECT w.url, coalesce(c.page_id, r.page_id) AS page_id, coalesce(p.html, '') AS body
FROM wanted w
LEFT JOIN (SELECT {d.canonical('url')} AS k, min(page_id) AS page_id FROM pages GROUP BY 1) c ON c.k = {d.canonical('w.url')}
LEFT JOIN (SELECT url AS k, min(page_id) AS page_id FROM pages GROUP BY 1) r ON r.k = w.url
LEFT JOIN pages p ON p.page_id = coalesce(c.page_id, r.page_id)""",
    "wanted",
)
def _(t):
    pages, url = t.pages(), F.col("url")
    wanted = pages.select(
        F.when(F.col("page_id") % 3 == 0, U.canonical(url))
        .when(F.col("page_id") % 3 == 1, url)
        .otherwise(F.concat(url, F.lit("/none")))
        .alias("url")
    )
    return urls.page_lookup(pages, wanted)


def log_frame(t):
    pages = t.product_pages()
    return crawl.crawl_log(pages, urls.link_edges(pages), classify.classify_balanced(pages))


cte("targets", f"SELECT DISTINCT link AS url, {d.canonical('link')} AS canonical FROM md_links", "md_links")
cte("tagged", f"SELECT page_id, url, {d.crawl_skip('url')} AS reason FROM product_pages", "product_pages")
cte(
    "crawl_log",
    f"""
SELECT url, {d.host('url')} AS host, status, reason FROM (
  SELECT url, 'discovered' AS status, '' AS reason FROM targets
  UNION ALL SELECT url, 'skipped', reason FROM tagged WHERE reason <> ''
  UNION ALL SELECT url, 'crawled', '' FROM tagged WHERE reason = ''
  UNION ALL SELECT t.url, 'product', '' FROM tagged t JOIN balanced b ON b.page_id = t.page_id
    WHERE t.reason = '' AND b.is_product AND b.strictness = 'balanced'
  UNION ALL SELECT url, 'failed', '' FROM targets WHERE {d.crawl_skip('url')} = ''
    AND canonical NOT IN (SELECT canonical FROM stored)) e""",
    "targets tagged balanced stored",
)


@query(
    "crawl_stats",
    "SELECT host, status, count(*) AS n FROM crawl_log GROUP BY ROLLUP (host, status)",
    "crawl_log",
)
def _(t):
    return crawl.crawl_stats(log_frame(t))


@query(
    "crawl_report",
    """
SELECT *, products_found / greatest(total_crawled, 1) * 100 AS product_rate,
  total_skipped / greatest(total_discovered, 1) * 100 AS skip_rate,
  total_failed / greatest(total_crawled, 1) * 100 AS failure_rate
FROM (SELECT count(*) FILTER (status = 'discovered') AS total_discovered,
  count(*) FILTER (status = 'crawled') AS total_crawled, count(*) FILTER (status = 'skipped') AS total_skipped,
  count(*) FILTER (status = 'failed') AS total_failed, count(*) FILTER (status = 'product') AS products_found
  FROM crawl_log) c""",
    "crawl_log",
)
def _(t):
    return crawl.crawl_report(log_frame(t))
