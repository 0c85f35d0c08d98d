"""Queries that profile sites."""

from ..functions import lexicons as lex
from ..operators import sites
from . import sqltext as d
from .registry import cte, query
from .url_queries import HREF, HTML_TEXT

#: A profile lists so many path patterns of its site; the path_patterns query has all.
PATTERNS = 20
ENV = "(SELECT *, lower(html) AS low, lower(url) AS low_url FROM pages)"


def _like(words) -> str:
    return f"len(list_filter({d.rx_all('html', HREF, 1)}, lambda x: {d.any_contained('lower(x)', words)}))"


cte(
    "link_counts",
    f"""SELECT page_id, url, {d.host('url')} AS host, len({d.rx_all('html', HREF, 1)}) AS link_count,
  {_like(lex.PRODUCT_LINK_WORDS)} AS product_like_links, {_like(lex.PROJECT_LINK_WORDS)} AS project_like_links,
  {_like(lex.BLOG_LINK_WORDS)} AS blog_like_links FROM pages""",
)
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in sites.LINK_COUNTS)


@query("link_mix", f"SELECT host, {SUMS} FROM link_counts GROUP BY host", "link_counts")
def _(t):
    return sites.link_mix(t.pages())


WORDS_FOUND = ", ".join(f"CASE WHEN bool_or(contains(low, {d.q(w)})) THEN {d.q(w)} END" for w in lex.SITE_KEYWORDS)
META = f"coalesce(nullif({d.rx('html', sites.META_NAME_FIRST)}, ''), nullif({d.rx('html', sites.META_CONTENT_FIRST)}, ''), '')"
N_TAGS = d.n_rx("html", "<[^>]+>")
cte(
    "signals",
    f"""
SELECT e.*, c.link_count, c.product_like_links, c.project_like_links, c.blog_like_links, p.url_patterns FROM (
  SELECT {d.host('url')} AS host, count(*) AS n_pages,
    bool_or({d.any_contained('low', lex.SCRIPT_APP_MARKERS)} OR {d.n_rx('html', '(?i)<script')} > 15) AS js_dependency,
    bool_or({d.any_contained('low', lex.FORM_MARKERS)}) AS forms_detected,
    arg_min(CASE WHEN {N_TAGS} < 100 THEN 'low' WHEN {N_TAGS} < 500 THEN 'medium' ELSE 'high' END, page_id) AS html_density,
    concat_ws(',', {WORDS_FOUND}) AS keywords,
    arg_min({d.strip(d.rx('html', sites.TITLE))}, page_id) AS page_title,
    arg_min({d.strip(META)}, page_id) AS meta_description,
    arg_min(substr({HTML_TEXT}, 1, 500), page_id) AS sample_text
  FROM {ENV} x GROUP BY 1) e
JOIN (SELECT host, {SUMS} FROM link_counts GROUP BY host) c ON c.host = e.host
LEFT JOIN (SELECT host, string_agg(pattern, ',' ORDER BY pattern) AS url_patterns FROM (
    SELECT host, pattern, row_number() OVER (PARTITION BY host ORDER BY pattern) AS rank FROM (
      SELECT DISTINCT {d.host('url')} AS host, '/' || regexp_extract({d.no_query('raw')}, '^/+([^/]+)', 1) || '/' AS pattern
      FROM (SELECT url, unnest({d.rx_all('html', HREF, 1)}) AS raw FROM pages) l
      WHERE regexp_extract({d.no_query('raw')}, '^/+([^/]+)', 1) <> '') a) b
  WHERE rank <= 20 GROUP BY host) p ON p.host = e.host""",
    "link_counts",
)


def flat_signals(t):
    from pyspark.sql import functions as F

    signals = sites.site_signals(t.pages(), PATTERNS)
    return signals.withColumn("url_patterns", F.array_join("url_patterns", ",")).withColumn(
        "keywords", F.array_join("keywords_found", ",")
    ).drop("keywords_found")


@query("site_signals", "SELECT * REPLACE (coalesce(url_patterns, '') AS url_patterns) FROM signals", "signals")
def _(t):
    return flat_signals(t)


HINTS = [(n, d.any_contained("low", ts)) for n, ts in lex.SITE_CATEGORY_TERMS] + [
    (n, f"({d.any_contained('low', ts)} OR {d.any_contained('low_url', ts)})") for n, ts in lex.INDUSTRY_TERMS
]
HINT_ROWS = " UNION ALL ".join(
    f"SELECT {d.host('url')} AS host, {i} AS rule, {d.q(n)} AS category FROM {ENV} x WHERE {test}"
    for i, (n, test) in enumerate(HINTS)
)


@query(
    "category_hints",
    f"""SELECT host, category, CAST(row_number() OVER (PARTITION BY host ORDER BY rule) AS INT) AS rank
  FROM (SELECT DISTINCT host, rule, category FROM ({HINT_ROWS}) h) u""",
)
def _(t):
    return sites.category_hints(t.pages())


NAV_BLOCK = "coalesce(" + ", ".join(f"nullif({d.rx('html', p, g)}, '')" for p, g in sites.NAV_BLOCKS) + ", html)"


def _nav_check(source: str) -> str:
    return f"""
SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INT) AS pos, text, href, full_url
FROM (
  SELECT page_id, url, place, text, href, full_url,
    row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY place) AS copy FROM (
    SELECT page_id, url, place, {d.squeeze(d.strip('raw_text'))} AS text, href, {d.absolute('href', 'url')} AS full_url FROM (
      SELECT page_id, url, unnest({d.rx_all('block', sites.NAV_LINK, 1)}) AS href,
        unnest({d.rx_all('block', sites.NAV_LINK, 2)}) AS raw_text,
        generate_subscripts({d.rx_all('block', sites.NAV_LINK, 1)}, 1) AS place
      FROM (SELECT page_id, url, {NAV_BLOCK} AS block FROM {source}) n) l) f
  WHERE length(text) >= 2 AND NOT {d.any_contained('lower(href)', lex.NAV_SKIP_MARKERS)}
    AND contains(url, {d.raw_host('full_url')})) u
WHERE copy = 1"""


cte("nav", _nav_check("pages"))
#: Pages whose navigation stands in a header, a div, a list, or in no block at all.
OTHER_BLOCKS = """
SELECT page_id, url, replace(replace(html, '<nav', CASE page_id % 5 WHEN 0 THEN '<nav' WHEN 1 THEN '<header' WHEN 2 THEN '<div class="main-nav1"'
    WHEN 3 THEN '<ul class="menu2"' ELSE '<p' END),
  '</nav>', CASE page_id % 5 WHEN 0 THEN '</nav>' WHEN 1 THEN '</header>' WHEN 2 THEN '</div>' WHEN 3 THEN '</ul>' ELSE '</p>' END) AS html
FROM (SELECT page_id, url, concat('<body><nav><a href="/blog/">Blog</a><a href="/shop/a">Shop</a> <a href="/cart">Cart</a>',
    '<a href="/shop/b"> shop </a><a href="/services/">Our  services</a></nav><a href="/about/">About</a>', html) AS html FROM pages) x
"""
cte("other_pages", OTHER_BLOCKS)
cte("other_nav", _nav_check("other_pages"), "other_pages")


@query("nav_links_fallbacks", "SELECT * FROM other_nav", "other_nav")
def _(t):
    return sites.nav_links(t.derive(OTHER_BLOCKS, "pages"))


@query("nav_links", "SELECT * FROM nav", "nav")
def _(t):
    return sites.nav_links(t.pages())


def _flow_rules(i):
    has = lambda w: f"contains(',' || keywords || ',', ',{w},')"
    rules = [
        ("nav_configurator", "m.nav_configurator", "unified", "lam", "balanced"),
        ("nav_shop", "m.nav_shop", "web", "static", "lenient"),
        ("nav_portfolio", "m.nav_portfolio", "unified", "ai", "strict"),
        ("nav_services", "m.n_services * 2 > m.n_nav", "unified", "ai", "strict"),
        ("configurator_words", "(" + " OR ".join(map(has, lex.CONFIGURATOR_KEYWORDS)) + ")", "unified", "lam", "balanced"),
        ("script_heavy", "js_dependency", "unified", "lam", "balanced"),
        ("project_links", "project_like_links > product_like_links", "unified", "ai", "strict"),
        ("blog_links", "blog_like_links * 2 > link_count", "web", "static", "strict"),
        ("product_links", "product_like_links > 0 AND blog_like_links = 0", "web", "static", "balanced"),
        ("mixed_links", "product_like_links > 0 AND blog_like_links > 0", "web", "auto", "balanced"),
    ]
    default = ("default", "web", "static", "balanced")
    pick = lambda r: (r[0],) + r[2:]
    return d.cases([(r[1], d.q(pick(r)[i])) for r in rules], d.q(default[i]))


@query(
    "recommend_flow",
    f"""
SELECT s.host, {_flow_rules(0)} AS rule, {_flow_rules(1)} AS crawler, {_flow_rules(2)} AS scraper,
  {_flow_rules(3)} AS strictness,
  'unified/lam: if configurator detected; ai/ai: if semantic extraction needed' AS fallback_plan,
  10 AS max_pages, 3 AS max_depth, CAST(0.5 AS DOUBLE) AS crawl_delay
FROM signals s LEFT JOIN (
  SELECT {d.host('url')} AS host, count(*) AS n_nav,
    bool_or({d.any_contained('lower(text)', lex.NAV_CONFIGURATOR_WORDS)}) AS nav_configurator,
    bool_or({d.any_contained('lower(text)', lex.NAV_SHOP_WORDS)}) AS nav_shop,
    bool_or({d.any_contained('lower(text)', lex.NAV_PORTFOLIO_WORDS)}) AS nav_portfolio,
    count(*) FILTER ({d.any_contained('lower(text)', lex.NAV_SERVICE_WORDS)}) AS n_services
  FROM nav GROUP BY 1) m ON m.host = s.host""",
    "signals nav",
)
def _(t):
    pages = t.pages()
    return sites.recommend_flow(sites.site_signals(pages, PATTERNS), sites.nav_links(pages))
