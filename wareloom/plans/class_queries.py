"""Queries that classify product pages."""


from ..functions import lexicons as lex
from ..operators import classify
from . import sqltext as d
from .registry import cte, query

PREPARED = "(SELECT *, lower(markdown) AS low, lower(url) AS low_url FROM product_pages)"


@query(
    "keyword_hits",
    "SELECT page_id, "
    + ", ".join(f"{d.n_contained('low', words)} AS {g}" for g, words in classify.KEYWORD_GROUPS)
    + f" FROM {PREPARED} p",
    "product_pages",
)
def _(t):
    return classify.keyword_hits(t.product_pages())


@query(
    "keyword_totals",
    " UNION ALL ".join(
        f"SELECT {d.q(g)} AS grp, count(*) FILTER ({d.n_contained('low', words)} > 0) AS n_pages, "
        f"CAST(sum({d.n_contained('low', words)}) AS BIGINT) AS n_hits FROM {PREPARED} p"
        for g, words in classify.KEYWORD_GROUPS
    ),
    "product_pages",
)
def _(t):
    return classify.keyword_totals(classify.keyword_hits(t.product_pages()))


PRICE_COUNT = " + ".join(d.n_rx("markdown", "(?i)" + p) for p in lex.BALANCED_PRICE_PATTERNS)
cte(
    "balanced_signals",
    f"""
SELECT page_id, url, length(markdown) < 200 AS too_short,
  {d.cases([(f"contains(low_url, {d.q(p)})", d.q(p)) for p in lex.NON_PRODUCT_URL_PARTS], "''")} AS blocked_by,
  {d.any_rx('low_url', lex.PRODUCT_URL_PATTERNS)} AS product_url,
  {d.any_rx('low_url', lex.CATEGORY_URL_PATTERNS)} AS category_url,
  {d.any_rx('low_url', lex.BLOG_URL_PATTERNS)} AS blog_url,
  {d.n_contained('low', lex.PRODUCT_WORDS)} AS product_words,
  {d.n_contained('low', lex.CUSTOMIZATION_WORDS)} AS custom_words,
  {PRICE_COUNT} AS price_count,
  regexp_matches(markdown, '(?i)base\\s+price') AS has_base_price,
  {d.n_rx('markdown', '(?m)' + lex.HEADER_LINE_PATTERN)} AS option_categories,
  {d.n_rx('markdown', lex.CHECKBOX_PATTERN)} AS checkbox_count,
  {d.n_contained('low', lex.SECTION_WORDS)} AS section_count,
  {d.n_contained('low', lex.CTA_WORDS)} AS cta_count,
  {d.n_contained('low', lex.BLOG_WORDS)} AS blog_words,
  {d.n_matching('low', lex.ARTICLE_PATTERNS)} AS article_count
FROM {PREPARED} p""",
    "product_pages",
)
LEVEL_ROWS = ", ".join(f"('{n}', {t}::DOUBLE, {b}::DOUBLE, {k}::DOUBLE, {p}::DOUBLE, {s}::DOUBLE)"
                       for n, t, b, k, p, s in lex.STRICTNESS_LEVELS)
cte(
    "balanced",
    f"""
SELECT *, page_type = 'product' AS is_product, least(greatest(score / 15.0::DOUBLE, 0.0), 1.0) AS confidence FROM (
SELECT *, CASE WHEN stopped THEN 'other' WHEN score >= product_threshold THEN 'product'
    WHEN blog_penalty >= blog_threshold THEN 'blog' WHEN category_url THEN 'category' ELSE 'other' END AS page_type FROM (
  SELECT *, CASE WHEN stopped THEN 0.0::DOUBLE
      ELSE url_score + keyword_score + price_score + structure_score + cta_score - blog_penalty END AS score FROM (
    SELECT s.*, l.*, too_short OR blocked_by <> '' AS stopped,
      CASE WHEN product_url THEN 3.0::DOUBLE ELSE 0.0 END - CASE WHEN blog_url THEN 5.0::DOUBLE ELSE 0.0 END AS url_score,
      product_words * kw + custom_words * 0.5::DOUBLE AS keyword_score,
      CASE WHEN has_base_price THEN pw ELSE 0.0::DOUBLE END + CASE WHEN price_count >= 5 THEN pw
        WHEN price_count >= 3 THEN pw * 0.7::DOUBLE WHEN price_count >= 1 THEN pw * 0.4::DOUBLE ELSE 0.0 END AS price_score,
      CASE WHEN option_categories >= 4 THEN sw * 1.5::DOUBLE WHEN option_categories >= 3 THEN sw
        WHEN option_categories >= 2 THEN sw * 0.7::DOUBLE ELSE 0.0 END
      + CASE WHEN checkbox_count >= 5 THEN 1.5::DOUBLE WHEN checkbox_count >= 3 THEN 1.0 ELSE 0.0 END
      + CASE WHEN section_count >= 2 THEN 1.5::DOUBLE ELSE 0.0 END AS structure_score,
      CASE WHEN cta_count >= 2 THEN 2.0::DOUBLE WHEN cta_count >= 1 THEN 1.0 ELSE 0.0 END AS cta_score,
      CASE WHEN blog_words >= 3 THEN 10.0::DOUBLE WHEN blog_words >= 2 THEN 5.0 WHEN blog_words >= 1 THEN 2.0 ELSE 0.0 END
      + CASE WHEN article_count >= 2 THEN 5.0::DOUBLE ELSE 0.0 END AS blog_penalty
    FROM balanced_signals s CROSS JOIN (VALUES {LEVEL_ROWS}) l(strictness, product_threshold, blog_threshold, kw, pw, sw)
  ) a) b) c""",
    "balanced_signals",
)
SHOWN = (
    "page_id, url, strictness, page_type, is_product, confidence, score, url_score, keyword_score, price_score, "
    "structure_score, cta_score, blog_penalty"
)


@query("classify_balanced", f"SELECT {SHOWN} FROM balanced WHERE strictness = 'balanced'", "balanced")
def _(t):
    return classify.classify_balanced(t.product_pages()).select(*SHOWN.split(", "))


@query(
    "strictness_sweep",
    """SELECT strictness, count(*) AS n_pages, count(*) FILTER (is_product) AS n_products,
  count(*) FILTER (page_type = 'blog') AS n_blogs FROM balanced GROUP BY strictness""",
    "balanced",
)
def _(t):
    return classify.strictness_sweep(t.product_pages())


# Header lines and their next 14 lines, by line numbers.
cte(
    "page_lines",
    f"""SELECT page_id, url, generate_subscripts(ls, 1) AS pos, unnest(ls) AS raw, {d.strip('unnest(ls)')} AS line
FROM (SELECT page_id, url, string_split(markdown, chr(10)) AS ls FROM product_pages) p""",
    "product_pages",
)
cte(
    "option_category_counts",
    f"""
SELECT p.page_id, p.url, CAST(coalesce(c.n, 0) AS INT) AS option_categories FROM product_pages p
LEFT JOIN (SELECT page_id, count(*) AS n FROM (
    SELECT h.page_id, h.pos FROM (
      SELECT page_id, pos, lead(pos, 1, 1000000) OVER (PARTITION BY page_id ORDER BY pos) AS next_pos FROM page_lines
      WHERE {d.has_rx('line', lex.RULE_CATEGORY_LINE)}) h
    JOIN page_lines l ON l.page_id = h.page_id AND l.pos > h.pos AND l.pos <= h.pos + 14 AND l.pos < h.next_pos
    WHERE starts_with(l.line, '-') OR starts_with(l.line, '*')
    GROUP BY h.page_id, h.pos HAVING count(*) >= 2) g GROUP BY page_id) c ON c.page_id = p.page_id""",
    "product_pages page_lines",
)


@query(
    "option_category_count",
    "SELECT page_id, url, option_categories FROM option_category_counts",
    "option_category_counts",
)
def _(t):
    return classify.option_categories(t.product_pages())


def _add(test, value):
    return f"CASE WHEN {test} THEN {value}::DOUBLE ELSE 0.0 END"


PHRASES = " + ".join(d.n_rx("low", p) for p in lex.RULE_LIST_PHRASES)
cte(
    "rules",
    f"""
SELECT page_id, url, CASE WHEN too_short THEN 'other' WHEN url_type <> '' THEN url_type WHEN blog_score >= 0.6 THEN 'blog'
    WHEN product_score >= 0.55 AND product_score > list_score THEN 'product' WHEN list_score >= 0.5 THEN 'list'
    ELSE 'other' END AS page_type,
  CASE WHEN too_short THEN 0.0::DOUBLE WHEN url_type <> '' THEN 0.9 WHEN blog_score >= 0.6 THEN blog_score
    WHEN product_score >= 0.55 AND product_score > list_score THEN product_score
    WHEN list_score >= 0.5 THEN list_score ELSE 0.3 END AS confidence, blog_score, product_score, list_score
FROM (SELECT p.page_id, p.url, length(markdown) < 200 AS too_short,
  CASE WHEN {d.any_rx('low_url', lex.STRONG_PRODUCT_URLS)} THEN 'product'
    WHEN {d.any_rx('low_url', lex.STRONG_LIST_URLS)} THEN 'list'
    WHEN {d.any_rx('low_url', lex.STRONG_BLOG_URLS)} THEN 'blog' ELSE '' END AS url_type,
  least({_add(d.has_rx('markdown', lex.RULE_BLOG_DATE), 0.4)} + {_add(d.has_rx('markdown', lex.RULE_BLOG_AUTHOR), 0.3)}
    + {_add(d.has_rx('markdown', lex.RULE_BLOG_TAGS), 0.2)}
    + {d.n_contained('low', lex.RULE_BLOG_WORDS)} * 0.1::DOUBLE, 1.0) AS blog_score,
  least({_add(d.has_rx('markdown', lex.RULE_BASE_PRICE), 0.3)}
    + {_add(d.n_rx('markdown', lex.RULE_PRICE_MODIFIER) + ' >= 3', 0.25)}
    + CASE WHEN option_categories >= 3 THEN 0.3::DOUBLE WHEN option_categories >= 2 THEN 0.2 ELSE 0.0 END
    + {_add(d.n_contained('low', lex.RULE_CUSTOM_WORDS) + ' >= 3', 0.15)}
    + {_add(d.n_contained('low', lex.RULE_PRODUCT_WORDS) + ' >= 2', 0.1)}
    + {_add(d.has_rx('markdown', lex.RULE_PURCHASE_CTA), 0.1)} + {_add(d.has_rx('markdown', lex.RULE_CUSTOM_CTA), 0.1)}
    + {_add(d.n_rx('markdown', lex.RULE_CHECKBOX) + ' >= 3', 0.15)}, 1.0) AS product_score,
  least(CASE WHEN {PHRASES} >= 15 THEN 0.6::DOUBLE WHEN {PHRASES} >= 8 THEN 0.4 WHEN {PHRASES} >= 5 THEN 0.2 ELSE 0.0 END
    + {_add(d.any_contained('low', lex.RULE_PAGING_WORDS), 0.25)}, 1.0) AS list_score
  FROM {PREPARED} p JOIN option_category_counts o ON o.page_id = p.page_id) s""",
    "product_pages option_category_counts",
)


@query("classify_rules", "SELECT * FROM rules", "rules")
def _(t):
    return classify.classify_rules(t.product_pages())


@query(
    "type_distribution",
    """SELECT page_type, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100 AS percent
FROM rules GROUP BY page_type""",
    "rules",
)
def _(t):
    return classify.type_distribution(classify.classify_rules(t.product_pages()))


cte(
    "reasons",
    """
SELECT page_id, page_type, generate_subscripts(rs, 1) - 1 AS pos, unnest(rs) AS reason FROM (
  SELECT page_id, page_type, CASE WHEN too_short THEN ['Content too short']
    WHEN blocked_by <> '' THEN ['Non-product URL pattern: ' || blocked_by]
    ELSE list_filter([
      CASE WHEN product_url THEN 'Product URL pattern detected' END,
      CASE WHEN blog_url THEN 'Blog URL pattern detected' END,
      CASE WHEN product_words > 0 THEN 'Found ' || product_words || ' product keywords' END,
      CASE WHEN has_base_price THEN 'Base price found' END,
      CASE WHEN price_count >= 5 THEN 'Multiple prices found (' || price_count || ')' END,
      CASE WHEN option_categories >= 2 THEN 'Found ' || option_categories || ' option categories' END,
      CASE WHEN blog_words >= 3 THEN 'Strong blog indicators detected' END,
      CASE WHEN is_product THEN 'PRODUCT' ELSE 'NOT PRODUCT' END || ' (score: ' || format('{:.1f}', score)
        || ', threshold: ' || format('{:.1f}', product_threshold) || ')'], lambda r: r IS NOT NULL) END AS rs
  FROM balanced WHERE strictness = 'balanced') x""",
    "balanced",
)


@query("classification_reasons", "SELECT page_id, page_type, CAST(pos AS INT) AS pos, reason FROM reasons", "reasons")
def _(t):
    return classify.classification_reasons(classify.classify_balanced(t.product_pages()))


@query("reason_counts", "SELECT page_type, reason, count(*) AS n FROM reasons GROUP BY page_type, reason", "reasons")
def _(t):
    return classify.reason_counts(classify.classification_reasons(classify.classify_balanced(t.product_pages())))
