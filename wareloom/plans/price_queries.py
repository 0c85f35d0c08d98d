"""Queries over prices and specifications."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import money as M
from ..operators import prices, specs
from . import sqltext as d
from .registry import cte, query

AMOUNT = r"[\d,]+(?:\.\d{2})?"
# The check engine knows no back-reference: one alternative per symbol.
RANGE_MATCH = "|".join(
    rf"(?i){s}\s*{AMOUNT}\s*(?:-|to|–)\s*{s}?\s*{AMOUNT}" for s in [r"\$", "€", "£", "¥", "₹"]
)
RANGE_PARTS = rf"(?i)^([$€£¥₹])\s*({AMOUNT})\s*(?:-|to|–)\s*[$€£¥₹]?\s*({AMOUNT})$"


def amount(x):
    return rf"TRY_CAST(regexp_replace({x}, '[$€£¥₹,\s]', '', 'g') AS DOUBLE)"


def currency(x):
    return d.cases([(f"{x} = {d.q(s)}", d.q(c)) for s, c in lex.CURRENCY_OF], "'USD'")


def symbol(x):
    return d.cases([(f"{x} = {d.q(c)}", d.q(s)) for c, s in lex.SYMBOL_OF], "'$'")


def money(v, c):
    return f"({symbol(c)} || format('{{:,.2f}}', {v}) || ' ' || {c})"


def parsed(n: int, source: str, keep: str) -> str:
    """Price columns for matches `m` of pattern n in a fragment with columns `keep`, m."""
    pattern = RANGE_PARTS if n == M.RANGE else M.PRICE_PATTERNS[n]
    first, second = d.rx("m", pattern, 1), d.rx("m", pattern, 2)
    value, mark = (first, second) if n in M.CODE_LAST else (second, first)
    high = amount(d.rx("m", pattern, 3)) if n == M.RANGE else "NULL::DOUBLE"
    return (
        f"SELECT {keep}, {n} AS n, m AS raw, {amount(value)} AS value, {currency(mark)} AS currency, "
        f"{high} AS max_price FROM {source}"
    )


def match_pattern(n: int) -> str:
    return RANGE_MATCH if n == M.RANGE else M.PRICE_PATTERNS[n]


def first_price(source: str, key: str, text: str) -> str:
    """First pattern's first match with a non-zero value, per key."""
    tries = " UNION ALL ".join(
        parsed(n, f"(SELECT {key}, {d.rx(text, match_pattern(n), 0)} AS m FROM {source}) s{n}", key) for n in range(6)
    )
    return (
        f"SELECT {key}, arg_min({{'value': value, 'currency': currency, 'max_price': max_price, 'raw': raw, 'n': n}}, n) "
        f"AS f FROM ({tries}) t WHERE value > 0 GROUP BY {key}"
    )


ALL_MATCHES = " UNION ALL ".join(
    parsed(
        n,
        f"(SELECT page_id, url, unnest({d.rx_all('markdown', match_pattern(n))}) AS m, "
        f"generate_subscripts({d.rx_all('markdown', match_pattern(n))}, 1) AS i FROM product_pages) s{n}",
        "page_id, url, i",
    )
    for n in range(6)
)


@query(
    "price_facts",
    f"""
SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY value) - 1 AS INT) AS rank, value, currency,
  max_price IS NOT NULL AS is_range, CASE WHEN max_price IS NOT NULL THEN value END AS min_price, max_price, raw
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, value ORDER BY n, i) AS copy FROM ({ALL_MATCHES}) a
  WHERE value > 0) b WHERE copy = 1""",
    "product_pages",
)
def _(t):
    return prices.price_facts(t.product_pages())


cte(
    "titles",
    f"""
SELECT page_id, url, markdown, list_filter(list_transform(list_filter(list_transform(string_split(markdown, chr(10)),
    lambda x: {d.strip('x')}), lambda x: starts_with(x, '# ') OR starts_with(x, '## ')),
    lambda x: {d.strip("ltrim(x, '#')")}),
    lambda x: length(x) > 3 AND NOT contains(lower(x), 'skip') AND NOT contains(lower(x), 'content'))[1] AS title
FROM product_pages""",
    "product_pages",
)
STRIPPED = "title"
for _pattern in lex.TITLE_PRICE_STRIPS + [r"\s*[-–—|:]\s*$"]:
    STRIPPED = f"regexp_replace({STRIPPED}, {d.q(_pattern)}, '', 'g')"
EXPLICIT = d.rx("markdown", lex.PRICE_EXPLICIT_BASE, 0)
EXPLICIT_CODE = d.rx("markdown", lex.PRICE_EXPLICIT_BASE, 3)
EXPLICIT_CURRENCY = (
    f"(CASE WHEN {EXPLICIT_CODE} <> '' THEN upper({EXPLICIT_CODE}) "
    f"ELSE {currency(d.rx('markdown', lex.PRICE_EXPLICIT_BASE, 1))} END)"
)
EXPLICIT_VALUE = amount(d.rx("markdown", lex.PRICE_EXPLICIT_BASE, 2))
FACT_TEXT = (
    f"CASE WHEN f.max_price IS NOT NULL THEN {symbol('f.currency')} || format('{{:,.2f}}', f.value) || ' - ' || "
    f"{symbol('f.currency')} || format('{{:,.2f}}', f.max_price) || ' ' || f.currency "
    f"WHEN f IS NOT NULL THEN {money('f.value', 'f.currency')} END"
)
cte("page_price", first_price("product_pages", "page_id", "markdown"), "product_pages")
cte("title_price", first_price("titles", "page_id", "title"), "titles")
cte(
    "base_prices",
    f"""
SELECT t.page_id, t.url, coalesce({d.strip(d.squeeze(STRIPPED))}, string_split(trim({d.path('t.url')}, '/'), '/')[-1])
    AS product_name,
  CASE WHEN tp.f IS NOT NULL THEN {money('tp.f.value', 'tp.f.currency')} END AS title_price,
  coalesce(CASE WHEN {EXPLICIT_VALUE} IS NOT NULL THEN {money(EXPLICIT_VALUE, EXPLICIT_CURRENCY)} END,
    {FACT_TEXT.replace('f.', 'pp.f.').replace('WHEN f ', 'WHEN pp.f ')},
    CASE WHEN tp.f IS NOT NULL THEN {money('tp.f.value', 'tp.f.currency')} END) AS base_price
FROM titles t LEFT JOIN page_price pp ON pp.page_id = t.page_id LEFT JOIN title_price tp ON tp.page_id = t.page_id""",
    "titles page_price title_price",
)


@query("base_price", "SELECT * FROM base_prices", "base_prices")
def _(t):
    return prices.base_price(t.product_pages())


cte(
    "detail_lines",
    f"""SELECT page_id, url, generate_subscripts(ls, 1) AS pos, {d.strip('unnest(ls)')} AS line
FROM (SELECT page_id, url, string_split(markdown, chr(10)) AS ls FROM detail_pages) p""",
    "detail_pages",
)
ALT = d.rx("line", r"!\[(?:Image \d+:?\s*)?([^\]]+)\]")
cte(
    "option_texts",
    f"""SELECT * FROM (SELECT page_id, pos - 1 AS pos, {d.strip(f"CASE WHEN {ALT} <> '' THEN {ALT} "
        f"ELSE {d.rx('line', '^[-*•]\\s*(?:\\[[x ]?\\]\\s*)?(.+)')} END")} AS text
FROM detail_lines) x WHERE text <> ''""",
    "detail_lines",
)


def modifier(sign: str, v: str) -> str:
    return (
        f"(CASE WHEN {sign} = '-' THEN '-' ELSE '+' END || '$' || CASE WHEN {v} % 1 = 0 THEN format('{{:,.0f}}', {v}) "
        f"ELSE format('{{:,.2f}}', {v}) END)"
    )


def option_price(x: str) -> str:
    paren = amount(d.rx(x, lex.OPTION_PRICE_PAREN, 3))
    signed = amount(d.rx(x, lex.OPTION_PRICE_SIGNED, 3))
    extra = amount(d.rx(x, lex.OPTION_PRICE_EXTRA, 2))
    return (
        f"CASE WHEN {d.has_rx(x, lex.OPTION_FREE)} THEN '+$0' ELSE coalesce("
        f"{modifier(d.rx(x, lex.OPTION_PRICE_PAREN, 1), paren)}, "
        f"{modifier(d.rx(x, lex.OPTION_PRICE_SIGNED, 1), signed)}, {modifier(d.q('+'), extra)}) END"
    )


def name_price(x: str) -> str:
    """struct(name, price, value) of a cleaned text, NULL when it carries no price."""
    sign = d.rx(x, lex.NAME_WITH_PRICE, 2)
    paren = amount(d.rx(x, lex.NAME_WITH_PRICE, 4))
    dash = amount(d.rx(x, lex.NAME_DASH_PRICE, 2))
    return (
        f"CASE WHEN {paren} IS NOT NULL THEN {{'name': {d.strip(d.rx(x, lex.NAME_WITH_PRICE, 1))}, "
        f"'price': {modifier(sign, paren)}, 'value': CASE WHEN {sign} = '-' THEN -{paren} ELSE {paren} END}} "
        f"WHEN {dash} IS NOT NULL THEN {{'name': {d.strip(d.rx(x, lex.NAME_DASH_PRICE, 1))}, "
        f"'price': {modifier(d.q('+'), dash)}, 'value': {dash}}} END"
    )


cte(
    "option_prices",
    f"""
SELECT page_id, pos, text, coalesce(np.name, clean) AS name, coalesce(np.price, {option_price('clean')}) AS price,
  {amount(f"coalesce(np.price, {option_price('clean')})")} AS value
FROM (SELECT *, {name_price('clean')} AS np FROM (SELECT *, {d.strip_tags('text')} AS clean FROM option_texts) c) n""",
    "option_texts",
)


@query("option_prices", "SELECT page_id, pos, text, name, price, value FROM option_prices", "option_prices")
def _(t):
    return prices.option_prices(prices.option_texts(t.detail_pages()))


@query(
    "option_price_summary",
    """SELECT name, count(*) AS n, min(value) AS min_value, max(value) AS max_value, avg(value) AS avg_value
FROM option_prices WHERE value IS NOT NULL GROUP BY name""",
    "option_prices",
)
def _(t):
    return prices.option_price_summary(prices.option_prices(prices.option_texts(t.detail_pages())))


def attribute(x, name):
    raw = d.rx(x, rf"""(?i)\b{name}=["']([^"']*)["']""")
    return f"replace({raw}, '&amp;', '&')"


@query(
    "form_options",
    f"""
SELECT page_id, part_no, n, f.name AS name, f.price AS price, f.value AS value FROM (
  SELECT page_id, part_no, n, coalesce({name_price('v')}, {name_price('alt')}, {name_price('span')}) AS f FROM (
    SELECT page_id, part_no, n, {d.strip_tags(attribute('tag', 'value'))} AS v, {attribute('tag', 'type')} AS kind,
      {d.strip_tags(attribute(d.rx('part', '(?i)<img[^>]*>', 0), 'alt'))} AS alt,
      {d.strip_tags(d.rx('part', prices.SPAN))} AS span
    FROM (SELECT page_id, part_no, part, unnest({d.rx_all('part', '(?i)<input[^>]*>')}) AS tag,
        generate_subscripts({d.rx_all('part', '(?i)<input[^>]*>')}, 1) - 1 AS n
      FROM (SELECT page_id, unnest({d.rx_all('html', prices.INPUT_OR_LABEL)}) AS part,
        generate_subscripts({d.rx_all('html', prices.INPUT_OR_LABEL)}, 1) - 1 AS part_no FROM form_pages) a) b) c
  WHERE lower(kind) IN ('radio', 'checkbox')) e
WHERE f IS NOT NULL""",
    "form_pages",
)
def _(t):
    return prices.form_options(t.form_pages())


@query(
    "price_context",
    f"""
SELECT p.page_id, {d.host('url')} AS host, {money('f.value', 'f.currency')} AS price, f.raw AS raw_match,
    {d.strip('substr(markdown, greatest(place - 100, 1), place + length(f.raw) + 100 - greatest(place - 100, 1))')} AS context,
    row_number() OVER (PARTITION BY {d.host('url')} ORDER BY p.page_id) AS rank
  FROM (SELECT *, strpos(markdown, f.raw) AS place FROM product_pages JOIN page_price USING (page_id)) p""",
    "product_pages page_price",
)
def _(t):
    return prices.price_context(t.product_pages())


def _spec_value(pattern: str) -> str:
    raw = d.rx("markdown", "(?i)" + pattern + r":\s*([^\n]+)")
    return d.strip(f"split_part({d.squeeze(d.strip(raw))}, '|', 1)")


SPEC_ROWS = " UNION ALL ".join(
    f"SELECT page_id, url, {d.q(name)} AS spec, {_spec_value(pattern)} AS value FROM detail_pages"
    for pattern, name in lex.SPEC_PATTERNS
)
cte(
    "spec_pairs",
    f"SELECT page_id, url, spec, value FROM ({SPEC_ROWS}) x WHERE value <> '' AND length(value) < 200",
    "detail_pages",
)


@query("spec_pairs", "SELECT * FROM spec_pairs", "spec_pairs")
def _(t):
    return specs.spec_pairs(t.detail_pages())


@query(
    "spec_coverage",
    "SELECT spec, count(*) AS n_pages, count(DISTINCT value) AS n_values FROM spec_pairs GROUP BY spec",
    "spec_pairs",
)
def _(t):
    return specs.spec_coverage(specs.spec_pairs(t.detail_pages()))


WIDE = list(dict.fromkeys(name for _, name in lex.SPEC_PATTERNS))


@query(
    "specs_wide",
    "SELECT page_id, "
    + ", ".join(f"max(value) FILTER (spec = '{n}') AS {n.lower().replace(' ', '_')}" for n in WIDE)
    + " FROM spec_pairs GROUP BY page_id",
    "spec_pairs",
)
def _(t):
    return specs.specs_wide(specs.spec_pairs(t.detail_pages()), WIDE)


# Line state machine: number the '#' lines, look at their kind and at the next one's.
SPEC_HEAD = r"(?i)^#+\s*(?:" + "|".join(lex.SPEC_HEADERS) + r")\s*:?\s*$"
FAQ_HEAD = r"(?i)^#+\s*(?:" + "|".join(lex.FAQ_HEADERS) + r")\s*:?\s*$"
cte(
    "spec_raw_lines",
    """SELECT page_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS raw
FROM (SELECT page_id, string_split(markdown, chr(10)) AS ls FROM detail_pages) p""",
    "detail_pages",
)
cte(
    "spec_heads",
    f"""SELECT page_id, pos, raw, row_number() OVER w AS section, lead(raw) OVER w AS next_raw,
  lead(pos) OVER w AS next_pos FROM spec_raw_lines WHERE starts_with(raw, '#')
WINDOW w AS (PARTITION BY page_id ORDER BY pos)""",
    "spec_raw_lines",
)
cte(
    "sections",
    f"""
SELECT h.page_id, CAST(h.section AS INT) AS section, {d.strip("ltrim(h.raw, '#')")} AS title, h.pos AS start_pos, h.next_pos
FROM spec_heads h WHERE {d.has_rx('h.raw', SPEC_HEAD)} AND NOT {d.has_rx("coalesce(h.next_raw, '')", FAQ_HEAD)}""",
    "spec_heads",
)


@query(
    "spec_sections",
    """SELECT s.page_id, s.section, s.title, coalesce(string_agg(l.raw, chr(10) ORDER BY l.pos), '') AS content
FROM sections s LEFT JOIN spec_raw_lines l ON l.page_id = s.page_id AND l.pos > s.start_pos
  AND l.pos < coalesce(s.next_pos, 1000000)
GROUP BY s.page_id, s.section, s.title""",
    "sections spec_raw_lines",
)
def _(t):
    return specs.spec_sections(t.detail_pages())


def clean_key(x):
    squeezed = d.squeeze(d.strip("rtrim(" + d.strip(rf"regexp_replace({x}, '\*\*?', '', 'g')") + ", ':')"))
    return (
        f"array_to_string(list_transform(string_split({squeezed}, ' '), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
    )


LIST_KEY, LIST_VALUE = d.rx("raw", lex.SPEC_LIST_LINE, 1), d.rx("raw", lex.SPEC_LIST_LINE, 2)
IN_LINE = d.strip("raw")
INLINE_KEY, INLINE_VALUE = d.rx(IN_LINE, lex.SPEC_INLINE_LINE, 1), d.rx(IN_LINE, lex.SPEC_INLINE_LINE, 2)
CELLS = f"list_filter(list_transform(string_split(raw, '|'), lambda x: {d.strip('x')}), lambda x: x <> '')"
cte(
    "section_raw",
    """SELECT s.page_id, s.section, s.title, l.pos, l.raw FROM sections s JOIN spec_raw_lines l
ON l.page_id = s.page_id AND l.pos > s.start_pos AND l.pos < coalesce(s.next_pos, 1000000)""",
    "sections spec_raw_lines",
)
cte(
    "section_lines",
    f"""
SELECT * FROM (
  SELECT page_id, section, title, pos, 0 AS source, {clean_key(LIST_KEY)} AS key,
    rtrim({d.strip(LIST_VALUE)}, '.*') AS value FROM section_raw WHERE {LIST_KEY} <> ''
  UNION ALL SELECT page_id, section, title, pos, 1, {clean_key(CELLS + '[1]')}, {CELLS}[2] FROM section_raw
    WHERE contains(raw, '|') AND NOT starts_with({IN_LINE}, '|---') AND len({CELLS}) = 2
  UNION ALL SELECT page_id, section, title, pos, 2, {clean_key(INLINE_KEY)}, rtrim({d.strip(INLINE_VALUE)}, '.*')
    FROM section_raw WHERE {INLINE_KEY} <> '' AND {IN_LINE} <> '' AND NOT starts_with({IN_LINE}, '#')) e
WHERE NOT ({' OR '.join(f"starts_with(lower(key), {d.q(p)})" for p in lex.QUESTION_PREFIXES)})
  AND CASE WHEN {d.strip('value')} = '' THEN 0 ELSE len(regexp_split_to_array({d.strip('value')}, '\\s+')) END <= 20
  AND {d.any_rx('lower(key)', lex.SPEC_KEY_PATTERNS)}""",
    "section_raw",
)
cte(
    "section_specs",
    f"""
SELECT page_id, key, {d.strip_tags('value')} AS value FROM (
  SELECT page_id, key, value, row_number() OVER (PARTITION BY page_id, key ORDER BY section DESC, source DESC, pos DESC)
    AS back FROM section_lines) x WHERE back = 1 AND value <> '' AND length(value) <= 200""",
    "section_lines",
)


@query("section_specs", "SELECT * FROM section_specs", "section_specs")
def _(t):
    return specs.section_specs(specs.spec_sections(t.detail_pages()))


@query(
    "specs_grouped",
    """
SELECT page_id, section, title, string_agg(key || '=' || value, ';' ORDER BY key) AS specs, count(*) AS n_specs FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, section, key ORDER BY source DESC, pos DESC) AS back
  FROM section_lines) x WHERE back = 1 GROUP BY page_id, section, title""",
    "section_lines",
)
def _(t):
    grouped = specs.specs_grouped(specs.spec_sections(t.detail_pages()))
    pairs = F.transform(F.map_entries("specs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return grouped.withColumn("specs", F.array_join(pairs, ";"))


@query(
    "format_specs",
    f"""SELECT p.page_id, coalesce(s.sheet, {d.q(lex.NO_SPECS_TEXT)}) AS sheet FROM product_pages p LEFT JOIN (
  SELECT page_id, string_agg(key || ': ' || value, chr(10) ORDER BY key) AS sheet FROM section_specs GROUP BY page_id) s
ON s.page_id = p.page_id""",
    "product_pages section_specs",
)
def _(t):
    found = specs.section_specs(specs.spec_sections(t.detail_pages()))
    return specs.format_specs(t.product_pages(), found)
