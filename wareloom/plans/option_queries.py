"""Queries over options and configurators."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.frames import union_rows
from ..operators import configurators, options, prices
from ..session import staged
from . import sqltext as d
from .price_queries import amount, name_price, option_price
from .registry import cte, query


def option_ctes(prefix: str, pages: str) -> None:
    """Check SQL of option lines, by line numbers and running block numbers."""
    cte(
        f"{prefix}_blocks",
        f"""
SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS block FROM (
  SELECT *, {d.strip(d.rx('line', lex.OPTION_CATEGORY_LINE))} AS head FROM (
    SELECT page_id, generate_subscripts(ls, 1) AS pos, {d.strip('unnest(ls)')} AS line
    FROM (SELECT page_id, string_split(markdown, chr(10)) AS ls FROM {pages}) a) b) c""",
        pages,
    )
    image = d.rx("line", lex.OPTION_IMAGE, 0)
    alt, link = d.strip(d.rx("line", lex.OPTION_IMAGE, 1)), d.strip(d.rx("line", lex.OPTION_IMAGE, 2))
    label = d.strip(f"regexp_replace({alt}, {d.q(lex.PRICE_SUFFIXES[0])}, '')")
    whole_alt = d.strip_tags(d.rx(image, r"!\[([^\]]*)\]"))
    text = d.strip(d.rx("line", lex.OPTION_CHECKBOX))
    short = text
    for suffix in lex.PRICE_SUFFIXES:
        short = d.strip(f"regexp_replace({short}, {d.q(suffix)}, '')")
    cte(
        f"{prefix}_parsed",
        f"""
SELECT page_id, block, pos, line, coalesce(
    CASE WHEN {image} <> '' AND NOT {d.any_contained(link, lex.TRACKING_IMAGE_PARTS)} AND length({label}) > 2
      THEN {{'label': {label}, 'price': {option_price(whole_alt)}, 'image': {link}}} END,
    CASE WHEN length({short}) > 2
      THEN {{'label': {short}, 'price': {option_price(d.strip_tags(text))}, 'image': NULL::VARCHAR}} END) AS o
FROM {prefix}_blocks WHERE block > 0 AND head = ''""",
        f"{prefix}_blocks",
    )
    cte(
        f"{prefix}_options",
        f"""
SELECT p.page_id, b.category, CAST(min_pos AS INT) AS category_pos, CAST(p.pos - b.start_pos - 1 AS INT) AS pos, p.line,
  p.o.label AS label, p.o.price AS price, p.o.image AS image
FROM {prefix}_parsed p JOIN (
  SELECT *, min(n) OVER (PARTITION BY page_id, category) AS min_pos,
    block = max(block) OVER (PARTITION BY page_id, category) AS is_last FROM (
    SELECT h.page_id, h.block, h.head AS category, h.pos AS start_pos,
      row_number() OVER (PARTITION BY h.page_id ORDER BY h.block) - 1 AS n
    FROM {prefix}_blocks h WHERE h.head <> '' AND EXISTS (
      SELECT 1 FROM {prefix}_parsed x WHERE x.page_id = h.page_id AND x.block = h.block AND x.o IS NOT NULL)) k) b
ON b.page_id = p.page_id AND b.block = p.block AND b.is_last
WHERE p.o IS NOT NULL""",
        f"{prefix}_blocks {prefix}_parsed",
    )
    cte(
        f"{prefix}_merged",
        f"""
SELECT page_id, category, category_pos, min(pos) AS pos, arg_min(label, pos) AS label,
  arg_min(price, pos) FILTER (price <> '') AS price, arg_min(image, pos) FILTER (image <> '') AS image
FROM {prefix}_options WHERE length({d.strip('label')}) >= 3
GROUP BY page_id, category, category_pos, lower({d.strip('label')})""",
        f"{prefix}_options",
    )


option_ctes("detail", "detail_pages")
option_ctes("product", "product_pages")
option_ctes("config", "config_pages")
OPTION = "page_id, category, category_pos, pos, label, price, image"


@query("option_lines", "SELECT page_id, category, category_pos, pos, line FROM detail_options", "detail_options")
def _(t):
    return options.option_lines(t.detail_pages()).drop("option")


@query("option_rows", f"SELECT {OPTION} FROM detail_options", "detail_options")
def _(t):
    return options.option_rows(t.detail_pages())


@query("merge_options", f"SELECT {OPTION} FROM detail_merged", "detail_merged")
def _(t):
    return options.merge_options(options.option_rows(t.detail_pages()))


@query(
    "price_audit",
    f"""SELECT page_id, category, category_pos, pos, label, image,
  CASE WHEN price <> '' AND {amount('price')} BETWEEN 0 AND 1000 THEN price END AS price,
  price IS NOT NULL AND price <> '' AND NOT coalesce({amount('price')} BETWEEN 0 AND 1000, false) AS invalid
FROM detail_merged""",
    "detail_merged",
)
def _(t):
    return prices.price_audit(options.merge_options(options.option_rows(t.detail_pages())), 0, 1000)


# ------------------------------------------------------------------ configurator pages
def configurator_ctes(prefix: str, pages: str) -> None:
    low = "lower(line)"
    noise = d.any_contained(low, lex.PAGE_NOISE_WORDS)
    marked = "(starts_with(line, '##') OR (starts_with(line, '**') AND ends_with(line, '**')))"
    heading = d.strip(
        "CASE WHEN starts_with(line, '###') THEN replace(line, '###', '') WHEN starts_with(line, '##') "
        "THEN replace(line, '##', '') ELSE replace(line, '**', '') END"
    )
    before = "split_part(line, ':', 1)"
    named = (
        f"contains(line, ':') AND length({before}) < 50 AND {d.strip(before)} <> '' "
        f"AND NOT {d.any_contained(before, lex.COLON_BAD_PARTS)} "
        f"AND NOT {d.any_contained(f'lower({before})', lex.COLON_NOISE_WORDS)}"
    )
    cte(
        f"{prefix}_infos",
        f"""
SELECT *, min(CASE WHEN heading IS NOT NULL OR name IS NOT NULL THEN pos END) OVER (PARTITION BY page_id) AS first_pos
FROM (SELECT page_id, pos, line, kept, next_line, after_next, kept AND {marked} AS marked,
    CASE WHEN kept AND {marked} AND {heading} <> '' AND length({heading}) < 100 THEN {heading} END AS heading,
    CASE WHEN kept AND NOT {marked} AND {named} THEN {d.strip(before)} END AS name,
    starts_with(line, '![Image') AS is_image, regexp_matches(line, '^[-*•]') AS is_bullet
  FROM (SELECT *, line <> '' AND NOT {noise} AS kept,
      coalesce(lead(line) OVER w, '') AS next_line, coalesce(lead(line, 2) OVER w, '') AS after_next
    FROM (SELECT page_id, generate_subscripts(ls, 1) - 1 AS pos, {d.strip('unnest(ls)')} AS line
      FROM (SELECT page_id, string_split(markdown, chr(10)) AS ls FROM {pages}) a) b
    WINDOW w AS (PARTITION BY page_id ORDER BY pos)) c) e""",
        pages,
    )
    cte(
        f"{prefix}_open",
        f"""
SELECT *, sum(opens::INT) OVER (PARTITION BY page_id ORDER BY pos) AS block FROM (
  SELECT *, heading IS NOT NULL OR (name IS NOT NULL AND (pos = first_pos OR NOT (is_image OR is_bullet))) AS opens
  FROM {prefix}_infos) x""",
        f"{prefix}_infos",
    )
    m = d.rx("line", lex.CONFIGURATOR_IMAGE, 0)
    alt, image = d.strip(d.rx("line", lex.CONFIGURATOR_IMAGE, 1)), d.strip(d.rx("line", lex.CONFIGURATOR_IMAGE, 2))
    alone = "(next_line <> '' AND NOT regexp_matches(next_line, '^(?:!\\[Image|#|\\*\\*|-|\\*|\\|)') AND length(next_line) < 200)"
    cte(
        f"{prefix}_images",
        f"""
SELECT page_id, pos, label, price, image FROM (
  SELECT page_id, pos, image, CASE WHEN own IS NOT NULL THEN own.name WHEN alone AND nb IS NOT NULL THEN nb.name
      WHEN alone THEN next_line ELSE alt END AS label,
    CASE WHEN own IS NOT NULL THEN own.price WHEN alone AND nb IS NOT NULL THEN nb.price
      WHEN alone THEN coalesce(after_price, next_price) ELSE next_price END AS price
  FROM (SELECT page_id, pos, next_line, {alt} AS alt, {image} AS image, {alone} AS alone,
      {name_price(d.strip_tags(alt))} AS own, {name_price(d.strip_tags('next_line'))} AS nb,
      {option_price(d.strip_tags('next_line'))} AS next_price, {option_price(d.strip_tags('after_next'))} AS after_price
    FROM {prefix}_infos WHERE is_image AND {m} <> '' AND NOT contains(lower({image}), 'pixel')
      AND NOT contains({image}, 'g.gif')) a) b WHERE length(label) < 200""",
        f"{prefix}_infos",
    )
    bullet = d.strip("regexp_replace(line, '^[-*•]\\s*', '')")
    same = d.strip("substr(line, strpos(line, ':') + 1)")

    def plain(text: str) -> str:
        np = name_price(d.strip_tags(text))
        return f"{{'label': coalesce(({np}).name, {d.strip_tags(text)}), 'price': ({np}).price, 'image': NULL::VARCHAR}}"

    cte(
        f"{prefix}_found",
        f"""
SELECT o.page_id, o.block, o.pos, CASE
    WHEN opens AND heading IS NOT NULL THEN NULL
    WHEN opens THEN CASE WHEN {same} <> '' AND length({same}) < 200 THEN {plain(same)} END
    WHEN NOT kept OR marked THEN NULL
    WHEN is_image THEN CASE WHEN i.label IS NOT NULL THEN {{'label': i.label, 'price': i.price, 'image': i.image}} END
    WHEN is_bullet THEN CASE WHEN {bullet} <> '' AND length({bullet}) <= 200 AND length(({plain(bullet)}).label) > 2
      THEN {plain(bullet)} END END AS option
FROM {prefix}_open o LEFT JOIN {prefix}_images i ON i.page_id = o.page_id AND i.pos = o.pos WHERE block > 0""",
        f"{prefix}_open {prefix}_images",
    )
    cte(
        f"{prefix}_rows",
        f"""
SELECT f.page_id, count(*) OVER (PARTITION BY f.page_id) < 3 AS few_options, b.category,
  CAST(b.category_pos AS INT) AS category_pos, CAST(f.pos - b.pos AS INT) AS pos, f.option.label AS label,
  f.option.price AS price, f.option.image AS image
FROM {prefix}_found f JOIN (
  SELECT page_id, block, pos, category, min(block - 1) OVER (PARTITION BY page_id, category) AS category_pos,
    block = max(block) OVER (PARTITION BY page_id, category) AS is_last
  FROM (SELECT page_id, block, pos, coalesce(heading, name) AS category FROM {prefix}_open WHERE opens) k) b
ON b.page_id = f.page_id AND b.block = f.block AND b.is_last WHERE f.option IS NOT NULL""",
        f"{prefix}_found {prefix}_open",
    )


configurator_ctes("dc", "detail_pages")
configurator_ctes("cc", "config_pages")


@query("configurator_options", "SELECT * FROM dc_rows", "dc_rows")
def _(t):
    return options.configurator_options(t.detail_pages())


@query("image_option_lookahead", "SELECT * FROM dc_images", "dc_images")
def _(t):
    return options.image_option_lookahead(t.detail_pages())


@query(
    "audit_counts",
    f"""SELECT category, count(*) AS n_options, count(*) FILTER (price <> '' AND NOT coalesce({amount('price')}
  BETWEEN 0 AND 100000, false)) AS n_invalid FROM cc_rows GROUP BY category""",
    "cc_rows",
)
def _(t):
    return prices.audit_counts(prices.price_audit(options.configurator_options(t.config_pages())))


# ------------------------------------------------------------------ guided options and elements
@query(
    "nest_options",
    """
SELECT page_id, string_agg(category || ':' || opts, ';' ORDER BY category) AS customizations,
  count(*) AS n_categories, CAST(sum(n) AS BIGINT) AS n_options FROM (
  SELECT page_id, coalesce(category, 'Options') AS category, count(*) AS n,
    string_agg(coalesce(component, 'Unknown') || '|' || coalesce(price, '') || '|' || coalesce(reference, ''), ','
      ORDER BY pos) AS opts
  FROM guided_options GROUP BY page_id, coalesce(category, 'Options')) x GROUP BY page_id""",
    "guided_options",
)
def _(t):
    nested = options.nest_options(t.guided_options())
    text = F.transform(
        F.map_entries("customizations"),
        lambda e: F.concat(
            e["key"],
            F.lit(":"),
            F.array_join(
                F.transform(
                    e["value"],
                    lambda o: F.concat_ws(
                        "|", o["label"], F.coalesce(o["price"], F.lit("")), F.coalesce(o["image"], F.lit(""))
                    ),
                ),
                ",",
            ),
        ),
    )
    return nested.withColumn("customizations", F.array_join(text, ";"))


cte("imaged_options", """
SELECT o.page_id, o.pos, o.category, o.component, o.price, o.reference, coalesce(m.image, '') AS image
FROM guided_options o LEFT JOIN (
  SELECT page_id, option_text, image FROM (
    SELECT o.page_id, o.option_text, e.image, row_number() OVER (PARTITION BY o.page_id, o.option_text
      ORDER BY length(o.option_text) / (length(e.text) + 1) DESC, e.pos) AS rank
    FROM (SELECT DISTINCT page_id, lower(component) AS option_text FROM guided_options) o
    JOIN elements e ON e.page_id = o.page_id AND e.image <> '' AND e.text <> '' AND o.option_text <> ''
      AND (contains(lower(e.text), o.option_text) OR contains(o.option_text, lower(e.text)))) r WHERE rank = 1) m
ON m.page_id = o.page_id AND m.option_text = lower(o.component)""", "guided_options elements")


@query("match_option_images", "SELECT * FROM imaged_options", "imaged_options")
def _(t):
    return options.match_option_images(t.guided_options(), t.elements())


@query(
    "remaining_models",
    f"""SELECT DISTINCT page_id, component AS model FROM guided_options
WHERE {d.any_contained('lower(category)', lex.MODEL_SELECTION_WORDS)} AND component <> ''
EXCEPT SELECT page_id, model FROM explored""",
    "guided_options explored",
)
def _(t):
    return options.remaining_models(t.guided_options(), t.explored())


@query(
    "options_by_model",
    """
SELECT product, model, category, n_options, n_models, n_models > 1 AS has_header FROM (
  SELECT g.*, m.n_models FROM (
    SELECT page_id AS product, coalesce(nullif(reference, ''), 'General') AS model, coalesce(category, 'Options') AS category,
      count(*) AS n_options FROM guided_options GROUP BY 1, 2, 3) g
  JOIN (SELECT page_id, count(DISTINCT coalesce(nullif(reference, ''), 'General')) AS n_models FROM guided_options
    GROUP BY 1) m ON m.page_id = g.product) x""",
    "guided_options",
)
def _(t):
    rows = t.guided_options().select(
        F.col("page_id").alias("product"),
        F.col("reference").alias("model"),
        F.coalesce("category", F.lit("Options")).alias("category"),
    )
    return options.options_by_model(rows)


# ------------------------------------------------------------------ configurators
LINK_TEXT, LINK = "lower(txt)", "lower(raw)"
LINK_SCORE = (
    f"{d.n_contained(LINK_TEXT, lex.ACTION_WORDS)} * 3 + {d.n_contained(LINK, lex.LINK_URL_WORDS)} * 2 + "
    f"{d.any_contained(LINK_TEXT, lex.BUTTON_PHRASES)}::INT * 2"
)
cte(
    "config_links",
    f"""
SELECT page_id, url, CAST(pos AS INT) AS pos, link, score, row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1 AS is_target,
  {d.host('link')} <> {d.host('url')} AS is_external FROM (
  SELECT page_id, url, pos, {d.absolute('raw', 'url')} AS link, {LINK_SCORE} AS score FROM (
    SELECT page_id, url, unnest({d.rx_all('markdown', lex.LINK_MARKDOWN, 1)}) AS txt,
      unnest({d.rx_all('markdown', lex.LINK_MARKDOWN, 2)}) AS raw,
      generate_subscripts({d.rx_all('markdown', lex.LINK_MARKDOWN, 2)}, 1) - 1 AS pos FROM product_pages) a) b
WHERE score >= 3""",
    "product_pages",
)


@query("configurator_links", "SELECT page_id, pos, link, score, is_target, is_external FROM config_links", "config_links")
def _(t):
    return configurators.configurator_links(t.product_pages())


HEADS = "(" + " OR ".join(d.has_rx("line", p) for p in lex.GROUP_HEADERS) + ")"
ITEMS = "(" + " OR ".join(d.has_rx("line", p) for p in lex.GROUP_ITEMS) + ")"
cte(
    "group_lines",
    f"""
SELECT *, sum(is_head::INT) OVER (PARTITION BY page_id ORDER BY pos) AS grp FROM (
  SELECT page_id, pos, line, {HEADS} AS is_head, {ITEMS} AS is_item FROM page_lines) x""",
    "page_lines",
)
cte(
    "option_groups",
    """
SELECT page_id, count(*) AS n FROM (
  SELECT l.page_id, l.grp FROM group_lines l LEFT JOIN (
    SELECT page_id, grp, min(pos) AS blank FROM group_lines WHERE line = '' GROUP BY page_id, grp) b
    ON b.page_id = l.page_id AND b.grp = l.grp
  WHERE l.grp > 0 AND l.is_item AND l.pos < coalesce(b.blank, 1000000) GROUP BY l.page_id, l.grp HAVING count(*) >= 2) g
GROUP BY page_id""",
    "group_lines",
)
VARIANTS = " || ".join(d.rx_all("markdown", p) for p in lex.VARIANT_PRICE_PATTERNS)
cte(
    "config_signals",
    f"""
SELECT *, CASE WHEN has_configurator THEN least(
    CASE WHEN links > 0 THEN 0.35::DOUBLE ELSE 0.0 END
    + CASE WHEN content_score >= 3 THEN 0.25::DOUBLE WHEN content_score > 0 THEN 0.15 ELSE 0.0 END
    + CASE WHEN form_elements >= 3 THEN 0.2::DOUBLE WHEN form_elements > 0 THEN 0.1 ELSE 0.0 END
    + CASE WHEN option_groups >= 3 THEN 0.15::DOUBLE WHEN option_groups >= 2 THEN 0.1 ELSE 0.0 END
    + CASE WHEN price_variants >= 5 THEN 0.15::DOUBLE WHEN price_variants >= 3 THEN 0.1 ELSE 0.0 END, 1.0)
  ELSE 0.0::DOUBLE END AS confidence FROM (
SELECT *, links > 0 OR content_score > 0 OR form_elements > 0 OR option_groups >= 2 OR price_variants >= 3 AS has_configurator,
  CASE WHEN links > 0 AND {d.host('configurator_url')} <> {d.host('url')} THEN 'external'
    WHEN links > 0 OR content_score > 0 OR form_elements > 0 OR option_groups >= 2 THEN 'embedded' ELSE 'none' END
    AS configurator_type
FROM (
  SELECT p.page_id, p.url, CAST(coalesce(l.n, 0) AS INT) AS links, l.target AS configurator_url,
    CAST(floor({d.n_contained('low', lex.ACTION_WORDS)} + {d.n_contained('low', lex.INDICATOR_WORDS)} * 0.5::DOUBLE
      + CASE WHEN {d.n_rx('low', 'step\\s+[0-9]+')} >= 2 THEN 3 ELSE 0 END) AS INT) AS content_score,
    CAST(least(least({d.n_rx('markdown', lex.CHECKBOX_PATTERN)} // 3, 3)
      + {' + '.join(f"least({d.n_rx('markdown', p)} // 3, 2)" for p in lex.RADIO_PATTERNS)}
      + {d.n_contained('low', lex.DROPDOWN_WORDS)}, 10) AS INT) AS form_elements,
    CAST(coalesce(g.n, 0) AS INT) AS option_groups, CAST(len(list_distinct({VARIANTS})) AS INT) AS price_variants
  FROM (SELECT *, lower(markdown) AS low FROM product_pages) p
  LEFT JOIN (SELECT page_id, count(*) AS n, arg_min(link, pos) AS target FROM config_links GROUP BY page_id) l
    ON l.page_id = p.page_id
  LEFT JOIN option_groups g ON g.page_id = p.page_id) a) b""",
    "product_pages config_links option_groups",
)


@query("configurator_signals", "SELECT * FROM config_signals", "config_signals")
def _(t):
    return configurators.configurator_signals(t.product_pages())


cte(
    "config_decisions",
    """
SELECT *, has_configurator AND confidence >= 0.25 AS should_scrape,
  CASE WHEN NOT has_configurator THEN 'no_configurator_detected' WHEN confidence < 0.25 THEN 'confidence_too_low'
    WHEN configurator_type = 'external' THEN CASE WHEN confidence >= 0.5 THEN 'external_configurator_high_confidence'
      ELSE 'external_configurator_medium_confidence' END
    WHEN confidence >= 0.5 THEN 'embedded_configurator_high_confidence'
    ELSE 'embedded_configurator_medium_confidence' END AS reason FROM config_signals""",
    "config_signals",
)


@query("configurator_decision", "SELECT * FROM config_decisions", "config_decisions")
def _(t):
    return configurators.configurator_decision(configurators.configurator_signals(t.product_pages()))


@query("decision_counts", "SELECT reason, count(*) AS n FROM config_decisions GROUP BY reason", "config_decisions")
def _(t):
    decided = configurators.configurator_decision(configurators.configurator_signals(t.product_pages()))
    return configurators.decision_counts(decided)


PLATFORM = d.cases(
    [(f"contains({d.host('configurator_url')}, {d.q(k)})", d.q(p)) for k, p in lex.PLATFORM_OF], "'generic_external'"
)


@query(
    "platform_report",
    f"""SELECT {PLATFORM} AS platform, count(*) AS n_pages, count(*) FILTER (
  {d.n_contained('lower(markdown)', lex.SCRIPT_HEAVY_MARKERS)} >= 2 OR length({d.strip('markdown')}) < 500) AS n_script_heavy
FROM config_signals JOIN product_pages USING (page_id) WHERE configurator_url IS NOT NULL GROUP BY 1""",
    "config_signals product_pages",
)
def _(t):
    return configurators.platform_report(t.product_pages())


cte("both_pages", "SELECT * FROM product_pages UNION ALL SELECT * FROM config_pages", "product_pages config_pages")
cte(
    "custom_sources",
    f"""
SELECT page_id, url, customization_source, CASE WHEN customization_source IN ('external_configurator',
    'embedded_configurator_page') THEN target_id WHEN customization_source <> 'none' THEN page_id END AS options_page_id,
  CASE WHEN customization_source = 'external_configurator' THEN {PLATFORM} END AS external_platform,
  customization_source = 'external_configurator' AND own AS own_kind FROM (
  SELECT c.page_id, c.url, c.configurator_url, s.page_id AS target_id, own, CASE WHEN NOT should_scrape THEN 'none'
      WHEN configurator_type = 'external' AND configurator_url IS NOT NULL THEN
        CASE WHEN own OR other THEN 'external_configurator' ELSE 'product_page_fallback' END
      WHEN configurator_url IS NOT NULL THEN
        CASE WHEN s.page_id IS NOT NULL THEN 'embedded_configurator_page' ELSE 'product_page_fallback' END
      ELSE 'product_page' END AS customization_source
  FROM config_decisions c
  LEFT JOIN (SELECT {d.canonical('url')} AS k, min(page_id) AS page_id,
      bool_or(page_id IN (SELECT page_id FROM cc_rows)) AS own, bool_or(page_id IN (SELECT page_id FROM config_merged)) AS other
    FROM both_pages GROUP BY 1) s ON s.k = {d.canonical('c.configurator_url')}) x""",
    "config_decisions both_pages cc_rows config_merged",
)


def sources_of(t, hold=lambda df, name: df):
    pages, config = t.product_pages(), t.config_pages()
    decided = configurators.configurator_decision(configurators.configurator_signals(pages))
    own = hold(options.configurator_options(config), "own-options")
    merged = hold(options.merge_options(options.option_rows(union_rows(pages, config))), "page-options")
    return configurators.customization_source(decided, union_rows(pages, config), own, merged), own, merged


@query("customization_source", "SELECT * FROM custom_sources", "custom_sources")
def _(t):
    return sources_of(t)[0]


cte("all_merged", "SELECT * FROM product_merged UNION ALL SELECT * FROM config_merged", "product_merged config_merged")


@query(
    "customizations",
    f"""
SELECT s.page_id, s.customization_source, o.* EXCLUDE (page_id) FROM custom_sources s
JOIN (SELECT {OPTION}, true AS kind FROM cc_rows UNION ALL SELECT {OPTION}, false FROM all_merged) o
ON o.page_id = s.options_page_id AND o.kind = s.own_kind""".replace("EXCLUDE (page_id)", "EXCLUDE (page_id, kind)"),
    "custom_sources cc_rows all_merged",
)
def _(t):
    return configurators.customizations(*sources_of(t, staged))
