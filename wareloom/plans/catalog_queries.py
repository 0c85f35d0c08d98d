"""Queries that build, clean, merge and export catalogs, and route pages."""

from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.frames import union_rows
from ..operators import catalog as C
from ..operators import classify, configurators, near_duplicates, options, prices, routing, specs
from ..session import staged, work_folder
from ..sources import catalog_json, sheets
from . import sqltext as d
from .price_queries import _spec_value
from .registry import CTES, cte, query

# ------------------------------------------------------------------ build
PRODUCT_SPECS = " UNION ALL ".join(
    f"SELECT page_id, {d.q(name)} AS spec, {_spec_value(pattern)} AS value FROM product_pages"
    for pattern, name in lex.SPEC_PATTERNS
)
cte(
    "product_specs",
    f"SELECT page_id, spec, value FROM ({PRODUCT_SPECS}) x WHERE value <> '' AND length(value) < 200",
    "product_pages",
)
PRODUCT_ID = "replace(replace(lower(product_name), ' ', '_'), '-', '_')"
cte(
    "winners",
    f"""
SELECT {PRODUCT_ID} AS product_id, max(p.page_id) AS page_id, count(*) - 1 AS collisions FROM base_prices p
JOIN balanced b ON b.page_id = p.page_id AND b.strictness = 'balanced' AND b.is_product
WHERE {d.crawl_skip('p.url')} = '' GROUP BY 1""",
    "base_prices balanced",
)
cte(
    "custom_rows",
    """SELECT s.page_id, o.category, o.category_pos, o.pos, o.label, o.price, o.image FROM custom_sources s
JOIN (SELECT *, true AS kind FROM cc_rows UNION ALL BY NAME SELECT *, false AS kind FROM all_merged) o
ON o.page_id = s.options_page_id AND o.kind = s.own_kind""",
    "custom_sources cc_rows all_merged",
)
cte(
    "built",
    """
SELECT w.product_id, p.product_name, p.url, p.base_price, coalesce(s.specs, '') AS specs, s.n_specs, c.has_configurator,
  c.configurator_type, c.configurator_url, c.confidence AS configurator_confidence, u.external_platform,
  u.customization_source, coalesce(o.categories, '') AS categories, coalesce(o.n_categories, 0) AS n_categories,
  CAST(coalesce(o.n, 0) AS INT) AS total_customization_options, w.collisions
FROM winners w JOIN base_prices p ON p.page_id = w.page_id JOIN config_signals c ON c.page_id = w.page_id
JOIN custom_sources u ON u.page_id = w.page_id
LEFT JOIN (SELECT page_id, string_agg(spec || '=' || value, ';' ORDER BY spec) AS specs, count(*) AS n_specs
  FROM product_specs GROUP BY page_id) s ON s.page_id = w.page_id
LEFT JOIN (SELECT page_id, string_agg(category, ',' ORDER BY category_pos) AS categories, sum(n) AS n,
    count(*) AS n_categories FROM (
    SELECT page_id, category, category_pos, count(*) AS n FROM custom_rows GROUP BY page_id, category, category_pos) x
  GROUP BY page_id) o ON o.page_id = w.page_id""",
    "winners base_prices config_signals custom_sources product_specs custom_rows",
)


def built_catalog(t):
    """Pages to catalog: classify, stage the product pages and the facts that several joins read, join."""
    pages = staged(classify.product_pages(t.product_pages()), "product-pages")
    config = t.config_pages()
    signals = staged(configurators.configurator_signals(pages), "signals")
    own = staged(options.configurator_options(config), "own-options")
    merged = staged(options.merge_options(options.option_rows(union_rows(pages, config))), "page-options")
    sources = configurators.customization_source(
        configurators.configurator_decision(signals), union_rows(pages.select("page_id", "url"), config.select("page_id", "url")),
        own, merged,
    )
    return C.build_catalog(
        prices.base_price(pages), specs.spec_pairs(pages), configurators.customizations(sources, own, merged), signals, sources
    )


def pair_text(map_name):
    return F.array_join(
        F.transform(F.sort_array(F.map_entries(map_name)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"
    )


@query(
    "build_catalog",
    "SELECT * EXCLUDE (n_specs, n_categories) FROM built",
    "built",
)
def _(t):
    return built_catalog(t).select(
        "product_id",
        "product_name",
        "url",
        "base_price",
        pair_text("specifications").alias("specs"),
        "has_configurator",
        "configurator_type",
        "configurator_url",
        "configurator_confidence",
        "external_platform",
        "customization_source",
        F.array_join("customization_categories", ",").alias("categories"),
        "total_customization_options",
        "collisions",
    )


@query(
    "catalog_summary",
    """SELECT count(*) AS n_products, count(*) FILTER (has_configurator) AS n_with_configurator,
  count(*) FILTER (configurator_type = 'embedded') AS n_embedded, count(*) FILTER (configurator_type = 'external') AS n_external,
  CAST(coalesce(sum(n_categories), 0) AS BIGINT) AS n_categories,
  CAST(coalesce(sum(total_customization_options), 0) AS BIGINT) AS n_options,
  CAST(coalesce(sum(n_specs), 0) AS BIGINT) AS n_specifications FROM built""",
    "built",
)
def _(t):
    return C.catalog_summary(built_catalog(t))


PAGE_TYPE = "CASE length(product_id) % 4 WHEN 0 THEN 'PRODUCT' WHEN 1 THEN 'OFFERING' WHEN 2 THEN 'product' ELSE 'INFO' END"


@query(
    "type_summary",
    f"""SELECT count(*) AS n_items, count(*) FILTER (upper({PAGE_TYPE}) = 'PRODUCT') AS n_products,
  count(*) FILTER ({PAGE_TYPE} = 'OFFERING') AS n_offerings,
  CAST(coalesce(sum(n_specs), 0) AS BIGINT) AS n_specifications,
  CAST(coalesce(sum(total_customization_options), 0) AS BIGINT) AS n_options FROM built""",
    "built",
)
def _(t):
    return C.type_summary(built_catalog(t).withColumn("page_type", F.expr(PAGE_TYPE)))


@query(
    "classification_summary",
    """SELECT count(*) FILTER (is_product) AS n_products, count(*) FILTER (NOT is_product) AS n_others,
  CAST(sum(CAST(confidence AS DECIMAL(18,6))) FILTER (is_product) AS DOUBLE) / count(*) FILTER (is_product) AS avg_confidence,
  CAST(sum(CAST(score AS DECIMAL(18,6))) FILTER (is_product) AS DOUBLE) / count(*) FILTER (is_product) AS avg_score FROM balanced WHERE strictness = 'balanced'""",
    "balanced",
)
def _(t):
    return C.classification_summary(classify.classify_balanced(t.product_pages()))


# ------------------------------------------------------------------ split
SPLIT_KIND = (
    f"CASE WHEN {d.any_contained('lower(category)', lex.PRODUCT_CATEGORY_WORDS)} THEN 0 WHEN n > 5 AND n_images > 5 THEN 1 END"
)
cte(
    "split_cats",
    f"""SELECT page_id, category AS split_category FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {SPLIT_KIND}, category_pos) AS rank FROM (
    SELECT page_id, category, category_pos, count(*) AS n, count(*) FILTER (image <> '') AS n_images
    FROM detail_merged GROUP BY page_id, category, category_pos) c WHERE {SPLIT_KIND} IS NOT NULL) r WHERE rank = 1""",
    "detail_merged",
)


cte(
    "split_rest",
    """SELECT m.page_id, count(DISTINCT category) AS n_categories, count(*) AS n FROM detail_merged m
LEFT JOIN split_cats s ON s.page_id = m.page_id WHERE s.split_category IS NULL OR s.split_category <> m.category GROUP BY 1""",
    "detail_merged split_cats",
)
cte(
    "split_items",
    """SELECT m.*, row_number() OVER (PARTITION BY m.page_id ORDER BY m.pos) AS k FROM detail_merged m
JOIN split_cats s ON s.page_id = m.page_id AND s.split_category = m.category""",
    "detail_merged split_cats",
)


@query(
    "split_products",
    """
SELECT p.page_id, coalesce(i.label, p.product_name) AS product_name,
  CASE WHEN i.label IS NULL THEN p.url ELSE p.url || '#product-' || i.k END AS url,
  CASE WHEN i.label IS NOT NULL THEN p.url END AS source_url, coalesce(nullif(i.price, ''), p.base_price) AS base_price,
  i.image AS product_image, coalesce(r.n_categories, 0) AS n_categories, coalesce(r.n, 0) AS total_customization_options,
  i.label IS NOT NULL AS extracted_from_multi_product_page
FROM base_prices p LEFT JOIN split_items i ON i.page_id = p.page_id LEFT JOIN split_rest r ON r.page_id = p.page_id""",
    "base_prices split_items split_rest",
)
def _(t):
    merged = staged(options.merge_options(options.option_rows(t.detail_pages())), "page-options")
    return C.split_products(prices.base_price(t.product_pages()), merged)


# ------------------------------------------------------------------ clean-up
CLEAN_NAME = f"lower({d.strip('coalesce(product_name, ' + d.q('') + ')')})"
cte(
    "judged",
    f"""SELECT *, CASE WHEN {CLEAN_NAME} = '' THEN 'empty_name'
  WHEN ends_with({CLEAN_NAME}, '?') THEN 'question'
  WHEN contains({CLEAN_NAME}, 'faq') THEN 'faq'
  WHEN {CLEAN_NAME} IN ({', '.join(map(d.q, C.GENERIC_NAMES))}) THEN 'generic_name'
  WHEN len(list_filter(string_split(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/')[2:],
    lambda s: regexp_replace(s, '[.](html?|php|aspx?)$', '') IN ('contact', 'contact-us', 'contacts', 'faq', 'faqs', 'about', 'about-us'))) > 0
    THEN 'navigation_page' ELSE '' END AS reason FROM raw_catalog""",
    "raw_catalog",
)
SIGNATURE = f"{CLEAN_NAME} || '|' || lower({d.strip('url')})"
cte("valid", "SELECT * EXCLUDE (reason) FROM judged WHERE reason = ''", "judged")
cte(
    "deduped",
    f"SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY {SIGNATURE} ORDER BY seq) = 1",
    "valid",
)


@query("tag_invalid", "SELECT *, reason = '' AS keep FROM judged", "judged")
def _(t):
    return C.tag_invalid(t.raw_catalog())


@query(
    "filter_invalid",
    """SELECT * EXCLUDE (reason) FROM judged
WHERE CASE WHEN seq % 13 = 0 THEN seq % 2 = 0 ELSE reason = '' END""",
    "judged",
)
def _(t):
    rows = t.raw_catalog()
    verdicts = rows.filter("seq % 13 = 0").select("seq", (F.col("seq") % 2 == 0).alias("keep"))
    return C.filter_invalid(rows, verdicts)


@query("dedupe_catalog", "SELECT * FROM deduped", "deduped")
def _(t):
    return C.dedupe_catalog(C.filter_invalid(t.raw_catalog()))


@query(
    "optimization_stats",
    """SELECT a AS input_items, a - b AS invalid_items_removed, b - c AS duplicates_removed, c AS output_items,
  CASE WHEN a > 0 THEN CAST(c AS DOUBLE) / a * 100 ELSE 0 END AS retention_rate
FROM (SELECT (SELECT count(*) FROM raw_catalog) AS a, (SELECT count(*) FROM valid) AS b, (SELECT count(*) FROM deduped) AS c) x""",
    "raw_catalog valid deduped",
)
def _(t):
    valid = C.filter_invalid(t.raw_catalog())
    return C.optimization_stats(t.raw_catalog(), valid, C.dedupe_catalog(valid))


def _near_check(source: str, unit: str, threshold: float) -> str:
    """All pairs that share a run of three; parents; and where they lead."""
    cut = "string_split(clean, ' ')" if unit == "word" else "regexp_extract_all(clean, '.')"
    return rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT id, unnest(s) AS run, len(s) AS n FROM (SELECT id, list_distinct(list_transform(range(1, greatest(len(u) - 2, 1) + 1),
    lambda i: array_to_string(u[i:i + 2], chr(1)))) AS s FROM (SELECT id, {cut} AS u FROM (
      SELECT id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS clean
      FROM ({source}) t) c) x) y),
pairs AS MATERIALIZED (SELECT a.id, b.id AS other, count(*) / (a.n + b.n - count(*)) AS similarity
  FROM runs a JOIN runs b ON a.run = b.run AND b.id < a.id GROUP BY a.id, b.id, a.n, b.n
  HAVING count(*) / (a.n + b.n - count(*)) >= {threshold}),
parents AS MATERIALIZED (SELECT id, min(other) AS parent, arg_min(similarity, other) AS similarity FROM pairs GROUP BY id),
walk AS (SELECT id, parent AS node FROM parents UNION ALL SELECT w.id, p.parent FROM walk w JOIN parents p ON p.id = w.node),
roots AS (SELECT id, min(node) AS root FROM walk GROUP BY id)
SELECT t.id, coalesce(root, t.id) AS kept_id, coalesce(similarity, 1.0) AS similarity, root IS NOT NULL AS is_duplicate
FROM ({source}) t LEFT JOIN parents p ON p.id = t.id LEFT JOIN roots r ON r.id = t.id"""


@query("near_duplicate_products", _near_check("SELECT seq AS id, product_name AS text FROM catalog", "char", 0.8).replace(
    "WITH RECURSIVE ", "WITH RECURSIVE catalog AS MATERIALIZED (" + CTES["catalog"] + "), "))
def _(t):
    items = t.catalog().select(F.col("seq").alias("id"), F.col("product_name").alias("text"))
    return near_duplicates.near_duplicates(items, 0.8, unit="char")


@query("near_duplicate_texts", _near_check("SELECT doc_id AS id, text FROM documents", "word", 0.7))
def _(t):
    items = t.spread(t.table("documents")).select(F.col("doc_id").alias("id"), "text")
    return near_duplicates.near_duplicates(items, 0.7)


# ------------------------------------------------------------------ merge and report
cte(
    "merged_catalog",
    """SELECT c.*, CASE WHEN route = 'ai' THEN concat('about ', product_name) END AS description,
  CASE WHEN count(*) OVER (PARTITION BY url) > 1
    THEN url || '#item-' || row_number() OVER (PARTITION BY url ORDER BY seq) ELSE url END AS catalog_key
FROM catalog c""",
    "catalog",
)


def merged(t):
    rows = t.catalog()
    lam, static = rows.filter("route = 'lam'"), rows.filter("route = 'static'")
    ai = rows.filter("route = 'ai'").withColumn("description", F.concat(F.lit("about "), "product_name"))
    return C.merge_catalogs(lam, static, ai)


@query("merge_catalogs", "SELECT * FROM merged_catalog", "merged_catalog")
def _(t):
    return merged(t)


@query("route_totals", "SELECT route, count(*) AS n_products FROM catalog GROUP BY ROLLUP (route)", "catalog")
def _(t):
    return C.route_totals(merged(t))


@query(
    "route_cube",
    """SELECT route, configurator_type, count(*) AS n_products, count(*) FILTER (has_configurator) AS n_with_configurator
FROM catalog GROUP BY CUBE (route, configurator_type)""",
    "catalog",
)
def _(t):
    return C.route_cube(t.catalog())


@query(
    "catalog_keys",
    """SELECT *, coalesce(product_name, 'product') || '_' || index AS sheet_key FROM (
  SELECT *, row_number() OVER (ORDER BY seq) - 1 AS index FROM catalog) x""",
    "catalog",
)
def _(t):
    return C.catalog_keys(t.catalog())


@query(
    "list_jobs",
    "SELECT * FROM jobs WHERE status = 'running'",
    "jobs",
)
def _(t):
    return C.list_jobs(t.jobs(), "running")


@query(
    "active_jobs",
    """SELECT n AS active_jobs, 2 AS max_active_jobs, n < 2 AS can_start
FROM (SELECT count(*) FILTER (status = 'running') AS n FROM jobs) x""",
    "jobs",
)
def _(t):
    return C.active_jobs(t.jobs())


# ------------------------------------------------------------------ sources and sheets
SHEET_OPTIONS = """
SELECT page_id, category, category_pos, pos, label, price, image,
  CASE WHEN page_id % 3 = 0 AND pos % 2 = 0 THEN 'Model B' END AS model,
  CASE WHEN category LIKE '%Color%' THEN concat('#', lpad(CAST(page_id % 1000000 AS STRING), 6, '0'))
    WHEN category LIKE '%Wood%' THEN '#abc' END AS hex_color
"""
cte("sheet_options", SHEET_OPTIONS + "FROM detail_merged", "detail_merged")


def sheet_catalog(t):
    merged_options = options.merge_options(options.option_rows(t.detail_pages()))
    rows = t.spark.sql(SHEET_OPTIONS + "FROM {merged}", merged=merged_options)
    base = prices.base_price(t.product_pages()).select(
        "page_id", F.col("page_id").alias("seq"), C.product_id(F.col("product_name")).alias("product_id"),
        "product_name", "url", "base_price",
    )
    spec_rows = specs.section_specs(specs.spec_sections(t.detail_pages()))
    return C.attach_nested(base, C.nest_specs(spec_rows, "key"), C.nest_customizations(rows))


cte("sheet_specs", "SELECT * FROM section_specs", "section_specs")
cte(
    "component_parts",
    """
SELECT page_id AS seq, 0 AS block, 0 AS a, 0 AS b, 'Base Model(' || product_name || ')' AS category,
  product_name AS component, url AS reference FROM base_prices
UNION ALL SELECT DISTINCT page_id, 1, 0, 0, '', '', '' FROM sheet_specs
UNION ALL SELECT DISTINCT page_id, 2, 0, 0, 'Specifications', '', '' FROM sheet_specs
UNION ALL SELECT page_id, 3, row_number() OVER (PARTITION BY page_id ORDER BY key), 0, '', key || ': ' || value, '' FROM sheet_specs
UNION ALL SELECT DISTINCT page_id, 4, 0, 0, '', '', '' FROM sheet_specs
UNION ALL SELECT page_id, 5, category_pos, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY page_id, category)
    THEN category ELSE '' END, label, coalesce(image, '') FROM sheet_options""",
    "base_prices sheet_specs sheet_options",
)


@query(
    "component_rows",
    """SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY block, a, b) - 1 AS INT) AS pos, category, component, reference
FROM component_parts""",
    "component_parts",
)
def _(t):
    return sheets.component_rows(sheet_catalog(t))


cte(
    "modelled",
    """SELECT o.* REPLACE (coalesce(o.model, 'General') AS model), n_models FROM sheet_options o
JOIN (SELECT page_id, count(DISTINCT coalesce(model, 'General')) AS n_models FROM sheet_options GROUP BY 1) m USING (page_id)""",
    "sheet_options",
)
cte(
    "priced_parts",
    """
SELECT page_id AS seq, 0 AS block, '' AS m, 0 AS h, 0 AS a, 0 AS b, 'Base Model(' || product_name || ')' AS category,
  product_name AS component, coalesce(base_price, 'N/A') AS price, '' AS image, '' AS notes, url AS reference,
  NULL::VARCHAR AS hex_color FROM base_prices
UNION ALL SELECT DISTINCT page_id, 1, '', 0, 0, 0, '', '', '', '', '', '', NULL FROM sheet_specs
UNION ALL SELECT DISTINCT page_id, 2, '', 0, 0, 0, 'Specifications', '', '', '', '', '', NULL FROM sheet_specs
UNION ALL SELECT page_id, 3, '', 0, row_number() OVER (PARTITION BY page_id ORDER BY key), 0, '', key || ': ' || value, '', '',
  'Specification', '', NULL FROM sheet_specs
UNION ALL SELECT DISTINCT page_id, 4, '', 0, 0, 0, '', '', '', '', '', '', NULL FROM sheet_specs
UNION ALL SELECT DISTINCT page_id, 5, model, 0, 0, 0, '', '', '', '', '', '', NULL FROM modelled WHERE n_models > 1
UNION ALL SELECT DISTINCT page_id, 5, model, 1, 0, 0, '═══ ' || model || ' ═══', '', '', '', 'Model Configuration', '', NULL
  FROM modelled WHERE n_models > 1
UNION ALL SELECT page_id, 5, model, 2, category_pos, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY page_id, model, category)
    THEN category ELSE '' END, label, coalesce(price, ''), coalesce(image, ''), 'Category: ' || category, '', hex_color FROM modelled""",
    "base_prices sheet_specs modelled",
)
cte(
    "priced_sheet",
    """SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY block, m, h, a, b) - 1 AS INT) AS pos, category,
  component, price, image, notes, reference, hex_color FROM priced_parts""",
    "priced_parts",
)


@query("priced_rows", "SELECT * FROM priced_sheet", "priced_sheet")
def _(t):
    return sheets.priced_rows(sheet_catalog(t))


@query(
    "unpriced_rows",
    """SELECT seq, pos, category, component, image, CASE WHEN reference <> '' THEN reference
  WHEN notes IN ('Specification', 'Model Configuration') THEN notes ELSE '' END AS reference, hex_color FROM priced_sheet""",
    "priced_sheet",
)
def _(t):
    return sheets.priced_rows(sheet_catalog(t), include_prices=False)


def _channel(at):
    return f"CAST('0x' || substr(hex_color, {at + 1}, 2) AS INT) / 255.0::DOUBLE"


@query(
    "color_cells",
    f"""
SELECT seq, row_index, 1 AS column_index, hex_color, red, green, blue,
  (red * 299 + green * 587 + blue * 114) / 1000 AS brightness,
  CASE WHEN (red * 299 + green * 587 + blue * 114) / 1000 > 0.5 THEN 'black' ELSE 'white' END AS text_color
FROM (SELECT seq, row_index, hex_color, {_channel(1)} AS red, {_channel(3)} AS green, {_channel(5)} AS blue FROM (
  SELECT *, row_number() OVER (ORDER BY seq, pos) AS row_index FROM priced_sheet) a WHERE length(hex_color) = 7) b""",
    "priced_sheet",
)
def _(t):
    return sheets.color_cells(sheets.priced_rows(sheet_catalog(t)))


@query(
    "quotation_template",
    f"""
SELECT {PRODUCT_ID} AS product_id, {d.q(lex.QUOTATION_TEXT)} AS instructions,
  '{{"product_name":' || to_json(product_name) || ',"base_price":' || coalesce(to_json(base_price)::VARCHAR, 'null') || ',"url":'
  || to_json(url) || ',"customizations":{{' || coalesce(custom, '') || '}}}}' AS quotation
FROM base_prices p LEFT JOIN (
  SELECT page_id, string_agg(to_json(category) || ':{{"options":[' || opts || ']}}', ',' ORDER BY category_pos) AS custom FROM (
    SELECT page_id, category, category_pos, string_agg('{{"label":' || to_json(label) || ',"price":'
      || coalesce(to_json(price)::VARCHAR, 'null') || ',"image":' || coalesce(to_json(image)::VARCHAR, 'null')
      || ',"selected":false}}', ',' ORDER BY pos) AS opts FROM sheet_options GROUP BY page_id, category, category_pos) x
  GROUP BY page_id) c ON c.page_id = p.page_id""",
    "base_prices sheet_options",
)
def _(t):
    return sheets.quotation_template(sheet_catalog(t))


@query(
    "option_export",
    """SELECT coalesce(category, '') AS "Categories", coalesce(component, '') AS "Component", coalesce(price, 'N/A') AS "Price",
  coalesce(reference, '') AS "References", coalesce(image, '') AS "Image" FROM imaged_options""",
    "imaged_options",
)
def _(t):
    return sheets.option_export(options.match_option_images(t.guided_options(), t.elements()))


@query(
    "write_and_read_catalog",
    """
SELECT p.page_id, replace(replace(lower(p.product_name), ' ', '_'), '-', '_') AS product_id, p.product_name, p.url, p.base_price,
  coalesce(s.specs, '') AS specs, coalesce(o.n, 0) AS n_options
FROM base_prices p
LEFT JOIN (SELECT page_id, string_agg(key || '=' || value, ';' ORDER BY key) AS specs FROM sheet_specs GROUP BY 1) s ON s.page_id = p.page_id
LEFT JOIN (SELECT page_id, CAST(count(*) AS INT) AS n FROM sheet_options GROUP BY 1) o ON o.page_id = p.page_id""",
    "base_prices sheet_specs sheet_options",
)
def _(t):
    folder = work_folder(t.spark, "catalog")
    nested = sheet_catalog(t).withColumn("source_url", F.col("page_id").cast("string"))
    catalog_json.write_catalog(nested.drop("seq", "page_id"), folder)
    return catalog_json.read_catalog_rows(t.spark, folder).select(
        F.col("source_url").cast("long").alias("page_id"),
        "product_id", "product_name", "url", "base_price",
        pair_text("specifications").alias("specs"),
        F.col("total_customization_options").alias("n_options"),
    )


@query(
    "component_csv",
    """SELECT row_number() OVER (ORDER BY seq, block, a, b) - 1 AS row_no, category, component, reference FROM component_parts""",
    "component_parts",
)
def _(t):
    folder = work_folder(t.spark, "sheet")
    sheets.write_sheet(sheets.component_rows(sheet_catalog(t)), folder, sheets.COMPONENT_HEADINGS)
    return sheets.read_sheet(t.spark, folder, sheets.COMPONENT_HEADINGS)


DAMAGE = """CASE doc % 6 WHEN 0 THEN left(text, length(text) - 9) WHEN 1 THEN '' WHEN 2 THEN '"just a word"'
  WHEN 3 THEN '{"products": "none"}' ELSE text END"""


@query(
    "catalog_errors",
    """SELECT doc, reason FROM (SELECT doc, CASE doc % 6 WHEN 0 THEN 'not json' WHEN 1 THEN 'empty' WHEN 2 THEN 'no catalog'
  WHEN 3 THEN 'no catalog' END AS reason FROM (SELECT DISTINCT seq // 50 AS doc FROM catalog) x) y WHERE reason IS NOT NULL""",
    "catalog",
)
def _(t):
    documents = catalog_documents(t).withColumn("value", F.expr(DAMAGE.replace("text", "value")))
    return catalog_json.catalog_errors(documents).select("doc", "reason")


DOCUMENT = 50  # products per catalog document


@query(
    "read_catalog",
    """
SELECT CASE (seq // 50) % 3 WHEN 0 THEN 'p' || seq END AS product_id, product_name, url, base_price, configurator_type,
  has_configurator FROM catalog""",
    "catalog",
)
def _(t):
    folder = work_folder(t.spark, "documents")
    catalog_documents(t).select("value").write.text(folder)
    return catalog_json.read_catalog(t.spark, folder, document_per_file=False).select(
        "product_id", "product_name", "url", "base_price", "configurator_type", "has_configurator"
    )


def catalog_documents(t):
    """doc, value: the catalog in documents of all three shapes."""
    product = F.struct("product_name", "url", "base_price", "configurator_type", "has_configurator")
    grouped = t.catalog().groupBy(F.floor(F.col("seq") / DOCUMENT).alias("doc")).agg(
        F.sort_array(F.collect_list(F.struct("seq", product.alias("product")))).alias("rows")
    )
    listed = F.transform("rows", lambda r: r["product"])
    keyed = F.map_from_entries(
        F.transform("rows", lambda r: F.struct(F.concat(F.lit("p"), r["seq"].cast("string")), r["product"]))
    )
    text = (
        F.when(F.col("doc") % 3 == 0, F.to_json(keyed))
        .when(F.col("doc") % 3 == 1, F.to_json(F.struct(listed.alias("products"), F.size("rows").alias("total_products"))))
        .otherwise(F.to_json(listed))
    )
    return grouped.select("doc", text.alias("value"))


# ------------------------------------------------------------------ routing
BLOG = d.any_contained("lower(url)", lex.BLOG_URL_PARTS)


@query("blog_prefilter", f"SELECT page_id, url FROM product_pages WHERE NOT {BLOG}", "product_pages")
def _(t):
    return routing.blog_prefilter(t.product_pages().select("page_id", "url"))


@query(
    "blog_counts",
    f"SELECT count(*) FILTER (NOT {BLOG}) AS kept, count(*) FILTER ({BLOG}) AS skipped FROM pages",
)
def _(t):
    return routing.blog_counts(t.pages())


GUESS = d.any_contained("lower(url)", lex.STATIC_CONFIGURATOR_WORDS)
cte(
    "routed",
    f"""SELECT page_id, url, CASE WHEN {BLOG} THEN 'SKIP' WHEN {d.any_contained('lower(url)', lex.ROUTE_CONFIGURATOR_WORDS)}
    THEN 'LAM' WHEN {d.any_contained('lower(url)', lex.ROUTE_SEMANTIC_WORDS)} THEN 'AI' ELSE 'STATIC' END AS route,
  {GUESS} AS has_configurator, CASE WHEN {GUESS} THEN 'embedded' ELSE 'none' END AS configurator_type,
  CASE WHEN {GUESS} THEN 0.7::DOUBLE ELSE 0.3 END AS confidence FROM product_pages""",
    "product_pages",
)


@query("route_pages", "SELECT * FROM routed", "routed")
def _(t):
    return routing.route_pages(t.product_pages().select("page_id", "url"))


@query(
    "route_counts",
    "SELECT route, count(*) AS n, count(*) FILTER (has_configurator) AS n_configurators FROM routed GROUP BY route",
    "routed",
)
def _(t):
    return routing.route_counts(routing.route_pages(t.product_pages()))


cte(
    "kept_urls",
    """
SELECT p.page_id, p.url, CASE WHEN d.has_configurator THEN d.category || '_CONFIGURATOR' ELSE d.category END AS category,
  d.confidence
FROM (SELECT page_id, url, (row_number() OVER (ORDER BY page_id) - 1) // 30 AS b, (row_number() OVER (ORDER BY page_id) - 1) % 30 + 1 AS n
  FROM pages) p JOIN decisions d ON d.batch_no = p.b AND d.url_number = p.n
WHERE d.relevance IN ('HIGH', 'MEDIUM') OR (d.relevance = 'LOW' AND d.has_configurator)""",
    "decisions",
)


@query("apply_decisions", "SELECT * FROM kept_urls", "kept_urls")
def _(t):
    return routing.apply_decisions(t.pages(), t.decisions())


@query(
    "apply_decisions_by_type",
    """SELECT p.page_id, p.url, d.category, d.confidence FROM pages p JOIN decisions d ON d.page_id = p.page_id
WHERE d.category IN ('PRODUCT', 'OFFERING') AND d.confidence >= 0.6""",
    "decisions",
)
def _(t):
    return routing.apply_decisions(t.pages(), t.decisions(), "type")


@query(
    "apply_payloads",
    """SELECT * FROM kept_urls k WHERE k.page_id IN (SELECT page_id FROM decisions WHERE batch_no % 4 <> 3)""",
    "kept_urls decisions",
)
def _(t):
    item = F.struct("url_number", "category", "relevance", "confidence", "has_configurator")
    out_of_range = F.array(
        F.struct(
            F.lit(99).cast("long").alias("url_number"), F.lit("PRODUCT").alias("category"), F.lit("HIGH").alias("relevance"),
            F.lit(1.0).alias("confidence"), F.lit(False).alias("has_configurator"),
        )
    )
    grouped = t.decisions().groupBy("batch_no").agg(F.concat(F.collect_list(item), out_of_range).alias("items"))
    payload = F.when(F.col("batch_no") % 4 == 3, F.lit("not json {")).otherwise(F.to_json("items"))
    payloads = grouped.select("batch_no", payload.alias("payload"))
    return routing.apply_decisions(t.pages(), routing.parse_payloads(payloads))


@query(
    "apply_decisions_fallback",
    f"""SELECT page_id, url, 'UNKNOWN' AS category, CAST(0.5 AS DOUBLE) AS confidence FROM pages
WHERE NOT {d.any_contained('lower(url)', lex.FALLBACK_EXCLUDED_WORDS)}""",
)
def _(t):
    nothing = t.decisions().withColumn("relevance", F.lit("LOW")).withColumn("has_configurator", F.lit(False))
    return routing.apply_decisions(t.pages(), nothing)


@query(
    "category_counts",
    """SELECT category, count(*) AS n, contains(category, 'CONFIGURATOR') AS is_configurator FROM kept_urls GROUP BY category""",
    "kept_urls",
)
def _(t):
    return routing.category_counts(routing.apply_decisions(t.pages(), t.decisions()))
