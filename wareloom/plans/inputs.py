"""Input tables: the given ones, and catalog-shaped ones Spark derives from them.

Each derived table has the same text for the check engine, so a query and
its check SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCT_PAGES_SQL = """
SELECT
  p_partkey AS page_id,
  concat('https://', CASE WHEN p_partkey % 4 = 0 THEN 'www.' ELSE '' END, 'shop', CAST(p_partkey % 7 AS STRING), '.example.com',
    CASE p_partkey % 10 WHEN 0 THEN '/blog/post-' WHEN 1 THEN '/collections/c-' WHEN 2 THEN '/contact/' WHEN 3 THEN '/build/' ELSE '/products/' END,
    CAST(p_partkey AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '' END, CASE WHEN p_partkey % 6 = 0 THEN '?ref=nav' ELSE '' END) AS url,
  concat_ws(chr(10),
    concat('# ', p_name, CASE WHEN p_partkey % 3 = 0 THEN concat(' - $', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)) ELSE '' END),
    '',
    CASE WHEN p_partkey % 4 = 1 THEN concat('Base price: $1,', CAST(100 + p_size AS STRING), ' CAD')
         WHEN p_partkey % 4 = 2 THEN concat('From $', CAST(p_size * 10 AS STRING), ' to $', CAST(p_size * 20 AS STRING))
         WHEN p_partkey % 4 = 3 THEN concat('Our cost: ', CAST(p_size * 7 AS STRING), '.50 EUR') ELSE 'Contact for price' END,
    CASE WHEN p_partkey % 2 = 0 THEN 'Add to cart or request quote today.' ELSE 'Shop now. Learn more.' END,
    CASE WHEN p_partkey % 10 = 0 THEN 'Published by John Smith. Tags: news. Read more. Share this.' ELSE 'Customize it: choose your options.' END,
    '',
    'Wood Type:',
    '- [ ] Walnut (+$120)',
    concat('- [x] ', CASE WHEN p_size > 25 THEN 'Dark Oak' ELSE 'Light Oak' END, ' (included)'),
    concat('- [ ] Cherry +$', CAST(p_size AS STRING)),
    '- [ ] walnut',
    '',
    CASE WHEN p_partkey % 9 = 0 THEN 'Select a model:' ELSE 'Color Options:' END,
    '![Image 1: Red swatch (+$50)](https://cdn.example.com/color_swatch_red.png)',
    '![Image 2: Blue (+$1,850)](https://cdn.example.com/blue.png)',
    concat('![Image 3: Green](https://cdn.example.com/', CAST(p_partkey % 11 AS STRING), '.png)'),
    '',
    '## Specifications',
    concat('- Weight: ', CAST(p_size AS STRING), ' lbs'),
    concat('| Width | ', CAST(p_size * 2 AS STRING), ' in |'),
    concat('Material: ', p_type, ' steel | grade A'),
    concat('Brand: ', p_brand),
    '## FAQ',
    '- What size is it: ask us',
    '',
    concat('[Customize](https://', CASE WHEN p_partkey % 8 = 0 THEN 'app.zakeke.com/c/' ELSE concat('shop', CAST(p_partkey % 7 AS STRING), '.example.com/configure/') END, CAST(p_partkey AS STRING), ')'),
    concat('[Next](', CASE (p_partkey + 28) % 10 WHEN 0 THEN '/blog/post-' WHEN 1 THEN '/collections/c-' WHEN 2 THEN '/contact/' WHEN 3 THEN '/build/' ELSE '/products/' END, CAST(p_partkey + 28 AS STRING), ') [Related](', CASE (p_partkey + 56) % 10 WHEN 0 THEN '/blog/post-' WHEN 1 THEN '/collections/c-' WHEN 2 THEN '/contact/' WHEN 3 THEN '/build/' ELSE '/products/' END, CAST(p_partkey + 56 AS STRING), ') [Cart](/cart/) [Home](/)')
  ) AS markdown
FROM part
"""

# Pages with richer specification and option sections behind the product text.
DETAIL_PAGES_SQL = f"""
SELECT page_id, url, concat(markdown, chr(10), concat_ws(chr(10),
    '## Technical Details',
    concat('* **Voltage**: ', CAST(100 + page_id % 12 AS STRING), ' V.'),
    concat('| Depth | ', CAST(page_id % 9 AS STRING), ' in |'),
    '|---|---|',
    CASE WHEN page_id % 2 = 0 THEN 'Depth: about <b>one</b>  foot' ELSE '- Engine size: 2 l' END,
    '- Why this finish: it lasts',
    '## Shipping',
    '- Frame: not in a section',
    '### Product Specs:',
    concat('**Motor**: M', CAST(page_id % 5 AS STRING)),
    'Finish: matte*',
    'Colour: none',
    '',
    '### Frame Color',
    '- Black (+$25)',
    '- White',
    concat('- Tone ', CAST(page_id % 13 AS STRING), ' - $', CAST(page_id % 40 AS STRING)),
    '![Image 4: Bronze](https://cdn.example.com/bronze.png)',
    '+ $15 extra',
    '![Image 5: frame photo](https://cdn.example.com/frame.png)',
    'Polished steel frame',
    '(+$75)',
    '**Handle**',
    '* Short handle (included)',
    CASE WHEN page_id % 3 = 0 THEN 'Size: Large (+$200)' ELSE 'Related products: none' END,
    '- Extra long',
    '- Recommended for you'
  )) AS markdown
FROM ({PRODUCT_PAGES_SQL}) AS base_pages
"""

# Stored configurator pages; those of every third product are linked by no product page.
CONFIG_PAGES_SQL = """
SELECT p_partkey + 1000000000 AS page_id,
  concat('https://', CASE WHEN p_partkey % 3 = 1 THEN 'elsewhere.example.org/c/' WHEN p_partkey % 8 = 0 THEN 'app.zakeke.com/c/' ELSE concat('shop', CAST(p_partkey % 7 AS STRING), '.example.com/configure/') END, CAST(p_partkey AS STRING)) AS url,
  CASE WHEN p_partkey % 16 = 0 THEN 'Loading' ELSE concat_ws(chr(10),
    CASE WHEN p_partkey % 24 = 8 THEN 'Wood (solid):' ELSE '### Frame Color' END,
    CASE WHEN p_partkey % 24 = 8 THEN '- [x] Maple (included)' ELSE '- Black (+$25)' END,
    concat('- [x] Tone ', CAST(p_size AS STRING), ' (+$', CAST(p_size * 9000 AS STRING), ')'),
    CASE WHEN p_partkey % 24 = 8 THEN '' ELSE 'Wood Type:' END,
    '- [x] Maple trim', '- [x] maple trim (+$5)') END AS markdown
FROM part
"""

FORM_PAGES_SQL = """
SELECT p_partkey AS page_id, concat(
  '<form><label class="o"><input type="radio" name="a" value="', p_name, ' - $', CAST(p_size AS STRING), '"><img alt="unused (+$1)"></label>',
  '<label><input name="b" type="checkbox" value="x"><img src="i.png" alt="', p_brand, ' trim (+$', CAST(p_size * 100 AS STRING), ')"></label>',
  '<label><input type="radio" value=""><span class="frm_text_label_for_image_inner">', p_type, ' kit (-$', CAST(p_size AS STRING), '.50)</span></label>',
  '<label><input type="text" value="skip - $5"></label>',
  '<input type="checkbox" value="Loose &amp; free - $0"></form>') AS html
FROM part
"""

VISITS_SQL = """
SELECT event_id, user_id AS session_id,
  concat('site', CAST(user_id % 5 AS STRING), '.example.com') AS site_domain,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state,
  event_type AS to_state,
  CASE WHEN event_id % 3 = 0 THEN 'select' ELSE 'click' END AS action_type,
  event_type <> 'error' AS success, ts
FROM events
"""

# Page visits as a browser session sees them: the url and a content mark.
PAGE_VISITS_SQL = """
SELECT event_id, user_id AS session_id, concat('/', event_type) AS url,
  CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS content, ts
FROM events
"""

PIXELS_SQL = """
SELECT vec_id, label AS image_id,
  CAST(least(255, greatest(0, floor((CAST({e1} AS DOUBLE) + 0.5) * 255))) AS INT) AS r,
  CAST(least(255, greatest(0, floor((CAST({e2} AS DOUBLE) + 0.5) * 255))) AS INT) AS g,
  CAST(least(255, greatest(0, floor((CAST({e3} AS DOUBLE) + 0.5) * 255))) AS INT) AS b
FROM embeddings
"""
PIXELS_SPARK_SQL = PIXELS_SQL.format(
    e1="element_at(embedding, 1)", e2="element_at(embedding, 2)", e3="element_at(embedding, 3)"
)
PIXELS_CHECK_SQL = PIXELS_SQL.format(e1="embedding[1]", e2="embedding[2]", e3="embedding[3]")

DECISIONS_SQL = """
SELECT page_id, url, CAST(floor(page_id / 30) AS BIGINT) AS batch_no, page_id % 30 + 1 AS url_number,
  CASE page_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS relevance,
  page_id % 7 = 0 AS has_configurator,
  CASE page_id % 4 WHEN 0 THEN 'PRODUCT' WHEN 1 THEN 'SERVICE' WHEN 2 THEN 'PROJECT' ELSE 'LISTING' END AS category,
  CAST(page_id % 10 AS DOUBLE) / 10 AS confidence
FROM pages
"""

CATALOG_SQL = """
SELECT p_partkey AS seq, p_name AS product_name,
  concat('https://shop', CAST(p_partkey % 3 AS STRING), '.example.com/', replace(lower(p_brand), '#', '-')) AS url,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_retailprice AS STRING) END AS base_price,
  CASE WHEN p_partkey % 3 = 0 THEN 'external' WHEN p_partkey % 3 = 1 THEN 'embedded' ELSE 'none' END AS configurator_type,
  p_partkey % 3 <> 2 AS has_configurator,
  CASE p_partkey % 3 WHEN 0 THEN 'lam' WHEN 1 THEN 'static' ELSE 'ai' END AS route
FROM part
"""

# Catalog rows as a crawl leaves them: some questions, menu words and blanks among the names.
RAW_CATALOG_SQL = f"""
SELECT seq, CASE WHEN seq % 17 = 0 THEN concat('What is a ', product_name, '?')
  WHEN seq % 19 = 0 THEN 'Contact us' WHEN seq % 23 = 0 THEN ' ' WHEN seq % 29 = 0 THEN 'FAQ'
  WHEN seq % 31 = 0 THEN upper(product_name) WHEN seq % 41 = 0 THEN concat('Can Crusher ', product_name)
  WHEN seq % 43 = 0 THEN concat('Do It Yourself ', product_name) WHEN seq % 47 = 0 THEN concat('Is this it? ', product_name)
  ELSE product_name END AS product_name,
  CASE WHEN seq % 37 = 0 THEN concat(url, '/contact') WHEN seq % 53 = 0 THEN concat(url, '/about-saunas/oak')
  WHEN seq % 59 = 0 THEN concat(url, '/FAQ.html#top') ELSE url END AS url,
  base_price, configurator_type, has_configurator, route
FROM ({CATALOG_SQL}) AS plain_catalog
"""

JOBS_SQL = """
SELECT o_orderkey AS job_id,
  CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'pending' END AS status,
  o_orderdate AS created_at
FROM orders
"""

STATES_SQL = """
SELECT concat('site', CAST(user_id % 5 AS STRING), '.example.com') AS site_domain,
  concat(event_type, '-', CAST(user_id % 50 AS STRING)) AS page_signature,
  concat('/', event_type) AS url_path, CAST(event_id % 7 AS INT) AS step_index,
  event_type = 'purchase' AS is_terminal, ts AS created_at, event_id
FROM events
"""

ELEMENTS_SQL = """
SELECT user_id AS page_id, event_id AS pos,
  CASE event_type WHEN 'view' THEN 'img' WHEN 'click' THEN 'button' WHEN 'error' THEN 'div' ELSE 'a' END AS tag,
  concat('card card-', event_type, '-with-a-long-class-name-', CAST(event_id % 3 AS STRING)) AS classes,
  concat(CASE WHEN event_id % 2 = 0 THEN 'Dark ' ELSE '' END, 'Option ', CAST(event_id % 40 AS STRING), ' in ', event_type) AS text,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('https://cdn.example.com/e', CAST(event_id AS STRING), '.png') END AS image,
  CAST(event_id % 900 AS INT) AS y
FROM events
"""

GUIDED_OPTIONS_SQL = """
SELECT user_id AS page_id, event_id AS pos,
  CASE WHEN event_id % 4 = 0 THEN 'Choose Model' WHEN event_id % 4 = 1 THEN NULL ELSE 'Colour' END AS category,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('option ', CAST(event_id % 40 AS STRING)) END AS component,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('+$', CAST(event_id % 100 AS STRING)) END AS price,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('ref-', CAST(event_id AS STRING)) END AS reference
FROM events
"""

EXPLORED_SQL = """
SELECT DISTINCT user_id AS page_id, concat('option ', CAST(event_id % 40 AS STRING)) AS model
FROM events WHERE event_type = 'purchase'
"""

CONTINUE_LOG_SQL = """
SELECT concat('site', CAST(user_id % 5 AS STRING), '.example.com') AS site_domain,
  concat('{"text": "', event_type, '", "step": ', CAST(event_id % 9 AS STRING), '}') AS pattern,
  event_id % 10 <> user_id % 9 AS success
FROM events
"""


#: Derived pages of one task: some 50 MB of text.
PAGES_PER_TASK = 20_000


class Inputs:
    """The tables of one data folder, given or derived."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame, *keys: str) -> DataFrame:
        """Spread a small one-file table over the cores; large scans stay as they are."""
        cores = self.spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(cores, *keys)

    def part_pages(self, sql: str, body: str) -> DataFrame:
        """Pages derived from `part`, with a bounded number of pages in each task.

        A row of `part` is a few bytes in its file and a page is thousands, so
        the rows are spread before the text is put together. The text comes
        out of a generator: the optimizer does not repeat it in every
        expression that reads it, and it is not shuffled.
        """
        parts = self.table("part")
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-parts.count() // PAGES_PER_TASK))
        pages = self.derive(sql, "part", part=parts.repartition(tasks, "p_partkey"))
        return pages.select(*[c for c in pages.columns if c != body], F.explode_outer(F.array(body)).alias(body))

    def derive(self, sql: str, source: str, **tables: DataFrame) -> DataFrame:
        frames = tables or {source: self.table(source)}
        plain = sql.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(plain.replace(f"FROM {source}", f"FROM {{{source}}}"), **frames)

    def pages(self) -> DataFrame:
        return self.spread(self.table("pages"))

    def product_pages(self) -> DataFrame:
        return self.part_pages(PRODUCT_PAGES_SQL, "markdown")

    def detail_pages(self) -> DataFrame:
        return self.part_pages(DETAIL_PAGES_SQL, "markdown")

    def config_pages(self) -> DataFrame:
        return self.part_pages(CONFIG_PAGES_SQL, "markdown")

    def form_pages(self) -> DataFrame:
        return self.part_pages(FORM_PAGES_SQL, "html")

    def visits(self) -> DataFrame:
        return self.derive(VISITS_SQL, "events")

    def page_visits(self) -> DataFrame:
        return self.derive(PAGE_VISITS_SQL, "events")

    def pixels(self) -> DataFrame:
        return self.derive(PIXELS_SPARK_SQL, "embeddings")

    def decisions(self) -> DataFrame:
        return self.derive(DECISIONS_SQL, "pages")

    def catalog(self) -> DataFrame:
        return self.derive(CATALOG_SQL, "part")

    def raw_catalog(self) -> DataFrame:
        return self.derive(RAW_CATALOG_SQL, "part")

    def jobs(self) -> DataFrame:
        return self.derive(JOBS_SQL, "orders")

    def states(self) -> DataFrame:
        return self.derive(STATES_SQL, "events")

    def elements(self) -> DataFrame:
        return self.derive(ELEMENTS_SQL, "events")

    def guided_options(self) -> DataFrame:
        return self.derive(GUIDED_OPTIONS_SQL, "events")

    def explored(self) -> DataFrame:
        return self.derive(EXPLORED_SQL, "events")

    def continue_log(self) -> DataFrame:
        return self.derive(CONTINUE_LOG_SQL, "events")
