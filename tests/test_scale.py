"""Steps whose cost must not grow faster than their input: texts are read out once, tasks stay bounded."""

import pytest
from pyspark.sql import functions as F

from wareloom.functions import lexicons as lex
from wareloom.functions import money
from wareloom.operators import colors, configurators, crawl, options, urls
from wareloom.plans import QUERIES, inputs
from wareloom.sources import sheets

PARTS = [(k, f"red part {k}", "STEEL", f"Brand#{k % 5}", k % 50 + 1, 100.0 + k) for k in range(40)]
PAGE = "# Name\n[Customize it](/custom/1) [Start designing](https://app.zakeke.com/c/2)\n![Image 1: Red swatch](https://a.b/color_swatch.png)"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    columns = "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"
    spark.createDataFrame(PARTS, columns).write.parquet(f"{at}/part.parquet")
    vectors = [(i, [i % 7 / 14, i % 5 / 10, i % 3 / 6], i % 10) for i in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_derived_pages_are_bounded_per_task_and_not_shuffled(spark, folder, monkeypatch):
    monkeypatch.setattr(inputs, "PAGES_PER_TASK", 2)
    pages = inputs.Inputs(spark, folder).product_pages()
    assert pages.rdd.getNumPartitions() == len(PARTS) / 2
    plan = optimized(pages)
    assert plan.index("Generate explode") < plan.index("Wood Type") < plan.index("RepartitionByExpression")
    assert pages.filter("markdown like '%Walnut%'").count() == len(PARTS)


@pytest.mark.parametrize("name, literal", [
    ("split_products", options.CATEGORY_HEADER), ("colors_by_image", "Polished steel frame"),
    ("customizations", options.CATEGORY_HEADER), ("build_catalog", options.CATEGORY_HEADER),
])
def test_facts_with_several_readers_are_staged(spark, folder, name, literal):
    assert literal not in optimized(QUERIES[name](spark, folder))


def test_platform_report_scores_links_once(spark):
    pages = spark.createDataFrame([(1, "https://s.example.com/p", PAGE), (2, "https://s.example.com/q", "none")], "page_id long, url string, markdown string")
    report = configurators.platform_report(pages)
    assert optimized(report).count("regexp_extract_all") == 1
    assert [(r.platform, r.n_pages) for r in report.collect()] == [("generic_external", 1)]


def test_swatch_words_are_counted_once(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, markdown string")
    found = colors.swatch_candidates(pages)
    assert optimized(found).count(f", {lex.SWATCH_WORDS[-1]})") == 1
    assert [r.image for r in found.collect()] == ["https://a.b/color_swatch.png"]


def test_pieces_that_fit_no_short_text_are_not_shuffled(spark):
    short = spark.createDataFrame([("g", "oak"), ("g", "red oak"), ("h", "oak")], "page_id string, s string")
    long = spark.createDataFrame([("g", "a dark red oak table"), ("h", "walnut"), ("h", None), ("k", "oak")], "page_id string, l string")
    pairs = options.contained_in(short, long, "page_id", "s", "l")
    assert "array_contains(marks" in optimized(pairs)
    assert sorted((r.page_id, r.s, r.l) for r in pairs.collect()) == [
        ("g", "oak", "a dark red oak table"), ("g", "red oak", "a dark red oak table"),
    ]


def test_sheet_rows_are_worked_out_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    rows = spark.range(0, 200, 1, 8).select(
        F.col("id").alias("seq"), F.lit(0).alias("pos"), counted(F.col("id").cast("string")).alias("category"),
        F.lit("c").alias("component"), F.lit("").alias("reference"),
    )
    sheets.write_sheet(rows, str(tmp_path / "sheet"), sheets.COMPONENT_HEADINGS)
    assert calls.value == 200
    back = sheets.read_sheet(spark, str(tmp_path / "sheet"), sheets.COMPONENT_HEADINGS).orderBy("row_no").collect()
    assert [r.category for r in back] == [str(i) for i in range(200)]


def test_nested_parts_are_not_broadcast(spark, folder):
    assert "Broadcast" not in physical(QUERIES["priced_rows"](spark, folder))


def test_customization_source_joins_by_shuffles(spark, folder):
    assert "Broadcast" not in physical(QUERIES["customization_source"](spark, folder))
    columns = "page_id long, url string, configurator_url string, configurator_type string, should_scrape boolean"
    outside, inside = "https://app.zakeke.com/c/7", "https://s.example.com/build"
    decided = spark.createDataFrame([
        (1, "https://s.example.com/1", outside, "external", True), (2, "https://s.example.com/2", inside, "embedded", True),
        (3, "https://s.example.com/3", None, "embedded", True), (None, None, None, "embedded", True), (None, None, None, "none", False),
        (4, "https://s.example.com/4", "https://x.example.com/none", "external", True),
    ], columns)
    pages = spark.createDataFrame([(7, outside), (8, outside), (9, inside), (10, None), (None, "https://x.example.com/n")], "page_id long, url string")
    own, other = (spark.createDataFrame(ids, "page_id long") for ids in ([(7,), (7,), (None,)], [(9,), (10,)]))
    rows = configurators.customization_source(decided, pages, own, other).collect()
    got = [(r.page_id, r.customization_source, r.options_page_id, r.own_kind) for r in rows]
    assert sorted(got, key=str) == sorted([
        (1, "external_configurator", 7, True), (2, "embedded_configurator_page", 9, False), (3, "product_page", 3, False),
        (None, "product_page", None, False), (None, "none", None, False), (4, "product_page_fallback", 4, False),
    ], key=str)


def test_color_cells_work_rows_out_once_and_shuffle_the_starts(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    # products 2, 5 and 9 have 3, 1 and 4 rows; rows of no product come first
    shown = [(9, 0, None), (9, 1, "#0000FF"), (9, 2, "#abc"), (9, 3, "ff0000"), (2, 0, None), (2, 1, None), (2, 2, "#00FF00"), (5, 0, ""), (None, 0, "#00FF00")]
    rows = spark.createDataFrame(shown, "seq long, pos int, hex string").select("seq", "pos", counted("hex").alias("hex_color"), F.lit("x").alias("category"))
    cells = sheets.color_cells(rows)
    assert "SortMergeJoin [seq" in physical(cells)
    got = sorted((r.seq, r.row_index, r.hex_color, r.red, r.green, r.blue) for r in cells.collect())
    assert got == [(2, 4, "#00FF00", 0.0, 1.0, 0.0), (9, 7, "#0000FF", 0.0, 0.0, 1.0), (9, 9, "ff0000", 1.0, 0.0, 0.0)]
    assert calls.value == len(shown)


def test_crawl_log_reads_links_once(spark):
    pages = spark.createDataFrame([(1, "https://s.example.com/p", PAGE)], "page_id long, url string, markdown string")
    classified = spark.createDataFrame([(1, True)], "page_id long, is_product boolean")
    log = crawl.crawl_log(pages, urls.link_edges(pages), classified)
    assert "regexp_extract_all" not in optimized(log)
    assert {r.status for r in log.collect()} == {"discovered", "crawled", "product", "failed"}


def test_texts_without_a_price_are_not_cast(spark):
    values = spark.createDataFrame([("",), ("$1,250.50",), (",",), (None,)], "t string").select(money.amount(F.col("t")).alias("v"))
    assert [r.v for r in values.collect()] == [None, 1250.5, None, None]
    assert "CASE WHEN NOT (t" in optimized(values)
