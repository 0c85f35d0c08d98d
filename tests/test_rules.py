"""Literal rows for the branches the generated tables do not reach."""

import pytest
from pyspark.sql import functions as F

from wareloom.functions import lexicons as lex
from wareloom.functions import money, urls
from wareloom.operators import catalog, classify, colors, configurators, options, prices, sites, specs
from wareloom.operators import urls as url_ops
from wareloom.sources import sheets


def one(spark, value, make):
    row = spark.createDataFrame([(value,)], "text string").select(make(F.col("text")).alias("out")).first()
    return row["out"]


@pytest.mark.parametrize(
    "text, price",
    [
        ("Premium (+$200)", "+$200"),
        ("Trim (-$1,850.5)", "-$1,850.50"),
        ("extra $30", "+$30"),
        ("- $40 off", "-$40"),
        ("No additional charge", "+$0"),
        ("freestanding bath (+$10)", "+$0"),
        ("(+$,)", None),
        ("plain", None),
        ("<b>Oak</b> (€15)", "+$15"),
    ],
)
def test_option_price(spark, text, price):
    assert one(spark, text, money.option_price) == price


@pytest.mark.parametrize(
    "text, found",
    [
        ("Custom Color Metal Cladding (+$1850)", ("Custom Color Metal Cladding", "+$1,850", 1850.0)),
        ("Slim (-$5)", ("Slim", "-$5", -5.0)),
        ("Oak - $0", ("Oak", "+$0", 0.0)),
        ("Oak - $12.5", ("Oak", "+$12.50", 12.5)),
        ("Oak", None),
    ],
)
def test_name_and_price(spark, text, found):
    row = one(spark, text, money.name_and_price)
    assert (tuple(row) if row else None) == found


@pytest.mark.parametrize(
    "text, price",
    [
        ("Base price: €1,200 each", "€1,200.00 EUR"),
        ("from $10 to $20", "$10.00 - $20.00 USD"),
        ("$5 - €6", "$5.00 USD"),
        ("cost: 12.50 EUR", "€12.50 EUR"),
        ("5 usd", "$5.00 USD"),
        ("$0 or $7", None),
        ("$, nothing", None),
        ("£99", "£99.00 GBP"),
    ],
)
def test_page_price(spark, text, price):
    assert one(spark, text, money.page_price) == price


def test_price_facts_keep_earliest_currency(spark):
    pages = spark.createDataFrame([(1, "u", "Price: 100 CAD and $100 and $50 and $0")], "page_id long, url string, markdown string")
    rows = [(r["value"], r["currency"]) for r in prices.price_facts(pages).orderBy("rank").collect()]
    assert rows == [(50.0, "USD"), (100.0, "CAD")]


@pytest.mark.parametrize(
    "base, link, full",
    [
        ("https://a.com/x/y", "/z", "https://a.com/z"),
        ("https://a.com/x/y", "z?q=1", "https://a.com/x/z?q=1"),
        ("https://a.com/x/y", "../z", "https://a.com/z"),
        ("https://a.com/x/y", "./z/", "https://a.com/x/z/"),
        ("https://a.com", "z", "https://a.com/z"),
        ("https://a.com/x", "//b.com/z", "https://b.com/z"),
        ("https://a.com/x", "tel:123", "tel:123"),
        ("https://a.com/x", "?p=2", "https://a.com/x?p=2"),
    ],
)
def test_absolute_link(spark, base, link, full):
    row = spark.createDataFrame([(base, link)], "base string, link string")
    assert row.select(urls.absolute(F.col("link"), F.col("base")).alias("x")).first()["x"] == full


def test_canonical_forms(spark):
    url = "https://WWW.Shop.com/A/b;v=1/?q=2#top"
    assert one(spark, url, urls.canonical) == "https://www.shop.com/A/b;v=1"
    assert one(spark, "https://s.com/a;v=1?q=2#t", urls.canonical) == "https://s.com/a"
    assert one(spark, "https://s.com/a/?q=2#t", urls.with_query) == "https://s.com/a?q=2"
    assert one(spark, "mailto:x", urls.with_query) is None


def pages_of(spark, *texts):
    rows = [(i, f"https://s.com/products/{i}", text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id long, url string, markdown string")


def test_short_page_is_other(spark):
    row = classify.classify_balanced(pages_of(spark, "")).first()
    assert (row["page_type"], row["confidence"]) == ("other", 0.0)
    assert classify.classify_rules(pages_of(spark, "x")).first()["page_type"] == "other"


def test_faq_header_drops_the_section_before_it(spark):
    text = "## Specifications\n- Weight: 5 lbs\n## FAQ\n- Size: ask\n## Dimensions\n- Width: 3 in\n## Features"
    rows = specs.spec_sections(pages_of(spark, text)).collect()
    assert [(r["title"], r["content"]) for r in rows] == [("Dimensions", "- Width: 3 in")]


def test_spec_patterns_are_unanchored(spark):
    found = {r["spec"]: r["value"] for r in specs.spec_pairs(pages_of(spark, "Bandwidth: 5 | x\nHorsepower: 9")).collect()}
    assert found == {"Width": "5", "Horsepower": "9", "Power": "9"}


def test_repeated_category_keeps_last_block(spark):
    text = "Wood:\n- [x] Oak\nSize:\n- [] Large\nWood:\n- [x] Pine\nWood:\nnothing"
    rows = options.option_rows(pages_of(spark, text)).collect()
    assert sorted((r["category"], r["category_pos"], r["label"]) for r in rows) == [("Size", 1, "Large"), ("Wood", 0, "Pine")]


def test_merge_fills_from_later_copies(spark):
    text = "Wood:\n- [x] Oak\n![Image 1: oak (+$5)](o.png)\n![Image 2: px](https://pixel.wp.com/g.gif)"
    row = options.merge_options(options.option_rows(pages_of(spark, text))).collect()
    assert [(r["label"], r["price"], r["image"]) for r in row] == [("Oak", "+$5", "o.png")]


def test_configurator_page_starts_at_its_first_category(spark):
    text = "- Loose\n- Size: Large (+$5)\n### Color\n- Red\n- Cookie policy\n### Color\n- Blue dark\nKind: none"
    rows = options.configurator_options(pages_of(spark, text)).collect()
    assert sorted((r["category"], r["label"], r["price"]) for r in rows) == [
        ("- Size", "Large", "+$5"), ("Color", "Blue dark", None), ("Kind", "none", None),
    ]


def test_blank_line_closes_an_option_group(spark):
    text = "## A\n- x\n\n- y\n**Bold**\n1. a\ntext\n2. b\nColor kind:\n- one\n- two"
    count = pages_of(spark, text).select(configurators.option_group_count(F.col("markdown")).alias("n")).first()["n"]
    assert count == 2


def test_external_page_without_own_options_falls_back(spark):
    page = pages_of(spark, "[Customize](https://app.zakeke.com/c/1) " + "x" * 10)
    decided = configurators.configurator_decision(configurators.configurator_signals(page))
    empty = page.select("page_id").limit(0)
    row = configurators.customization_source(decided, page, empty, empty).first()
    assert row["customization_source"] == "product_page_fallback"


def test_title_rules(spark):
    rows = url_ops.url_info(pages_of(spark, "text\n# Name #1", "[x](y)\nFirst line")).orderBy("page_id").collect()
    assert [(r["title"], r["short_title"]) for r in rows] == [
        ("Name #1", "Name #1"), ("Untitled Page", "First line"),
    ]


def test_sheet_text_without_specs(spark):
    pages = pages_of(spark, "nothing", "## Specifications\n- Weight: 5 lbs\n- Brand: B")
    found = specs.section_specs(specs.spec_sections(pages)).filter("key in ('Weight', 'Brand')")
    rows = specs.format_specs(pages, found).orderBy("page_id").collect()
    assert [r["sheet"] for r in rows] == ["No specifications available.", "Brand: B\nWeight: 5 lbs"]


def test_product_without_specs_has_no_spec_block(spark):
    base = spark.createDataFrame([(1, 1, "Desk", "u", None)], "page_id long, seq long, product_name string, url string, base_price string")
    empty_specs = spark.createDataFrame([], "page_id long, key string, value string")
    empty_options = spark.createDataFrame(
        [], "page_id long, category string, category_pos int, pos int, label string, price string, image string"
    )
    nested = catalog.attach_nested(
        base, catalog.nest_specs(empty_specs, "key"), catalog.nest_customizations(empty_options)
    )
    rows = sheets.priced_rows(nested).collect()
    assert [(r["category"], r["price"], r["reference"]) for r in rows] == [("Base Model(Desk)", "N/A", "u")]


def test_canonical_urls_follow_the_grammar(spark):
    from urllib.parse import urlparse, urlunparse

    from wareloom.functions import urls as U

    odd = [
        "/a", "/b/", "b", "shop.example.com/x", "//Shop.Example.com/x/", "HTTP://Shop.example.com/A/?q=1#f", "https://h", "https://h/", "",
        "mailto:me@example.com", "https://h:8080/p;x=1?y", "?q", "#f", "https://h/a;b/c;d", "https://h//",
    ]

    def plain(url):
        u = urlparse(url)
        return urlunparse((u.scheme.lower(), u.netloc.lower(), u.path.rstrip("/"), "", "", ""))

    got = spark.createDataFrame([(u,) for u in odd], "url string").select("url", U.canonical(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in got} == {u: plain(u) for u in odd}


def test_products_that_only_sound_like_questions_stay(spark):
    from wareloom.operators.catalog import invalid_reason

    cases = {
        ("Can Crusher", "https://h/can"): "",
        ("Do It Yourself Kit", "https://h/kit"): "",
        ("Is This Sauna for Two", "https://h/about-saunas/oak"): "",
        ("What is a sauna?", "https://h/x"): "question",
        ("Oak Desk", "https://h/about"): "navigation_page",
        ("Oak Desk", "https://h/About-us.html?x=1"): "navigation_page",
        ("Oak Desk", "https://h/contact/"): "navigation_page",
        ("Oak Desk", "https://h/faqtory"): "",
        ("Oak Desk", None): "",
        (None, "https://h/x"): "empty_name",
        ("Sauna FAQ", "https://h/x"): "faq",
    }
    rows = spark.createDataFrame(list(cases), "name string, url string")
    got = rows.select("name", "url", invalid_reason(F.col("name"), F.col("url")).alias("r")).collect()
    assert {(r.name, r.url): r.r for r in got} == cases


def test_contained_texts_join_only_true_matches(spark):
    from wareloom.operators.options import contained_in

    short = [(p, f"option {i}") for p in (1, 2) for i in range(30)] + [(1, ""), (1, "x")]
    long = [(p, k, f"see option {k} here, option 1") for p in (1, 2) for k in range(40)] + [(1, 99, "xx"), (1, 100, "")]
    got = contained_in(
        spark.createDataFrame(short, "page_id int, a string"), spark.createDataFrame(long, "page_id int, k int, b string"), "page_id", "a", "b"
    )
    want = sorted((p, a, k) for p, a in short for q, k, b in long if p == q and a and a in b)
    assert sorted((r.page_id, r.a, r.k) for r in got.collect()) == want


def test_no_break_blanks_are_trimmed(spark):
    from wareloom.functions import text as T

    rows = spark.createDataFrame([("\xa0 Oak\u2003\xa0Desk \u3000",), ("a b",), ("\x85",)], "t string")
    got = [(r.a, r.b) for r in rows.select(T.strip(F.col("t")).alias("a"), T.strip(T.squeeze(F.col("t"))).alias("b")).collect()]
    assert got == [("Oak\u2003\xa0Desk", "Oak Desk"), ("a b", "a b"), ("", "")]
    page = spark.createDataFrame([(1, "https://h/oak-desk", "# Oak Desk\xa0\n\nPrice: $120.00\n")], "page_id long, url string, markdown string")
    assert prices.base_price(page).first().product_name == "Oak Desk"


def test_navigation_is_read_whole(spark):
    links = "".join(f'<a href="/p/{i}">Place {i}</a>' for i in range(40))
    rows = [(1, "https://a.example/x", "<p>" + "x" * 6000 + "</p>" + links), (2, "https://a.example/y", f"<nav>{links}</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")

    def texts(**limits):
        got = sites.nav_links(pages, **limits).orderBy("page_id", "pos").collect()
        return [[r.text for r in got if r.page_id == k] for k in (1, 2)]

    every = [f"Place {i}" for i in range(40)]
    assert texts() == [every, every]
    assert texts(top=15, whole_page_chars=5000) == [[], every[:15]]


def test_lists_have_no_default_limit(spark):
    links = "".join(f'<a href="/part{i:02}/x">x</a>' for i in range(30))
    pages = spark.createDataFrame(
        [(i, f"https://a.example/{i}", links, "Base price: $1,100 CAD") for i in range(8)], "page_id long, url string, html string, markdown string"
    )
    assert url_ops.path_patterns(pages).count() == 30 and url_ops.path_patterns(pages, 20).count() == 20
    assert len(sites.site_signals(pages).first().url_patterns) == 30
    assert prices.price_context(pages).count() == 8 and prices.price_context(pages, 5).count() == 5
    items = "Choose: " + ", ".join(f"tone {i}" for i in range(14))
    near = spark.createDataFrame([(1, 1, 1, "i.png", items)], "page_id long, line_no int, place int, image string, context string")
    assert colors.nearby_options(near).count() == 14 and colors.nearby_options(near, 10).count() == 10
    words = " ".join(t for _, terms in [*lex.SITE_CATEGORY_TERMS, *lex.INDUSTRY_TERMS] for t in terms)
    every = spark.createDataFrame([("https://a.example/", words)], "url string, html string")
    assert sites.category_hints(every).count() == len([*lex.SITE_CATEGORY_TERMS, *lex.INDUSTRY_TERMS]) > 5


def test_damaged_catalogs_give_error_rows(spark):
    from wareloom.sources import catalog_json

    texts = {
        "list": '[{"product_name": "a"}, {"product_name": "b"}]',
        "wrapped": '{"products": [{"product_name": "c"}], "n": 1}',
        "keyed": '{"x": {"product_name": "d"}}',
        "cut": '{"x": {"product_name": "d"',
        "blank": "  ",
        "null": None,
        "word": '"text"',
        "number": "17",
        "no list": '{"products": 5}',
        "empty list": "[]",
        "one bad": '[{"product_name": "e"}, null]',
    }
    documents = spark.createDataFrame(list(texts.items()), "path string, value string")
    errors = {r.path: r.reason for r in catalog_json.catalog_errors(documents).collect()}
    assert errors == {
        "cut": "not json", "blank": "empty", "null": "empty", "word": "no catalog", "number": "no catalog",
        "no list": "no catalog", "one bad": "damaged product",
    }
    names = sorted(r.product_name for r in catalog_json.parse_catalogs(documents).collect() if r.product_name)
    assert names == list("abcde")


def test_sheets_come_back_as_they_were(spark):
    from wareloom.session import work_folder
    from wareloom.sources import sheets

    rows = [(1, 0, 'a "quoted" one', " blank ", ""), (0, 0, "comma, here", "two\nlines", None), (0, 1, "", "back\\slash", "x")]
    rows += [(k, 0, f"c{k}", "n", "r") for k in range(2, 300)]
    folder = work_folder(spark, "sheet")
    sheets.write_sheet(spark.createDataFrame(rows, "seq long, pos int, category string, component string, reference string").repartition(6), folder, sheets.COMPONENT_HEADINGS)
    got = [tuple(r) for r in sheets.read_sheet(spark, folder, sheets.COMPONENT_HEADINGS).orderBy("row_no").collect()]
    assert got == [(i, *r[2:]) for i, r in enumerate(sorted(rows, key=lambda r: r[:2]))]
