"""Price facts, base prices, option modifiers, form options, price audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


from ..functions import money as M
from ..functions import urls as U
from ..functions.text import contains_any, extract_all, first_of_each, let, lines, null_if_empty, strip, strip_tags, unnest
from .ordering import numbered

CONTEXT = 100


def price_facts(pages: DataFrame) -> DataFrame:
    """Distinct price values of each page, smallest first.

    When several patterns find one value, the earliest pattern decides its
    currency. All of it happens inside the page row.
    """
    facts = F.sort_array(first_of_each(M.all_prices(F.col("markdown")), lambda f: f["value"]))
    return unnest(pages, ["page_id", "url"], facts, "rank", "fact").select(
        "page_id",
        "url",
        "rank",
        "fact.value",
        "fact.currency",
        F.col("fact.max_price").isNotNull().alias("is_range"),
        F.when(F.col("fact.max_price").isNotNull(), F.col("fact.value")).alias("min_price"),
        "fact.max_price",
        "fact.raw",
    )


def title_line(text: Column) -> Column:
    """First usable heading of a page, NULL when it has none."""
    heads = F.filter(
        F.transform(lines(text), lambda x: strip(x)), lambda x: x.startswith("# ") | x.startswith("## ")
    )
    titles = F.transform(heads, lambda x: strip(F.ltrim(x, F.lit("#"))))
    usable = F.filter(
        titles,
        lambda x: (F.length(x) > 3) & ~contains_any(F.lower(x), ["skip", "content"]),
    )
    return F.get(usable, 0)


def product_name(title: Column, url: Column) -> Column:
    """Title without its price, else the last path segment of the url."""
    return F.coalesce(M.strip_title_price(title), F.element_at(F.split(strip(U.path(url), "/"), "/"), -1))


def early_title_price(text: Column) -> Column:
    """First price in a heading among the first ten lines."""
    heads = F.filter(
        F.transform(F.slice(lines(text), 1, 10), lambda x: strip(x)),
        lambda x: x.startswith("# ") | x.startswith("## "),
    )
    found = F.transform(heads, lambda x: M.plain_price(strip(F.ltrim(x, F.lit("#")))))
    return F.get(F.array_compact(found), 0)


def base_price(pages: DataFrame) -> DataFrame:
    """Product name and base price: explicit label, first price, then title price."""
    md = F.col("markdown")
    titled = pages.select("page_id", "url", "markdown", title_line(md).alias("title"))
    return titled.select(
        "page_id",
        "url",
        product_name(F.col("title"), F.col("url")).alias("product_name"),
        M.plain_price(F.col("title")).alias("title_price"),
        F.coalesce(M.page_price(md), M.plain_price(F.col("title")), early_title_price(md)).alias("base_price"),
    )


def option_texts(pages: DataFrame) -> DataFrame:
    """Texts that may carry an option price: bullets and image alts, in line order."""
    line = F.col("line")
    bullet = F.regexp_extract(line, r"^[-*•]\s*(?:\[[x ]?\]\s*)?(.+)", 1)
    alt = F.regexp_extract(line, r"!\[(?:Image \d+:?\s*)?([^\]]+)\]", 1)
    found = unnest(pages, ["page_id"], lines(F.col("markdown")), item="raw").withColumn(
        "line", strip(F.col("raw"))
    )
    text = F.when(alt != "", alt).otherwise(bullet)
    return found.select("page_id", "pos", strip(text).alias("text")).filter("text <> ''")


def option_prices(texts: DataFrame, text: str = "text") -> DataFrame:
    """Name, modifier text and signed value of each option text."""
    both = M.name_and_price(F.col(text))
    parsed = texts.withColumn("both", both).withColumn(
        "price", F.coalesce(F.col("both.price"), M.option_price(F.col(text)))
    )
    return parsed.select(
        *texts.columns,
        F.coalesce(F.col("both.name"), strip_tags(F.col(text))).alias("name"),
        "price",
        M.modifier_value(F.col("price")).alias("value"),
    )


def option_price_summary(priced: DataFrame, key: str = "name") -> DataFrame:
    """Number, smallest, largest and mean modifier per key."""
    return (
        priced.filter(F.col("value").isNotNull())
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.avg("value").alias("avg_value"),
        )
    )


def _attribute(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"""(?i)\b{name}=["']([^"']*)["']""", 1)
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return raw


INPUT_OR_LABEL = r"(?is)<label[^>]*>.*?</label>|<input[^>]*>"
SPAN = r"""(?is)<span[^>]*class=["'][^"']*frm_text_label_for_image_inner[^"']*["'][^>]*>(.*?)</span>"""


def form_options(pages: DataFrame) -> DataFrame:
    """Priced options of radio buttons and checkboxes: value, image alt, label span."""
    parts = unnest(pages, ["page_id"], extract_all(F.col("html"), INPUT_OR_LABEL), "part_no", "part")
    tags = extract_all(F.col("part"), r"(?i)<input[^>]*>")
    inputs = unnest(parts, ["page_id", "part_no", "part"], tags, "n", "tag").filter(F.lower(_attribute(F.col("tag"), "type")).isin("radio", "checkbox"))
    part = F.col("part")
    alt = _attribute(F.regexp_extract(part, r"(?i)<img[^>]*>", 0), "alt")
    spans = F.transform(extract_all(part, SPAN, 1), M.name_and_price)
    found = F.coalesce(
        M.name_and_price(_attribute(F.col("tag"), "value")),
        M.name_and_price(alt),
        F.get(F.array_compact(spans), 0),
    )
    return (
        inputs.withColumn("found", found)
        .filter(F.col("found").isNotNull())
        .select("page_id", "part_no", "n", "found.name", "found.price", "found.value")
    )


def _located(number: int, start: Column):
    return lambda match: F.struct(M.parse_match(match, number).alias("fact"), start.alias("start"))


def price_context(pages: DataFrame, samples: int | None = None) -> DataFrame:
    """First price of a page with the text around it; `samples` pages per host if given.

    rank counts the pages of a host; a host with very many is numbered in ranges.
    """
    md = F.col("markdown")
    tries = [
        let(
            F.regexp_extract(md, pattern, 0),
            _located(number, F.regexp_instr(md, F.lit(pattern))),
        )
        for number, pattern in enumerate(M.PRICE_PATTERNS)
    ]
    first = F.get(F.filter(F.array(*tries), lambda x: x["fact"]["value"] > 0), 0)
    found = pages.select("page_id", U.host(F.col("url")).alias("host"), "markdown", first.alias("hit")).filter(
        F.col("hit").isNotNull()
    )
    begin = F.greatest(F.col("hit.start") - CONTEXT, F.lit(1))
    end = F.col("hit.start") + F.length("hit.fact.raw") + CONTEXT
    ranked = found.select(
        "page_id",
        "host",
        M.format_price(F.col("hit.fact.value"), F.col("hit.fact.currency")).alias("price"),
        F.col("hit.fact.raw").alias("raw_match"),
        strip(F.substring(md, begin, end - begin)).alias("context"),
    )
    if samples is None:
        return numbered(ranked, "page_id", keys=["host"], name="rank").withColumn("rank", F.col("rank") + 1)
    rank = F.row_number().over(W.partitionBy("host").orderBy("page_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= samples)


def price_audit(options: DataFrame, low: float = 0, high: float = 100_000) -> DataFrame:
    """Null out prices that are no number in [low, high], and mark them."""
    value = M.amount(F.col("price"))
    valid = F.coalesce(value.between(low, high), F.lit(False))
    has_price = null_if_empty(F.col("price")).isNotNull()
    return options.withColumn("invalid", has_price & ~valid).withColumn(
        "price", F.when(has_price & valid, F.col("price"))
    )


def audit_counts(audited: DataFrame) -> DataFrame:
    """Options and invalid prices per category."""
    return audited.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_options"), F.count_if("invalid").alias("n_invalid")
    )


