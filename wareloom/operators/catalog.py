"""The catalog: build, split, filter, de-duplicate, merge, summarize."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.frames import union_rows
from ..functions.text import any_of, contains_any, null_if_empty, strip
from .ordering import numbered

OPTION_FIELDS = ["label", "price", "image", "reference", "hex_color", "model"]


def product_id(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")


def nest_specs(specs: DataFrame, name: str = "spec") -> DataFrame:
    """One specification map per page from (page_id, <name>, value) rows."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(name).alias("spec"), "value")))
    return specs.groupBy("page_id").agg(F.map_from_entries(pairs).alias("specifications"))


def nest_customizations(options: DataFrame) -> DataFrame:
    """Category order, category -> options map and option total of each page.

    One output row is one product, as the nested export wants it; the long
    option table stays the working form.
    """
    known = [F.col(f) if f in options.columns else F.lit(None).cast("string").alias(f) for f in OPTION_FIELDS]
    by_category = options.groupBy("page_id", "category", "category_pos").agg(
        F.sort_array(F.collect_list(F.struct("pos", *known))).alias("options")
    )
    nested = by_category.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("category_pos", "category", "options"))).alias("cats")
    )
    plain = lambda o: F.struct(*[o[f].alias(f) for f in OPTION_FIELDS])
    return nested.select(
        "page_id",
        F.transform("cats", lambda c: c["category"]).alias("customization_categories"),
        F.map_from_entries(
            F.transform("cats", lambda c: F.struct(c["category"], F.transform(c["options"], plain)))
        ).alias("customizations"),
        F.aggregate("cats", F.lit(0), lambda acc, c: acc + F.size(c["options"])).alias("total_customization_options"),
    )


def attach_nested(base: DataFrame, spec_maps: DataFrame, custom: DataFrame) -> DataFrame:
    """Left-join both nested parts; products without them get empty ones.

    Facts of derived pages look as small as the table that the pages come
    from, so the joins are told to shuffle: no nested part is broadcast.
    """
    fields = ",".join(f"{f}:string" for f in OPTION_FIELDS)
    empty = {
        "specifications": "map<string,string>",
        "customizations": f"map<string,array<struct<{fields}>>>",
    }
    joined = base.join(spec_maps.hint("merge"), "page_id", "left").join(custom.hint("merge"), "page_id", "left")
    return joined.withColumns(
        {
            **{c: F.coalesce(c, F.create_map().cast(kind)) for c, kind in empty.items()},
            "customization_categories": F.coalesce(
                "customization_categories", F.array().cast("array<string>")
            ),
            "total_customization_options": F.coalesce("total_customization_options", F.lit(0)),
        }
    )


def build_catalog(
    prices: DataFrame, specs: DataFrame, options: DataFrame, signals: DataFrame, sources: DataFrame
) -> DataFrame:
    """Join the facts of each page into nested product rows.

    All inputs are small facts keyed by page_id; page text is not carried.
    The last page wins per product id, found by a partial aggregate of ids
    before any fact is joined; `collisions` counts the pages that lost.
    """
    named = prices.withColumn("product_id", product_id(F.col("product_name")))
    winners = named.groupBy("product_id").agg(
        F.max("page_id").alias("page_id"), (F.count(F.lit(1)) - 1).alias("collisions")
    )
    base = named.join(winners, ["product_id", "page_id"])
    facts = signals.select(
        "page_id", "has_configurator", "configurator_type", "configurator_url",
        F.col("confidence").alias("configurator_confidence"),
        F.create_map(
            F.lit("links"), F.col("links"),
            F.lit("content_score"), F.col("content_score"),
            F.lit("form_elements"), F.col("form_elements"),
            F.lit("option_groups"), F.col("option_groups"),
            F.lit("price_variants"), F.col("price_variants"),
        ).alias("configurator_signals"),
    )
    where = sources.select("page_id", "customization_source", "external_platform")
    joined = base.join(facts, "page_id", "left").join(where, "page_id", "left")
    return attach_nested(joined, nest_specs(specs), nest_customizations(options)).select(
        "product_id",
        "page_id",
        "product_name",
        "url",
        "base_price",
        "specifications",
        "has_configurator",
        "configurator_type",
        "configurator_url",
        "configurator_confidence",
        "configurator_signals",
        "external_platform",
        "customization_source",
        "customization_categories",
        "customizations",
        "total_customization_options",
        "collisions",
    )


# ------------------------------------------------------------------ multi-product pages
def split_category(options: DataFrame) -> DataFrame:
    """The category of a page that lists products: by name, else > 5 items with > 5 images."""
    cats = options.groupBy("page_id", "category", "category_pos").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(null_if_empty(F.col("image")).isNotNull()).alias("n_images"),
    )
    kind = F.when(contains_any(F.lower("category"), lex.PRODUCT_CATEGORY_WORDS), 0).when(
        (F.col("n_items") > 5) & (F.col("n_images") > 5), 1
    )
    found = cats.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    return found.groupBy("page_id").agg(
        F.min_by("category", F.struct("kind", "category_pos")).alias("split_category")
    )


def split_products(catalog: DataFrame, options: DataFrame) -> DataFrame:
    """One row per product: each item of a product-listing category, or the page itself.

    The other categories of the page stay with every one of its products.
    """
    chosen = split_category(options)
    tagged = options.join(chosen, "page_id", "left").withColumn(
        "is_item", F.coalesce(F.col("category") == F.col("split_category"), F.lit(False))
    )
    rest = tagged.filter(~F.col("is_item")).groupBy("page_id").agg(
        F.countDistinct("category").alias("n_categories"), F.count(F.lit(1)).alias("n_options")
    )
    items = tagged.filter("is_item").groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "label", "price", "image"))).alias("items")
    )
    joined = catalog.select("page_id", "product_name", "url", "base_price").join(items, "page_id", "left").join(
        rest, "page_id", "left"
    )
    rows = joined.select("*", F.posexplode_outer("items").alias("n", "item"))
    split = F.col("item").isNotNull()
    return rows.select(
        "page_id",
        F.coalesce("item.label", "product_name").alias("product_name"),
        F.when(split, F.concat("url", F.lit("#product-"), (F.col("n") + 1).cast("string"))).otherwise(
            F.col("url")
        ).alias("url"),
        F.when(split, F.col("url")).alias("source_url"),
        F.coalesce(null_if_empty(F.col("item.price")), F.col("base_price")).alias("base_price"),
        F.col("item.image").alias("product_image"),
        F.coalesce("n_categories", F.lit(0)).alias("n_categories"),
        F.coalesce("n_options", F.lit(0)).alias("total_customization_options"),
        split.alias("extracted_from_multi_product_page"),
    )


# ------------------------------------------------------------------ clean-up
GENERIC_NAMES = ["untitled page", "unknown", "unknown product", "product", "home", "menu", "navigation", "contact us",
                 "about us", "read more", "learn more"]
NAVIGATION_SEGMENTS = ["contact", "contact-us", "contacts", "faq", "faqs", "about", "about-us"]
#: One whole segment of the path, with or without a file ending.
NAVIGATION_URL = "^([a-z][a-z0-9+.-]*:)?(//)?[^?#]*/(" + "|".join(NAVIGATION_SEGMENTS) + ")([.](html?|php|aspx?))?(/|[?#]|$)"


def invalid_reason(name: Column, url: Column) -> Column:
    """Why an entry is no product, '' when nothing speaks against it."""
    clean = F.lower(strip(F.coalesce(name, F.lit(""))))
    return (
        F.when(clean == "", "empty_name")
        .when(clean.endswith("?"), "question")
        .when(F.contains(clean, F.lit("faq")), "faq")
        .when(clean.isin(GENERIC_NAMES), "generic_name")
        .when(F.lower(url).rlike(NAVIGATION_URL), "navigation_page")
        .otherwise("")
    )


def tag_invalid(catalog: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Add keep and reason. A verdict (seq, keep) overrules; unjudged entries follow the rules."""
    tagged = catalog.withColumn("reason", invalid_reason(F.col("product_name"), F.col("url")))
    if verdicts is None:
        return tagged.withColumn("keep", F.col("reason") == "")
    judged = verdicts.select("seq", F.col("keep").alias("verdict"))
    return tagged.join(judged, "seq", "left").withColumn(
        "keep", F.coalesce("verdict", F.col("reason") == "")
    ).drop("verdict")


def filter_invalid(catalog: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    return tag_invalid(catalog, verdicts).filter("keep").drop("keep", "reason")


def signature(name: Column, url: Column) -> Column:
    clean = lambda c: strip(F.lower(F.coalesce(c, F.lit(""))))
    return F.concat(clean(name), F.lit("|"), clean(url))


def dedupe_catalog(catalog: DataFrame) -> DataFrame:
    """First entry per name and url.

    Only (signature, seq) takes part in the aggregate, and it folds on the
    map side, so a heavily repeated entry costs one row per task.
    """
    keyed = catalog.withColumn("_signature", signature(F.col("product_name"), F.col("url")))
    firsts = keyed.groupBy("_signature").agg(F.min("seq").alias("seq")).select("seq")
    return catalog.join(firsts, "seq", "left_semi")


def optimization_stats(raw: DataFrame, valid: DataFrame, deduped: DataFrame) -> DataFrame:
    """Input, removed and output counts, and retention in percent."""
    stages = [
        frame.select(F.lit(stage).alias("stage")) for stage, frame in (("raw", raw), ("valid", valid), ("out", deduped))
    ]
    counts = union_rows(*stages).agg(
        *[F.count_if(F.col("stage") == s).alias(s) for s in ("raw", "valid", "out")]
    )
    return counts.select(
        F.col("raw").alias("input_items"),
        (F.col("raw") - F.col("valid")).alias("invalid_items_removed"),
        (F.col("valid") - F.col("out")).alias("duplicates_removed"),
        F.col("out").alias("output_items"),
        F.when(F.col("raw") > 0, F.col("out") / F.col("raw") * 100).otherwise(0.0).alias("retention_rate"),
    )


# ------------------------------------------------------------------ merge and report
def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """All routes in one catalog; entries of a page with several get url#item-n.

    Entries are numbered per url in seq order, in ranges, so one url with
    very many entries is not handled by a single task. Entries without a url
    stay, without a key.
    """
    merged = union_rows(*catalogs, allow_missing=True)
    placed = numbered(merged, "seq", keys=["url"], name="item_no", of_key="n_items")
    key = F.when(
        F.col("n_items") > 1, F.concat("url", F.lit("#item-"), (F.col("item_no") + 1).cast("string"))
    ).otherwise(F.col("url"))
    return placed.withColumn("catalog_key", key).drop("item_no", "n_items")


def route_totals(merged: DataFrame) -> DataFrame:
    return merged.rollup("route").agg(F.count(F.lit(1)).alias("n_products"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    """Totals of a built catalog."""
    return catalog.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.count_if("has_configurator").alias("n_with_configurator"),
        F.count_if(F.col("configurator_type") == "embedded").alias("n_embedded"),
        F.count_if(F.col("configurator_type") == "external").alias("n_external"),
        F.coalesce(F.sum(F.size("customization_categories")), F.lit(0)).alias("n_categories"),
        F.coalesce(F.sum("total_customization_options"), F.lit(0)).alias("n_options"),
        F.coalesce(F.sum(F.size("specifications")), F.lit(0)).alias("n_specifications"),
    )


def type_summary(catalog: DataFrame) -> DataFrame:
    """Entries, those that are products and offerings by their page_type, and what they hold in total."""
    kind = F.upper("page_type")
    return catalog.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(kind == "PRODUCT").alias("n_products"),
        F.count_if(kind == "OFFERING").alias("n_offerings"),
        F.coalesce(F.sum(F.size("specifications")), F.lit(0)).alias("n_specifications"),
        F.coalesce(F.sum("total_customization_options"), F.lit(0)).alias("n_options"),
    )


def classification_summary(classified: DataFrame) -> DataFrame:
    """Mean confidence and score of the product pages, and counts by type."""
    products = F.col("is_product")

    def mean(c: str) -> Column:
        # Summed as decimals: the result does not depend on the order of the rows.
        exact = F.when(products, F.col(c).cast("decimal(18,6)"))
        return F.coalesce(F.sum(exact).cast("double") / F.nullif(F.count_if(products), F.lit(0)), F.lit(0.0))

    return classified.agg(
        F.count_if(products).alias("n_products"),
        F.count_if(~products).alias("n_others"),
        mean("confidence").alias("avg_confidence"),
        mean("score").alias("avg_score"),
    )


def route_cube(catalog: DataFrame) -> DataFrame:
    """Entries and entries with configurator, by route and type, with all subtotals."""
    return catalog.cube("route", "configurator_type").agg(
        F.count(F.lit(1)).alias("n_products"), F.count_if("has_configurator").alias("n_with_configurator")
    )


def catalog_keys(catalog: DataFrame, style: str = "name") -> DataFrame:
    """Unique sheet key of every entry: name_index, or product_index."""
    placed = numbered(catalog, "seq", name="index")
    prefix = F.coalesce("product_name", F.lit("product")) if style == "name" else F.lit("product")
    return placed.withColumn("sheet_key", F.concat(prefix, F.lit("_"), F.col("index").cast("string")))


def list_jobs(jobs: DataFrame, status: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest jobs first, of one status if given; the first `limit` if given."""
    wanted = jobs if status is None else jobs.filter(F.col("status") == status)
    newest = wanted.orderBy(F.desc("created_at"), "job_id")
    return newest if limit is None else newest.limit(limit)


def active_jobs(jobs: DataFrame, cap: int = 2) -> DataFrame:
    """Running jobs against the cap."""
    running = jobs.agg(F.count_if(F.col("status") == "running").alias("active_jobs"))
    return running.select("active_jobs", F.lit(cap).alias("max_active_jobs"),
                          (F.col("active_jobs") < cap).alias("can_start"))
