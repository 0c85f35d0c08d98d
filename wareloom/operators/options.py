"""Option categories and options of product and configurator pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import money as M
from ..functions.frames import union_rows
from ..functions.text import (
    blocks,
    contains_any,

    let,
    lines,
    null_if_empty,
    strip,
    strip_tags,
    unnest,
)

CATEGORY_HEADER = r"[A-Z][^:\n]+?:[^\S\n]*\*?"
FEW_OPTIONS = 3
END = 1_000_000_000
MARKS = 1024


# ------------------------------------------------------------------ product pages
def _image_option(line: Column) -> Column:
    """struct(label, price, image) of an image line, NULL when it is none."""

    def read(match: Column) -> Column:
        alt = strip(F.regexp_extract(match, lex.OPTION_IMAGE, 1))
        image = strip(F.regexp_extract(match, lex.OPTION_IMAGE, 2))
        # The price is read from the whole alt text: the label group leaves it out.
        price = M.option_price(F.regexp_extract(match, r"!\[([^\]]*)\]", 1))
        label = strip(F.regexp_replace(alt, lex.PRICE_SUFFIXES[0], ""))
        row = F.struct(label.alias("label"), price.alias("price"), image.alias("image"))
        usable = (match != "") & ~contains_any(image, lex.TRACKING_IMAGE_PARTS)
        return F.when(usable & (F.length(label) > 2), row)

    return let(F.regexp_extract(line, lex.OPTION_IMAGE, 0), read)


def _checkbox_option(line: Column) -> Column:
    def read(text: Column) -> Column:
        label = text
        for suffix in lex.PRICE_SUFFIXES:
            label = strip(F.regexp_replace(label, suffix, ""))
        row = F.struct(
            label.alias("label"), M.option_price(text).alias("price"), F.lit(None).cast("string").alias("image")
        )
        return F.when(F.length(label) > 2, row)

    return let(strip(F.regexp_extract(line, lex.OPTION_CHECKBOX, 1)), read)


def _options_of(block: Column) -> Column:
    """Options of one block, with line number and the line itself."""
    rows = F.transform(
        F.slice(lines(block), 2, END),
        lambda raw, i: let(
            strip(raw),
            lambda line: F.struct(
                i.alias("pos"),
                line.alias("line"),
                F.coalesce(_image_option(line), _checkbox_option(line)).alias("option"),
            ),
        ),
    )
    return F.filter(rows, lambda r: r["option"].isNotNull())


def _keep_last(cats: Column) -> Column:
    """Of blocks with one name keep the last, at the place of the first."""

    def pick(all_blocks: Column) -> Column:
        names = F.transform(all_blocks, lambda b: b["category"])
        placed = F.transform(
            all_blocks,
            lambda b, i: F.struct(
                b["category"].alias("category"),
                (F.array_position(names, b["category"]) - 1).cast("int").alias("category_pos"),
                (F.array_position(F.reverse(names), b["category"]) == F.size(names) - i).alias("is_last"),
                b["options"].alias("options"),
            ),
        )
        return F.filter(placed, lambda b: b["is_last"])

    return let(cats, pick)


def option_blocks(text: Column) -> Column:
    """array<struct(category, category_pos, is_last, options)> of a page."""
    cats = F.transform(
        F.slice(blocks(text, CATEGORY_HEADER), 2, END),
        lambda block: F.struct(
            strip(
                F.regexp_extract(strip(F.substring_index(block, "\n", 1)), lex.OPTION_CATEGORY_LINE, 1)
            ).alias("category"),
            _options_of(block).alias("options"),
        ),
    )
    return _keep_last(F.filter(cats, lambda c: F.size(c["options"]) > 0))


def option_lines(pages: DataFrame) -> DataFrame:
    """Option lines under their category: page_id, category, category_pos, pos, line, option.

    A category without options vanishes; of a repeated one the last block
    that has options counts.
    """
    cats = unnest(pages, ["page_id"], option_blocks(F.col("markdown"))).select("page_id", "item.*")
    rows = unnest(cats, ["page_id", "category", "category_pos"], F.col("options"), "n")
    return rows.select("page_id", "category", "category_pos", "item.*")


def option_rows(pages: DataFrame) -> DataFrame:
    """Options as rows: page_id, category, category_pos, pos, label, price, image."""
    return option_lines(pages).select("page_id", "category", "category_pos", "pos", "option.*")


def merge_options(options: DataFrame) -> DataFrame:
    """One row per category and label; later copies fill a missing image or price."""
    key = F.lower(strip(F.col("label")))

    def first_known(name: str) -> Column:
        known = null_if_empty(F.col(name)).isNotNull()
        return F.min_by(name, F.when(known, F.col("pos"))).alias(name)

    return (
        options.withColumn("label_key", key)
        .filter(F.length("label_key") >= 3)
        .groupBy("page_id", "category", "category_pos", "label_key")
        .agg(
            F.min("pos").alias("pos"),
            F.min_by("label", "pos").alias("label"),
            first_known("price"),
            first_known("image"),
        )
        .drop("label_key")
    )


# ------------------------------------------------------------------ configurator pages
def _look_ahead(alt: Column, image: Column, next_line: Column, after_next: Column) -> Column:
    """Label and price of an image line; the next two lines may improve them."""
    stand_alone = (
        (next_line != "")
        & ~next_line.rlike(r"^(?:!\[Image|#|\*\*|-|\*|\|)")
        & (F.length(next_line) < 200)
    )

    def read(x: Column) -> Column:
        from_next = F.when(stand_alone, x["next_both"])
        label = (
            F.when(x["own"].isNotNull(), x["own"]["name"])
            .when(from_next.isNotNull(), from_next["name"])
            .when(stand_alone, next_line)
            .otherwise(alt)
        )
        price = (
            F.when(x["own"].isNotNull(), x["own"]["price"])
            .when(from_next.isNotNull(), from_next["price"])
            .when(stand_alone, F.coalesce(M.option_price(after_next), x["next_price"]))
            .otherwise(x["next_price"])
        )
        row = F.struct(label.alias("label"), price.alias("price"), image.alias("image"))
        return F.when(F.length(label) < 200, row)

    parts = F.struct(
        M.name_and_price(alt).alias("own"),
        M.name_and_price(next_line).alias("next_both"),
        M.option_price(next_line).alias("next_price"),
    )
    return let(parts, read)


def _configurator_image(info: Column) -> Column:
    def read(match: Column) -> Column:
        alt = strip(F.regexp_extract(match, lex.CONFIGURATOR_IMAGE, 1))
        image = strip(F.regexp_extract(match, lex.CONFIGURATOR_IMAGE, 2))
        usable = (match != "") & ~F.contains(F.lower(image), F.lit("pixel")) & ~F.contains(image, F.lit("g.gif"))
        return F.when(usable, _look_ahead(alt, image, info["next_line"], info["after_next"]))

    return let(F.regexp_extract(info["line"], lex.CONFIGURATOR_IMAGE, 0), read)


def _plain_option(text: Column, both: Column) -> Column:
    return F.struct(
        F.coalesce(both["name"], strip_tags(text)).alias("label"),
        both["price"].alias("price"),
        F.lit(None).cast("string").alias("image"),
    )


def _bullet(line: Column) -> Column:
    def read(text: Column) -> Column:
        option = let(M.name_and_price(text), lambda both: _plain_option(text, both))
        usable = (text != "") & (F.length(text) <= 200)
        return F.when(usable, let(option, lambda o: F.when(F.length(o["label"]) > 2, o)))

    return let(strip(F.regexp_replace(line, r"^[-*•]\s*", "")), read)


def _line_infos(text: Column) -> Column:
    """Each line with its two successors and the category it could open."""

    def flag(line: Column) -> Column:
        noise = contains_any(F.lower(line), lex.PAGE_NOISE_WORDS)
        marked = line.startswith("##") | (line.startswith("**") & line.endswith("**"))
        return F.struct(
            line.alias("line"),
            ((line != "") & ~noise).alias("kept"),
            marked.alias("marked"),
            F.substring_index(line, ":", 1).alias("before"),
        )

    def heading(line: Column) -> Column:
        title = strip(
            F.when(line.startswith("###"), F.replace(line, F.lit("###"), F.lit("")))
            .when(line.startswith("##"), F.replace(line, F.lit("##"), F.lit("")))
            .otherwise(F.replace(line, F.lit("**"), F.lit("")))
        )
        return let(title, lambda t: F.when((t != "") & (F.length(t) < 100), t))

    def colon_name(x: Column) -> Column:
        usable = (
            F.contains(x["line"], F.lit(":"))
            & (F.length(x["before"]) < 50)
            & ~contains_any(x["before"], lex.COLON_BAD_PARTS)
            & ~contains_any(F.lower(x["before"]), lex.COLON_NOISE_WORDS)
        )
        return F.when(usable, null_if_empty(strip(x["before"])))

    def describe(flagged: Column) -> Column:
        return F.transform(
            flagged,
            lambda x, i: F.struct(
                i.alias("pos"),
                x["line"].alias("line"),
                F.coalesce(F.get(flagged, i + 1)["line"], F.lit("")).alias("next_line"),
                F.coalesce(F.get(flagged, i + 2)["line"], F.lit("")).alias("after_next"),
                x["kept"].alias("kept"),
                (x["kept"] & x["marked"]).alias("marked"),
                F.when(x["kept"] & x["marked"], heading(x["line"])).alias("heading"),
                F.when(x["kept"] & ~x["marked"], colon_name(x)).alias("name"),
                x["line"].startswith("![Image").alias("is_image"),
                x["line"].rlike(r"^[-*•]").alias("is_bullet"),
            ),
        )

    flagged = F.transform(lines(text), lambda raw: let(strip(raw), flag))
    return let(flagged, describe)


def _opened(infos: Column) -> Column:
    """Lines that open a category.

    Bullets and images count as options once a category is open; before
    the first one they may open a category by their colon.
    """
    openers = F.filter(infos, lambda x: x["heading"].isNotNull() | x["name"].isNotNull())

    def pick(candidates: Column) -> Column:
        first = F.get(candidates, 0)["pos"]
        kept = F.filter(
            candidates,
            lambda x: x["heading"].isNotNull() | (x["pos"] == first) | ~(x["is_image"] | x["is_bullet"]),
        )
        return F.transform(
            kept, lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(x["heading"], x["name"]).alias("category"),
                                     x["heading"].isNull().alias("by_colon"))
        )

    return let(openers, pick)


def _same_line_option(line: Column) -> Column:
    text = strip(F.substr(line, F.length(F.substring_index(line, ":", 1)) + 2))
    return let(
        text,
        lambda t: F.when(
            (t != "") & (F.length(t) < 200), let(M.name_and_price(t), lambda both: _plain_option(t, both))
        ),
    )


def configurator_blocks(text: Column) -> Column:
    """array<struct(category, category_pos, is_last, options)> of a configurator page."""

    def options_in(infos: Column, opener: Column, until: Column) -> Column:
        span = F.slice(infos, opener["pos"] + 1, until - opener["pos"])
        rows = F.transform(
            span,
            lambda x: F.struct(
                (x["pos"] - opener["pos"]).alias("pos"),
                x["line"].alias("line"),
                F.when(
                    x["pos"] == opener["pos"], F.when(opener["by_colon"], _same_line_option(x["line"]))
                )
                .when(~x["kept"] | x["marked"], F.lit(None))
                .when(x["is_image"], _configurator_image(x))
                .when(x["is_bullet"], _bullet(x["line"]))
                .alias("option"),
            ),
        )
        return F.filter(rows, lambda r: r["option"].isNotNull())

    def build(infos: Column) -> Column:
        def cut(openers: Column) -> Column:
            return F.transform(
                openers,
                lambda o, k: F.struct(
                    o["category"].alias("category"),
                    options_in(infos, o, F.coalesce(F.get(openers, k + 1)["pos"], F.size(infos))).alias("options"),
                ),
            )

        return let(_opened(infos), cut)

    last = _keep_last(let(_line_infos(text), build))
    return F.filter(last, lambda b: F.size(b["options"]) > 0)


def configurator_options(pages: DataFrame) -> DataFrame:
    """Options of configurator pages, flagged when a page has fewer than three."""
    cats = pages.select("page_id", configurator_blocks(F.col("markdown")).alias("cats"))
    n = F.aggregate("cats", F.lit(0), lambda acc, c: acc + F.size(c["options"]))
    flagged = cats.withColumn("few_options", n < FEW_OPTIONS)
    rows = unnest(flagged, ["page_id", "few_options"], F.col("cats")).select("page_id", "few_options", "item.*")
    keys = ["page_id", "few_options", "category", "category_pos"]
    return unnest(rows, keys, F.col("options"), "n").select(*keys, "item.pos", "item.option.*")


def image_option_lookahead(pages: DataFrame) -> DataFrame:
    """Label and price of every image line, helped by the next two lines."""

    def with_next(trimmed: Column) -> Column:
        placed = F.transform(
            trimmed,
            lambda line, i: F.struct(
                i.alias("pos"),
                line.alias("line"),
                F.coalesce(F.get(trimmed, i + 1), F.lit("")).alias("next_line"),
                F.coalesce(F.get(trimmed, i + 2), F.lit("")).alias("after_next"),
            ),
        )
        return F.filter(placed, lambda x: x["line"].startswith("![Image"))

    images = let(F.transform(lines(F.col("markdown")), lambda x: strip(x)), with_next)
    rows = F.transform(images, lambda x: F.struct(x["pos"].alias("pos"), _configurator_image(x).alias("option")))
    found = F.filter(rows, lambda r: r["option"].isNotNull())
    return unnest(pages, ["page_id"], found, "n").select("page_id", "item.pos", "item.option.*")


# ------------------------------------------------------------------ collected options
def nest_options(flat: DataFrame) -> DataFrame:
    """One map per page: category -> options in order.

    The long form is the working form; this is the shape of the nested
    export, where one row is one product.
    """
    option = F.struct(
        "pos",
        F.coalesce("component", F.lit("Unknown")).alias("label"),
        F.col("price"),
        F.col("reference").alias("image"),
    )
    by_category = flat.groupBy("page_id", F.coalesce("category", F.lit("Options")).alias("category")).agg(
        F.sort_array(F.collect_list(option)).alias("options")
    )
    return by_category.groupBy("page_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "options")))).alias("customizations"),
        F.count(F.lit(1)).alias("n_categories"),
        F.sum(F.size("options")).alias("n_options"),
    )


def contained_in(short: DataFrame, long: DataFrame, group: str, short_text: str, long_text: str) -> DataFrame:
    """Pairs of texts in one group where `short_text` occurs in `long_text`.

    Not a product of the two sides: the long texts are cut at every place
    into pieces of the lengths that the group's short texts have, and the
    pieces meet whole short texts in an equi join. Every joined row is a match.
    A piece whose mark no short text of the group has is dropped before it is
    shuffled; a group has at most MARKS of them, however many texts it has.
    """

    def mark(text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(MARKS)).cast("int")

    lengths = short.groupBy(group).agg(
        F.collect_set(F.length(short_text)).alias("lengths"), F.collect_set(mark(F.col(short_text))).alias("marks")
    )
    pieces = F.flatten(
        F.transform(
            F.filter("lengths", lambda n: (n > 0) & (n <= F.length(long_text))),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length(long_text) - n + 1), lambda s: F.substring(F.col(long_text), s, n)
            ),
        )
    )
    marked = F.filter(pieces, lambda piece: F.array_contains("marks", mark(piece)))
    cut = long.join(lengths, group).withColumn("piece", F.explode_outer(F.array_distinct(marked)))
    cut = cut.filter(F.col("piece").isNotNull()).drop("lengths", "marks")
    return short.withColumn("piece", F.col(short_text)).join(cut, [group, "piece"]).drop("piece")


def match_option_images(options: DataFrame, elements: DataFrame) -> DataFrame:
    """Image of the page element that fits an option best.

    Texts match when one contains the other; the score is
    length(option) / (length(element) + 1), the first element wins a tie.
    """
    text = F.lower("component")
    wanted = options.select("page_id", text.alias("option_text")).filter("option_text <> ''").distinct()
    shown = (
        elements.filter(F.col("image") != "")
        .select("page_id", F.lower("text").alias("element_text"), "pos", "image")
        .filter("element_text <> ''")
        .groupBy("page_id", "element_text")
        .agg(F.min("pos").alias("element_pos"), F.min_by("image", "pos").alias("image"))
    )
    in_element = contained_in(wanted, shown, "page_id", "option_text", "element_text")
    in_option = contained_in(shown, wanted, "page_id", "element_text", "option_text")
    columns = ["page_id", "option_text", "element_text", "element_pos", "image"]
    pairs = union_rows(in_element.select(*columns), in_option.select(*columns))
    score = F.length("option_text") / (F.length("element_text") + 1)
    best = pairs.groupBy("page_id", "option_text").agg(
        F.max_by("image", F.struct(score, -F.col("element_pos"))).alias("image")
    )
    return (
        options.withColumn("option_text", text)
        .join(best, ["page_id", "option_text"], "left")
        .drop("option_text")
        .withColumn("image", F.coalesce("image", F.lit("")))
    )


def remaining_models(options: DataFrame, explored: DataFrame) -> DataFrame:
    """Models a page offers for selection that were not explored yet."""
    offered = options.filter(contains_any(F.lower("category"), lex.MODEL_SELECTION_WORDS))
    models = offered.select("page_id", F.col("component").alias("model")).filter("model <> ''").distinct()
    return models.join(explored, ["page_id", "model"], "left_anti")


def options_by_model(options: DataFrame) -> DataFrame:
    """Options per product, model and category, and whether models need a header."""
    model = F.coalesce(null_if_empty(F.col("model")), F.lit("General"))
    grouped = options.groupBy("product", model.alias("model"), "category").agg(F.count(F.lit(1)).alias("n_options"))
    models = grouped.groupBy("product").agg(F.countDistinct("model").alias("n_models"))
    return grouped.join(models, "product").withColumn("has_header", F.col("n_models") > 1)


