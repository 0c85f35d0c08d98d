"""Flat exports of a nested catalog: component sheets, colours, quotations.

A product is one row, so its sheet rows are built inside that row and
exploded; only the running row number looks across products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import let, null_if_empty
from ..operators.ordering import running_total
from ..session import staged

TRIPLE = ["category", "component", "reference"]
SIX = ["category", "component", "price", "image", "notes", "reference"]


def _row(fields: list[str], **values: Column) -> Column:
    blank = F.lit("")
    cells = [F.coalesce(values.get(f, blank).cast("string"), blank).alias(f) for f in fields]
    return F.struct(*cells, values.get("hex_color", F.lit(None).cast("string")).alias("hex_color"))


def _rows(condition: Column, rows: Column) -> Column:
    return F.when(condition, rows).otherwise(F.slice(rows, 1, 0))


def _name() -> Column:
    return F.coalesce(null_if_empty(F.col("product_name")), F.lit("Unknown Product"))


def _spec_rows(fields: list[str], **extra: Column) -> Column:
    blank = F.array(_row(fields))
    title = F.array(_row(fields, category=F.lit("Specifications")))
    specs = F.transform(
        F.sort_array(F.map_entries("specifications")),
        lambda e: _row(fields, component=F.concat(e["key"], F.lit(": "), e["value"]), **extra),
    )
    return _rows(F.size("specifications") > 0, F.concat(blank, title, specs, blank))


def _flat_options() -> Column:
    """Options with their category, in category order: array<struct(category, option, first)>."""
    category_order = F.col("customization_categories")
    return F.flatten(
        F.transform(
            category_order,
            lambda c: F.transform(
                F.coalesce(F.col("customizations")[c], F.array()),
                lambda o, i: F.struct(c.alias("category"), o.alias("option"), (i == 0).alias("first")),
            ),
        )
    )


def component_rows(catalog: DataFrame) -> DataFrame:
    """Three-column sheet rows: seq, pos, category, component, reference."""
    name = _name()
    base = F.array(
        _row(TRIPLE, category=F.concat(F.lit("Base Model("), name, F.lit(")")), component=name, reference=F.col("url"))
    )
    options = F.transform(
        _flat_options(),
        lambda x: _row(
            TRIPLE,
            category=F.when(x["first"], x["category"]),
            component=x["option"]["label"],
            reference=x["option"]["image"],
        ),
    )
    rows = catalog.select("seq", F.posexplode(F.concat(base, _spec_rows(TRIPLE), options)).alias("pos", "row"))
    return rows.select("seq", "pos", *[f"row.{f}" for f in TRIPLE])


def priced_rows(catalog: DataFrame, include_prices: bool = True) -> DataFrame:
    """Six-column (or four-column) sheet rows, options grouped by model.

    A model header stands before each model when a product has several.
    """
    name = _name()
    base = F.array(
        _row(
            SIX,
            category=F.concat(F.lit("Base Model("), name, F.lit(")")),
            component=name,
            price=F.coalesce(null_if_empty(F.col("base_price")), F.lit("N/A")),
            reference=F.col("url"),
        )
    )

    def grouped(flat: Column) -> Column:
        tagged = F.transform(
            flat,
            lambda x, i: F.struct(
                F.coalesce(x["option"]["model"], F.lit("General")).alias("model"), i.alias("place"), x.alias("item")
            ),
        )
        return F.sort_array(tagged)

    def write(items: Column) -> Column:
        several = F.size(F.array_distinct(F.transform(items, lambda x: x["model"]))) > 1

        def one(x: Column, i: Column) -> Column:
            before = F.get(items, i - 1)
            new_model = (i == 0) | (F.coalesce(before["model"], F.lit("")) != x["model"])
            new_category = new_model | (before["item"]["category"] != x["item"]["category"])
            category, option = x["item"]["category"], x["item"]["option"]
            row = _row(
                SIX,
                category=F.when(new_category, category),
                component=option["label"],
                price=option["price"],
                image=option["image"],
                notes=F.concat(F.lit("Category: "), category),
                hex_color=option["hex_color"],
            )
            header = _row(
                SIX,
                category=F.concat(F.lit("═══ "), x["model"], F.lit(" ═══")),
                notes=F.lit("Model Configuration"),
            )
            return F.concat(_rows(new_model & several, F.array(_row(SIX), header)), F.array(row))

        return F.flatten(F.transform(items, one))

    options = let(let(_flat_options(), grouped), write)
    rows = F.concat(base, _spec_rows(SIX, notes=F.lit("Specification")), options)
    out = catalog.select("seq", F.posexplode(rows).alias("pos", "row"))
    if include_prices:
        return out.select("seq", "pos", *[f"row.{f}" for f in SIX], "row.hex_color")
    # Without prices, the last column holds the url of the base row or the note.
    reference = F.coalesce(
        null_if_empty(F.col("row.reference")),
        F.when(F.col("row.notes").isin("Specification", "Model Configuration"), F.col("row.notes")),
        F.lit(""),
    )
    return out.select("seq", "pos", "row.category", "row.component", "row.image", reference.alias("reference"),
                      "row.hex_color")


def color_cells(priced: DataFrame) -> DataFrame:
    """Sheet row, channel fractions and text colour of every option with a colour.

    The row number runs over all products in seq order, header included. Of
    the rows, three columns are staged for their several readers, and the
    starts of the products are joined by a shuffle, however small they look.
    """
    rows = staged(priced.select("seq", "pos", "hex_color"), "sheet-cells")
    sizes = staged(rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n_rows")), "sheet-sizes")
    starts = running_total(sizes, F.col("n_rows"), "seq", name="rows_before").select("seq", "rows_before").hint("merge")
    code = F.ltrim("hex_color", F.lit("#"))
    colored = rows.withColumn("code", code).filter(F.col("code").rlike("^[0-9A-Fa-f]{6}$"))
    channel = lambda at: F.conv(F.substring("code", at, 2), 16, 10).cast("int") / 255.0
    cells = colored.join(starts, "seq").select(
        "seq",
        (F.col("rows_before") + F.col("pos") + 1).alias("row_index"),
        F.lit(1).alias("column_index"),
        "hex_color",
        channel(1).alias("red"),
        channel(3).alias("green"),
        channel(5).alias("blue"),
    )
    brightness = (F.col("red") * 299 + F.col("green") * 587 + F.col("blue") * 114) / 1000
    return cells.withColumn("brightness", brightness).withColumn(
        "text_color", F.when(F.col("brightness") > 0.5, "black").otherwise("white")
    )


def quotation_template(catalog: DataFrame) -> DataFrame:
    """Quotation JSON of every product, options not selected."""
    custom = F.transform_values(
        "customizations",
        lambda _, options: F.struct(
            F.transform(
                options,
                lambda o: F.struct(
                    o["label"].alias("label"), o["price"].alias("price"), o["image"].alias("image"),
                    F.lit(False).alias("selected"),
                ),
            ).alias("options")
        ),
    )
    body = F.struct("product_name", "base_price", "url", custom.alias("customizations"))
    return catalog.select(
        "product_id",
        F.lit(lex.QUOTATION_TEXT).alias("instructions"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("quotation"),
    )


def option_export(options: DataFrame) -> DataFrame:
    """Flat option list with export headings; a missing price reads N/A."""
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default))
    return options.select(
        text("category").alias("Categories"),
        text("component").alias("Component"),
        text("price", "N/A").alias("Price"),
        text("reference").alias("References"),
        text("image").alias("Image"),
    )


#: As spreadsheet programs write and read it: quotes doubled, blanks kept, an empty cell is not a missing one.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_sheet(rows: DataFrame, path: str, headings: dict[str, str]) -> None:
    """Write sheet rows as CSV files in sheet order (range partitions keep it).

    The rows are staged: the sample that sets the ranges would work them out a second time.
    """
    ordered = staged(rows.select("seq", "pos", *headings), "sheet-rows").orderBy("seq", "pos")
    ordered.select(*[F.col(c).alias(h) for c, h in headings.items()]).write.mode("overwrite").options(**CSV).csv(path)


def read_sheet(spark: SparkSession, path: str, headings: dict[str, str]) -> DataFrame:
    """Read what write_sheet wrote: row_no (from 0, in sheet order) and the columns by their own names.

    The files' names are in sheet order; each file is read by one task, cells
    with line breaks stay whole. One count per file carries the numbers on.
    """
    schema = ", ".join(f"`{h}` string" for h in headings.values())
    # with a null value of its own the reader tells a quoted empty cell from a missing one
    cells = spark.read.schema(schema).options(**CSV, multiLine="true", nullValue="\x00").csv(path)
    placed = staged(
        cells.select(
            F.col("_metadata.file_name").alias("file"),
            F.monotonically_increasing_id().alias("line"),
            *[F.col(h).alias(c) for c, h in headings.items()],
        ),
        "sheet-lines",
    )
    files = placed.groupBy("file").agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    starts = files.select("file", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(starts, "file").select((F.col("before") + F.col("line") - F.col("first")).alias("row_no"), *headings)


COMPONENT_HEADINGS = dict(zip(TRIPLE, lex.SHEET_HEADER))
PRICED_HEADINGS = dict(zip(SIX, lex.PRICED_HEADER))
UNPRICED_HEADINGS = dict(zip(["category", "component", "image", "reference"], lex.UNPRICED_HEADER))
