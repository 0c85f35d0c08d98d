"""Catalog JSON: read the three known shapes, write nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unnest

OPTION_TYPE = "struct<label:string,price:string,image:string,reference:string,hex_color:string,model:string>"
CATALOG_FIELDS = {
    "product_id": "string",
    "product_name": "string",
    "url": "string",
    "source_url": "string",
    "page_type": "string",
    "base_price": "string",
    "price_note": "string",
    "description": "string",
    "features": "array<string>",
    "specifications": "map<string,string>",
    "customizations": f"map<string,array<{OPTION_TYPE}>>",
    "customization_categories": "array<string>",
    "total_customization_options": "int",
    "customization_source": "string",
    "has_configurator": "boolean",
    "configurator_type": "string",
    "configurator_url": "string",
    "configurator_confidence": "double",
    "configurator_signals": "map<string,int>",
    "external_platform": "string",
    "extraction_method": "string",
    "model": "string",
    "detection_method": "string",
    "requires_interaction": "boolean",
}
CATALOG_TYPE = ", ".join(f"{name} {kind}" for name, kind in CATALOG_FIELDS.items())


def _entries(text: Column) -> Column:
    """Products (key, value) of one document, in order; NULL if it is none of the known shapes."""
    product = "struct<" + ",".join(f"{name}:{kind}" for name, kind in CATALOG_FIELDS.items()) + ">"
    listed = F.from_json(text, f"array<{product}>")
    wrapped = F.from_json(text, f"struct<products:array<{product}>>")["products"]
    keyed = F.map_entries(F.from_json(text, f"map<string,{product}>"))
    without_key = lambda products: F.transform(
        products, lambda p: F.struct(F.lit(None).cast("string").alias("key"), p.alias("value"))
    )
    has_products = F.get_json_object(text, "$.products").isNotNull()
    return F.when(text.startswith("["), without_key(listed)).when(has_products, without_key(wrapped)).otherwise(keyed)


def parse_catalogs(documents: DataFrame, document: str = "value") -> DataFrame:
    """One row per product of JSON documents: keyed object, products object, or list.

    A document is an object id -> product, an object with a `products`
    array, or a bare array. Products carry the document's key as
    product_id when it names one. Documents that can't be read give no row
    here; catalog_errors() has them.
    """
    rows = unnest(documents, [], _entries(F.trim(F.col(document))), "position", "entry")
    return rows.select(
        "position",
        F.coalesce("entry.key", "entry.value.product_id").alias("product_id"),
        *[F.col(f"entry.value.{n}") for n in CATALOG_FIELDS if n != "product_id"],
    )


def catalog_errors(documents: DataFrame, document: str = "value", sample: int = 80) -> DataFrame:
    """The documents that parse_catalogs() can't read whole, with other columns kept: reason, n_chars, start.

    empty: no text; not json: it breaks off or is damaged; no catalog: proper
    JSON of another shape (a bare value, or `products` that are no list);
    damaged product: some products of it are no objects, the others are read.
    `start` is the beginning of the text.
    """
    text = F.trim(F.coalesce(F.col(document), F.lit("")))
    whole = F.try_parse_json(text)
    entries = _entries(text)
    reason = (
        F.when(text == "", "empty")
        .when(whole.isNull(), "not json")
        .when(entries.isNull(), "no catalog")
        .when(F.exists(entries, lambda e: e["value"].isNull()), "damaged product")
    )
    others = [c for c in documents.columns if c != document]
    found = documents.select(*others, reason.alias("reason"), F.length(text).alias("n_chars"), F.substring(text, 1, sample).alias("start"))
    return found.where("reason IS NOT NULL")


def read_catalog(spark: SparkSession, path: str, document_per_file: bool = True) -> DataFrame:
    """Read catalog documents, one per file or one per line."""
    return parse_catalogs(spark.read.text(path, wholetext=document_per_file))


def read_catalog_rows(spark: SparkSession, path: str) -> DataFrame:
    """Read a catalog that write_catalog wrote: one product per line."""
    return spark.read.schema(CATALOG_TYPE).json(path)


def write_catalog(catalog: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write nested products, one JSON object per line, in parallel files."""
    catalog.write.mode(mode).option("ignoreNullFields", "false").json(path)
