"""Specifications by pattern and by section."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions.text import extract_all, let, lines, matches_any, squeeze, strip, strip_tags, unnest

ALL_NAMES = "|".join(pattern for pattern, _ in lex.SPEC_PATTERNS)
# Looks ahead only, so a label inside another label's value is found as well.
LETTERS = "".join(sorted(set(re.findall(r"(?:^|\(\?:|\|)([A-Za-z])", ALL_NAMES.lower()))))
LABELLED = rf"(?i)(?=[{LETTERS}])(?=((?:{ALL_NAMES}):\s*[^\n]+))"


def _spec_value(raw: Column) -> Column:
    cut = strip(F.substring_index(squeeze(strip(raw)), "|", 1))
    return let(cut, lambda value: F.when((value != "") & (F.length(value) < 200), value))


def spec_pair_array(text: Column) -> Column:
    """array<struct(spec, value)>: the first match of each named pattern.

    One pass over the text collects every "name: value"; the patterns then
    pick from these few labels.
    """
    found = F.transform(
        extract_all(text, LABELLED, 1),
        lambda x: F.struct(
            F.substring_index(x, ":", 1).alias("label"),
            F.regexp_extract(x, r"\A[^:]*:\s*([^\n]+)", 1).alias("value"),
        ),
    )

    def pick(labelled: Column) -> Column:
        def first(pattern: str) -> Column:
            hits = F.filter(labelled, lambda x: x["label"].rlike(rf"(?i)\A(?:{pattern})\z"))
            return F.get(hits, 0)["value"]

        return F.array(
            *[
                F.struct(F.lit(name).alias("spec"), let(first(pattern), _spec_value).alias("value"))
                for pattern, name in lex.SPEC_PATTERNS
            ]
        )

    return F.filter(let(found, pick), lambda p: p["value"].isNotNull())


def spec_pairs(pages: DataFrame) -> DataFrame:
    """Specifications of each page: page_id, url, spec, value."""
    pairs = spec_pair_array(F.col("markdown"))
    return unnest(pages, ["page_id", "url"], pairs).select("page_id", "url", "item.*")


def spec_coverage(pairs: DataFrame) -> DataFrame:
    """How many pages give each specification, and how many values it takes."""
    return pairs.groupBy("spec").agg(
        F.count(F.lit(1)).alias("n_pages"), F.countDistinct("value").alias("n_values")
    )


def specs_wide(pairs: DataFrame, names: list[str]) -> DataFrame:
    """One column per named specification."""
    columns = [F.max(F.when(F.col("spec") == n, F.col("value"))).alias(n.lower().replace(" ", "_")) for n in names]
    return pairs.groupBy("page_id").agg(*columns)


def _header(words: list[str]) -> str:
    return r"(?i)\A#+\s*(?:" + "|".join(words) + r")\s*:?\s*\z"


def spec_sections(pages: DataFrame) -> DataFrame:
    """Sections under a specification header: page_id, section, title, content.

    Every line that starts with '#' ends a section. A section that a FAQ
    header ends is dropped, and so is an empty one at the end of the page.
    """
    parts = F.split(F.concat(F.lit("\n"), F.col("markdown")), r"\n(?=#)")
    def describe(blocks: Column) -> Column:
        heads = F.transform(blocks, lambda block: F.substring_index(block, "\n", 1))
        return F.transform(
            blocks,
            lambda block, i: F.struct(
                i.alias("section"),
                F.get(heads, i).alias("header"),
                F.substr(block, F.length(F.get(heads, i)) + 2).alias("content"),
                F.coalesce(F.get(heads, i + 1), F.lit("")).alias("next_header"),
                ((i + 1) == F.size(blocks)).alias("is_last"),
            ),
        )

    kept = F.filter(
        let(parts, describe),
        lambda b: (b["section"] > 0)
        & b["header"].rlike(_header(lex.SPEC_HEADERS))
        & ~b["next_header"].rlike(_header(lex.FAQ_HEADERS))
        & ~(b["is_last"] & (b["content"] == "")),
    )
    return unnest(pages, ["page_id"], kept).select(
        "page_id", "item.section", strip(F.ltrim("item.header", F.lit("#"))).alias("title"), "item.content"
    )


def _clean_key(raw: Column) -> Column:
    return F.initcap(squeeze(strip(F.rtrim(strip(F.regexp_replace(raw, r"\*\*?", "")), F.lit(":")))))


def _clean_value(raw: Column) -> Column:
    return F.rtrim(strip(raw), F.lit(".*"))


def section_lines(sections: DataFrame) -> DataFrame:
    """Every key and value a section line gives, in overwrite order."""
    cells = F.filter(F.transform(F.split(F.col("raw"), r"\|"), lambda x: strip(x)), lambda x: x != "")
    rows = (
        unnest(sections, ["page_id", "section", "title"], lines(F.col("content")), item="raw")
        .withColumn("line", strip(F.col("raw")))
        .withColumn("cells", cells)
        .withColumn("list_key", F.regexp_extract("raw", lex.SPEC_LIST_LINE, 1))
        .withColumn("inline_key", F.regexp_extract("line", lex.SPEC_INLINE_LINE, 1))
    )
    raw, line, cells = F.col("raw"), F.col("line"), F.col("cells")
    is_table = F.contains(raw, F.lit("|")) & ~line.startswith("|---") & (F.size(cells) == 2)
    is_inline = (line != "") & ~line.startswith("#")

    def entry(source: int, test: Column, key: Column, value: Column) -> Column:
        return F.when(
            test,
            F.struct(F.lit(source).alias("source"), _clean_key(key).alias("key"), value.alias("value")),
        )

    list_key, inline_key = F.col("list_key"), F.col("inline_key")
    list_value = F.regexp_extract(raw, lex.SPEC_LIST_LINE, 2)
    inline_value = F.regexp_extract(line, lex.SPEC_INLINE_LINE, 2)
    entries = F.array_compact(
        F.array(
            entry(0, list_key != "", list_key, _clean_value(list_value)),
            entry(1, is_table, F.get(cells, 0), F.get(cells, 1)),
            entry(2, is_inline & (inline_key != ""), inline_key, _clean_value(inline_value)),
        )
    )
    found = unnest(rows, ["page_id", "section", "title", "pos"], entries, "n").select(
        "page_id", "section", "title", "pos", "item.*"
    )
    low_key = F.lower("key")
    question = low_key.rlike("^(?:" + "|".join(lex.QUESTION_PREFIXES) + ")")
    words = F.when(strip(F.col("value")) == "", 0).otherwise(F.size(F.split(strip(F.col("value")), r"\s+")))
    return found.filter(~question & (words <= 20) & matches_any(low_key, lex.SPEC_KEY_PATTERNS))


def _last_value(keys: list[str], entries: DataFrame) -> DataFrame:
    order = F.struct("section", "source", "pos")
    return entries.groupBy(*keys).agg(F.max_by("value", order).alias("value"))


def section_specs(sections: DataFrame) -> DataFrame:
    """Specifications of each page; a later section, source or line overwrites."""
    latest = _last_value(["page_id", "key"], section_lines(sections))
    return latest.filter((F.col("value") != "") & (F.length("value") <= 200)).select(
        "page_id", "key", strip_tags(F.col("value")).alias("value")
    )


def specs_grouped(sections: DataFrame) -> DataFrame:
    """Specifications per section as a map, as found (without clean-up)."""
    latest = _last_value(["page_id", "section", "title", "key"], section_lines(sections))
    return latest.groupBy("page_id", "section", "title").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("specs"),
        F.count(F.lit(1)).alias("n_specs"),
    )


def format_specs(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """Specification sheet text of every page: sorted "key: value" lines."""
    pairs = F.sort_array(F.collect_list(F.struct("key", "value")))
    sheets = specs.groupBy("page_id").agg(
        F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(": "), p["value"])), "\n").alias("sheet")
    )
    return (
        pages.select("page_id")
        .join(sheets, "page_id", "left")
        .select("page_id", F.coalesce("sheet", F.lit(lex.NO_SPECS_TEXT)).alias("sheet"))
    )
