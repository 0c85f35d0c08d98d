"""Inputs and small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")), F.lit(parts))


def word_count(text: Column) -> Column:
    """Words between blanks; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case; null becomes empty."""
    return (text or "").encode("utf-8", "replace").lower()


def whole_groups(frames: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut frames sorted by key so that no key's rows stand in two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = (frame[key] == frame[key].iloc[-1]).all(axis=1).to_numpy()
        first = int(len(last) - np.argmin(last[::-1])) if not last.all() else 0
        if first:
            held.append(frame.iloc[:first])
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            held = [frame.iloc[first:]]
        elif held and not (held[-1][key].iloc[-1] == frame[key].iloc[0]).all():
            yield pd.concat(held, ignore_index=True)
            held = [frame]
        else:
            held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int
) -> list[tuple[int, str, int]]:
    """Up to `rows` labelled texts of each class from the folds other than `held`.

    The ids are drawn from the labels alone, in the order of a hash, so the
    choice does not depend on partitions; texts come from one scan of the
    documents with a filter on these (at most 2 * rows) ids. Ids that occur
    several times in the labels count once, with their largest label; rows
    without text, id or label are left out.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("i"), F.col(label).cast("int").alias("y"))
        .where(F.col("i").isNotNull() & F.col("y").isin(0, 1))
        .where(fold(F.col("i"), parts) != held)
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    chosen: dict[int, int] = {}
    for y in (0, 1):
        for r in ids.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows).collect():
            chosen[r["i"]] = y
    if not chosen:
        return []
    some = documents.sparkSession.createDataFrame([(i,) for i in chosen], "i long")
    texts = (
        documents.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
        .where(F.col("t").isNotNull())
        .join(F.broadcast(some), "i", "left_semi")
    )
    first = {}
    for r in texts.toLocalIterator():
        first[r["i"]] = min(first.get(r["i"], r["t"]), r["t"])
    return [(i, first[i], chosen[i]) for i in sorted(first)]
