"""Order-dependent columns that never pull a whole table or group into one task.

Rows are cut into ranges of the order column. Windows run inside a range;
one small table with a row per range carries the offset from range to range.
NULL keys and NULL order values form groups and ranges of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RANGE = "_range"
#: Ranges that the rows are cut into, each with about as many rows.
RANGES = 1024


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL; the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def with_ranges(df: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """Add RANGE: ranges of about equally many rows, in the order of the values; NULLs are one of their own.

    The ranges begin at quantiles, found with one sketch per task; at most
    `ranges` numbers come to the driver. However the values lie, an outlier is
    only one row of its range. Equal values share a range.
    """
    value = F.col(order).cast("double")
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.agg(F.approx_percentile(value, shares, F.lit(4 * ranges))).first()[0]
    if not found:
        return df.withColumn(RANGE, F.lit(0.0))
    splits = [-float("inf"), *sorted(set(found)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol=RANGE, handleInvalid="keep")
    return cut.transform(df.withColumn("_at", value)).drop("_at")


def running_total(
    df: DataFrame,
    value: Column,
    order: str,
    keys: list[str] | None = None,
    width: int | None = None,
    name: str = "total",
    of_key: str | None = None,
    part: Column | None = None,
) -> DataFrame:
    """Add the sum of `value` over all rows before this one, per key, by an integer order.

    A range spans `width` order values; without it ranges hold about equally
    many rows (with_ranges). An order of another type needs `part`, which cuts
    it into ordered pieces (its first letters, say). `of_key` names one more
    column with the key's sum over all rows.
    """
    keys = keys or []
    if part is not None:
        cut = df.withColumn(RANGE, part)
    else:
        cut = with_ranges(df, order) if width is None else df.withColumn(RANGE, F.floor(F.col(order) / width))
    cut = cut.withColumn("_value", value.cast("long"))
    sums = cut.groupBy(*keys, RANGE).agg(F.sum("_value").alias("_sum"))
    ranges = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        RANGE,
        F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_offset"),
        *([F.sum("_sum").over(W.partitionBy(*keys)).alias(of_key)] if of_key else []),
    )
    inside = W.partitionBy(*keys, RANGE).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        join_null_safe(local, offsets, [*keys, RANGE])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop(RANGE, "_value", "_local", "_offset")
    )


def numbered(
    df: DataFrame,
    order: str,
    keys: list[str] | None = None,
    width: int | None = None,
    name: str = "row_no",
    of_key: str | None = None,
    part: Column | None = None,
) -> DataFrame:
    """Add the 0-based row number by an order, over all rows or per key, as running_total() does."""
    return running_total(df, F.lit(1), order, keys, width, name, of_key, part)


def previous(df: DataFrame, columns: list[str], key: str, order: list[str], part: Column) -> DataFrame:
    """Add previous_<column>: the value in the row before, per key.

    `part` cuts a key's rows into ordered pieces (a day, say), so that a key
    with very many rows spreads over several tasks.
    """
    cut = df.withColumn(RANGE, part)
    spec = W.partitionBy(key, RANGE).orderBy(*order)
    values = F.struct(*columns)
    inside = cut.withColumn("_before", F.lag(values).over(spec))
    lasts = cut.groupBy(key, RANGE).agg(F.max_by(values, F.struct(*order)).alias("_last"))
    carried = lasts.select(key, RANGE, F.lag("_last").over(W.partitionBy(key).orderBy(RANGE)).alias("_carried"))
    joined = join_null_safe(inside, carried, [key, RANGE]).withColumn("_before", F.coalesce("_before", "_carried"))
    added = {f"previous_{c}": F.col("_before")[c] for c in columns}
    return joined.withColumns(added).drop(RANGE, "_before", "_carried")
