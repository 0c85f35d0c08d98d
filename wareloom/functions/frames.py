"""Helpers on whole DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def union_rows(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Union by column name whose result counts as not partitioned.

    Spark 4.1 can take a union of equally partitioned inputs as partitioned
    itself and leave out the exchange before an aggregate; when adaptive
    execution then reads the inputs in different pieces, groups come out
    several times. The setting switches that shortcut off for the session.
    """
    frames[0].sparkSession.conf.set(UNION_PARTITIONING, "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
