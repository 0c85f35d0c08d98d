"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.functions.frames import union_rows
from wareloom.session import staged


def components(links: DataFrame) -> DataFrame:
    """a, b -> node, root: the smallest node that each linked node reaches.

    Each round hangs the larger neighbours of a node, then all neighbours up
    to the node, on the smallest of them; the links end as stars. The number
    of rounds follows the logarithm of the longest path. Rounds are written
    to the shared folder, so a lost executor costs no earlier round. Only a
    count and a checksum of the links come to the driver. Null ends are left out.
    """
    edges = staged(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links"
    )
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(mark) == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = tuple(mark)
        both = union_rows(edges.select("u", "v"), edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(union_rows(hung, low.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "links")
