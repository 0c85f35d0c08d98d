"""Mix sources to target weights with a low-discrepancy schedule.

Each source has a slot length: `block_words`, or less where the source is small,
so that its words make `LEAST_BLOCKS` blocks if there are as many. Its target in
words gives its number of slots. Slots 0, 1, 2, ... of all sources get golden-ratio
points; in the order of the points the slots go through the cumulative slot
numbers of the sources, so every source has exactly its own and they lie evenly
in the schedule. A slot's rank among the slots of its source is the block it
takes: each source's documents stand in a shuffled order, cut into blocks of
equal words, and after the last block the source starts anew; the last slot
takes as many words of its block as the target still has. All of it is joins, windows
over bounded ranges and aggregates; no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wareloom.llm.common import word_count
from wareloom.session import staged

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 64
#: Blocks that a source is cut into at least, if it has as many words.
LEAST_BLOCKS = 1024
#: Ranges of the shuffled order; slots that are ranked together.
RANGES = 4096
RANK_TOGETHER = 16_384


def _point(slot: Column) -> Column:
    """Fractional part of slot times the golden ratio, in steps of 2**-32, as a whole number."""
    return F.pmod(F.pmod(slot, F.lit(1 << 32)) * F.lit(1640531527), F.lit(1 << 32))


def slot_words(source_size: Column, block_words: int = BLOCK_WORDS) -> Column:
    """Words of a slot and block of a source."""
    return F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(source_size / LEAST_BLOCKS))).cast("long")


def slot_counts(targets: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST) -> DataFrame:
    """targets plus words (of a slot), blocks, slots, and rest: the words of the last
    slot if it takes only a part of its block, else null."""
    words, size = slot_words(F.col("source_size"), block_words), F.col("source_size")
    goal = F.least(F.round("target").cast("long"), F.floor(F.lit(most) * size))
    rounds = F.floor(goal / F.greatest(size, F.lit(1)))
    over = goal - rounds * size
    return (
        targets.withColumn("words", words)
        .withColumn("blocks", F.ceil(size / F.col("words")))
        .withColumn("slots", F.when(goal > 0, rounds * F.col("blocks") + F.ceil(over / F.col("words"))).otherwise(0))
        .withColumn("rest", F.when(over % F.col("words") > 0, over % F.col("words")))
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> sid, source, source_size, target.

    Sources by code point, null last, get the repeating weights and share
    `share` of all words; none gets more than `most` times its own words, and
    the excess goes to the others by weight. One row per source.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_cap = W.orderBy("ratio", "sid")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    level = (
        F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    return (
        sizes.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("fits", F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.col("level")))
        .withColumn("level", F.first("fits", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        .select(
            "sid",
            "source",
            "source_size",
            F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
        )
    )


def _ranked(rows: DataFrame, keys: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """Add the 0-based rank per keys; `cell` cuts the order into ranges that are ranked each by itself."""
    earlier = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, cell)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    )
    within = F.row_number().over(W.partitionBy(*keys, cell).orderBy(*order)) - 1
    ranked = rows.withColumn("within", within).join(offsets, [*keys, cell])
    return ranked.withColumn(name, F.col("offset") + F.col("within")).drop("offset", "within", cell)


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST) -> DataFrame:
    """slot, sid, rank: which source fills a slot and its how-manieth slot it is.

    Every source has exactly its slots (slot_counts).
    """
    counted = slot_counts(targets, block_words, most).where("slots > 0")
    total = int(counted.agg(F.sum("slots")).first()[0] or 0)
    cells = max(1, total // RANK_TOGETHER)
    slots = targets.sparkSession.range(total).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / F.lit((1 << 32) / cells)))
    placed = _ranked(slots, [], "cell", ["point", "slot"], "place")

    high = F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    intervals = counted.withColumn("high", high).withColumn("low", F.col("high") - F.col("slots"))
    parts = F.sequence(F.floor(F.col("low") / RANK_TOGETHER), F.floor((F.col("high") - 1) / RANK_TOGETHER))
    intervals = intervals.select("sid", "low", "high", F.explode(parts).alias("part"))
    named = (
        placed.withColumn("part", F.floor(F.col("place") / RANK_TOGETHER))
        .join(intervals, "part")
        .where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
        .select("slot", "sid", F.floor(F.col("slot") / RANK_TOGETHER).alias("range"))
    )
    return _ranked(named, ["sid"], "range", ["slot"], "rank").select("slot", "sid", "rank")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, plus sid, at (the document's first
    word in its source's shuffled order).

    `docs` has doc_id, text and source; other columns are ignored. A null or
    empty text has size 0 and is taken 0 times. Rows with the same doc_id
    stay apart, one result each. An empty table gives no row. Each source ends
    at its target rounded to words, and no document is taken more than `most`
    times, rounded up.
    """
    sized = staged(
        docs.select(
            F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")
        ).withColumn("order", F.xxhash64(F.lit("mix"), "doc_id", "size")),
        "mix-sizes",
    ).withColumn("part", F.shiftright("order", 52))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    targets = staged(source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")

    earlier = W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        parts.withColumnRenamed("source", "s")
        .join(targets, F.col("s").eqNullSafe(F.col("source")))
        .select("s", F.col("part").alias("p"), "sid", "source_size", "target", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    )
    in_part = W.partitionBy("source", "part").orderBy("order", "doc_id", "size")
    placed = (
        sized.withColumn("row", F.row_number().over(in_part))
        .withColumn("before", F.sum("size").over(in_part.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .select("doc_id", "size", "source_size", "target", "sid", "part", "row", (F.col("offset") + F.col("before")).alias("at"))
    )
    plan = slot_counts(targets, block_words, most).select("sid", "blocks", "slots", "rest")
    uses = (
        schedule(targets, block_words, most)
        .join(plan, "sid")
        .withColumn("part_words", F.when(F.col("rank") == F.col("slots") - 1, F.col("rest")))
        .groupBy(F.col("sid").alias("u_sid"), (F.col("rank") % F.col("blocks")).alias("u_block"))
        .agg(F.count_if(F.col("part_words").isNull()).alias("uses"), F.max("part_words").alias("part_words"))
    )
    words = slot_words(F.col("source_size"), block_words)
    first, last = F.floor(F.col("at") / words), F.floor((F.col("at") + F.col("size") - 1) / words)
    segments = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    start = F.col("block") * words
    begin, end = F.greatest("at", start), F.least(F.col("at") + F.col("size"), start + words)
    of_part = F.greatest(F.least(end, start + F.coalesce("part_words", F.lit(0))) - begin, F.lit(0))
    return (
        segments.join(uses, (F.col("sid") == F.col("u_sid")) & (F.col("block") == F.col("u_block")), "left")
        .groupBy("sid", "part", "row", "doc_id", "size", "source_size", "target", "at")
        .agg(F.coalesce(F.sum((end - begin) * F.col("uses") + of_part), F.lit(0)).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken", "sid", "at")
    )
