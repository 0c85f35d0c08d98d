"""How filters on documents act on each other, in every order.

Each document gets a mask of the filters it fails. Four filters look at its
text alone; the fifth, "identical to a text of a smaller id", needs the whole
table. A counting Bloom prepass spares most texts the shuffle: every task
counts the slots of its texts' hashes in a sketch, the sketches are added up,
and a text with a slot that only it fills is unique for certain. Only possible
repeats are grouped, by full text, to their smallest id. The flags then join
into counts per part and mask; those are additive, so all orders of the
filters follow from at most 32 counts a part.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions.frames import union_rows
from wareloom.session import staged

FILTERS = "ABCDE"
#: Fewest words; least distinct words and most capitals, in hundredths; characters that no kept text holds.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

#: The sketch: slots a text at least, slots each text fills, slots of a block.
SLOTS_PER_TEXT, PROBES, BLOCK_BITS = 16, 3, 16
#: Blocks at most: their bitmaps are broadcast, so they take 512 MB at most. Beyond
#: (some 260 million texts) more unique texts count as possible repeats; results stay exact.
MOST_BLOCKS = 1 << 16
#: Blocks that a task holds before it passes its counts on.
HELD_BLOCKS = 1 << 10


def _text_flags(text: str) -> int:
    """Failed filters A to D as bits 0 to 3."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at space and \\t to \\r only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def _flag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        mask = np.fromiter(map(_text_flags, frame["text"]), dtype=np.int32, count=len(frame))
        yield frame.drop(columns="text").assign(mask=mask)


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and two hashes of the text; nulls of the latter two are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.withColumns({"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit("check"), "text")})


def blocks_for(texts: int) -> int:
    """Blocks of the sketch, a power of two that grows with the number of texts up to MOST_BLOCKS."""
    least = -(-texts * SLOTS_PER_TEXT >> BLOCK_BITS)
    return min(MOST_BLOCKS, 1 << max(0, (least - 1).bit_length()))


def _block(h: Column, blocks: int) -> Column:
    """The block from the highest bits; the lowest 3 * 16 bits are the slots in it."""
    return F.shiftrightunsigned(h, 48).bitwiseAND(blocks - 1).cast("int")


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """This task's sketch: per block one counter a slot, which stops at 2."""
    held: dict[int, np.ndarray] = {}

    def passed_on() -> pd.DataFrame:
        out = pd.DataFrame({"block": list(held), "counts": [zlib.compress(c.tobytes(), 1) for c in held.values()]})
        held.clear()
        return out

    for frame in frames:
        h = frame["h"].to_numpy().view(np.uint64)
        for block, at in frame.groupby("block").indices.items():
            if block not in held and len(held) >= HELD_BLOCKS:
                yield passed_on()
            counts = held.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint8))
            slots = np.stack([(h[at] >> np.uint64(16 * k)).astype(np.uint16) for k in range(PROBES)], axis=1)
            slots.sort(axis=1)
            fresh = np.ones(slots.shape, bool)  # a text fills each of its slots once
            fresh[:, 1:] = slots[:, 1:] != slots[:, :-1]
            found = np.bincount(slots[fresh], minlength=1 << BLOCK_BITS)
            np.minimum(counts + np.minimum(found, 2).astype(np.uint8), 2, out=counts)
    if held:
        yield passed_on()


def _merged(keys: list[str], last: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.uint8)
        for c in frame["counts"]:
            np.minimum(total + np.frombuffer(zlib.decompress(c), np.uint8), 2, out=total)
        one = {k: frame[k].iloc[:1].reset_index(drop=True) for k in keys}
        if last:
            return pd.DataFrame(one | {"bits": [np.packbits(total >= 2, bitorder="little").view(np.int64)]})
        return pd.DataFrame(one | {"counts": [zlib.compress(total.tobytes(), 1)]})

    return run


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """h -> block, bits: a bit for every slot that at least two texts fill.

    Sketches add up in two steps, so no task merges those of all tasks.
    """
    parts = (
        hashes.select("h", _block(F.col("h"), blocks).alias("block"))
        .mapInPandas(_counted, "block int, counts binary")
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    )
    parts = parts.groupBy("block", "salt").applyInPandas(_merged(["block", "salt"], False), "block int, salt int, counts binary")
    return parts.groupBy("block").applyInPandas(_merged(["block"], True), "block int, bits array<bigint>")


def _possible_repeats(rows: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """The rows whose slots are all filled by two texts or more; the bitmaps have a bound of 512 MB."""

    def filled(k: int) -> Column:
        slot = F.shiftrightunsigned("h", 16 * k).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        return F.getbit(F.element_at("bits", F.shiftright(slot, 6) + 1), slot.bitwiseAND(63)) == 1

    marked = rows.withColumn("block", _block(F.col("h"), blocks)).join(F.broadcast(bits), "block")
    for k in range(PROBES):
        marked = marked.where(filled(k))
    return marked.drop("block", "bits")


def flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: one row per document; bit k stands for FILTERS[k].

    `docs` has doc_id, text and source; a null text is empty, a null source
    the part "". A null id is smaller than no id, and none is smaller than it,
    so its text fails E never; rows that share id and text do not make each
    other fail. Other columns are ignored, an empty table gives no row.
    """
    rows = staged(
        _hashed(docs).mapInPandas(_flag, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, h long, h2 long, mask int"),
        "audit-rows",
    )
    blocks = blocks_for(rows.count())
    bits = staged(sketch(rows, blocks), "audit-sketch")
    firsts = staged(
        _possible_repeats(_hashed(docs).where("doc_id is not null"), bits, blocks)
        .groupBy("text")
        .agg(F.min("doc_id").alias("f_id"), F.first("h").alias("f_h"), F.first("h2").alias("f_h2"))
        .select("f_id", "f_h", "f_h2"),
        "audit-firsts",
    )
    # a possible repeat keeps E if it is the first of its text: (id, hashes) is a key that spreads hot texts
    possible = _possible_repeats(rows.where("doc_id is not null"), bits, blocks).select("doc_id", "h", "h2").distinct()
    repeats = possible.join(
        firsts, (F.col("doc_id") == F.col("f_id")) & (F.col("h") == F.col("f_h")) & (F.col("h2") == F.col("f_h2")), "left_anti"
    ).select(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"), F.col("h2").alias("r_h2"))
    same = (F.col("doc_id") == F.col("r_id")) & (F.col("h") == F.col("r_h")) & (F.col("h2") == F.col("r_h2"))
    e = F.when(F.col("r_id").isNotNull(), 1 << FILTERS.index("E")).otherwise(0)
    known = rows.where("doc_id is not null").join(repeats, same, "left").select("doc_id", "part", (F.col("mask") + e).alias("mask"))
    return union_rows(known, rows.where("doc_id is null").select("doc_id", "part", "mask"))


def mask_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many rows, and how many of them are labelled so.

    A label holds for all rows of its id; of several label rows of an id any will do.
    """
    marks = (
        labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy(F.col("doc_id").alias("l_id"))
        .agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    )
    # rows that share id, part and mask are one before the join; rows without an id have no label
    folded = flagged.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return (
        folded.join(marks, F.col("doc_id") == F.col("l_id"), "left")
        .groupBy("part", "mask")
        .agg(*(F.sum(F.col("n") * c).alias(a) for c, a in ((F.lit(1), "n"), (F.coalesce("good", F.lit(0)), "good"), (F.coalesce("toxic", F.lit(0)), "toxic"))))
    )


def _rules(spark: SparkSession) -> DataFrame:
    """What a document with a mask counts for at each step of each order: 32 * 600 fixed rows."""
    orders = len(list(itertools.permutations(FILTERS)))
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            for mask in range(1 << len(FILTERS)):
                fails, earlier = mask >> k & 1, bool(mask & before)
                kept = not mask & (before | 1 << k)
                first = orders // mask.bit_count() if fails else 0  # orders in which it is the first that fails
                rows.append((mask, name, step, int(kept), int(fails and not earlier), int(fails and earlier), int(mask == 1 << k), first))
            before |= 1 << k
    kind = "rule_mask int, filter_order string, step int, k int, r int, e int, u int, s int"
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")]), kind)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per part, order of the five filters and step. Ties cannot occur:
    everything is a count. An empty table gives no row.
    """
    counts = staged(mask_counts(flags(docs), labels), "audit-counts")
    spread = counts.join(F.broadcast(_rules(docs.sparkSession)), F.col("mask") == F.col("rule_mask"))

    def total(rule: str, count: str, name: str) -> Column:
        return F.sum(F.col(rule) * F.col(count)).cast("long").alias(name)

    return spread.groupBy("part", "filter_order", "step").agg(
        total("k", "n", "kept"),
        total("r", "n", "removed"),
        total("e", "n", "redundant"),
        total("u", "n", "unique_fails"),
        total("r", "good", "good_lost"),
        total("r", "toxic", "toxic_lost"),
        total("s", "n", "shapley"),
    )
