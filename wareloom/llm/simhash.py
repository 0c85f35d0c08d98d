"""SimHash near duplicates by pivot distance tables.

A text's fingerprint has 64 bits, by majority over the hashes of its
three-word shingles. Equal fingerprints are folded first. For every distinct
fingerprint a table holds its Hamming distances to reference fingerprints:
zero, the masks of 32 two-bit blocks, and a few spread references.

* Where two fingerprints differ in `d` bits, no coordinate differs by more
  than `d`; pairs beyond that are discarded by their largest coordinate
  difference and only the rest compared bit by bit.
* distance(x, zero) - distance(x, mask of a block) gives the number of ones in
  that block, and two differing bits change it in at most two blocks. The
  blocks stand in four groups, so two of the groups agree in every block: a
  link's ends meet under one of six keys. Nothing is missed.

A key's rows come sorted to one task and are compared in tiles; only a
spanning forest of each key's links goes on, so a group of n near copies
gives fewer than 6 n links. Keys with very many fingerprints are first split
by the blocks of the other two groups, the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import lower_ascii, whole_groups
from wareloom.llm.components import components
from wareloom.session import staged

BITS = 2
SEED = 42
#: A key with more fingerprints is split by the blocks of the other groups.
SPLIT_OVER = 4096
TILE = 1024
#: The pairs of 16-bit groups that make up a key.
GROUP_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
#: Shingles whose bits are summed up at once.
SLICE = 65_536


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole if there are fewer words."""
    w = lower_ascii(text).split()
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprint(text: str | None) -> int:
    """The majority of each bit over all shingles; zero for a text without words."""
    h = shingle_hashes(text)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), SLICE):
        part = h[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, bits (the fingerprint as a signed long)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits = np.array([fingerprint(t) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "bits": bits})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, bits long")


def references() -> np.ndarray:
    """Zero, the 32 block masks, and 8 spread references."""
    masks = [0] + [3 << (2 * i) for i in range(32)]
    spread = [int(xxhash.xxh64_intdigest(bytes([i]), seed=SEED)) for i in range(8)]
    return np.array(masks + spread, np.uint64)


def distance_table(bits: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per fingerprint and one column per reference."""
    return np.bitwise_count(bits[:, None] ^ references()[None, :]).astype(np.int16)


def block_ones(table: np.ndarray) -> np.ndarray:
    """Ones per two-bit block, from the distances to zero and to the masks."""
    return (table[:, :1] - table[:, 1:33] + 2) // 2


def group_codes(ones: np.ndarray) -> np.ndarray:
    """One number per group of eight blocks."""
    return ones.reshape(-1, 4, 8).astype(np.int64) @ (3 ** np.arange(8, dtype=np.int64))


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        code = group_codes(block_ones(distance_table(frame["bits"].to_numpy(np.int64).view(np.uint64))))
        for k, (a, b) in enumerate(GROUP_PAIRS):
            rest = [g for g in range(4) if g not in (a, b)]
            yield pd.DataFrame(
                {"key": (k * 6561 + code[:, a]) * 6561 + code[:, b], "rest_a": code[:, rest[0]], "rest_b": code[:, rest[1]], "bits": frame["bits"]}
            )


def _sub_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three keys for each row of a large key: at most two of the other sixteen
    blocks differ, so one of three parts of these agrees in full."""
    parts = [np.arange(0, 5), np.arange(5, 10), np.arange(10, 16)]
    power = 3 ** np.arange(8, dtype=np.int64)
    for frame in frames:
        rest = np.concatenate([(frame[c].to_numpy()[:, None] // power) % 3 for c in ("rest_a", "rest_b")], axis=1)
        for k, part in enumerate(parts):
            sub = k * 729 + rest[:, part] @ power[: len(part)]
            yield pd.DataFrame({"key": frame["key"], "sub": sub + 1, "bits": frame["bits"]})


def forest(bits: np.ndarray, most: int = BITS) -> list[tuple[int, int]]:
    """Links that connect what the links of at most `most` differing bits connect."""
    values = np.unique(bits)
    u, table = values.view(np.uint64), distance_table(values.view(np.uint64))
    root = np.arange(len(u))
    for i in range(0, len(u), TILE):
        for j in range(i, len(u), TILE):
            near = np.ones((min(TILE, len(u) - i), min(TILE, len(u) - j)), bool)
            for c in range(33, table.shape[1]):
                near &= np.abs(table[i : i + TILE, None, c] - table[None, j : j + TILE, c]) <= most
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            x, y = x[x < y], y[x < y]
            keep = (np.abs(table[x] - table[y]).max(axis=1, initial=0) <= most) & (np.bitwise_count(u[x] ^ u[y]) <= most)
            for a, b in zip(x[keep].tolist(), y[keep].tolist()):
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
    for a in range(len(u)):
        root[a] = root[root[a]]
    return [(int(values[a]), int(values[root[a]])) for a in range(len(u)) if root[a] != a]


def _links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(frames, ["key", "sub"]):
        key, sub, bits = (frame[c].to_numpy() for c in ("key", "sub", "bits"))
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
        ends = np.r_[starts[1:], len(key)]
        out = [pair for s, e in zip(starts, ends) if e - s > 1 for pair in forest(bits[s:e])]
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def links(distinct: DataFrame) -> DataFrame:
    """bits (distinct) -> a, b: links whose components are those of all links of
    at most two differing bits."""
    keys = staged(distinct.select("bits").mapInPandas(_keys, "key long, rest_a long, rest_b long, bits long"), "simhash-keys")
    counts = keys.groupBy("key").count().where("count > 1")
    shared = keys.join(counts, "key")
    small = shared.where(F.col("count") <= SPLIT_OVER).select("key", F.lit(0).cast("long").alias("sub"), "bits")
    large = (
        shared.where(F.col("count") > SPLIT_OVER)
        .select("key", "rest_a", "rest_b", "bits")
        .mapInPandas(_sub_keys, "key long, sub long, bits long")
    )
    both = small.unionByName(large)
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(parts, "key", "sub").sortWithinPartitions("key", "sub").mapInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, fingerprint, component_id, bits.

    component_id is the smallest doc_id that a document reaches over links of
    at most two differing bits, itself included. Null and empty texts have
    fingerprint zero and link like any other. A row with a null doc_id keeps
    its row and takes part; a component of such rows alone has a null
    component_id. Repeated rows stay. An empty table gives no row; columns
    other than doc_id and text are ignored.
    """
    marked = staged(fingerprints(docs), "simhash-bits")
    distinct = staged(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "bits")
    grouped = distinct.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = grouped.join(named, "root").select(F.col("bits").alias("b"), "component_id")
    return marked.join(known, F.col("bits") == F.col("b")).select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "bits"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but the first, by doc_id, of each component.

    Rows with a null doc_id are kept only if no other row is in their
    component; of rows with the same smallest doc_id each one stays.
    """
    groups = near_duplicates(docs).select(F.col("doc_id").alias("kept_id"), "component_id")
    keep = groups.where(F.col("kept_id").eqNullSafe(F.col("component_id"))).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]), "left_semi")
