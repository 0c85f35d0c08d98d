"""Find benchmark items inside documents: size-partitioned MinHash containment search.

Jaccard similarity between a short item and a long document is tiny, so the
search space is partitioned by size: items fall into classes of up to 32, 64,
128, ... shingles, and for each class a document counts as all its windows of
that length plus eight, starting every eight shingles. A passage that holds an
item then lies whole in some window and has a Jaccard similarity of at least
n / (limit + 8), whatever the document's length. Windows and items meet where
one of `HASHES` minimum hashes is equal; every meeting is verified by exact
shingle containment, on the words themselves.

Items of up to `EXACT` distinct shingles have too few minimum hashes to be sure
of. They are looked up: a document that holds enough of an item's shingles must
hold one of any n - needed + 1 of them, so that many of its hashes are keys
that are searched among all hashes of the document. Nothing is lost there.

Documents are never shuffled and never joined: the items of one slice of the
benchmark, at most `SLICE_CHARS` characters, go to every task, and a larger
benchmark takes several passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.functions.frames import union_rows
from wareloom.session import staged

WORDS = 5
CONTAINED = 0.8
HASHES = 24
GRID = 8
#: Items of up to so many distinct shingles are looked up, not sampled.
EXACT = 2 * GRID
SLICE_CHARS = 4_000_000
#: Shingles of documents that are searched at once.
BATCH = 100_000

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of ASCII letters and digits and of everything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """Runs of five words; fewer words make one shingle, no words none."""
    if len(words) < WORDS:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(WORDS))))


def _hashes(words: list[bytes]) -> np.ndarray:
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    runs = max(len(w) - WORDS + 1, min(len(w), 1))
    used = min(len(w), WORDS)
    h = np.full(runs, used, np.uint64)
    for i in range(used):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w[i : i + runs] >> np.uint64(1))
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(7)
    return draw.integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, HASHES, np.uint64)


class Items:
    """One slice of the benchmark: keys of its short items, minimum hashes of the others by size class."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids: list = []
        self.shingles: list[set[tuple[bytes, ...]]] = []
        by_class: dict[int, list[int]] = {}
        keys: list[np.ndarray] = []
        short: list[int] = []
        hashes = []
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            n = len(own := set(shingles(words)))
            self.ids.append(item_id)
            self.shingles.append(own)
            hashes.append(_hashes(words))
            if n <= EXACT:
                needed = next(k for k in range(1, n + 1) if k / n >= CONTAINED)
                keys.append(np.unique(hashes[-1])[: n - needed + 1])
                short.append(len(self.ids) - 1)
                continue
            limit = EXACT
            while limit < n:
                limit *= 2
            by_class.setdefault(limit, []).append(len(self.ids) - 1)
        self.keys = None
        if keys:
            values = np.concatenate(keys)
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.keys = values[order], np.repeat(short, [len(k) for k in keys])[order], seen
        a, b = _factors()
        self.classes = []
        for limit, members in sorted(by_class.items()):
            per_hash = []
            for j in range(HASHES):
                values = np.array([(hashes[m] * a[j] + b[j]).min() for m in members], np.uint64)
                order = np.argsort(values, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[(values & np.uint64(0xFFFF)).astype(np.int64)] = True
                per_hash.append((values[order], np.array(members)[order], seen))
            self.classes.append((limit // GRID + 1, per_hash))

    def search(self, texts: list) -> list[tuple[int, int, float]]:
        """(row, item, containment) of all verified matches, by row and item."""
        found: list[tuple[int, int, float]] = []
        rows, hashes, size = [], [], 0
        for row, text in enumerate(texts):
            words = words_of(text)
            if words:
                rows.append(row)
                hashes.append(_hashes(words))
                size += len(hashes[-1])
            if size >= BATCH:
                found += self._verified(texts, self._met(rows, hashes))
                rows, hashes, size = [], [], 0
        if rows:
            found += self._verified(texts, self._met(rows, hashes))
        return found

    def _met(self, rows: list[int], hashes: list[np.ndarray]) -> set[tuple[int, int]]:
        """(row, item) of documents and short items with a key in common, and of
        windows and items with an equal minimum hash."""
        looked_up = self._looked_up(rows, hashes) if self.keys else set()
        return looked_up | (self._windows_met(rows, hashes) if self.classes else set())

    def _looked_up(self, rows: list[int], hashes: list[np.ndarray]) -> set[tuple[int, int]]:
        values, members, seen = self.keys
        flat = np.concatenate(hashes)
        some = np.flatnonzero(seen[(flat & np.uint64(0xFFFF)).astype(np.int64)])
        left = np.searchsorted(values, flat[some], "left")
        hit = np.searchsorted(values, flat[some], "right") > left
        row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])[some]
        # a shingle that a document repeats counts once
        row, left = np.divmod(np.unique(row[hit] * len(values) + left[hit]), len(values))
        n = np.searchsorted(values, values[left], "right") - left
        item = members[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return {(rows[r], i) for r, i in zip(np.repeat(row, n).tolist(), item.tolist())}

    def _windows_met(self, rows: list[int], hashes: list[np.ndarray]) -> set[tuple[int, int]]:
        blocks = np.array([-(-len(h) // GRID) for h in hashes])
        ends = np.cumsum(blocks)
        wide = max(k for k, _ in self.classes)
        total = int(ends[-1])
        at = np.concatenate([np.arange(len(h)) + GRID * (e - n) for h, e, n in zip(hashes, ends, blocks)])
        flat = np.concatenate(hashes)
        a, b = _factors()
        grid = np.full(total * GRID, _TOP, np.uint64)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(HASHES):
            grid[at] = flat * a[j] + b[j]
            low = grid[0::GRID].copy()
            for i in range(1, GRID):
                np.minimum(low, grid[i::GRID], out=low)
            low = np.concatenate([low, np.full(wide, _TOP, np.uint64)])
            span = 1
            for k, per_hash in self.classes:  # ascending
                while span * 2 <= k:
                    low = np.minimum(low, np.concatenate([low[span:], np.full(span, _TOP, np.uint64)]))
                    span *= 2
                window = low[:total]
                if k > span:
                    window = np.minimum(window, np.concatenate([low[k - span :], np.full(k - span, _TOP, np.uint64)])[:total])
                values, members, seen = per_hash[j]
                some = np.flatnonzero(seen[(window & np.uint64(0xFFFF)).astype(np.int64)])
                if len(some):
                    left = np.searchsorted(values, window[some], "left")
                    right = np.searchsorted(values, window[some], "right")
                    for w, s, e in zip(some[right > left], left[right > left], right[right > left]):
                        met.append((np.full(e - s, w), members[s:e], np.full(e - s, k)))
        if not met:
            return set()
        start, item, k = (np.concatenate(x) for x in zip(*met))
        first = np.searchsorted(ends, start, "right")
        last = np.searchsorted(ends, np.minimum(start + k - 1, total - 1), "right")
        return {(rows[r], int(i)) for f, l, i in set(zip(first.tolist(), last.tolist(), item.tolist())) for r in range(f, l + 1)}

    def _verified(self, texts: list, met: set[tuple[int, int]]) -> list[tuple[int, int, float]]:
        out, last, own = [], -1, set()
        for row, item in sorted(met):
            if row != last:
                last, own = row, set(shingles(words_of(texts[row])))
            share = len(self.shingles[item] & own) / len(self.shingles[item])
            if share >= CONTAINED:
                out.append((row, item, share))
        return out


def _slices(benchmark: DataFrame) -> Iterator[Items]:
    rows: list[tuple] = []
    size = 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= SLICE_CHARS:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, containment: items with at least 0.8 of their distinct
    shingles in the document.

    Items of up to `EXACT` distinct shingles are always found. A match with a
    longer item whose shingles stand in one passage, not longer than the item's
    class limit plus one shingle, is found with a probability above 0.9998
    (above 0.999998 for a whole copy); what is returned is always exact.
    Null and empty texts match nothing. Rows with the same doc_id or item_id
    are matched each for itself. Empty tables give no row. Columns other than
    doc_id, item_id and text are ignored.
    """
    spark = docs.sparkSession
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, containment double"
    some = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    passes = []
    for items in _slices(benchmark):
        if not items.ids:
            continue
        sent = spark.sparkContext.broadcast(items)  # at most SLICE_CHARS of text

        def work(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            items = sent.value
            for frame in frames:
                hits = items.search(list(frame["text"]))
                if hits:
                    row, item, share = zip(*hits)
                    yield pd.DataFrame(
                        {"doc_id": frame["doc_id"].iloc[list(row)].to_numpy(), "item_id": [items.ids[i] for i in item], "containment": share}
                    )

        passes.append(some.mapInPandas(work, schema))
    return union_rows(*passes) if passes else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that contain no benchmark item."""
    for k, items in enumerate(_slices(benchmark)):
        if not items.ids:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                keep = np.ones(len(texts), bool)
                keep[[row for row, _, _ in sent.value.search(texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema)
        if k % 8 == 7:
            docs = staged(docs, "decontaminated")
    return docs
