"""Line dedup, SimHash, decontamination and search against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
import xxhash
from data import MIDDLE, SMALL

from wareloom.llm import decontamination, line_dedup, search, simhash
from wareloom.llm.common import table
from wareloom.llm.components import components


def ids(df, column="doc_id"):
    return [r[column] for r in df.collect()]


# line dedup


def plain_lines(rows):
    order = sorted(((r.doc_id, p, frozenset(re.split(r"[\x20\x09-\x0D]+", line.lower())) - {""}) for r in rows if r.text is not None for p, line in enumerate(r.text.split("\n"))), key=lambda x: (x[0] is not None, x[0], x[1]))
    seen, gone = [], collections.Counter()
    index = collections.defaultdict(list)
    for doc, _, w in order:
        if not w:
            continue
        shared = collections.Counter(j for q in w for j in index[q])
        if any(n >= 0.8 * (len(w) + len(seen[j]) - n) - 1e-9 for j, n in shared.items()):
            gone[doc] += 1
        for q in w:
            index[q].append(len(seen))
        seen.append(w)
    return gone


def test_line_dedup_equals_plain_version(spark):
    docs = table(spark, SMALL, "documents")
    gone = plain_lines(docs.collect())
    got = {r.doc_id: r for r in line_dedup.line_report(docs).collect()}
    assert len(got) == docs.count()
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == dict(gone)


def test_line_dedup_keeps_the_first_of_similar_lines(spark):
    base = [f"word{i}" for i in range(20)]
    near = base[:18] + ["other1", "other2"]
    far = base[:15] + [f"new{i}" for i in range(5)]
    texts = ["\n".join([" ".join(base), " ".join(far), "a", ""]), " ".join(reversed(near)) + "\nb", "A\n\n" + " ".join(far[::-1])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert kept == {0: texts[0], 1: "b", 2: ""}


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.line_report(odd).collect()
    assert len(got) == 12
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in got if r.doc_id in (1, 2, 3, 4, 5)) == [
        (1, 1, 0), (2, 1, 1), (2, 1, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0)]
    assert line_dedup.line_report(empty).collect() == []
    back = line_dedup.without_repeated_lines(odd)
    assert back.columns == odd.columns and back.count() == 12


def test_line_dedup_reads_again_only_lines_of_pairs(spark):
    rows = [(i, f"common\tword{i} other{i} third{i}\nsecond{i} line{i}") for i in range(50)] + [(None, "common word1 other1 third1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ends = spark.createDataFrame([(3, 0), (7, 1), (None, 0)], "d long, p int")
    some = line_dedup.lines(docs).where(line_dedup._marks(ends, "test-marks")).collect()
    found = {(r.doc_id, r.pos) for r in some}
    assert {(3, 0), (7, 1), (None, 0)} <= found and len(found) < 10


# SimHash


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_simhash_equals_plain_version(spark):
    docs = table(spark, SMALL, "documents")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    near = [(a, b) for a, x in prints.items() for b, y in prints.items() if (x ^ y).bit_count() <= 2]
    want = plain_components(near)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("split_over", [4096, 3])
def test_no_link_is_missed(spark, monkeypatch, split_over):
    monkeypatch.setattr(simhash, "SPLIT_OVER", split_over)
    draw = random.Random(3)
    values = {draw.getrandbits(64) for _ in range(60)}
    for _ in range(6):  # chains and balls of close fingerprints
        v = draw.getrandbits(64)
        for _ in range(30):
            w = v
            for _ in range(draw.randint(1, 4)):
                w ^= 1 << draw.randrange(64)
            values.add(w)
            v = w if draw.random() < 0.3 else v
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = plain_components([(a, b) for a in signed for b in signed if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    got = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long"))).collect()
    found = {r.node: r.root for r in got}
    assert {v: found.get(v, v) for v in signed} == want


def test_distance_table_gives_block_ones():
    bits = np.array([0, 1, 3, 0xF0F0F0F0F0F0F0F0, (1 << 64) - 1], np.uint64)
    ones = simhash.block_ones(simhash.distance_table(bits))
    assert ones.tolist() == [[(int(b) >> 2 * i & 3).bit_count() for i in range(32)] for b in bits]


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(links).collect()} == {0}
    assert components(links.where("false")).collect() == []


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 12
    parts = {(r.doc_id, r.component_id) for r in got}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)} <= parts
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {1, 3, 6, 7} <= set(ids(kept)) and not {2, 4, 5} & set(ids(kept)) and None in ids(kept)


# decontamination


def plain_contained(docs, items):
    want = {}
    texts = [(r.doc_id, set(decontamination.shingles(decontamination.words_of(r.text)))) for r in docs]
    for item in items:
        s = set(decontamination.shingles(decontamination.words_of(item.text)))
        for doc, own in texts:
            if s and len(s & own) >= 0.8 * len(s):
                want[doc, item.item_id] = len(s & own) / len(s)
    return want


def test_contained_items_equal_plain_version(spark):
    docs, items = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "benchmark")
    want = plain_contained(docs.collect(), items.collect())
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contained_items(docs, items).collect()}
    assert want and got == want


def test_changed_passages_of_all_sizes_are_found(spark):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([5, 6, 12, 13, 20, 21, 40, 70, 150, 300])]
    docs = []
    for k, text in items:
        w = text.split()
        if len(w) > 30:
            w[len(w) // 2] = "changed"
        around = [word() for _ in range(5000)]
        at = draw.randrange(5000)
        docs.append((100 + k, " ".join(around[:at] + [x.upper() + "," for x in w] + around[at:])))
    docs.append((99, " ".join(word() for _ in range(3000))))
    got = decontamination.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(100 + k, k) for k, _ in items]


def test_short_items_are_always_found():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    for n in [*range(1, 19), 33]:
        words = [word() for _ in range(n + 4)]
        items = decontamination.Items([("x", " ".join(words))])
        texts = []
        for k in range(300):
            around = [word() for _ in range(200)]
            at = draw.randrange(200)
            # every other copy of five shingles or more lacks its first one
            texts.append(" ".join(around[:at] + words[k % 2 if n > 4 else 0 :] + around[at:]))
        assert [row for row, _, _ in items.search(texts)] == list(range(300)), n


def test_short_items_equal_plain_version(spark):
    draw = random.Random(6)
    words = lambda least, most: " ".join(draw.choice("abc") for _ in range(draw.randint(least, most)))
    docs = spark.createDataFrame([(k, words(0, 60)) for k in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(k, words(1, 20)) for k in range(200)], "item_id long, text string")
    want = plain_contained(docs.collect(), items.collect())
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.contained_items(docs, items).collect()}
    assert want and got == want
    hit = {doc for doc, _ in want}
    assert sorted(ids(decontamination.decontaminated(docs, items))) == [k for k in range(400) if k not in hit]


def test_decontamination_odd_rows(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog"), (1, "ONE!"), (None, "w1 w2 w3 w4 w5 w6"), (4, None), (5, ""), (6, "lazy dog")],
        "item_id long, text string",
    )
    want = [(1, 1), (2, 1), (2, 1), (6, 1), (7, None)]
    key = lambda x: (x[0], x[1] or 0)
    assert sorted(((r.doc_id, r.item_id) for r in decontamination.contained_items(odd, items).collect()), key=key) == want
    monkeypatch.setattr(decontamination, "SLICE_CHARS", 10)  # many passes give the same
    assert sorted(((r.doc_id, r.item_id) for r in decontamination.contained_items(odd, items).collect()), key=key) == want
    clean = decontamination.decontaminated(odd, items)
    assert clean.columns == odd.columns and sorted(i or 0 for i in ids(clean)) == [0, 3, 4, 5, 8, 9, 9]
    assert decontamination.contained_items(empty, items).count() == decontamination.contained_items(odd, items.where("false")).count() == 0
    assert decontamination.decontaminated(odd, items.where("false")).count() == 12


# search


def plain_search(docs, queries, k=10):
    bag = [(r.doc_id, collections.Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (r.text or "").encode().lower()))) for r in docs]
    n, size = len(bag), [sum(c.values()) for _, c in bag]
    average = sum(size) / n
    found = collections.Counter(w for _, c in bag for w in c)
    out = {}
    for q, text in queries:
        scores = []
        terms = set(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()))
        for (doc, c), length in zip(bag, size):
            s = sum(math.log1p((n - found[t] + 0.5) / (found[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / average)) for t in terms if t in c)
            if s:
                scores.append((-round(s, 4), doc is not None, doc))
        out[q] = [d for _, _, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard,block", [(32_768, 16_384), (40, 3)])
def test_search_equals_plain_version(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    monkeypatch.setattr(search, "CUT_CHARS", 50_000 if shard == 40 else search.CUT_CHARS)
    docs = table(spark, SMALL, "documents")
    asked = docs.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text")
    want = plain_search(docs.collect(), [(r.query_id, r.text) for r in asked.collect()])
    got = collections.defaultdict(list)
    for r in search.search(docs, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    assert got == want


def test_search_odd_rows(spark, odd, empty):
    asked = spark.createDataFrame([(1, "lazy Dog"), (2, None), (3, ""), (4, "zzz"), (5, "one w7")], "query_id long, text string")
    got = [(r.query_id, r.doc_id) for r in search.search(odd, asked).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1), (1, 2), (1, 2), (5, 7), (5, 6)]  # 3,000 times w7 weighs more than one "one"
    assert search.search(empty, asked).count() == 0 and search.search(odd, asked.where("false")).count() == 0


def test_search_cuts_the_documents_once_for_all_blocks_of_queries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 2)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, f"w{i} w{i % 3} all") for i in range(40)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    reads = []
    keep = search.staged
    monkeypatch.setattr(search, "staged", lambda df, name: reads.append(any("documents.parquet" in f for f in df.inputFiles())) or keep(df, name))
    got = search.search(docs, docs.where("doc_id % 4 = 0").selectExpr("doc_id AS query_id", "text"))
    assert {r.query_id for r in got.collect()} == set(range(0, 40, 4))
    assert reads.count(False) == 5 and reads.count(True) == 2  # five blocks of answers; the queries, and the index


def test_search_shard_equals_full_scores():
    rng = np.random.default_rng(3)
    n, words = 1500, 400
    bags = np.minimum(rng.zipf(1.3, (n, 60)), words) - 1
    bags[700:] = bags[:800]  # copies tie
    pairs, times = np.unique(np.repeat(np.arange(n), 60) * words + bags.ravel(), return_counts=True)
    doc, term = pairs // words, pairs % words
    found = np.bincount(term, minlength=words)
    weight = np.log1p((n - found + 0.5) / (found + 0.5))
    row = np.full(words, -1, np.int32)
    often = np.flatnonzero(found * search.FREQUENT > n)
    row[often] = np.arange(len(often))
    lists = (doc.astype(np.int32), term.astype(np.int32), times.astype(np.float32))
    shard = search.Shard(list(range(n)), np.full(n, 60), [tuple(x[some] for x in lists) for some in (doc < 600, doc >= 600)], 60.0, weight, row)
    assert 0 < len(often) < words
    impact = np.zeros((n, words))
    impact[doc, term] = times.astype(np.float32) * np.float32(2.2) / (times.astype(np.float32) + np.float32(1.2))
    queries = [np.unique(b) for b in bags[:20]] + [often[:1], np.flatnonzero(row < 0)[:2], np.flatnonzero(found == 0)[:1]]
    for terms, weights, product in zip(queries, *shard.products(queries)):
        full = np.round(impact[:, terms] @ weight[terms], 6)
        tenth = max(np.sort(full)[-10], 1e-9)
        want = np.flatnonzero(full >= tenth)
        docs, scores = shard.top(terms, weights, product, 10)
        assert docs.tolist() == want.tolist() and np.allclose(scores, full[want], atol=2e-6)
        floor = float(np.sort(full)[-4])
        docs, _ = shard.top(terms, weights, product, 10, max(floor, 1e-9))
        assert docs.tolist() == np.flatnonzero(full >= max(floor, 1e-9)).tolist()


def test_search_counts_are_whole_at_every_size():
    for most in (0, 255, 256, 65_535, 65_536, 4_000_000_000):
        numbers = np.array([0, 1, most])
        assert search._unpacked(search._packed(numbers), 3).tolist() == numbers.tolist()
    assert len(search._unpacked(search._packed(np.empty(0, np.int64)), 0)) == 0
