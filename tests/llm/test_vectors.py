"""Neighbour search, whitening and the filter audit against plain versions."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from data import MIDDLE, SMALL

from wareloom.llm import filter_audit, neighbours, whitening
from wareloom.llm.common import table
from wareloom.llm.queries import op11_neighbours, op12_filter_audit, op13_whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, non-finite, zero, empty and extreme vectors, another length, repeated rows and ids, clashing names."""
    rows = [
        (0, [1.0, 0.0, 0.0]),
        (1, [2.0, 0.0, 0.0]),
        (2, [1.0, 0.0, 0.0]),
        (2, [1.0, 0.0, 0.0]),
        (3, [0.0, 1.0, 0.5]),
        (3, [0.0, -1.0, 0.5]),
        (None, [1.0, 0.5, 0.0]),
        (4, None),
        (5, [1.0, None, 0.0]),
        (6, [1.0, NAN, 0.0]),
        (7, [INF, 0.0, 0.0]),
        (8, [0.0, 0.0, 0.0]),
        (9, []),
        (50, [1.0, 1.0]),
        (51, [-1.0, 1.0]),
        (100, [1e-30, 1e-30, 0.0]),
    ]
    extra = [(*r, 1, k, 0.5, "x", 2, k, 0.1) for k, r in enumerate(rows)]
    kind = "vec_id long, embedding array<float>, label int, node long, score double, x string, dims int, query long, unit double"
    return spark.createDataFrame(extra, kind)


# neighbours


def plain_nearest(rows, wanted, k):
    """rows: (id, vector); nearest other ids of each wanted id, ties to the smaller id."""
    out = {}
    for q, a in wanted:
        best = {}
        for i, b in rows:
            if i != q and len(a) == len(b):
                s = math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(y * y for y in b))
                best[i] = max(best.get(i, -2), round(s, 12))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def test_neighbour_query_has_high_recall_and_exact_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, MIDDLE, "embeddings").collect()]
    want = plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {}
    for r in op11_neighbours(spark, MIDDLE).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == [1, 2, 3, 4, 5]
        assert [(-round(x[2], 12), x[1]) for x in found] == sorted((-round(x[2], 12), x[1]) for x in found)
        truth = dict(plain_nearest(rows, [(q, dict(rows)[q])], len(rows))[q])
        assert all(abs(truth[i] - s) < 1e-9 for _, i, s in found)
        hits += len({x[1] for x in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def clustered(seed, n):
    """Loose vectors, a tight cluster of a third of all, and copies of one vector."""
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, 24))
    v[: n // 3] = v[0] + 0.02 * draw.normal(size=(n // 3, 24))
    v[n // 3 : n // 3 + n // 10] = v[n // 3]
    order = draw.permutation(n)
    return [(int(i), [float(x) for x in v[j]]) for i, j in enumerate(order)]


def test_descent_finds_what_small_blocks_miss(spark, monkeypatch):
    """With blocks, entries and lists far smaller than the table the rounds and the walk have to find the rest."""
    for name, value in (("LEAF", 24), ("TREES", 3), ("ENTRIES", 8), ("STARTS", 2), ("NEIGHBOURS", 16), ("BEAM", 64), ("ENOUGH", 0.01)):
        monkeypatch.setattr(neighbours, name, value)
    rows = clustered(1, 1500)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph = neighbours.build(vectors)
    asked = vectors.where("vec_id % 25 = 0").selectExpr("vec_id AS query_id", "embedding")
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    got = {}
    for r in neighbours.search(graph, asked).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 25):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        hits += len(got[q] & set(np.lexsort((np.arange(1500), -s))[:5].tolist()))
    assert hits >= 0.9 * 5 * 60
    # queries that are not in the table
    draw = np.random.default_rng(5)
    new = [(i, (u[draw.integers(1500)] + 0.1 * draw.normal(size=24)).tolist()) for i in range(10_000, 10_040)]
    hits = 0
    found = neighbours.search(graph, spark.createDataFrame(new, "query_id long, embedding array<double>")).collect()
    for q, v in new:
        s = np.round(u @ np.array(v), 12)
        hits += len({r.vec_id for r in found if r.query_id == q} & set(np.lexsort((np.arange(1500), -s))[:5].tolist()))
    assert hits >= 0.85 * 5 * 40


def test_neighbours_odd_rows(spark, odd_vectors):
    graph = neighbours.build(odd_vectors, keep=6)
    asked = odd_vectors.selectExpr("vec_id AS query_id", "embedding", "label AS rank")
    got = {}
    for r in neighbours.search(graph, asked, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    half = round(math.sqrt(0.5), 6)
    assert got[0] == [(1, 1.0), (2, 1.0), (100, half), (3, 0.0)]
    assert got[2] == [(0, 1.0), (1, 1.0), (100, half), (3, 0.0)]
    assert got[50] == [(51, 0.0)] and got[51] == [(50, 0.0)]
    assert got[100][:3] == [(0, half), (1, half), (2, half)]
    assert sorted(got) == [0, 1, 2, 3, 50, 51, 100]
    none = odd_vectors.where("false")
    assert neighbours.search(neighbours.build(none), asked).collect() == []
    assert neighbours.search(graph, asked.where("false")).collect() == []


# whitening


def plain_whitening(rows, weights="one", components=4):
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], dtype=np.int64)
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "counts" else np.ones_like(counts)
    n, s = w.sum(), w @ distinct
    c = distinct - s / n
    v = (c * w[:, None]).T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, ((n * x.astype(object) - s) ** 2).sum(axis=1), (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_equals_plain_version(spark, weights):
    rows = clustered(2, 400)
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), weights=weights).toPandas()
    n, deviation, white, explained = plain_whitening(rows, weights)
    got = got.sort_values(["vec_id", "component"])
    assert len(got) == 1600 and set(got["n"]) == {n}
    assert (got["deviation"].to_numpy().reshape(-1, 4) == deviation[:, None]).all()
    mine = got["whitened"].to_numpy().reshape(-1, 4)
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * sign).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 4), explained, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_query_covers_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, MIDDLE, "embeddings").collect()]
    got = op13_whitening(spark, MIDDLE).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, _ = plain_whitening(sorted(rows))
    assert (got["deviation"].to_numpy().reshape(-1, 4) == deviation[:, None]).all() and set(got["n"]) == {n}
    assert np.abs(np.abs(got["whitened"].to_numpy().reshape(-1, 4)) - np.abs(white)).max() < 1e-6


def test_whitening_odd_rows(spark, odd_vectors):
    got = whitening.whiten(odd_vectors.where("vec_id is null or vec_id <> 100")).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert {i: len(x) for i, x in by.items()} == {0: 3, 1: 3, 2: 6, 3: 6, None: 3, 8: 3, 50: 2, 51: 2}
    assert {r.n for r in by[0]} == {6} and {r.n for r in by[50]} == {2}
    # two distinct vectors span one dimension: the second component has no spread
    flat = {r.component: r for r in by[50]}
    assert abs(abs(flat[1].whitened) - 1) < 1e-9 and abs(flat[1].explained - 1) < 1e-9
    assert flat[2].whitened is None and flat[2].explained == 0
    assert whitening.whiten(odd_vectors.where("false")).collect() == []
    one = whitening.whiten(odd_vectors.where("vec_id in (0, 2)")).collect()
    assert len(one) == 9 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)


def test_whitening_keeps_wide_sums_exact(spark):
    big = [(i, [float(1 << 40) + i, -float(1 << 41) * (i % 3), 0.5 * i]) for i in range(5)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    _, deviation, _, _ = plain_whitening(big)
    assert got == {i: int(d) if d < 1 << 63 else None for i, d in enumerate(deviation)}


# filter audit


def plain_masks(rows):
    first = {}
    for r in rows:
        if r.doc_id is not None:
            t = r.text or ""
            first[t] = min(first.get(t, r.doc_id), r.doc_id)
    for r in rows:
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        caps = sum("A" <= c <= "Z" for c in t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * caps > 5 * len(t), bool(set("#$%&*|") & set(t)), r.doc_id is not None and r.doc_id > first[t]]
        yield r, sum(1 << k for k, f in enumerate(fails) if f)


def plain_audit(rows, labels):
    """Walks every order, document by document."""
    good, toxic = ({x.doc_id for x in labels if x.doc_id is not None and x[c] == 1} for c in ("quality", "toxic"))
    masks = [(r.source or "", r.doc_id, m) for r, m in plain_masks(rows)]
    out, shapley = {}, {}
    for order in itertools.permutations("ABCDE"):
        for part, doc, mask in masks:
            gone = False
            for step, f in enumerate(order, 1):
                x = out.setdefault((part, "".join(order), step), [0] * 6)
                hit = mask >> "ABCDE".index(f) & 1
                x[2] += bool(hit and gone)
                x[3] += mask == 1 << "ABCDE".index(f)
                if hit and not gone:
                    gone = True
                    x[1] += 1
                    x[4] += doc in good
                    x[5] += doc in toxic
                    shapley[part, f] = shapley.get((part, f), 0) + 1
                x[0] += not gone
    return {k: (*v, shapley.get((k[0], k[1][k[2] - 1]), 0)) for k, v in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_filter_audit_equals_plain_version(spark):
    want = plain_audit(table(spark, SMALL, "documents").collect(), table(spark, SMALL, "labels").collect())
    assert as_dict(op12_filter_audit(spark, SMALL)) == want


def test_filter_audit_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, 1), (77, 1, 1)], "doc_id long, quality int, toxic int"
    )
    assert as_dict(filter_audit.audit(odd, labels)) == plain_audit(odd.collect(), labels.collect())
    got = {(r.doc_id, r.mask) for r in filter_audit.flags(odd).collect()}
    assert got == {(r.doc_id, m) for r, m in plain_masks(odd.collect())}
    assert filter_audit.audit(empty, labels).collect() == []
    assert as_dict(filter_audit.audit(odd, labels.where("false")))[("a", "ABCDE", 1)][4:6] == (0, 0)


def test_sketch_clears_only_unique_texts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BLOCKS", 2)  # sketches are passed on in pieces
    draw = random.Random(4)
    texts = [f"text {draw.randrange(30_000)}" for _ in range(20_000)]
    rows = filter_audit._hashed(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    blocks = filter_audit.blocks_for(len(texts))
    assert blocks == 8
    possible = {r.doc_id for r in filter_audit._possible_repeats(rows, filter_audit.sketch(rows.select("h"), blocks), blocks).collect()}
    counts = {t: 0 for t in texts}
    for t in texts:
        counts[t] += 1
    repeated = {i for i, t in enumerate(texts) if counts[t] > 1}
    assert repeated <= possible
    assert len(possible - repeated) < 0.03 * len(texts)
