"""Classifiers, language, licenses, mixing and token output."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from data import LARGER, MIDDLE, SMALL
from pyspark.sql import functions as F

from wareloom.llm import lang_id, licenses, mixing, quality, token_output, toxicity
from wareloom.llm.common import fold, table, whole_groups


def test_folds_are_crc32_of_the_id_as_text(spark):
    got = spark.range(200).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


def test_whole_groups_never_cuts_a_key():
    import pandas as pd

    rows = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5], "v": range(11)})
    for size in (1, 2, 3, 5, 11):
        out = list(whole_groups((rows.iloc[i : i + size] for i in range(0, 11, size)), ["k"]))
        assert pd.concat(out)["v"].tolist() == list(range(11))
        keys = [set(f["k"]) for f in out]
        assert sum(map(len, keys)) == 5


# classifiers


@pytest.mark.parametrize("kind,label,folder,least", [(quality, "quality", MIDDLE, 0.95), (toxicity, "toxic", LARGER, 0.96)])
def test_held_out_accuracy(spark, kind, label, folder, least):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = kind.scores(docs, kind.train(docs, labels))
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    held = got.where("held_out").join(labels, "doc_id")
    n, right = held.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col(label)).cast("int"))).first()
    assert n > 50 and right / n >= least


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_held_out_labels_are_not_used(spark, kind):
    docs = table(spark, SMALL, "documents")
    labels = table(spark, SMALL, "labels")
    label = "quality" if kind is quality else "toxic"
    lied = labels.withColumn(label, F.when(fold(F.col("doc_id"), kind.FOLDS) == kind.HELD, 1 - F.col(label)).otherwise(F.col(label)))
    one, two = (kind.scores(docs, kind.train(docs, x)).orderBy("doc_id").collect() for x in (labels, lied))
    assert one == two


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifier_odd_rows(spark, odd, empty, kind):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 1, 0), (7, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = kind.train(odd, labels)
    got = kind.scores(odd, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4]
    assert kind.scores(empty, kind.train(empty, labels.where("false"))).collect() == []
    none = kind.scores(odd, kind.train(odd, labels.where("false"))).collect()
    assert {r.score for r in none} == {0.5}


def plain_quality(net, text):
    """The network window by window: maxima of overlapping chunks, the largest and the mean of each filter, one logistic unit."""
    data = text.encode()
    starts = range(0, max(1, -(-(len(data) - 8) // 4) + 1))
    windows = [[data[4 * p + k] if 4 * p + k < len(data) else 0 for k in range(8)] for p in starts]
    total = net.bias
    for f in range(quality.FILTERS):
        at = [sum(float(net.table[b][d]) * float(net.filters[8 * k + d][f]) for k, b in enumerate(w) for d in range(8)) + float(net.shift[f]) for w in windows]
        halves = [max(0.0, *at[h : h + 64]) for h in range(0, len(at), 64)]
        chunks = [max(pair) for pair in zip(halves, halves[1:])] or halves
        total += float(net.out[f]) * max(chunks) + float(net.out[quality.FILTERS + f]) * sum(chunks) / len(chunks)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_quality_equals_a_plain_network():
    net = quality.fit([(1, "good words here. " * 30, 1), (2, "@@@@@@@@ " * 60, 0)], epochs=8)
    draw = random.Random(9)
    for n in (0, 1, 7, 8, 9, 12, 13, 255, 256, 263, 264, 265, 520, 1200):
        text = "".join(draw.choice("good wrds@é.\n") for _ in range(n))
        assert net.score(text) == pytest.approx(plain_quality(net, text), abs=1e-4), n


def plain_ftrl(rows, epochs):
    """FTRL-proximal place by place: rows of (places, label)."""
    z, n, bias = {}, {}, 1 << toxicity.BITS
    n1 = sum(y for _, y in rows)
    share = {0: 0.5 * len(rows) / (len(rows) - n1), 1: 0.5 * len(rows) / n1}

    def weight(p):
        zp, rate = z.get(p, 0.0), (toxicity.BETA + math.sqrt(n.get(p, 0.0))) / toxicity.ALPHA
        if p == bias:
            return -zp / rate
        return 0.0 if abs(zp) <= toxicity.L1 else (math.copysign(toxicity.L1, zp) - zp) / (rate + toxicity.L2)

    draw = np.random.default_rng(5)
    for _ in range(epochs * max(1, 1000 // len(rows))):
        for i in draw.permutation(len(rows)):
            places, y = [*rows[i][0], bias], rows[i][1]
            w = {p: weight(p) for p in places}
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()))))) - y) * share[y]
            for p in places:
                old = n.get(p, 0.0)
                z[p] = z.get(p, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[p]
                n[p] = old + g * g
    return {p: weight(p) for p in z if p != bias and weight(p)}, weight(bias)


def test_toxicity_equals_plain_ftrl():
    draw = random.Random(3)
    calm, rude = ["table", "green", "river", "walks", "slowly"], ["awful", "stupid", "hate"]
    sample = [(i, " ".join(draw.choice(calm + rude * (i % 2)) for _ in range(12)), i % 2) for i in range(60)]
    got = toxicity.fit(sample, epochs=2)
    weights, bias = plain_ftrl([(sorted(set(toxicity.features(t).tolist())), y) for _, t, y in sample], 2)
    assert weights and got.places.tolist() == sorted(weights)
    assert got.values == pytest.approx([weights[p] for p in sorted(weights)], rel=1e-4, abs=1e-5)
    assert got.bias == pytest.approx(bias, rel=1e-6)
    text = sample[1][1]
    total = bias + sum(weights.get(p, 0.0) for p in set(toxicity.features(text).tolist()))
    assert got.score(text) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_quality_chunks_cover_the_whole_text(monkeypatch):
    net = quality.fit([(1, "good words here. " * 30, 1), (2, "@@@@@@@@ " * 60, 0)], epochs=20)
    text = "plain " * 3000
    whole = net.score(text)
    monkeypatch.setattr(quality, "PIECE", 4 * quality.HALF * quality.STRIDE)
    assert net.score(text) == pytest.approx(whole, abs=1e-5)
    assert net.score(text + "@@@@@@@@ ") != net.score(text)


def test_good_documents_keep_their_columns(spark, odd):
    net = quality.fit([(1, "good words here. " * 30, 1), (2, "@@@@@@@@ " * 60, 0)], epochs=5)
    kept = quality.good(odd, net)
    scores = quality.scores(odd, net).where("score >= 0.5")
    assert kept.columns == odd.columns and kept.count() == scores.count()


# language


def plain_phrases(text, known):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrases_equal_plain_parse(monkeypatch):
    draw = random.Random(2)
    make = lambda n: bytes(draw.choice([0, 1, 2, 3, 30]) for _ in range(n))
    learned = {"a": make(300), "b": make(40), "c": b"\x05\x06", "d": make(2000)}
    texts = [make(n) for n in (0, 1, 5, 100, 511, 512, 513, 1024, 1025, 5000)] + [b"\x07\x08\x05\x06\x05"]
    texts.append(make(200) + learned["d"][100:1900] + make(300) + learned["d"][:700])  # phrases over several blocks
    want = [[plain_phrases(t, learned[k]) for k in "abcd"] for t in texts]
    assert lang_id.Languages(learned).phrases(texts).tolist() == want
    monkeypatch.setattr(lang_id, "LANES", 3)
    monkeypatch.setattr(lang_id, "BLOCK", 7)
    assert lang_id.Languages(learned).phrases(texts).tolist() == want


def test_languages_are_learned_from_whole_rows(spark):
    rows = [(i, "ab " * (2_000 + i), "x") for i in range(40)] + [(100, "long " * 20_000, "y"), (101, None, "z"), (None, "q", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.learn(docs)
    learned = dict(zip(model.names, model.texts))
    assert set(learned) <= {"x", "y"} and len(learned["x"]) >= lang_id.LEARN_BYTES
    # three rows of 3 * (2,000 + i) bytes with a byte between them: none is cut
    assert len(learned["x"]) < lang_id.LEARN_BYTES + 3 * 2_040 and (len(learned["x"]) - 2) % 3 == 0


def test_languages_of_held_out_documents(spark):
    docs = table(spark, MIDDLE, "documents")
    got = lang_id.predictions(docs, lang_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(odd, empty):
    model = lang_id.learn(odd)
    got = lang_id.predictions(odd, model).collect()
    assert len(got) == 12
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {3, 4, 5, 8} and all(r.lang_pred in (*model.names, "und") for r in got)
    assert lang_id.predictions(empty, model).collect() == []
    assert {r.lang_pred for r in lang_id.predictions(odd, lang_id.learn(empty)).collect()} == {"und"}


# licenses


def plain_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places_equal_plain_version(spark):
    docs = table(spark, MIDDLE, "documents")
    want = {r.doc_id: plain_base(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_detections_and_suppression(spark):
    cases = [
        ("cc by cc-BY CC--by x", "cc-by", "cc-by"),
        ("under the GNU General Public License, version 3 or later. Gpl here", "gpl", "gpl,gpl-3-or-later"),
        ("Licensed under the Apache License, Version 2.0", "", "apache-2.0,license-mention"),
        ("ALL RIGHTS RESERVED all rights reserved", "reserved", "reserved"),
        ("CC BY-NC-SA 4.0", "cc-by", "cc-by,cc-by-nc-sa-4.0"),
        ("permitted mitigation disc", "", ""),
        ("K cc bý", "", ""),
        ("The MIT License. Permission is hereby granted, free of charge", "", "mit"),
        ("gpl gpl gpl", "", "gpl"),
        (None, "", ""),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "", "lgpl-2.1-or-later"),
        ("GNU Lesser General Public License 2.1 only", "gpl", "gpl,lgpl-2.1-only"),
        ("the PHP License, version 3.01", "", "php-3.01"),
        ("Business Source License 1.1; Server Side Public License v 1", "", "busl-1.1,sspl-1"),
        ("a redistributions of source code must retain", "", "bsd"),
        ("You may not use this file except in compliance with the License.", "", "apache-2.0"),
        ("released under EUPL 1.2 and the CeCILL Free Software License Agreement 2.1", "", "cecill-2.1,eupl-1.2"),
        ("no such thing: GPL 2.1, LGPL 1, AGPL 2, Eclipse Public License 1.1", "", "agpl,epl,gpl-2,lgpl"),
    ]
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, (text, base, labels) in enumerate(cases):
        r = got[i]
        assert (r.base_labels, r.labels) == (base, labels), text
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == plain_base(text)[:4]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    assert [(f.start, f.end) for f in got[8].found] == [(0, 1), (1, 2), (2, 3)]


def test_license_odd_rows(odd, empty):
    got = licenses.scan(odd).collect()
    assert len(got) == 12
    assert {r.doc_id: r.n_words for r in got if r.doc_id in (3, 4, 5, 6, 7)} == {3: 0, 4: 0, 5: 0, 6: 1, 7: 120_000}
    assert licenses.scan(empty).collect() == []


# mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_meets_its_targets(spark):
    docs = table(spark, MIDDLE, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    targets = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(size)
    taken = {}
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[source[r.doc_id]])
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - t) <= max(4 * mixing.BLOCK_WORDS, 0.01 * t) for s, t in targets.items())
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_small_sources_meet_their_targets(spark):
    sizes = {"a": [100] * 1000, "b": [30, 40], "c": [3, 0, 7], "d": [1], "e": [64, 1], "f": [700, 1, 299], "g": [0], None: [11]}
    rows = [(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate((s, n) for s, every in sizes.items() for n in every)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    targets = plain_targets({s: sum(n) for s, n in sizes.items()})
    source = {k: s for k, _, s in rows}
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s, t in targets.items():
        taken = sum(r.taken for r in got if source[r.doc_id] == s)
        assert abs(taken - t) <= 0.51, s
    assert targets["b"] == 140


def plain_mix(rows):
    """rows: (doc_id, source, size, order). Walks the schedule slot by slot; words taken of each document."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    goals = {s: min(math.floor(t + 0.5), 2 * sizes[s]) for s, t in plain_targets(sizes).items()}
    words = {s: min(64, max(1, sizes[s] // 1024)) for s in sources}
    blocks, owed = {}, []
    for s in sources:
        queue = [r for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[3] >> 52, r[3], r[0], r[2])) for _ in range(r[2])]
        blocks[s] = [queue[i : i + words[s]] for i in range(0, len(queue), words[s])]
        n = goal = 0
        while goal < goals[s]:
            goal += len(blocks[s][n % len(blocks[s])])
            n += 1
        owed += [s] * n
    points = sorted(range(len(owed)), key=lambda k: (k * 1640531527 % (1 << 32), k))
    owner = dict(zip(points, owed))
    taken, rank, left = {r[0]: 0 for r in rows}, dict.fromkeys(sources, 0), dict(goals)
    for slot in range(len(owed)):
        s = owner[slot]
        for r in blocks[s][rank[s] % len(blocks[s])][: left[s]]:
            taken[r[0]] += 1
            left[s] -= 1
        rank[s] += 1
    return taken


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_mix_equals_a_plain_schedule(spark, folder):
    docs = table(spark, folder, "documents")
    order = F.xxhash64(F.lit("mix"), "doc_id", mixing.word_count(F.col("text")))
    rows = [tuple(r) for r in docs.select("doc_id", "source", mixing.word_count(F.col("text")), order).collect()]
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == plain_mix(rows)


def test_schedule_spreads_each_source_evenly(spark):
    targets = mixing.source_targets(spark.createDataFrame([("a", 90_000), ("b", 200_000), (None, 100_000)], "source string, source_size long"))
    slots = [r.sid for r in mixing.schedule(targets).orderBy("slot").collect()]
    for sid in set(slots):
        share, seen = slots.count(sid) / len(slots), 0
        for k, s in enumerate(slots, 1):
            seen += s == sid
            assert abs(seen - share * k) < 6


def test_schedule_fills_every_slot_once(spark):
    targets = mixing.source_targets(spark.createDataFrame([("a", 900), ("b", 50_000), (None, 3_000)], "source string, source_size long"))
    slots = mixing.schedule(targets, 10).orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(len(slots)))
    for sid in {r.sid for r in slots}:
        assert [r.rank for r in slots if r.sid == sid] == list(range(sum(r.sid == sid for r in slots)))


def test_mix_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == 12 and sum(r.doc_id == 2 for r in got) == 2
    assert all(r.taken == 0 for r in got if r.doc_id in (3, 4, 5))
    assert mixing.mix(empty).collect() == []


# token output


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_output.vocabulary())


def test_ids_equal_the_librarys():
    draw, whole, own = random.Random(4), library(), token_output.Encoder(token_output.vocabulary())
    letters = " \n\t\r  aé1,.'stll ß²\xa0\x0bZ\x1c\x85Ω中😀<|endoftext|>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 16))) for _ in range(5000)] + ["x <|endoftext|> y", None]
    got = own(texts)
    assert own.plain
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, own.kind).tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000, 5001])
def test_coder_round_trip_and_checkpoints(monkeypatch, n):
    monkeypatch.setattr(token_output, "CHECKPOINT_STEPS", 16)
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.geometric(0.02, n), 400) * 3
    counts = {int(s): int(c) for s, c in zip(*np.unique(ids, return_counts=True))} | {77_000: 1}
    symbols, freq = token_output.frequencies(counts)
    assert freq.sum() == 1 << token_output.SCALE_BITS and freq.min() >= 1
    coder = token_output.Coder(symbols, freq, lanes=8)
    block = coder.pack(ids, [n])
    lengths, back = coder.unpack(block)
    assert lengths.tolist() == [n] and back.tolist() == ids.tolist()
    for mark in range(-(-n // (8 * 16))):
        assert coder.unpack(block, mark)[1].tolist() == ids[mark * 8 * 16 :].tolist()
    for at in (5, len(block) // 2, len(block) - 3):
        with pytest.raises(ValueError):
            coder.unpack(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])


def test_blocks_hold_the_ids_in_order(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    token_output.write(docs, str(tmp_path / "out"), block_tokens=3000)
    got = {r.doc_id: r for r in token_output.read(spark, str(tmp_path / "out")).collect()}
    at, whole = 0, library()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = whole.encode(r.text, add_special_tokens=False).ids + [0]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids) == (at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_output_odd_rows(odd, empty):
    got = token_output.round_trip(odd).collect()
    assert len(got) == 12 and sorted(r.n_tokens for r in got if r.doc_id in (3, 4)) == [1, 1]
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert token_output.round_trip(empty).collect() == []


def test_every_license_rule_finds_its_own_words():
    """Each rule is a pattern that can match within its window, and no license has a version that does not exist."""
    rules = licenses._families()
    assert len(set(rules)) == len(rules)
    for label, word, regex, priority, weight in rules:
        pattern = regex.replace("@", licenses.MARK + word)
        assert pattern.count(licenses.MARK) >= 1 and 1 <= priority <= licenses.PRIORITIES and 0 < weight <= 1
        re.compile(rf"(?<= ){pattern}(?= )")
        assert len(re.sub(r"[(|?:)]", " ", regex).split()) <= 2 * licenses.REACH, regex
    versions = {label for label, *_ in rules}
    assert not versions & {"gpl-2.1", "lgpl-1.0", "lgpl-1", "agpl-2.0", "agpl-2", "agpl-2.1", "epl-1.1", "cddl-2.0"}
    assert {"gpl-3.0-or-later", "lgpl-2.1-only", "agpl-3.0", "cc-by-nc-sa-4.0", "eupl-1.2", "mpl-1.1"} <= versions
