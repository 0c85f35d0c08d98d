"""The stages of the corpus pipeline, each against what it has to do."""

import re
from collections import Counter

from data import MIDDLE
from pyspark.sql import functions as F
from test_pairs import plain_components, plain_fingerprint

import corpus_pipeline as P
from wareloom.llm import decontamination, mixing, quality, simhash
from wareloom.llm.common import table
from wareloom.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    docs = table(spark, MIDDLE, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_classifier", "near_duplicates", "decontaminate", "mix_sources", "token_blocks"]

    good = staged(stages["quality_classifier"](spark, docs, MIDDLE), "t")
    net = quality.train(docs, table(spark, MIDDLE, "labels"))
    assert good.columns == COLUMNS
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.scores(docs, net).where("predicted = 1").collect()}

    single = staged(stages["near_duplicates"](spark, good, MIDDLE), "t")
    groups = simhash.near_duplicates(good).collect()
    assert Counter(r.doc_id for r in single.collect()) == Counter({r.component_id for r in groups})
    assert single.columns == COLUMNS

    clean = staged(stages["decontaminate"](spark, single, MIDDLE), "t")
    hit = {r.doc_id for r in decontamination.contained_items(single, table(spark, MIDDLE, "benchmark")).collect()}
    assert hit and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - hit
    assert clean.columns == COLUMNS

    mixed = staged(stages["mix_sources"](spark, clean, MIDDLE), "t")
    assert mixed.columns == COLUMNS
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == Counter({r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken})

    last = stages["token_blocks"](spark, mixed, MIDDLE).collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in mixed.collect())


def test_part_of_a_text_is_its_first_words(spark, monkeypatch):
    text = "  a\tb c  d e\nf "
    monkeypatch.setattr(P.mixing, "mix", lambda docs: docs.select("doc_id", F.lit(6).cast("long").alias("size"), F.lit(10).cast("long").alias("taken")))
    docs = spark.createDataFrame([(1, text, "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.text for r in P.mix_sources(spark, docs, MIDDLE).collect())
    assert got[0] == text and [got[1].split(), len(got)] == [["a", "b", "c", "d"], 2]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_pipeline_odd_rows(spark, odd):
    docs = odd.select(*COLUMNS)
    stages = dict(P.STAGES)
    net = quality.train(docs, table(spark, MIDDLE, "labels"))
    good = staged(stages["quality_classifier"](spark, docs, MIDDLE), "t")
    assert rows_of(good) == Counter(tuple(r) for r in docs.collect() if net.score(r.text) >= 0.5)

    # the later stages get all odd rows, whatever the network thinks of them
    single = staged(stages["near_duplicates"](spark, docs, MIDDLE), "t")
    assert rows_of(single) <= rows_of(docs)
    prints = {r: plain_fingerprint(r[1]) for r in rows_of(docs)}
    kept = [prints[r] for r in rows_of(single)]
    near = plain_components([(a, b) for a in set(prints.values()) for b in set(prints.values()) if (a ^ b).bit_count() <= 2])
    assert {near[k] for k in kept} == {near[k] for k in prints.values()}  # every group has a document left
    with_id = [near[prints[r]] for r in rows_of(single).elements() if r[0] is not None]
    assert len(with_id) == len(set(with_id))  # and one with an id at most

    clean = staged(stages["decontaminate"](spark, docs, MIDDLE), "t")
    assert rows_of(clean) == rows_of(docs)  # none of them holds a benchmark item
    mixed = staged(stages["mix_sources"](spark, docs, MIDDLE), "t")
    assert mixed.columns == COLUMNS
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    whole, taken = Counter(), Counter()
    for r in docs.collect():
        whole[r.doc_id] += size(r.text)
    for r in mixed.collect():
        assert r.text and r.n_chars == len(r.text)
        taken[r.doc_id] += size(r.text)
    assert taken and all(taken[i] <= 2 * whole[i] for i in taken) and not {3, 4, 5} & set(taken)
    last = stages["token_blocks"](spark, docs, MIDDLE).orderBy("start").collect()
    assert Counter(r.doc_id for r in last) == Counter(r.doc_id for r in docs.collect())
    assert [r.start for r in last] == [sum(x.n_tokens for x in last[:k]) for k in range(len(last))]


def test_pipeline_empty_table(spark, empty):
    docs = empty.select(*COLUMNS)
    for name, stage in P.STAGES:
        out = stage(spark, docs, MIDDLE)
        assert out.collect() == []
        assert out.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if name == "token_blocks" else COLUMNS)


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_|", q)[0] for q in names} and "pipeline" in names
