"""Properties: order, skew and plan shape."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wareloom.functions.frames import union_rows
from wareloom.functions.text import unnest
from wareloom.operators import catalog, classify, colors, memory, near_duplicates, options, prices, urls
from wareloom.operators.ordering import numbered, previous, running_total
from wareloom.plans.inputs import Inputs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Inputs(spark, FOLDER)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_row_numbers_match_a_global_window(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 5003).alias("seq"), (F.col("id") % 3).alias("k"))
    df = df.withColumn("k", F.when(F.col("seq") < 2500, 0).otherwise(F.col("k")))
    want = df.withColumn("row_no", F.row_number().over(W.partitionBy("k").orderBy("seq")) - 1)
    assert rows_of(numbered(df, "seq", ["k"], width=100).select("seq", "k", "row_no")) == rows_of(
        want.select("seq", "k", "row_no")
    )
    total = running_total(df, F.col("k") + 1, "seq", width=50)
    spec = W.orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    want = df.withColumn("total", F.coalesce(F.sum(F.col("k") + 1).over(spec), F.lit(0)))
    assert rows_of(total.select("seq", "total")) == rows_of(want.select("seq", "total"))


def test_previous_crosses_ranges(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("k"), (F.col("id") * 3).alias("v"))
    got = previous(df, ["v"], "k", ["id"], F.floor(F.col("id") / 37)).select("id", "previous_v")
    want = df.withColumn("previous_v", F.lag("v").over(W.partitionBy("k").orderBy("id"))).select("id", "previous_v")
    assert rows_of(got) == rows_of(want)


def test_no_change_runs_across_days(spark):
    rng = random.Random(3)
    rows, start = [], 1_700_000_000
    for i in range(400):
        start += rng.choice([60, 3600, 90_000])
        rows.append((i, i % 2, rng.choice("aab"), "c", start))
    df = spark.createDataFrame(rows, "event_id long, session_id long, url string, content string, s long")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want, state = {}, {}
    for event, session, url, content, _ in rows:
        last, run = state.get(session, (None, 0))
        run = run + 1 if last == (url, content) else 0
        state[session] = ((url, content), run)
        want[event] = run
    got = {r["event_id"]: r["no_change_count"] for r in memory.no_change_runs(df).collect()}
    assert got == want


def brute_force(spark, items, threshold, size, unit):
    """Each item's first similar earlier item, and where these lead; all pairs compared."""
    hashed = items.select("id", F.sort_array(near_duplicates.shingles(F.col("text"), size, unit)).alias("h"))
    data = [(r["id"], set(r["h"])) for r in hashed.orderBy("id").collect()]
    root = {}
    for i, mine in data:
        first = next((j for j, other in data if j < i and len(mine & other) / len(mine | other) >= threshold), i)
        root[i] = root.get(first, i)
    return root


@pytest.mark.parametrize("unit, size, threshold", [("word", 1, 0.6), ("char", 2, 0.5), ("word", 2, 0.8)])
def test_near_duplicates_match_brute_force(spark, unit, size, threshold):
    rng = random.Random(11)
    words = ["red", "oak", "table", "long", "wide", "desk", "lamp", "steel"]
    texts = [" ".join(rng.choices(words, k=rng.randint(2, 6))) for _ in range(120)] + ["red oak table"] * 60 + ["", ""]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = near_duplicates.near_duplicates(items, threshold, size=size, unit=unit).collect()
    assert len(found) == len(texts)
    assert {r["id"]: r["kept_id"] for r in found} == brute_force(spark, items, threshold, size, unit)
    assert all(r["is_duplicate"] == (r["id"] != r["kept_id"]) and r["similarity"] >= threshold for r in found)


def test_chain_of_similar_texts_takes_few_rounds(spark):
    words = [f"w{i}" for i in range(1100)]
    texts = [(i, " ".join(words[i : i + 40])) for i in range(1000)]
    found = near_duplicates.near_duplicates(spark.createDataFrame(texts, "id long, text string"), 0.8, size=1).collect()
    assert {r["kept_id"] for r in found} == {0} and len(found) == 1000


def test_first_wins_does_not_depend_on_partitions(tables):
    pages = tables.pages()
    assert rows_of(urls.canonical_pages(pages)) == rows_of(urls.canonical_pages(pages.repartition(5, "url")))
    rows = tables.raw_catalog()
    deduped = catalog.dedupe_catalog(rows)
    assert rows_of(deduped) == rows_of(catalog.dedupe_catalog(rows.repartition(7)))
    assert rows_of(deduped) == rows_of(catalog.dedupe_catalog(deduped))
    swatch_pages = tables.detail_pages()
    assert rows_of(colors.best_swatch(swatch_pages)) == rows_of(colors.best_swatch(swatch_pages.repartition(3)))


def test_stats_add_up(tables):
    raw = tables.raw_catalog()
    valid = catalog.filter_invalid(raw)
    row = catalog.optimization_stats(raw, valid, catalog.dedupe_catalog(valid)).first()
    assert row["input_items"] == row["invalid_items_removed"] + row["duplicates_removed"] + row["output_items"]


def test_union_is_not_taken_as_partitioned(spark, tables):
    pages = tables.spread(tables.product_pages(), "page_id")
    copies = union_rows(*[pages.select("page_id", F.lit(i).alias("i")) for i in range(3)])
    grouped = copies.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    assert grouped.filter("n <> 3").count() == 0
    assert grouped.count() == pages.count()


def test_cluster_shares_add_up(tables):
    found = colors.dominant_colors(tables.pixels(), 3)
    shares = found.groupBy("image_id").agg(F.sum("percentage").alias("p"), F.count(F.lit(1)).alias("k")).collect()
    assert all(abs(r["p"] - 100) < 1e-9 and r["k"] <= 12 for r in shares)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_row_local_and_native(tables):
    pages = tables.spark.read.schema("page_id long, url string, markdown string, html string").json(
        tables.spark.sparkContext.emptyRDD()
    )
    local = [
        classify.classify_balanced(pages), classify.classify_rules(pages), prices.price_facts(pages), prices.base_price(pages),
        options.option_rows(pages), options.configurator_options(pages), urls.link_edges(pages), colors.swatch_candidates(pages),
    ]
    for df in local:
        plan = plan_of(df)
        assert "Exchange" not in plan, plan[:500]
        for word in ("EvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
            assert word not in plan


def test_html_is_not_read_for_url_work(tables):
    folder_scan = urls.canonical_pages(tables.table("pages"))
    plan = plan_of(folder_scan)
    assert "html" not in plan.split("ReadSchema")[1]


def test_unnest_keeps_order_and_drops_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, xs array<string>")
    assert [tuple(r) for r in unnest(df, ["id"], F.col("xs")).collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_templates_and_groups_of_near_copies_make_few_pairs(spark, monkeypatch):
    """Texts that share a template, and one large group of near copies: pairs grow with the rows, not with their square."""
    draw = random.Random(6)
    template = [f"form{i}" for i in range(40)]
    texts = [template[:30] + [f"own{k}x{i}" for i in range(20)] for k in range(400)]  # 60 % in common: not similar
    base = [f"word{i}" for i in range(60)]
    for k in range(400):
        copy = base[:]
        copy[draw.randrange(60)] = f"typo{k}"
        texts.append(copy)
    order = draw.sample(range(800), 800)
    items = spark.createDataFrame([(i, " ".join(texts[k])) for i, k in enumerate(order)], "id long, text string")
    written = {}
    plain = near_duplicates.staged

    def counted(df, name):
        out = plain(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(near_duplicates, "staged", counted)
    pairs = []
    similar = near_duplicates._similar
    monkeypatch.setattr(near_duplicates, "_similar", lambda p, *a: (pairs.append(p.count()), similar(p, *a))[1])
    got = near_duplicates.near_duplicates(items, 0.8, size=1).collect()
    copies = sorted(i for i, k in enumerate(order) if k >= 400)
    assert {r.id for r in got if r.is_duplicate} == set(copies[1:])
    assert {r.kept_id for r in got if r.id in set(copies)} == {copies[0]}
    assert sum(pairs) < 10 * 800


def test_texts_with_few_rare_words_in_common_are_not_verified(spark, monkeypatch):
    """Two rare words in common are no reason to fetch whole sets; a copy with a few words changed is."""
    draw = random.Random(8)
    texts = [draw.sample([f"word{i}" for i in range(600)], 38) + [f"rare{k // 2}a", f"rare{k // 2}b"] for k in range(200)]
    copy = texts[17][:36] + [f"other{i}" for i in range(4)]
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([*texts, copy])], "id long, text string")
    pairs = []
    similar = near_duplicates._similar
    monkeypatch.setattr(near_duplicates, "_similar", lambda p, *a: (pairs.append(p.count()), similar(p, *a))[1])
    got = near_duplicates.near_duplicates(items, 0.7, size=1).collect()
    assert [(r.id, r.kept_id) for r in got if r.is_duplicate] == [(200, 17)]
    assert sum(pairs) < 50
