"""Order-dependent operators and streams: NULL keys, sparse ids, pauses, many rows of one session."""

import random

from pyspark.sql import functions as F

from wareloom.operators import catalog, crawl, memory
from wareloom.operators.ordering import RANGE, numbered, with_ranges
from wareloom.session import work_folder
from wareloom.streaming import jobs
from wareloom.streaming.versions import BucketedVersions, children

SCHEMA = "event_id long, session_id long, ts timestamp, url string, content string"


def plain_runs(visits):
    """No-change counts by a loop over each session in order."""
    out, last = {}, {}
    for event, session, ts, url, content in sorted(visits, key=lambda v: (v[2] is not None, v[2] or 0, v[0])):
        before = last.get(session, (None, None, 0))
        same = url is not None and content is not None and before[:2] == (url, content)
        run = before[2] + 1 if same else 0
        last[session] = (url, content, run)
        out[event] = run
    return out


def visits_frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, session_id long, s long, url string, content string").select(
        "event_id", "session_id", F.timestamp_seconds("s").alias("ts"), "url", "content"
    )


def some_visits(n, seed, sessions=5):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, draw.choice([None, *range(sessions)]), draw.choice([None] + [draw.randrange(400_000)] * 20), draw.choice(["a", "b", None] if i % 9 == 0 else ["a"]), "x"))
    return rows


def test_runs_keep_rows_without_time_or_session(spark):
    rows = some_visits(500, 1)
    got = {r.event_id: r.no_change_count for r in memory.no_change_runs(visits_frame(spark, rows)).collect()}
    assert got == plain_runs(rows)


def test_runs_continue_from_the_rows_before(spark):
    rows = [r for r in some_visits(400, 2) if r[2] is not None]
    rows.sort(key=lambda r: (r[2], r[0]))
    one, two = rows[:150], rows[150:]
    before = memory.last_visits(memory.counted_runs(visits_frame(spark, one)))
    got = memory.counted_runs(visits_frame(spark, two), before).collect()
    want = plain_runs(rows)
    assert {r.event_id: r.no_change_count for r in got} == {r[0]: want[r[0]] for r in two}


def stream_of(spark, batches):
    folder = work_folder(spark, "test-stream")
    for rows in batches:
        visits_frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_sessions_that_pause_and_null_sessions(spark):
    rows = [r for r in some_visits(300, 3, sessions=8) if r[2] is not None]
    rows.sort(key=lambda r: (r[2], r[0]))
    batches = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    batches[1] = [r for r in batches[1] if r[1] not in (1, 2, None)]  # these pause for a batch or two
    batches[2] = [r for r in batches[2] if r[1] != 1]
    out = work_folder(spark, "test-runs")
    jobs.stream_no_change(stream_of(spark, batches), out)
    got = {r.event_id: r.no_change_count for r in jobs.read_runs(spark, out).collect()}
    assert got == plain_runs([r for b in batches for r in b])


def test_stream_many_shuffled_visits_of_one_session(spark):
    rows = [(i, 1, 1_000 + 7 * i, "a" if i % 1000 else "b", "x") for i in range(25_000)]
    mixed = rows[:]
    random.Random(4).shuffle(mixed)
    out = work_folder(spark, "test-runs")
    jobs.stream_no_change(stream_of(spark, [mixed]), out)
    got = {r.event_id: r.no_change_count for r in jobs.read_runs(spark, out).collect()}
    assert got == plain_runs(rows)


def test_stream_forgets_sessions_after_the_gap(spark):
    day = 86_400
    batches = [[(0, 1, day, "a", "x"), (1, 1, day + 5, "a", "x")], [(2, 2, 11 * day, "a", "x")], [(3, 1, 11 * day + 5, "a", "x")]]
    out = work_folder(spark, "test-runs")
    jobs.stream_no_change(stream_of(spark, batches), out, gap="3 days")
    assert {r.event_id: r.no_change_count for r in jobs.read_runs(spark, out, "3 days").collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    last = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}-progress")
    assert {r.key.session_key for r in last.collect()} <= {"1", "2"}


def test_stream_places_late_visits_and_leaves_out_what_comes_too_late(spark):
    """Visits shuffled within the delay count as in order; each batch writes only what the watermark has passed."""
    rows = [(i, draw, 10_000 + 60 * i, "a" if i % 7 else "b", "x") for i in range(600) for draw in [random.Random(i).randrange(4)]]
    draw = random.Random(8)
    arrived = sorted(rows, key=lambda r: r[2] + draw.randrange(3_000))  # up to 50 minutes late
    batches = [arrived[i : i + 100] for i in range(0, 600, 100)]
    too_late = [(900, 1, 10_030, "b", "x"), (901, 2, 10_090, "b", "x")]
    batches.append(too_late)
    out = work_folder(spark, "test-runs")
    jobs.stream_no_change(stream_of(spark, batches), out, delay="1 hour")
    want = plain_runs(rows)
    assert {r.event_id: r.no_change_count for r in jobs.read_runs(spark, out).collect()} == want
    final = {r.event_id: r.no_change_count for r in spark.read.parquet(out).collect()}
    newest = max(r[2] for r in rows)
    assert final == {r[0]: want[r[0]] for r in rows if r[2] <= newest - 3600}


def test_stream_session_keeps_one_timer_and_one_state(spark):
    """However many batches and waiting visits, a session is read, written and woken once; nothing is left behind."""
    hour = 3_600
    batches = [[(10 * b + s, s, (b + 20) * 24 * hour + s * hour, "a", None if s == 2 else "x") for s in range(1, 4)] for b in range(5)]
    batches[2] += [(100, 1, 22 * 24 * hour + 2 * hour, "b", "x"), (101, 1, 22 * 24 * hour + 3 * hour, "b", "x")]
    out = work_folder(spark, "test-runs")
    jobs.stream_no_change(stream_of(spark, batches), out, delay="12 hours")
    timers = spark.read.format("statestore").option("readRegisteredTimers", True).load(f"{out}-progress")
    assert sorted(r.key.session_key for r in timers.collect()) == ["1", "2", "3"]
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}-progress")
    assert {r.key.session_key: (r.value.event_id, r.value.event_ids) for r in state.collect()} == {
        "1": (31, [41]), "2": (32, [42]), "3": (33, [43]),
    }
    got = {r.event_id: r.no_change_count for r in jobs.read_runs(spark, out).collect()}
    want = plain_runs([r for b in batches for r in b])
    assert got == want


def test_stream_upsert_rewrites_only_touched_buckets(spark):
    def states(ids, batch):
        rows = [(f"site{i}", f"sig{i}", batch * 100 + i, batch) for i in ids]
        return spark.createDataFrame(rows, "site_domain string, page_signature string, event_id long, created_at long")

    folder, out = work_folder(spark, "test-states"), work_folder(spark, "test-upsert")
    batches = [states(range(200), 1), states([3], 2), states([3, 4, 777], 3), states([5], 0)]
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.stream_upsert(stream, out, buckets=16)
    got = {r.site_domain: r.created_at for r in jobs.read_states(spark, out).collect()}
    assert got == {f"site{i}": 1 for i in range(200)} | {"site3": 3, "site4": 3, "site777": 3}
    table = BucketedVersions(spark, f"{out}-rows")
    versions = {b: table.versions(b) for b in range(16)}
    assert len([b for b in versions if 1 in versions[b]]) == 1  # one key, one bucket written
    assert all(len(v) <= 2 for v in versions.values())
    assert sum(len(v) for v in versions.values()) <= 16 + 1 + 3 + 1
    # batch 2 again: it reads what stood before it and writes the same once more
    before = sorted(map(tuple, table.read(1).collect()))
    touched = [b for b in versions if 2 in versions[b]]
    assert sorted(map(tuple, table.read(1, touched).collect())) == [r for r in before if r in set(map(tuple, table.read(1, touched).collect()))]
    assert len(before) == 200


def test_from_state_keeps_rows_without_session(spark):
    rows = [(0, None, 10, "s0"), (1, None, 20, "s1"), (2, 1, None, "s2"), (3, 1, 5, "s3")]
    visits = spark.createDataFrame(rows, "event_id long, session_id long, s long, to_state string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.from_state for r in memory.with_from_state(visits).collect()}
    assert got == {0: None, 1: "s0", 2: None, 3: "s2"}


def test_merge_keeps_entries_without_url(spark):
    rows = spark.createDataFrame([(1, None), (2, "u"), (3, "u"), (4, None), (5, "v")], "seq long, url string")
    got = {r.seq: r.catalog_key for r in catalog.merge_catalogs(rows).collect()}
    assert got == {1: None, 2: "u#item-1", 3: "u#item-2", 4: None, 5: "v"}


def test_numbers_of_sparse_ids(spark):
    ids = sorted({i * i * 7_919_113 for i in range(3000)})
    got = numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id").orderBy("id").collect()
    assert [r.row_no for r in got] == list(range(len(ids)))


def test_one_outlier_leaves_the_other_rows_spread(spark):
    ids = [*range(5_000), 1 << 60, -(1 << 60)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    per_range = [r["count"] for r in with_ranges(df, "id").groupBy(RANGE).count().collect()]
    assert len(per_range) > 500 and max(per_range) < 50
    got = numbered(df, "id").orderBy("id").collect()
    assert [r.row_no for r in got] == list(range(len(ids) + 1))
    near = [(1 << 60) + i for i in range(300)]  # closer than doubles can tell apart
    got = numbered(spark.createDataFrame([(i,) for i in near], "id long"), "id").orderBy("id").collect()
    assert [r.row_no for r in got] == list(range(300))
    assert numbered(df.where("false"), "id").collect() == []


def small_site(spark):
    def u(path, host="a.com"):
        return f"https://{host}/{path}"

    pages = [(9, u("products/home")), (2, u("products/x")), (3, u("products/y")), (4, u("cart/1")), (5, u("products/z")), (6, u("products/b", "b.com"))]
    links = [(9, "products/x"), (2, "products/y"), (3, "products/x"), (4, "products/z"), (5, "products/gone"), (5, "products/z")]
    urls = dict(pages)
    edges = spark.createDataFrame([(urls[i], u(path)) for i, path in links], "url string, link string")
    return spark.createDataFrame(pages, "page_id long, url string"), edges


def test_seeds_are_first_pages_and_pages_found_from_nowhere(spark):
    pages, edges = small_site(spark)
    graph = crawl.store_graph(pages, edges, 4)
    names = {r.canonical.rsplit("/", 1)[1] for r in crawl.seed_pages(pages, graph).collect()}
    # x is the first page of its host; home has no link to it, z one from a page not crawled and one from itself
    assert names == {"x", "home", "z", "b"}
    graph.close()
    found = {r.canonical.rsplit("/", 1)[1]: (r.depth, r.fetched) for r in crawl.discover(pages, edges).collect()}
    assert found == {"x": (0, True), "home": (0, True), "z": (0, True), "b": (0, True), "y": (1, True), "gone": (1, False)}


def test_levels_do_not_move_the_stored_graph(spark):
    pages, edges = small_site(spark)
    graph = crawl.store_graph(pages, edges, 4)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("-1", "false")):
            spark.conf.set(n, v)
        known = graph.pages.filter("canonical like '%home'")
        level = crawl.next_level(graph, known, known)
        plan = level._jdf.queryExecution().executedPlan().toString()
        assert [r.canonical.rsplit("/", 1)[1] for r in level.collect()] == ["x"]
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    scan = next(i for i, line in enumerate(plan.split("\n")) if "FileScan" in line and "dst" in line)
    above = plan.split("\n")[:scan]
    # between the scan of the links and the semi join stand only codegen steps and a sort
    join = max(i for i, line in enumerate(above) if "LeftSemi" in line)
    assert not any("Exchange" in line for line in above[join:]), plan
    assert "Bucketed: true" in plan
    graph.close()


def test_work_folders_can_be_cleared(spark, monkeypatch):
    from wareloom import session

    monkeypatch.setattr(session, "_WORK", {})  # those of other tests stay
    staged = session.staged(spark.range(5), "short-lived")
    assert staged.count() == 5 and children(spark, session._WORK[spark.sparkContext.applicationId][0])
    folder = session._WORK[spark.sparkContext.applicationId][0]
    assert session.clear_work(spark) == 1 and children(spark, folder) == [] and session.clear_work(spark) == 0
