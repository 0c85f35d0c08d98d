"""Queries over interaction memory, and streams replayed against batch results."""

from pyspark.sql import functions as F

from ..operators import memory
from ..session import work_folder
from ..streaming import jobs
from . import sqltext as d
from .registry import cte, query

STATE = "site_domain, page_signature, url_path, step_index, is_terminal, created_at, event_id"
NEWEST = f"""SELECT {STATE} FROM states
QUALIFY row_number() OVER (PARTITION BY site_domain, page_signature ORDER BY created_at DESC, event_id DESC) = 1"""
cte("newest_states", NEWEST, "states")


@query("upsert_states", f"SELECT {STATE} FROM newest_states", "newest_states")
def _(t):
    rows = t.states()
    old, new = rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <> 0")
    return memory.upsert_states(old, new)


def visit_log(t):
    return memory.with_from_state(t.visits().drop("from_state"))


@query("from_states", "SELECT event_id, session_id, from_state, to_state FROM visits", "visits")
def _(t):
    return visit_log(t).select("event_id", "session_id", "from_state", "to_state")


cte(
    "counted",
    """SELECT site_domain, from_state, to_state, action_type, count(*) FILTER (success) AS success_count,
  count(*) FILTER (NOT success) AS failure_count, max(ts) AS last_used FROM visits WHERE from_state IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "visits",
)


@query("transitions", "SELECT * FROM counted", "counted")
def _(t):
    return memory.transitions(visit_log(t))


@query(
    "confident_transition",
    """SELECT site_domain, from_state, to_state, action_type, success_count + failure_count AS seen,
  CAST(success_count AS DOUBLE) / (success_count + failure_count) AS success_rate FROM counted
WHERE success_count + failure_count >= 3 AND CAST(success_count AS DOUBLE) / (success_count + failure_count) >= 0.8
QUALIFY row_number() OVER (PARTITION BY site_domain, from_state ORDER BY
  CAST(success_count AS DOUBLE) / (success_count + failure_count) DESC, to_state, action_type) = 1""",
    "counted",
)
def _(t):
    return memory.confident_transition(memory.transitions(visit_log(t)))


cte(
    "patterns",
    """SELECT site_domain, pattern, count(*) AS seen_count, count(*) FILTER (success) AS success_count,
  CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS success_rate FROM continue_log GROUP BY 1, 2""",
    "continue_log",
)


@query("continue_patterns", "SELECT * FROM patterns", "patterns")
def _(t):
    return memory.continue_patterns(t.continue_log())


@query(
    "best_continue_pattern",
    """SELECT * FROM patterns WHERE success_rate >= 0.8 AND seen_count >= 3
QUALIFY row_number() OVER (PARTITION BY site_domain ORDER BY success_rate DESC, pattern) = 1""",
    "patterns",
)
def _(t):
    return memory.best_continue_pattern(memory.continue_patterns(t.continue_log()))


@query(
    "memory_stats",
    """SELECT site_domain, count(*) FILTER (k = 's') AS states, count(*) FILTER (k = 't') AS transitions,
  count(*) FILTER (k = 'p') AS patterns FROM (SELECT site_domain, 's' AS k FROM newest_states
  UNION ALL SELECT site_domain, 't' FROM counted UNION ALL SELECT site_domain, 'p' FROM patterns) x GROUP BY ROLLUP (site_domain)""",
    "newest_states counted patterns",
)
def _(t):
    states = memory.upsert_states(t.states().limit(0), t.states())
    return memory.memory_stats(states, memory.transitions(visit_log(t)), memory.continue_patterns(t.continue_log()))


cte(
    "signatures",
    """SELECT page_id, sha256(string_agg(part, '|' ORDER BY part)) AS signature FROM (
  SELECT page_id, tag || '|' || substr(classes, 1, 30) || '|' || (y // 100) AS part FROM elements
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 50) x GROUP BY page_id""",
    "elements",
)


@query("page_signatures", "SELECT * FROM signatures", "signatures")
def _(t):
    return memory.page_signatures(t.elements())


@query(
    "pages_per_signature",
    "SELECT signature, count(*) AS n_pages FROM signatures GROUP BY signature",
    "signatures",
)
def _(t):
    return memory.pages_per_signature(memory.page_signatures(t.elements()))


cte(
    "runs",
    """
SELECT event_id, session_id, url, content, row_number() OVER (PARTITION BY session_id, island ORDER BY ts, event_id) - 1 AS no_change_count
FROM (SELECT *, sum(changed) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS island FROM (
  SELECT *, CASE WHEN lag(url) OVER w = url AND lag(content) OVER w = content THEN 0 ELSE 1 END AS changed FROM page_visits
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)) a) b""",
    "page_visits",
)


@query("no_change_runs", "SELECT *, no_change_count >= 3 AS is_stuck FROM runs", "runs")
def _(t):
    return memory.no_change_runs(t.page_visits())


# ------------------------------------------------------------------ streams
def replay(t, rows, order, slices=4, files=4):
    """The rows as a file stream: one micro-batch of several files per range of the order value."""
    folder = work_folder(t.spark, "replay")
    keyed = rows.withColumn("_order", F.expr(order).cast("double"))
    cuts = keyed.approxQuantile("_order", [i / slices for i in range(1, slices)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        piece = keyed
        if low is not None:
            piece = piece.filter(F.col("_order") > low)
        if high is not None:
            piece = piece.filter(F.col("_order") <= high)
        piece.drop("_order").repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


#: Pages that come when the watermark has passed them.
TOO_LATE = "page_id % 50 = 7 AND 2 * page_id < (SELECT max(page_id) FROM product_pages)"


def in_batches(t, frames, files=4):
    """A file stream with one micro-batch per frame."""
    folder = work_folder(t.spark, "batches")
    for frame in frames:
        frame.repartition(files).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def with_late_pages(t, pages):
    """Half of the pages, a quarter, the rest, and then those that come too late."""
    last = pages.agg(F.max("page_id")).first()[0] or 0
    late = (F.col("page_id") % 50 == 7) & (2 * F.col("page_id") < last)
    share = F.col("page_id") / F.lit(max(last, 1))
    return [pages.where(~late & (share <= 0.5)), pages.where(~late & (share > 0.5) & (share <= 0.75)), pages.where(share > 0.75), pages.where(late)]


@query(
    "stream_new_pages",
    f"SELECT page_id, {d.canonical('url')} AS canonical FROM product_pages WHERE NOT ({TOO_LATE})",
    "product_pages",
)
def _(t):
    # pages come again one and two batches later, an hour after their time and under other ids
    one, two, three, late = with_late_pages(t, timed_pages(t).select("page_id", "url", "ts"))
    again = one.where("page_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    again = again.withColumn("page_id", -1 - F.col("page_id"))
    folder = work_folder(t.spark, "new-pages")
    source = in_batches(t, [one, two.unionByName(again), three.unionByName(again), late])
    jobs.run_to_folder(jobs.stream_new_pages(source, delay="1 hour"), folder)
    return t.spark.read.parquet(folder).select("page_id", "canonical")


@query("stream_transitions", "SELECT * FROM counted", "counted")
def _(t):
    folder = work_folder(t.spark, "transitions")
    jobs.run_to_folder(jobs.stream_transitions(replay(t, t.visits(), "event_id")), folder, "update")
    return jobs.read_latest(t.spark, folder, ["site_domain", "from_state", "to_state", "action_type"])


@query("stream_upsert", f"SELECT {STATE} FROM newest_states", "newest_states")
def _(t):
    folder = work_folder(t.spark, "states")
    jobs.stream_upsert(replay(t, t.states(), "event_id"), folder)
    return jobs.read_states(t.spark, folder)


TIMED = "SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS ts FROM balanced WHERE strictness = 'balanced'"


@query(
    "stream_type_counts",
    f"""SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS "end",
  page_type, count(*) AS n FROM ({TIMED}) x GROUP BY 1, 2, 3""",
    "balanced",
)
def _(t):
    pages = timed_pages(t)
    folder = work_folder(t.spark, "type-counts")
    jobs.run_to_folder(jobs.stream_type_counts(replay(t, pages, "page_id"), "6 hours", delay="60 days"), folder, "update")
    return jobs.read_latest(t.spark, folder, ["start", "end", "page_type"])


@query(
    "stream_type_counts_sliding",
    f"""SELECT start, start + INTERVAL 6 HOURS AS "end", page_type, count(*) AS n FROM (
  SELECT page_type, time_bucket(INTERVAL 2 HOURS, ts) - k * INTERVAL 2 HOURS AS start FROM ({TIMED}) x, range(3) r(k)) y GROUP BY ALL""",
    "balanced",
)
def _(t):
    pages = timed_pages(t)
    folder = work_folder(t.spark, "type-counts")
    stream = jobs.stream_type_counts(replay(t, pages, "page_id"), "6 hours", "2 hours", delay="60 days")
    jobs.run_to_folder(stream, folder, "update")
    return jobs.read_latest(t.spark, folder, ["start", "end", "page_type"])


@query(
    "stream_type_sessions",
    f"""SELECT min(ts) AS start, max(ts) + INTERVAL 150 SECONDS AS "end", page_type, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY page_type ORDER BY ts) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY page_type ORDER BY ts) < INTERVAL 150 SECONDS THEN 0 ELSE 1 END AS fresh
    FROM ({TIMED} AND NOT ({TOO_LATE})) x) y) z
GROUP BY page_type, session HAVING max(ts) + INTERVAL 150 SECONDS <= (SELECT max(ts) FROM ({TIMED}) x) - INTERVAL 10 MINUTES""",
    "balanced product_pages",
)
def _(t):
    # sessions are written once the watermark has passed them; what comes later than that is left out
    folder = work_folder(t.spark, "type-sessions")
    stream = jobs.stream_type_counts(in_batches(t, with_late_pages(t, timed_pages(t))), delay="10 minutes", pause="150 seconds")
    jobs.run_to_folder(stream, folder)
    return t.spark.read.parquet(folder).drop("batch")


def timed_pages(t):
    base = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t.product_pages().withColumn("ts", F.timestamp_seconds(base + F.col("page_id") * 60))


@query(
    "stream_no_change",
    "SELECT event_id, session_id, no_change_count, no_change_count >= 3 AS is_stuck FROM runs",
    "runs",
)
def _(t):
    visits = t.page_visits().withColumn("ts", F.col("ts").cast("timestamp"))
    folder = work_folder(t.spark, "runs")
    # visits arrive up to twelve hours late, out of order
    arrival = "unix_micros(ts) + pmod(xxhash64(event_id), 43200) * 1000000"
    jobs.stream_no_change(replay(t, visits, arrival), folder, delay="1 day", gap="3650 days")
    return jobs.read_runs(t.spark, folder, "3650 days").drop("url", "content")
