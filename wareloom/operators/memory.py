"""Interaction memory: states, transitions, continue patterns, page changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.frames import union_rows
from .ordering import RANGE, join_null_safe, previous

SIGNATURE_ELEMENTS = 50
CLASS_CHARS = 30
BAND_PIXELS = 100
STUCK_AFTER = 3

STATE_KEY = ["site_domain", "page_signature"]


def upsert_states(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest row per domain and signature; ties go to the larger event_id.

    A max_by aggregate folds a heavily rewritten state on the map side.
    """
    rows = union_rows(old, new, allow_missing=True)
    values = [c for c in rows.columns if c not in STATE_KEY]
    newest = F.max_by(F.struct(*values), F.struct("created_at", "event_id"))
    return rows.groupBy(*STATE_KEY).agg(newest.alias("row")).select(*STATE_KEY, *[f"row.{c}" for c in values])


def with_from_state(visits: DataFrame) -> DataFrame:
    """from_state of every visit: the state before it in its session.

    Sessions are cut by day, so that one very long session spreads out.
    """
    return previous(visits, ["to_state"], "session_id", ["ts", "event_id"], F.to_date("ts")).withColumnRenamed(
        "previous_to_state", "from_state"
    )


def transitions(log: DataFrame) -> DataFrame:
    """Success and failure counts and last use per (domain, from, to, action)."""
    return (
        log.filter(F.col("from_state").isNotNull())
        .groupBy("site_domain", "from_state", "to_state", "action_type")
        .agg(
            F.count_if("success").alias("success_count"),
            F.count_if(~F.col("success")).alias("failure_count"),
            F.max("ts").alias("last_used"),
        )
    )


def confident_transition(counts: DataFrame, min_rate: float = 0.8, min_seen: int = 3) -> DataFrame:
    """Best transition per domain and state, seen often enough and mostly successful."""
    seen = F.col("success_count") + F.col("failure_count")
    rated = counts.withColumn("seen", seen).withColumn("success_rate", F.col("success_count") / F.col("seen"))
    good = rated.filter((F.col("seen") >= min_seen) & (F.col("success_rate") >= min_rate))
    rank = F.row_number().over(
        W.partitionBy("site_domain", "from_state").orderBy(F.desc("success_rate"), "to_state", "action_type")
    )
    return (
        good.withColumn("rank", rank)
        .filter("rank = 1")
        .select("site_domain", "from_state", "to_state", "action_type", "seen", "success_rate")
    )


def continue_patterns(log: DataFrame) -> DataFrame:
    """Times seen, successes and rate per domain and pattern."""
    counted = log.groupBy("site_domain", "pattern").agg(
        F.count(F.lit(1)).alias("seen_count"), F.count_if("success").alias("success_count")
    )
    return counted.withColumn("success_rate", F.col("success_count") / F.col("seen_count"))


def best_continue_pattern(patterns: DataFrame, min_rate: float = 0.8, min_seen: int = 3) -> DataFrame:
    """Most reliable pattern per domain."""
    good = patterns.filter((F.col("success_rate") >= min_rate) & (F.col("seen_count") >= min_seen))
    rank = F.row_number().over(W.partitionBy("site_domain").orderBy(F.desc("success_rate"), "pattern"))
    return good.withColumn("rank", rank).filter("rank = 1").drop("rank")


def memory_stats(states: DataFrame, counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """States, transitions and patterns per domain, with a total row (NULL domain)."""
    frames = {"states": states, "transitions": counts, "patterns": patterns}
    parts = union_rows(*[f.select("site_domain", F.lit(kind).alias("kind")) for kind, f in frames.items()])
    return parts.rollup("site_domain").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("states", "transitions", "patterns")]
    )


def page_signatures(elements: DataFrame) -> DataFrame:
    """SHA-256 over the structure of each page's first fifty elements.

    The row limit is applied before the shuffle, so what is collected per
    page is bounded however many elements it has.
    """
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    part = F.concat_ws(
        "|",
        "tag",
        F.substring("classes", 1, CLASS_CHARS),
        F.floor(F.coalesce("y", F.lit(0)) / BAND_PIXELS).cast("string"),
    )
    firsts = elements.withColumn("rank", rank).filter(F.col("rank") <= SIGNATURE_ELEMENTS)
    joined = F.array_join(F.sort_array(F.collect_list(part)), "|")
    return firsts.groupBy("page_id").agg(F.sha2(joined, 256).alias("signature"))


def pages_per_signature(signatures: DataFrame) -> DataFrame:
    return signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n_pages"))


def _continued(marked: DataFrame, before: DataFrame) -> DataFrame:
    """The first visit of each session follows the session's row in `before`."""
    firsts = marked.groupBy("session_id").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    known = join_null_safe(
        firsts,
        before.select("session_id", F.col("url").alias("_url"), F.col("content").alias("_content"), F.col("ts").alias("_ts")),
        ["session_id"],
    )
    here = F.struct("ts", "event_id").eqNullSafe(F.col("_first"))
    return (
        join_null_safe(marked, known, ["session_id"], "left")
        .withColumn("previous_url", F.when(here, F.col("_url")).otherwise(F.col("previous_url")))
        .withColumn("previous_content", F.when(here, F.col("_content")).otherwise(F.col("previous_content")))
        .withColumn("previous_ts", F.when(here, F.col("_ts")).otherwise(F.col("previous_ts")))
        .drop("_first", "_url", "_content", "_ts")
    )


def counted_runs(visits: DataFrame, before: DataFrame | None = None, gap: str | None = None) -> DataFrame:
    """Length of the current run of unchanged visits, with the time of each.

    Runs are counted inside day ranges; a run that crosses ranges adds what
    the ranges before it ended with, carried by one row per range. `before`
    has one row per session (session_id, ts, url, content, run): the last visit
    and its run before all of these visits. After a pause of more than `gap`
    a run starts anew.
    """
    part: Column = F.to_date("ts")
    marked = previous(visits, ["url", "content", "ts"], "session_id", ["ts", "event_id"], part)
    if before is not None:
        marked = _continued(marked, before)
    same = (F.col("url") == F.col("previous_url")) & (F.col("content") == F.col("previous_content"))
    if gap is not None:
        same &= F.coalesce(F.col("ts") <= F.col("previous_ts") + F.expr(f"INTERVAL {gap}"), F.lit(True))
    marked = marked.withColumn("changed", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn(RANGE, part)
    spec = W.partitionBy("session_id", RANGE).orderBy("ts", "event_id")
    islands = marked.withColumn("island", F.sum("changed").over(spec))
    inside = islands.withColumn(
        "run", F.row_number().over(W.partitionBy("session_id", RANGE, "island").orderBy("ts", "event_id"))
    )
    # Island 0 continues the previous range; other islands start with a changed visit.
    tails = inside.groupBy("session_id", RANGE).agg(
        F.max("island").alias("islands"),
        F.count_if(F.col("island") == 0).alias("n_open"),
        F.max_by("run", F.struct("ts", "event_id")).alias("last_run"),
    )
    days = W.partitionBy("session_id").orderBy(RANGE)
    closed = F.sum((F.col("islands") > 0).cast("int")).over(days.rowsBetween(W.unboundedPreceding, -1))
    grouped = tails.withColumn("epoch", F.coalesce(closed, F.lit(0)))
    # Within an epoch: the range that closed it ends with last_run - 1 unchanged visits,
    # and later ranges without a change add all their visits.
    closing = F.last(F.when(F.col("islands") > 0, F.col("last_run") - 1), ignorenulls=True).over(
        days.rowsBetween(W.unboundedPreceding, -1)
    )
    opened = F.sum(F.when(F.col("islands") == 0, F.col("n_open")).otherwise(0)).over(
        W.partitionBy("session_id", "epoch").orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    )
    if before is not None:
        grouped = join_null_safe(grouped, before.select("session_id", F.col("run").alias("earlier")), ["session_id"], "left")
    earlier = F.lit(0) if before is None else F.coalesce("earlier", F.lit(0))
    carried = grouped.select(
        "session_id", RANGE, (F.coalesce(closing, earlier) + F.coalesce(opened, F.lit(0))).alias("carried")
    )
    joined = join_null_safe(inside, carried, ["session_id", RANGE])
    length = F.when(F.col("island") == 0, F.col("run") + F.col("carried")).otherwise(F.col("run") - 1)
    return joined.withColumn("no_change_count", length).select(
        "event_id", "session_id", "ts", "url", "content", "no_change_count",
        (F.col("no_change_count") >= STUCK_AFTER).alias("is_stuck"),
    )


def no_change_runs(visits: DataFrame) -> DataFrame:
    """Length of the current run of unchanged visits, flagged from three on."""
    return counted_runs(visits).drop("ts")


def last_visits(counted: DataFrame) -> DataFrame:
    """The last visit of each session with its run: what counted_runs() continues from."""
    last = F.max_by(F.struct("ts", "event_id", "url", "content", F.col("no_change_count").alias("run")), F.struct("ts", "event_id"))
    return counted.groupBy("session_id").agg(last.alias("last")).select("session_id", "last.*")
