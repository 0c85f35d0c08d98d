"""Streaming versions of the incremental operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.frames import union_rows
from ..operators import classify, memory
from .sessions import no_change_processor
from .versions import BucketedVersions, children


def stream_new_pages(pages: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """First page per canonical url; state older than the watermark is dropped."""
    keyed = pages.withColumn("canonical", U.canonical(F.col("url")))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["canonical"])


def stream_transitions(visits: DataFrame) -> DataFrame:
    """Running success and failure counters per transition (update mode)."""
    return memory.transitions(visits)


def stream_type_counts(
    pages: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "1 day", ts: str = "ts", pause: str | None = None
) -> DataFrame:
    """Pages per type and time window, classified as they arrive.

    Windows follow one another, overlap (`slide`), or end where a type has no
    page for `pause` (session windows, for append mode). A page counts unless
    the watermark has passed all of its windows.
    """
    signals = classify.balanced_signals(pages, [ts])
    scored = classify.score_balanced(signals, ["balanced"]).withWatermark(ts, delay)
    if pause is not None:
        span = F.session_window(ts, pause)
    else:
        span = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        scored.groupBy(span.alias("span"), "page_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "page_type", "n")
    )


def stream_no_change(visits: DataFrame, folder: str, delay: str = "1 day", gap: str = "365 days") -> None:
    """No-change run of each visit, into one folder per batch id.

    A session's visits wait in the state store until the watermark (the newest
    time stamp seen less `delay`) passes them; then they are counted in the
    order of their time stamps and written once and for all. So visits may come
    late and in any order within the delay, and a batch touches the sessions
    that it has visits of or whose time has come, no others. A visit that the
    watermark has passed already (it starts at 1970-01-01) is not counted. More than `gap` after a
    session's last visit its run starts anew, and the session leaves the store.
    Sessions may be NULL; visits without a time stamp follow what is counted
    when they come. read_runs() also counts the visits that still wait.
    """
    spark = visits.sparkSession
    keyed = visits.select(
        F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("session_key"),
        F.col("session_id").isNull().alias("no_session"),
        "ts", "event_id", F.unix_micros("ts").alias("at"), "url", "content",
    )
    kinds = visits.schema
    kind = kinds["event_id"].dataType.simpleString()
    micros = spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {gap}"))).first()[0]
    counted = (
        keyed.withWatermark("ts", delay)
        .groupBy("session_key", "no_session")
        .transformWithState(
            no_change_processor(kind, micros),
            outputStructType=f"session_key string, no_session boolean, event_id {kind}, at long, url string, content string, no_change_count long",
            outputMode="append",
            timeMode="EventTime",
        )
    )
    session = F.when(~F.col("no_session"), F.col("session_key").cast(kinds["session_id"].dataType))
    named = counted.select(
        "event_id", session.alias("session_id"), F.timestamp_micros("at").alias("ts"), "url", "content",
        F.col("no_change_count"), (F.col("no_change_count") >= memory.STUCK_AFTER).alias("is_stuck"),
    )
    with _rocksdb(spark):
        run_to_folder(named, folder)


def read_runs(spark: SparkSession, folder: str, gap: str = "365 days") -> DataFrame:
    """All visits that stream_no_change has counted, and those that still wait as if no other came before them.

    `gap` is that of the stream.
    """
    done = spark.read.parquet(folder).drop("batch")
    kind = done.schema["session_id"].dataType

    reader = spark.read.format("statestore").option("stateVarName", "last")
    session = F.when(~F.col("key.no_session"), F.col("key.session_key").cast(kind))
    state = reader.load(f"{folder}-progress").select(session.alias("session_id"), "value.*")
    held = state.select("session_id", F.explode(F.arrays_zip("event_ids", "ats", "urls", "contents")).alias("v"))
    waiting = held.select(
        "session_id", F.col("v.event_ids").alias("event_id"), F.timestamp_micros("v.ats").alias("ts"),
        F.col("v.urls").alias("url"), F.col("v.contents").alias("content"),
    )
    last = state.where("run IS NOT NULL").select("session_id", F.timestamp_micros("at").alias("ts"), "url", "content", "run")
    return union_rows(done.drop("ts"), memory.counted_runs(waiting, last, gap).drop("ts"))


@contextmanager
def _rocksdb(spark: SparkSession):
    """Keyed state with lists and timers needs the RocksDB provider; other streams keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


# ------------------------------------------------------------------ running and sinks
def _write_batch(folder: str):
    """One folder per batch id, overwritten on replay, so a retried batch counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process what is available and keep each batch's rows under its id."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}-progress")
        .foreachBatch(_write_batch(folder))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Last written row per key of an update-mode stream."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    last = F.max_by(F.struct(*values), "batch")
    return rows.groupBy(*keys).agg(last.alias("row")).select(*keys, *[f"row.{c}" for c in values])


def stream_upsert(states: DataFrame, folder: str, buckets: int = 256) -> None:
    """Fold each batch into the newest state per key, kept in a table of `buckets` by key.

    A batch reads and rewrites only the buckets it has keys of, as a version
    named by its batch id. A batch that runs again reads the versions before
    its own and overwrites its own, so it counts once. Of each bucket the
    newest two versions stay.
    """
    table = BucketedVersions(states.sparkSession, f"{folder}-rows")
    bucket = F.pmod(F.xxhash64(*memory.STATE_KEY), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.withColumn("bucket", bucket).persist()  # counted, then folded
        try:
            touched = [r["bucket"] for r in arrived.select("bucket").distinct().collect()]
            if touched:
                old = table.read(batch_id - 1, touched)
                newest = memory.upsert_states(batch.limit(0) if old is None else old, arrived.drop("bucket"))
                table.write(newest.withColumn("bucket", bucket), batch_id)
                table.forget(batch_id, touched)
        finally:
            arrived.unpersist()

    _run(states, write, folder)


def read_states(spark: SparkSession, folder: str) -> DataFrame:
    """Current states of a folder that stream_upsert feeds, as of its last finished batch."""
    finished = [int(p) for p in children(spark, f"{folder}-progress/commits") if p.isdigit()]
    return BucketedVersions(spark, f"{folder}-rows").read(max(finished))


def _run(stream: DataFrame, write, folder: str) -> None:
    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}-progress")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
