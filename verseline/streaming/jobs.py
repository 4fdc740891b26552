"""Live flows on Structured Streaming. Every job has a batch twin with the same result on the same rows.

The caller starts the query (and names the checkpoint folder). Producers write new files; the file source does not see
bytes appended to an old file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verseline.operators.matching import near_duplicates
from verseline.operators.stats import robust_mean

EVENT_COLUMNS = ("job_id", "step_id", "state", "progress", "ts", "seq")


# ------------------------------------------------------------------ step state
def _step_aggregates() -> list[Column]:
    started = F.min(F.when(F.col("state") != "pending", F.col("seq"))).alias("started_seq")
    last = F.max_by("state", "seq").alias("state")
    progress = F.max_by(F.when(F.col("state") == "done", 1.0).otherwise(F.least(F.greatest("progress", F.lit(0.0)), F.lit(1.0))), "seq").alias("progress")
    finished = F.max(F.when(F.col("state").isin("done", "error"), F.col("seq"))).alias("finished_seq")
    return [last, progress, started, finished]


def step_state(events: DataFrame) -> DataFrame:
    """Current state of every step of every job: last state, clipped progress (1 when done), first start, last finish."""
    return events.groupBy("job_id", "step_id").agg(*_step_aggregates())


def stream_step_state(events: DataFrame) -> DataFrame:
    """The same over a stream; start it in ``update`` mode."""
    return step_state(events)


# ------------------------------------------------------------------ actions, edits, logs
def stream_actions(actions: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """Each action id once, as long as repeats come within the watermark."""
    return actions.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])


def coalesce_edits(edits: DataFrame) -> DataFrame:
    """Keep an edit only when no later unfinished edit of the same job is queued (edits: job_id, seq, done)."""
    last = edits.where(~F.col("done")).groupBy("job_id").agg(F.max("seq").alias("__last"))
    return edits.where(~F.col("done")).join(last, "job_id").where(F.col("seq") == F.col("__last")).select("job_id", "seq")


def stream_coalesce_edits(edits: DataFrame) -> DataFrame:
    """Newest unfinished edit of each job (``update`` mode)."""
    return edits.where(~F.col("done")).groupBy("job_id").agg(F.max("seq").alias("seq"))


def stream_log_tail(lines: DataFrame, sink) -> "object":
    """Hand every micro-batch of log lines, in order, to ``sink(batch_df, batch_id)``."""
    return lines.writeStream.foreachBatch(lambda df, batch: sink(df.orderBy("seq"), batch))


# ------------------------------------------------------------------ windows
def progress_windows(events: DataFrame, *, length: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Finished and failed steps per window of event time."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w")).agg(
        F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "error").alias("failed"), F.count("*").alias("events")
    ).select(F.col("w.start").alias("window_start"), "done", "failed", "events")


def stream_progress_windows(events: DataFrame, *, length: str = "1 minute", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Rows later than the watermark are dropped and counted in the query's progress metrics."""
    return progress_windows(events.withWatermark("ts", watermark), length=length, slide=slide)


def sessions(events: DataFrame, *, gap: str) -> DataFrame:
    """Runs of a track's events no further apart than ``gap`` (an equal gap still joins)."""
    return events.groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(
        "track_id", "first_ts", "last_ts", "events"
    )


def stream_sessions(events: DataFrame, *, gap: str, watermark: str = "10 minutes") -> DataFrame:
    return sessions(events.withWatermark("ts", watermark), gap=gap)


# ------------------------------------------------------------------ state per user
def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def tap_calibration(taps: DataFrame) -> DataFrame:
    """Robust mean of all of each user's offsets (taps: user_id, seq, off)."""
    return robust_mean(taps, by=["user_id"], value="off", name="offset")


def stream_tap_counts(taps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(user_id, off, n): how often each offset has been tapped, a row for every count that a batch changes.

    The state of a user holds counts of distinct offsets; with ``idle_ms`` it goes after that time without a tap (for queries that keep
    running: an ``availableNow`` trigger does not end while states wait to go). ``calibration_of`` the counts is the calibration.
    """

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(*state.get)) if state.exists else {}
        new = pd.concat([df["off"] for df in batches]).value_counts()
        changed = {float(off): int(known.get(off, 0) + n) for off, n in new.items()}
        known.update(changed)
        state.update((list(known), list(known.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": [key[0]] * len(changed), "off": list(changed), "n": list(changed.values())})

    return taps.groupBy("user_id").applyInPandasWithState(
        update, "user_id long, off double, n long", "offs array<double>, counts array<long>", "update", _timeout(idle_ms)
    )


def calibration_of(counts: DataFrame) -> DataFrame:
    """Robust mean of each user's taps from the rows of ``stream_tap_counts``; the highest count of an offset is the latest."""
    latest = counts.groupBy("user_id", "off").agg(F.max("n").alias("n"))
    return robust_mean(latest, by=["user_id"], value="off", name="offset", weight="n")


def backward_alerts(stamps: DataFrame) -> DataFrame:
    """The first stamp of each session that lies before the one written just before it (stamps: session_id, seq, start_ms)."""
    from pyspark.sql import Window

    before = F.lag("start_ms").over(Window.partitionBy("session_id").orderBy("seq"))
    back = stamps.withColumn("behind_ms", before - F.col("start_ms")).where("behind_ms > 0")
    first = back.groupBy("session_id").agg(F.min(F.struct("seq", "behind_ms")).alias("x"))
    return first.select("session_id", F.col("x.seq").alias("seq"), F.col("x.behind_ms").cast("long").alias("behind_ms"))


def stream_backward_alerts(stamps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Alert once per session, at the first stamp before the one written just before it; with ``idle_ms`` a session
    is forgotten after that time without a stamp (see ``stream_tap_counts``)."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last, warned = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        behind = rows["start_ms"].shift(fill_value=rows["start_ms"].iloc[0] if last is None else last) - rows["start_ms"]
        back = rows.assign(behind_ms=behind)[behind > 0].head(0 if warned else 1)
        state.update((int(rows["start_ms"].iloc[-1]), bool(warned or len(back))))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]] * len(back), "seq": back["seq"].astype("int64"), "behind_ms": back["behind_ms"].astype("int64")})

    return stamps.groupBy("session_id").applyInPandasWithState(
        update, "session_id string, seq long, behind_ms long", "last long, warned boolean", "append", _timeout(idle_ms)
    )


# ------------------------------------------------------------------ asset ingest
def ingest_batch(batch: DataFrame, pool_path: str, *, max_bits: int = 6) -> None:
    """Append the pictures of one batch that are new: not in the pool by id or content, nor near any picture there."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["asset_id"])
    try:
        pool = spark.read.parquet(pool_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # the first batch finds no pool; any other failure is one
            raise
        pool = None
    if pool is not None:
        fresh = fresh.join(pool.select("asset_id"), "asset_id", "left_anti")
        known = pool.select(F.lit(-(1 << 63)).cast("long").alias("asset_id"), "ahash").distinct()  # before every other id
        ranked = known.unionByName(fresh.select("asset_id", "ahash"))
        fresh = fresh.join(near_duplicates(ranked, max_bits=max_bits), "asset_id", "left_anti")
    else:
        fresh = fresh.join(near_duplicates(fresh.select("asset_id", "ahash"), max_bits=max_bits), "asset_id", "left_anti")
    from verseline.session import cut_lineage

    cut_lineage(fresh).write.mode("append").parquet(pool_path)


def stream_neardup_ingest(assets: DataFrame, pool_path: str, *, max_bits: int = 6):
    return assets.writeStream.foreachBatch(lambda df, _: ingest_batch(df, pool_path, max_bits=max_bits))
