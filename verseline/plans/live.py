"""Batch twins of the streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseline.plans import bindings as b
from verseline.plans.registry import query
from verseline.streaming import jobs

_E = "ev AS (SELECT user_id AS job_id, event_type AS step_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END AS state, value / 100 AS progress, ts, event_id AS seq FROM events)"


def step_events(spark, sf):
    ev = b.table(spark, sf, "events")
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").otherwise("running")
    return ev.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("step_id"), state.alias("state"), (F.col("value") / 100).alias("progress"), "ts", F.col("event_id").alias("seq"))


@query(
    f"""WITH {_E} SELECT job_id, step_id, arg_max(state, seq) AS state, arg_max(CASE WHEN state = 'done' THEN 1.0::DOUBLE ELSE least(greatest(progress, 0.0::DOUBLE), 1.0::DOUBLE) END, seq) AS progress,
 min(seq) AS started_seq, max(seq) FILTER (state IN ('done', 'error')) AS finished_seq FROM ev GROUP BY 1, 2"""
)
def stream_step_state(spark, sf):
    return jobs.step_state(step_events(spark, sf))


@query(f"WITH {_E} SELECT job_id, max(seq) AS seq FROM ev WHERE state <> 'done' GROUP BY 1")
def coalesce_edits(spark, sf):
    ev = step_events(spark, sf).select("job_id", "seq", (F.col("state") == "done").alias("done"))
    return jobs.coalesce_edits(ev)


@query(f"WITH {_E} SELECT epoch_us(date_trunc('hour', ts)) AS window_start, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'error') AS failed, count(*) AS events FROM ev GROUP BY 1")
def stream_progress_windows(spark, sf):
    out = jobs.progress_windows(step_events(spark, sf), length="1 hour")
    return out.withColumn("window_start", _micros("window_start"))


@query(
    f"""WITH {_E}, w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS ws, state FROM ev, (SELECT unnest([0, 1, 2]) AS k)) SELECT epoch_us(ws) AS window_start, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'error') AS failed, count(*) AS events FROM w GROUP BY 1"""
)
def stream_sliding_windows(spark, sf):
    out = jobs.progress_windows(step_events(spark, sf), length="3 hours", slide="1 hour")
    return out.withColumn("window_start", _micros("window_start"))


def _micros(c):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 210 MINUTE THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id AS track_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS events FROM s GROUP BY user_id, n"""
)
def stream_sessions(spark, sf):
    ev = b.table(spark, sf, "events", F.col("user_id").alias("track_id"), "ts")
    out = jobs.sessions(ev, gap="210 minutes")
    return out.withColumns({"first_ts": _micros("first_ts"), "last_ts": _micros("last_ts")})


@query(
    """WITH t AS (SELECT user_id, event_id AS seq, CAST((event_id * 37) % 401 - 200 AS DOUBLE) AS v FROM events),
o AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM t), q AS (SELECT user_id, max(v) FILTER (i = n // 4) AS q1, max(v) FILTER (i = n * 3 // 4) AS q3 FROM o GROUP BY 1),
k AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM o JOIN q USING (user_id) WHERE o.n < 4 OR v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
SELECT user_id, round(avg(v), 4) AS "offset" FROM k WHERE i >= n // 10 AND i < n - n // 10 GROUP BY 1"""
)
def stream_tap_offset(spark, sf):
    ev = b.table(spark, sf, "events")
    taps = ev.select("user_id", F.col("event_id").alias("seq"), (F.pmod(F.col("event_id") * 37, F.lit(401)) - 200).cast("double").alias("off"))
    return jobs.tap_calibration(taps).withColumn("offset", F.round("offset", 4))


@query(
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, (event_id * 37) % 401 AS t FROM events), p AS (SELECT *, lag(t) OVER (PARTITION BY session_id ORDER BY seq) - t AS behind_ms FROM s)
SELECT session_id, seq, behind_ms FROM p WHERE behind_ms > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY seq) = 1"""
)
def stream_backward_alerts(spark, sf):
    ev = b.table(spark, sf, "events")
    return jobs.backward_alerts(ev.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.pmod(F.col("event_id") * 37, F.lit(401)).alias("start_ms")))
