"""The same rows through a stream give the batch result."""

import tempfile

from pyspark.sql import functions as F

from verseline.streaming import jobs

SF = "/root/testdata/sf0.001"


def as_stream(spark, df, parts=3):
    """Write the rows as several files in time order and read the folder as a stream."""
    from pyspark.sql import Window

    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/in"
    cut = df.withColumn("__n", F.ntile(parts).over(Window.orderBy(df.columns[-1])))
    for n in range(1, parts + 1):  # files must arrive in the order of writing
        cut.where(F.col("__n") == n).drop("__n").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, mode, keys=None):
    name = "out_" + str(abs(hash((mode, id(stream)))))
    ckpt = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def step_rows(spark):
    from verseline.plans.live import step_events

    return step_events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).select("job_id", "step_id", "state", "progress", "ts", "seq")


def test_step_state(spark):
    rows = step_rows(spark)
    out = drain(jobs.stream_step_state(as_stream(spark, rows)), "complete")
    want = jobs.step_state(rows)
    assert out.exceptAll(want).count() == 0 and out.count() == want.count()


def test_actions_once(spark):
    rows = step_rows(spark).select(F.col("seq").alias("id"), "ts").limit(200)
    rows = rows.union(rows).orderBy("ts")
    out = drain(jobs.stream_actions(as_stream(spark, rows), watermark="60 days"), "append")
    assert out.count() == 200


def test_sessions(spark):
    rows = step_rows(spark).select(F.col("job_id").alias("track_id"), "ts")
    out = drain(jobs.stream_sessions(as_stream(spark, rows), gap="210 minutes", watermark="1 hour"), "append")
    want = jobs.sessions(rows, gap="210 minutes")
    assert out.count() > 0 and out.exceptAll(want).count() == 0


def test_tap_calibration(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = ev.select("user_id", (F.pmod(F.col("event_id") * 37, F.lit(401)) - 200).cast("double").alias("off"), F.col("event_id").alias("seq"))
    out = drain(jobs.stream_tap_counts(as_stream(spark, rows)), "update")
    out = spark.createDataFrame(out.collect(), out.schema)  # a memory sink can not be joined with itself
    got, want = jobs.calibration_of(out), jobs.tap_calibration(rows)
    both = got.join(want.withColumnRenamed("offset", "wanted"), "user_id")
    assert both.count() == want.count() == got.count() > 0 and both.where(F.abs(F.col("offset") - F.col("wanted")) > 1e-6).count() == 0
    assert out.groupBy("user_id", "off").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == rows.count()


def running(stream, mode, seconds=30):
    """Rows of a query that keeps running, after it has had time for three small files."""
    name = "run_" + str(abs(hash((mode, id(stream)))))
    ckpt = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", ckpt).start()
    q.awaitTermination(seconds)
    q.stop()
    return stream.sparkSession.table(name)


def test_idle_states_go(spark):
    rows = [(1, 5.0, 1), (1, 5.0, 2), (2, 1.0, 3), (2, 1.0, 4), (1, 5.0, 5), (1, 6.0, 6)]  # two rows a file
    taps = spark.createDataFrame(rows, "user_id long, off double, seq long")
    out = running(jobs.stream_tap_counts(as_stream(spark, taps), idle_ms=1), "update")
    assert sorted(map(tuple, out.collect())) == [(1, 5.0, 1), (1, 5.0, 2), (1, 6.0, 1), (2, 1.0, 2)]


def test_backward_alerts(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    rows = ev.select(F.col("user_id").cast("string").alias("session_id"), F.pmod(F.col("event_id") * 37, F.lit(401)).alias("start_ms"), F.col("event_id").alias("seq"))
    stream = as_stream(spark, rows)
    out = drain(jobs.stream_backward_alerts(stream), "append")
    want = jobs.backward_alerts(rows)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


def test_ingest(spark):
    from verseline.plans.catalogue import hashed

    pool = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/pool"
    rows = hashed(spark, SF)
    jobs.ingest_batch(rows.where("asset_id % 2 = 0"), pool)
    jobs.ingest_batch(rows.where("asset_id % 2 = 1"), pool)
    ids = {r.asset_id for r in spark.read.parquet(pool).collect()}
    assert ids and all(i % 2 == 0 for i in ids)
