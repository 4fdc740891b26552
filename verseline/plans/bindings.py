"""The given tables seen as the operators' input schemas, in Spark and (``*_SQL``) in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verseline.functions import timetext as tt


def table(spark: SparkSession, sf_dir: str, name: str, *cols) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores one task per core before per-row text work; a large scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- lines: one track per user, an hour of event time is a second
def song_ms() -> Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 3600000")


def lines(spark: SparkSession, sf_dir: str, *extra) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("track_id"),
        F.col("event_id").alias("line_no"),
        F.col("event_type").alias("text"),
        song_ms().alias("start_ms"),
        (song_ms() + F.floor(F.col("value") * 100 + 0.5)).alias("end_ms"),
        *extra,
    )


LINES_SQL = """lines AS (
  SELECT CAST(user_id AS VARCHAR) AS track_id, event_id AS line_no, event_type AS text,
         (epoch_us(ts) - 1704067200000000) // 3600000 AS start_ms,
         (epoch_us(ts) - 1704067200000000) // 3600000 + CAST(floor(value * 100 + 0.5) AS BIGINT) AS end_ms, value, user_id, event_id, ts
  FROM events)"""


# ---------------------------------------------------------------- document lines
def doc_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", *extra))
    return docs.select("doc_id", *extra, F.posexplode(F.split("text", "\n")).alias("__p", "text")).select(
        "doc_id", (F.col("__p") + 1).cast("long").alias("line_no"), "text", *extra
    )


DOC_LINES_SQL = """doc_lines AS (
  SELECT doc_id, lang, source, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents))"""

# ---------------------------------------------------------------- the documents written as timed text
# line i of document d starts at i * 3170 + d % 1000 ms
LINE_START_SQL = "(line_no * 3170 + doc_id % 1000)"


def line_start(doc_id: Column, line_no: Column) -> Column:
    return line_no.cast("long") * 3170 + doc_id % 1000


def _files(spark: SparkSession, sf_dir: str, content: Column) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text"))
    return docs.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("songs/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".lrc")).alias("path"),
        content.alias("content"),
    )


def _per_line(fn) -> Column:
    return F.array_join(F.transform(F.split("text", "\n"), lambda l, i: fn(l, i + 1)), "\n")


def lrc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title / artist / offset tags, a number line, then stamped lines: odd lines in ms, even in cs, each fifth stamped twice."""

    def one(text: Column, no: Column) -> Column:
        start = line_start(F.col("doc_id"), no)
        stamp = F.when(F.pmod(no, F.lit(2)) == 1, tt.lrc_stamp(start, "ms")).otherwise(tt.lrc_stamp(start))
        again = F.when(F.pmod(no, F.lit(5)) == 0, tt.lrc_stamp(start + 600000, "ms")).otherwise("")
        return F.concat(stamp, again, text)

    head = F.concat(
        F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(F.concat(F.lit("[ti:doc "), F.col("doc_id").cast("string"), F.lit("]\n"))),
        F.lit("[ar:"), F.col("source"), F.lit("]\n[offset:1]\n12345\n[offset:"),
        ((F.pmod("doc_id", F.lit(7)) - 3) * 1000).cast("string"), F.lit("]\n"),
    )
    return _files(spark, sf_dir, F.concat(head, _per_line(one)))


def word_files(spark: SparkSession, sf_dir: str, enhanced: bool = False) -> DataFrame:
    """Word-stamped lines: word k of a line starts 250 ms after the one before, with a closing stamp."""

    def one(text: Column, no: Column) -> Column:
        start = line_start(F.col("doc_id"), no)
        left, right = ("<", ">") if enhanced else ("[", "]")
        stamp = lambda t: F.concat(F.lit(left), tt.lrc_clock(t, "ms"), F.lit(right))
        words = F.split(text, " ")
        body = F.array_join(F.transform(words, lambda w, k: F.concat(stamp(start + k * 250), w)), " ")
        out = F.concat(body, stamp(start + F.size(words) * 250))
        return F.concat(tt.lrc_stamp(start, "ms"), out) if enhanced else out

    return _files(spark, sf_dir, _per_line(one))


def duration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents in the line-relative dialect, odd ones in the absolute one."""

    def one(text: Column, no: Column) -> Column:
        start = line_start(F.col("doc_id"), no)
        words = F.split(text, " ")
        rel = F.array_join(
            F.transform(words, lambda w, k: F.concat(F.lit("<"), (k * 250).cast("string"), F.lit(",200,0>"), w)), ""
        )
        absolute = F.array_join(
            F.transform(words, lambda w, k: F.concat(F.lit("("), (start + k * 250).cast("string"), F.lit(",200,0)"), F.translate(w, "()", ""))), ""
        )
        head = F.concat(F.lit("["), start.cast("string"), F.lit(","), (F.size(words) * 250).cast("string"), F.lit("]"))
        return F.concat(head, F.when(F.pmod("doc_id", F.lit(2)) == 0, rel).otherwise(absolute))

    return _files(spark, sf_dir, _per_line(one))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per line; every fourth ends before it starts; every third is in italics over two text rows."""

    def one(text: Column, no: Column) -> Column:
        start = line_start(F.col("doc_id"), no)
        end = F.when(F.pmod(no, F.lit(4)) == 0, start - 10).otherwise(start + 2000)
        shown = F.when(F.pmod(no, F.lit(3)) == 0, F.concat(F.lit("<i>"), text, F.lit("</i>\nsecond row"))).otherwise(text)
        return F.concat(no.cast("string"), F.lit("\n"), tt.srt_clock(start), F.lit(" --> "), tt.srt_clock(end), F.lit("\n"), shown, F.lit("\n"))

    return _files(spark, sf_dir, _per_line(one))


def ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(text: Column, no: Column) -> Column:
        start = line_start(F.col("doc_id"), no) * 10
        words = F.split(text, " ")
        body = F.array_join(
            F.transform(
                words,
                lambda w, k: F.concat(
                    F.lit("{"), F.when(F.pmod(k, F.lit(4)) == 2, "\\sing_b").otherwise(""), F.lit("\\k"), (F.pmod(k, F.lit(3)) * 10 + 20).cast("string"), F.lit("}"), F.translate(w, ",", ";")
                ),
            ),
            "",
        )
        return F.concat(F.lit("Dialogue: 0,"), tt.ass_clock(start), F.lit(","), tt.ass_clock(start + 5000), F.lit(",Default,a,0,0,0,,"), body, F.lit("{\\k50}"))

    head = F.lit("[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n")
    return _files(spark, sf_dir, F.concat(head, _per_line(one)))


# ---------------------------------------------------------------- recogniser words: conversations
def asr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spread(table(spark, sf_dir, "conversations"))
    return conv.select(
        F.col("conv_id").alias("track_id"),
        F.col("turn").alias("seg_no"),
        "role",
        F.posexplode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("word_no", "word"),
    ).select(
        "track_id",
        "seg_no",
        F.col("word_no").cast("long").alias("word_no"),
        (F.col("seg_no") * 10000 + F.col("word_no") * 400).alias("start_ms"),
        (F.col("seg_no") * 10000 + F.col("word_no") * 400 + 300).alias("end_ms"),
        "word",
        "role",
    )


ASR_SQL = """asr_words AS (
  SELECT conv_id AS track_id, turn AS seg_no, k - 1 AS word_no, turn * 10000 + (k - 1) * 400 AS start_ms,
         turn * 10000 + (k - 1) * 400 + 300 AS end_ms, word, role
  FROM (SELECT conv_id, turn, role, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word
        FROM (SELECT *, regexp_extract_all(text, '[a-zA-Z]+', 0) AS w FROM conversations)))"""


# ---------------------------------------------------------------- frames: one track per supplier, one frame per week of shipping
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_quantity")
    week = F.floor(F.datediff("l_shipdate", F.lit("1992-01-01")) / 7)
    sums = li.groupBy(F.col("l_suppkey").alias("track_id"), week.alias("frame_no")).agg(F.sum("l_quantity").alias("value"))
    grid = sums.groupBy("track_id").agg(F.min("frame_no").alias("a"), F.max("frame_no").alias("b"))
    grid = grid.select("track_id", F.explode(F.sequence("a", "b")).alias("frame_no"))
    return grid.join(sums, ["track_id", "frame_no"], "left").select("track_id", "frame_no", F.coalesce("value", F.lit(0.0)).alias("value"))


FRAMES_SQL = """sums AS (
  SELECT l_suppkey AS track_id, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS frame_no, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2),
frames AS (
  SELECT g.track_id, g.frame_no, coalesce(s.value, 0.0) AS value
  FROM (SELECT track_id, unnest(range(min(frame_no), max(frame_no) + 1)) AS frame_no FROM sums GROUP BY track_id) g
  LEFT JOIN sums s ON s.track_id = g.track_id AND s.frame_no = g.frame_no)"""


# ---------------------------------------------------------------- assets: one footage clip per order
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    mod = lambda c, n: F.pmod(F.col(c), F.lit(n))
    return o.select(
        F.col("o_orderkey").alias("asset_id"),
        F.floor(F.col("o_custkey") / 15).alias("library_id"),
        F.translate(F.lower("o_orderstatus"), "fop", "ran").alias("origin_code"),
        ((mod("o_custkey", 50) + 1) / 500).alias("motion"),
        (mod("o_orderkey", 11) * 0.06).alias("luma"),
        (F.pmod(F.floor("o_totalprice"), F.lit(40)) / 100).alias("color"),
        (mod("o_orderkey", 9) * 0.03).alias("detail"),
        (mod("o_orderkey", 50) * 2.0).alias("t_in"),
        F.col("o_totalprice").alias("quality"),
        (mod("o_custkey", 2) == 0).alias("fade"),
    )


ASSETS_SQL = """assets AS (
  SELECT o_orderkey AS asset_id, o_custkey // 15 AS library_id, translate(lower(o_orderstatus), 'fop', 'ran') AS origin_code,
         (o_custkey % 50 + 1) / 500 AS motion, (o_orderkey % 11) * 0.06::DOUBLE AS luma, (CAST(floor(o_totalprice) AS BIGINT) % 40) / 100 AS color,
         (o_orderkey % 9) * 0.03::DOUBLE AS detail, (o_orderkey % 50) * 2.0::DOUBLE AS t_in, o_totalprice AS quality, o_custkey % 2 = 0 AS fade
  FROM orders)"""
