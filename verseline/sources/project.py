"""Song project files (JSON) of the current and the first layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field names of the project layouts. ``sentences`` is the current one, ``lines`` the first.
SCHEMA = """struct<
  version: string, metadata: struct<title: string, artist: string, album: string>, audio_duration_ms: bigint, global_offset_ms: bigint,
  singers: array<struct<id: string, name: string, is_default: boolean, enabled: boolean>>,
  sentences: array<struct<id: string, singer_id: string, characters: array<struct<
    char: string, ruby: struct<parts: array<struct<text: string, offset_ms: bigint>>>, check_count: int, timestamps: array<bigint>,
    sentence_end_ts: bigint, is_sentence_end: boolean, linked_to_next: boolean, singer_id: string>>>>,
  lines: array<struct<id: string, singer_id: string, text: string, timetags: array<struct<char_idx: int, checkpoint_idx: int, timestamp_ms: bigint>>,
    checkpoints: array<struct<char_idx: int, check_count: int, linked_to_next: boolean, singer_id: string>>,
    rubies: array<struct<start_idx: int, end_idx: int, text: string>>>>
>"""
FIRST_VERSIONS = ("1.0",)


def parse_projects(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.from_json("content", SCHEMA).alias("p")).where(F.col("p").isNotNull())


def project_tracks(projects: DataFrame) -> DataFrame:
    return projects.select(
        F.col("file_id").alias("track_id"), F.coalesce("p.version", F.lit("1.0")).alias("version"), F.coalesce("p.metadata.title", F.lit("")).alias("title"),
        F.coalesce("p.metadata.artist", F.lit("")).alias("artist"), F.coalesce("p.audio_duration_ms", F.lit(0)).alias("duration_ms"),
        F.coalesce(F.size("p.singers"), F.lit(0)).alias("singers"),
    )


def project_chars(projects: DataFrame) -> DataFrame:
    """Character rows of both layouts; the track offset is added to the times, never below 0."""
    offset = F.coalesce("p.global_offset_ms", F.lit(0))
    old = F.coalesce("p.version", F.lit("1.0")).isin(*FIRST_VERSIONS)
    move = lambda t: F.when(t.isNotNull(), F.greatest(t + F.col("off"), F.lit(0)))
    now = (
        projects.where(~old).select("file_id", offset.alias("off"), F.posexplode("p.sentences").alias("ln", "s"))
        .select("file_id", "off", "ln", F.col("s.singer_id").alias("line_singer"), F.posexplode("s.characters").alias("cn", "c"))
        .select(
            F.col("file_id").alias("track_id"), (F.col("ln") + 1).cast("long").alias("line_no"), F.col("cn").cast("long").alias("char_no"), F.col("c.char").alias("ch"),
            F.coalesce(F.col("c.ruby.parts.text"), F.array().cast("array<string>")).alias("parts"), F.coalesce("c.check_count", F.lit(1)).alias("check_count"),
            F.transform(F.coalesce("c.timestamps", F.array().cast("array<bigint>")), move).alias("cps_ms"),
            F.when(F.coalesce("c.is_sentence_end", F.lit(False)), move(F.col("c.sentence_end_ts"))).alias("release_ms"),
            F.coalesce("c.linked_to_next", F.lit(False)).alias("linked"), F.coalesce(F.nullif("c.singer_id", F.lit("")), "line_singer").alias("singer_id"),
        )
    )
    first = (
        projects.where(old).select("file_id", offset.alias("off"), F.posexplode("p.lines").alias("ln", "s"))
        .select("file_id", "off", "ln", "s", F.posexplode(F.split("s.text", "")).alias("cn", "ch"))
    )
    cp = F.get(F.filter("s.checkpoints", lambda x: x["char_idx"] == F.col("cn")), F.lit(0))
    tags = F.array_sort(F.transform(F.filter("s.timetags", lambda x: x["char_idx"] == F.col("cn")), lambda x: F.struct(x["checkpoint_idx"].alias("i"), x["timestamp_ms"].alias("t"))))
    ruby = F.get(F.filter("s.rubies", lambda x: x["start_idx"] == F.col("cn")), F.lit(0))["text"]
    first = first.select(
        F.col("file_id").alias("track_id"), (F.col("ln") + 1).cast("long").alias("line_no"), F.col("cn").cast("long").alias("char_no"), "ch",
        F.when(ruby.isNotNull(), F.array(ruby)).otherwise(F.array().cast("array<string>")).alias("parts"),
        F.greatest(F.coalesce(cp["check_count"], F.lit(1)), F.lit(0)).alias("check_count"),
        F.coalesce(F.transform(tags, lambda x: move(x["t"])), F.array().cast("array<bigint>")).alias("cps_ms"),
        F.lit(None).cast("long").alias("release_ms"), F.coalesce(cp["linked_to_next"], F.lit(False)).alias("linked"),
        F.coalesce(F.nullif(cp["singer_id"], F.lit("")), F.col("s.singer_id")).alias("singer_id"),
    )
    return now.unionByName(first)
