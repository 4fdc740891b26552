"""Plug-in points: text dialects by file extension, and reading functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.sources import dialects

Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Parser] = {
    "lrc": dialects.parse_lrc, "srt": dialects.parse_srt, "ass": dialects.parse_ass_karaoke, "txt": dialects.parse_txt, "krc": dialects.parse_duration_words,
    "yrc": dialects.parse_duration_words,
}
_WRITERS: dict[str, Callable[..., DataFrame]] = {}
_READINGS: dict[str, Callable[[Column], Column]] = {}


def register_format(ext: str, parse: Parser | None = None, write: Callable[..., DataFrame] | None = None) -> None:
    """Add or replace a dialect. ``parse``: text_files -> rows; ``write``: rows -> (track_id, line_no, out)."""
    if parse:
        _PARSERS[ext.lower()] = parse
    if write:
        _WRITERS[ext.lower()] = write


def parse_as(files: DataFrame, ext: str) -> DataFrame:
    if ext.lower() not in _PARSERS:
        raise ValueError(f"no parser for .{ext}")
    return _PARSERS[ext.lower()](files)


def write_as(rows: DataFrame, ext: str, **params) -> DataFrame:
    if ext.lower() not in _WRITERS:
        raise ValueError(f"no writer for .{ext}")
    return _WRITERS[ext.lower()](rows, **params)


def register_reading(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a reading analyser: a Column function (for example an Arrow ``pandas_udf``)."""
    _READINGS[name] = fn


def add_readings(chars: DataFrame, *, analyser: str | None = None, dictionary: DataFrame | None = None, text: str = "ch") -> DataFrame:
    """Reading column from a registered analyser, else from a (word, reading) dictionary join."""
    if analyser:
        return chars.withColumn("reading", _READINGS[analyser](F.col(text)))
    words = dictionary.groupBy(F.col("word").alias(text)).agg(F.min("reading").alias("reading"))
    return chars.join(words, text, "left")
