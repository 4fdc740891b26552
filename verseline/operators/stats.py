"""Aggregates per track: statistics, audits, exact percentiles and robust means.

Percentiles work on the table of distinct values with their counts, scanned in value blocks, so no group is ever
collected: a hot track costs its number of distinct values spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.operators.ordered import group_total, multiplied, running_sum, salted_lookup, scan

LINE = ("track_id", "line_no")


def value_block(value: Column) -> Column:
    """Monotone block number of a number: about 1.5 % of its size wide."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 64)).cast("long")


def _distribution(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with count n (or sum of ``weight``), inclusive cumulative count and group total."""
    number = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(number.alias("n"))
    return scan(
        counts, by=by, order=["v"], block=value_block(F.col("v")), cum=running_sum(F.col("n")), total=group_total(F.col("n"))
    )


def _value_at(index: Column) -> Column:
    """Value at a 0-based position of the sorted group (as an aggregate over the distribution)."""
    return F.min(F.when(F.col("cum") > index, F.col("v")))


def exact_percentiles(df: DataFrame, *, by: Sequence[str], value: str, **ps: float) -> DataFrame:
    """Exact percentiles with linear interpolation; one output column per keyword."""
    dist = _distribution(df, by, value)
    aggs = []
    for name, p in ps.items():
        at = F.lit(p) * (F.col("total") - 1)
        aggs += [_value_at(F.floor(at)).alias(f"__lo_{name}"), _value_at(F.ceil(at)).alias(f"__hi_{name}")]
    g = dist.groupBy(*by, "total").agg(*aggs)
    at = lambda p: F.lit(p) * (F.col("total") - 1)
    return g.select(
        *by, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (at(p) - F.floor(at(p)))).alias(n) for n, p in ps.items()]
    )


def robust_mean(df: DataFrame, *, by: Sequence[str], value: str, name: str = "robust_mean", weight: str | None = None) -> DataFrame:
    """Mean after a 1.5 IQR fence (from four values on) and a tenth trimmed at both ends; ``weight``: how often a row's value counts."""
    dist = _distribution(df, by, value, weight)
    fence = dist.groupBy(*by, "total").agg(
        _value_at(F.floor(F.col("total") / 4)).alias("q1"), _value_at(F.floor(F.col("total") * 3 / 4)).alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = salted_lookup(dist.select(*by, "v", "n"), fence, list(by)).where(
        (F.col("total") < 4) | F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    )
    s = scan(kept.select(*by, "v", "n"), by=by, order=["v"], block=value_block(F.col("v")), cum=running_sum(F.col("n")), total=group_total(F.col("n")))
    trim = F.floor(F.col("total") / 10)
    copies = F.greatest(
        F.lit(0), F.least(F.col("cum"), F.col("total") - trim) - F.greatest(F.col("cum") - F.col("n"), trim)
    )
    return s.groupBy(*by).agg((F.sum(F.col("v") * copies) / F.sum(copies)).alias(name))


# ------------------------------------------------------------------ project statistics and audits
def timing_stats(chars: DataFrame) -> DataFrame:
    """Per track: lines with timing work, characters, stamps, checkpoints, finished lines and their share."""
    points = F.col("check_count") + F.col("release_ms").isNotNull().cast("int")
    stamps = F.size("cps_ms") + F.col("release_ms").isNotNull().cast("int")
    lines = chars.groupBy(*LINE).agg(
        F.count("*").alias("chars"), F.sum(stamps).alias("stamps"), F.sum(points).alias("points"),
        F.min(F.size("cps_ms") >= F.col("check_count")).alias("done"),
    )
    real = lines.where(F.col("points") > 0)
    return real.groupBy("track_id").agg(
        F.count("*").alias("total_lines"), F.sum("chars").alias("total_chars"), F.sum("stamps").alias("total_timetags"),
        F.sum("points").alias("total_checkpoints"), F.count_if("done").alias("completed_lines"),
        F.round(F.count_if("done") / F.count("*"), 4).alias("completion_rate"),
    )


def untimed_report(lines: DataFrame, *, done: Column, shown: int = 10) -> DataFrame:
    """The first ``shown`` unfinished lines of each track with the track's total of unfinished lines."""
    open_lines = lines.where(~done).select(*LINE)
    first = open_lines.withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy("line_no"))).where(F.col("rank") <= shown)
    return first.join(open_lines.groupBy("track_id").agg(F.count("*").alias("total")), "track_id")


def validate_tracks(tracks: DataFrame, singers: DataFrame, lines: DataFrame) -> DataFrame:
    """Error rows: no singers, no default singer, lines that name an unknown singer."""
    have = singers.groupBy("track_id").agg(F.count("*").alias("n"), F.max("is_default").alias("d"))
    j = tracks.select("track_id").join(have, "track_id", "left")
    none = j.where(F.col("n").isNull()).select("track_id", F.lit("no singer").alias("error"), F.lit(1).cast("long").alias("n"))
    no_default = j.where(F.col("n").isNotNull() & ~F.col("d")).select("track_id", F.lit("no default singer").alias("error"), F.lit(1).cast("long").alias("n"))
    used = lines.groupBy("track_id", "singer_id").agg(F.count("*").alias("n"))
    unknown = used.join(singers, ["track_id", "singer_id"], "left_anti").groupBy("track_id").agg(F.sum("n").alias("n")).select("track_id", F.lit("unknown singer").alias("error"), "n")
    return none.unionByName(no_default).unionByName(unknown)


def ruby_part_mismatch(chars: DataFrame) -> DataFrame:
    """Characters whose reading parts do not match their beats, with the reading re-split to fit."""
    from verseline.functions.kana import split_for_checks

    bad = chars.where((F.size("parts") > 0) & (F.col("check_count") > 0) & (F.size("parts") != F.col("check_count")))
    return bad.select(*LINE, "char_no", F.size("parts").alias("n_parts"), "check_count", F.array_join(split_for_checks(F.array_join("parts", ""), F.col("check_count")), "|").alias("preview"))


def audit_alignment(tokens: DataFrame) -> DataFrame:
    """Violations per track: start after end, repeated ids, starts that go back (tokens: token_no, token_id, start_ms, end_ms)."""
    from verseline.operators.ordered import running_max

    s = scan(tokens, by=["track_id"], order=["token_no"], block=F.floor(F.col("token_no") / 65536), hi=running_max(F.col("start_ms"), inclusive=False))
    flags = s.groupBy("track_id").agg(
        F.count_if(F.col("start_ms") > F.col("end_ms")).alias("inverted"), F.count_if(F.col("start_ms") < F.col("hi")).alias("backward"), F.count("*").alias("tokens")
    )
    ids = tokens.groupBy("track_id", "token_id").agg(F.count("*").alias("n")).groupBy("track_id").agg(F.sum(F.col("n") - 1).alias("repeated_ids"))
    return flags.join(ids, "track_id")


def roles_in_order(rows: DataFrame, *, by: Sequence[str], role: str, order: str) -> DataFrame:
    """Distinct labels numbered by first appearance (distinct labels of a track are few)."""
    first = rows.groupBy(*by, role).agg(F.min(order).alias("first_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("first_at", role)))


def majority_source(lines: DataFrame) -> DataFrame:
    """Blocks most of whose lines were sung in one earlier block: (block_no, repeat_of). Lines need block_no and key."""
    # nearly as many keys as lines: a copy for every salt would be many times the text
    first = lines.groupBy("track_id", "key").agg(F.min("block_no").alias("src"), F.max("block_no").alias("__last")).where(F.col("src") < F.col("__last")).drop("__last")
    per_block = lines.groupBy("track_id", "block_no", "key").agg(F.count("*").alias("n"))
    votes = per_block.join(multiplied(first), ["track_id", "key"]).where(F.col("src") < F.col("block_no"))
    tally = votes.groupBy("track_id", "block_no", "src").agg(F.sum("n").alias("votes"))
    best = tally.groupBy("track_id", "block_no").agg(F.max(F.struct("votes", -F.col("src"))).alias("b"))
    size = lines.groupBy("track_id", "block_no").agg(F.count("*").alias("lines"))
    j = best.join(size, ["track_id", "block_no"])
    enough = F.col("b.votes") >= F.greatest(F.lit(2), F.floor(F.col("lines") * 0.6))
    return j.where(enough).select("track_id", "block_no", (-F.col("b.col2")).alias("repeat_of"), F.col("b.votes").alias("votes"))


def chorus_kinds(blocks: DataFrame, repeats: DataFrame) -> DataFrame:
    """``chorus`` for repeating blocks and the blocks they repeat, ``verse`` for the rest."""
    marked = repeats.select("track_id", "block_no").union(repeats.select("track_id", "repeat_of")).distinct().withColumn("__c", F.lit(True))
    return blocks.join(marked, ["track_id", "block_no"], "left").select(*blocks.columns, F.when(F.col("__c"), "chorus").otherwise("verse").alias("kind"))


def suggest_segment(matches: DataFrame, regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Sung stretch of a recording: first to last good hit with padding, carried to the end of the region it ends in."""
    hit = F.col("start_ms").isNotNull() & (F.col("score") >= 0.5)
    m = matches.groupBy("track_id").agg(
        F.min(F.when(hit, F.col("start_ms"))).alias("first"), F.max(F.when(hit, F.col("end_ms"))).alias("last"),
        F.round(F.count_if(hit) / F.count("*"), 2).alias("confidence"),
    )
    around = m.select("track_id", "last").join(regions, "track_id").where(F.col("last").between(F.col("region_start"), F.col("region_end")))
    tail = around.groupBy("track_id").agg(F.max("region_end").alias("tail"))
    j = m.join(durations, "track_id").join(tail, "track_id", "left")
    end = F.least("duration_ms", F.greatest(F.least("duration_ms", F.col("last") + 2500), F.coalesce(F.col("tail") + 1500, F.lit(0))))
    return j.select(
        "track_id", F.coalesce(F.greatest(F.lit(0), F.col("first") - 2000), F.lit(0).cast("long")).alias("start_ms"),
        F.coalesce(F.when(F.col("first").isNotNull(), end), F.col("duration_ms")).alias("end_ms"), "confidence",
    )


def tap_offset(tap_s: Column, start_s: Column, beat_s: Column) -> Column:
    """Signed ms from a tap to its nearest beat (positive = early); null before the start."""
    elapsed = tap_s - start_s
    n = F.bround(elapsed / beat_s)
    return F.when((beat_s > 0) & (elapsed >= 0), (start_s + n * beat_s - tap_s) * 1000)
