"""Text-format writers. Each gives one row per output line, so a long track never sits in one cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.functions import timetext as tt
from verseline.operators.ordered import following_row, row_index, running_sum, scan
from verseline.functions.textnorm import strip

LINE_BLOCK_MS = 60_000


def _lines_scan(lines: DataFrame, **values) -> DataFrame:
    return scan(
        lines,
        by=["track_id"],
        order=["start_ms", "line_no"],
        block=F.floor(F.col("start_ms") / LINE_BLOCK_MS),
        **values,
    )


def write_lrc_lines(lines: DataFrame, precision: str = "cs") -> DataFrame:
    """Line mode: one stamp in front of the text."""
    return lines.select(
        "track_id", "line_no", F.concat(tt.lrc_stamp(F.col("start_ms"), precision), F.col("text")).alias("out")
    )


def write_lrc_chars(chars: DataFrame, mode: str = "word", precision: str = "cs") -> DataFrame:
    """Word or enhanced mode from ``chars`` (cps_ms array per character; empty = untimed, glued without a stamp)."""
    first = F.get("cps_ms", F.lit(0))
    clock = tt.lrc_clock(first, precision)
    left, right = ("[", "]") if mode == "word" else ("<", ">")
    piece = F.concat(F.when(first.isNotNull(), F.concat(F.lit(left), clock, F.lit(right))).otherwise(""), F.col("ch"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", piece.alias("p")))), lambda x: x["p"]), "")
    line = chars.groupBy("track_id", "line_no").agg(
        body.alias("body"), F.min(first).alias("start_ms"), F.max("release_ms").alias("release_ms")
    )
    tail = F.when(
        F.col("start_ms").isNotNull() & F.col("release_ms").isNotNull(),
        F.concat(F.lit(left), tt.lrc_clock(F.col("release_ms"), precision), F.lit(right)),
    ).otherwise("")
    lead = F.when(F.col("start_ms").isNotNull(), tt.lrc_stamp(F.col("start_ms"), precision)).otherwise("") if mode == "enhanced" else F.lit("")
    return line.select("track_id", "line_no", F.concat(lead, "body", tail).alias("out"))


def write_srt(lines: DataFrame, *, min_ms: int = 5000, durations: DataFrame | None = None) -> DataFrame:
    """Subtitle blocks: the end is the next line's start; blank lines get no number; an empty span becomes ``min_ms``."""
    seen = strip(F.col("text")) != ""
    s = _lines_scan(
        lines,
        nxt=following_row("start_ms"),
        number=running_sum(F.when(seen, 1).otherwise(0).cast("long")),
    )
    if durations is not None:
        s = s.join(durations.select("track_id", F.col("duration_ms").alias("__dur")), "track_id", "left")
    else:
        s = s.withColumn("__dur", F.lit(None).cast("long"))
    start = F.col("start_ms")
    raw_end = F.coalesce(F.col("nxt.start_ms"), F.when(F.col("__dur") > start, F.col("__dur")), start + min_ms)
    end = F.when(raw_end <= start, start + min_ms).otherwise(raw_end)
    return s.where(seen).select(
        "track_id",
        "line_no",
        "number",
        F.concat(F.col("number").cast("string"), F.lit("\n"), tt.srt_clock(start), F.lit(" --> "), tt.srt_clock(end), F.lit("\n"), F.col("text")).alias("out"),
    )


def write_ass(chars: DataFrame, *, pre_ms: int = 200, post_ms: int = 200) -> DataFrame:
    """Karaoke dialogue lines: ``\\k`` lengths run to the next timed character, the last one to the release."""
    from pyspark.sql import Window

    w = Window.partitionBy("track_id", "line_no").orderBy("char_no")
    ahead = Window.partitionBy("track_id", "line_no").orderBy(F.col("char_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = F.get("cps_ms", F.lit(0))
    line_end = F.greatest(F.max("release_ms").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.max(first).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    stop = F.coalesce(F.last(first, True).over(ahead), line_end)
    timed = chars.withColumns({"__t": first, "__stop": stop, "__end": line_end})
    k = F.greatest(F.round((F.col("__stop") - F.col("__t")) / 10).cast("long"), F.lit(0).cast("long"))
    piece = F.concat(F.when(F.col("__t").isNotNull(), F.concat(F.lit("{\\k"), k.cast("string"), F.lit("}"))).otherwise(""), F.col("ch"))
    lines = timed.groupBy("track_id", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", piece.alias("p")))), lambda x: x["p"]), "").alias("body"),
        F.min("__t").alias("s"),
        F.max("__end").alias("e"),
        F.array_join(
            F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("char_no", "singer_id"))), lambda x: x["singer_id"])), "/"
        ).alias("singers"),
    )
    lead = F.least(F.col("s"), F.lit(pre_ms)) / 10
    return lines.where(F.col("s").isNotNull()).select(
        "track_id",
        "line_no",
        F.concat(
            F.lit("Dialogue: 0,"),
            tt.ass_clock(F.col("s") - pre_ms),
            F.lit(","),
            tt.ass_clock(F.col("e") + post_ms),
            F.lit(",Default,"),
            F.col("singers"),
            F.lit(",0,0,0,,{\\k"),
            F.round(lead).cast("long").cast("string"),
            F.lit("}"),
            F.col("body"),
        ).alias("out"),
    )


def write_txt(lines: DataFrame) -> DataFrame:
    return lines.select("track_id", "line_no", F.col("text").alias("out"))


def write_inline(chars: DataFrame) -> DataFrame:
    """``[N|mm:ss:cc]char``: N is the beat count, with 0 appended on the last character of a line."""
    from pyspark.sql import Window

    last = F.max("char_no").over(Window.partitionBy("track_id", "line_no")) == F.col("char_no")
    n = F.concat(F.col("check_count").cast("string"), F.when(last, "0").otherwise(""))
    piece = F.when(
        F.size("cps_ms") > 0, F.concat(F.lit("["), n, F.lit("|"), tt.inline_clock(F.get("cps_ms", F.lit(0))), F.lit("]"), F.col("ch"))
    ).otherwise(F.col("ch"))
    return (
        chars.withColumn("__p", piece)
        .groupBy("track_id", "line_no")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_no", "__p"))), lambda x: x["__p"]), "").alias("out"))
    )


def write_view_json(chars: DataFrame) -> DataFrame:
    """One JSON document per line with its characters, times in seconds at three decimals."""
    sec = lambda c: F.round(c / 1000, 3)
    item = F.struct(
        F.col("ch").alias("c"),
        F.col("parts").alias("r"),
        F.transform("cps_ms", sec).alias("cp"),
        F.coalesce("linked", F.lit(False)).alias("link"),
        F.col("singer_id").alias("sg"),
        F.col("release_ms").isNotNull().alias("se"),
    )
    lines = chars.groupBy("track_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("char_no", item.alias("x")))).alias("cs"))
    body = F.struct(
        F.col("line_no").alias("i"),
        F.array_join(F.transform("cs", lambda v: v["x"]["c"]), "").alias("text"),
        F.transform("cs", lambda v: v["x"]).alias("chars"),
    )
    return lines.select("track_id", "line_no", F.to_json(body).alias("out"))


def save_text(rows: DataFrame, path: str, partitions: int = 200) -> None:
    """Write output lines to one folder per track, in line order inside every part file."""
    (
        rows.repartitionByRange(partitions, "track_id", "line_no")
        .sortWithinPartitions("track_id", "line_no")
        .select("track_id", F.col("out").alias("value"))
        .write.partitionBy("track_id")
        .text(path)
    )
