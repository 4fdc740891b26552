"""Ordered operators over lines (whole tracks, in time blocks) and characters (inside one line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.operators.ordered import (
    Running,
    following_row,
    framed,
    islands,
    islands_after,
    last_known,
    next_known,
    previous_row,
    row_index,
    running_max,
    running_min,
    running_sum,
    scan,
)

TRACK = ("track_id",)
ORDER = ("start_ms", "line_no")
BLOCK_MS = 60_000


def line_scan(lines: DataFrame, *, by: Sequence[str] = TRACK, order: Sequence[str] = ORDER, block: Column | None = None, **values) -> DataFrame:
    return scan(lines, by=by, order=order, block=F.floor(F.col(order[0]) / BLOCK_MS) if block is None else block, **values)


def line_islands(lines: DataFrame, starts: Column, name: str, *, by: Sequence[str] = TRACK, order: Sequence[str] = ORDER) -> DataFrame:
    return islands(lines, by=by, order=order, block=F.floor(F.col(order[0]) / BLOCK_MS), starts=starts, name=name)


# ------------------------------------------------------------------ sections, paragraphs, pages
def section_ids(lines: DataFrame, *, gap_ms: int) -> DataFrame:
    """0-based section number: a new one where the gap to the previous line's end exceeds ``gap_ms``."""
    s = islands_after(
        lines, by=TRACK, order=ORDER, block=F.floor(F.col("start_ms") / BLOCK_MS), cols=["start_ms", "end_ms"],
        starts=lambda prev, cur: cur["start_ms"] - prev["end_ms"] > gap_ms, name="section_id",
    )
    return s.withColumn("section_id", F.col("section_id") - 1)


def lyric_blocks(lines: DataFrame, *, gap_s: float = 3.5) -> DataFrame:
    """1-based sung block: a new one where the gap to everything sung before exceeds ``gap_s``."""
    gap = int(round(gap_s * 1000))
    reach = line_scan(lines, __reach=running_max(F.col("end_ms"), inclusive=False))
    fresh = F.col("__reach").isNull() | (F.col("start_ms") - F.col("__reach") > gap)
    return line_islands(reach, fresh, "block_no").drop("__reach")


def lyric_sections(lines: DataFrame, *, gap_s: float = 3.5) -> DataFrame:
    return lyric_blocks(lines, gap_s=gap_s).groupBy("track_id", "block_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("lines")
    )


def section_ends(lines: DataFrame, *, tail_ms: int) -> DataFrame:
    return lines.groupBy("track_id", "section_id").agg((F.max("end_ms") + tail_ms).alias("end_ms"))


def paragraph_flags(lines: DataFrame, *, threshold_ms: int = 3100) -> DataFrame:
    """Flag the last line of each paragraph; blank lines split pages and are never flagged."""
    blank = F.trim("text") == ""
    paged = line_islands(lines, blank, "page")
    words = paged.where(~blank)
    by = ["track_id", "page"]
    near = line_scan(words, by=by, __reach=running_max(F.col("end_ms")), __next=running_min(F.col("start_ms"), inclusive=False, forward=False))
    last = F.col("__next").isNull() | (F.col("__next") - F.col("__reach") >= max(threshold_ms, 0))
    flagged = near.select(*lines.columns, last.alias("paragraph_end"))
    return flagged.unionByName(lines.where(blank).withColumn("paragraph_end", F.lit(False)))


def page_plan(lines: DataFrame, *, rows: int = 2, gap_ms: int) -> DataFrame:
    """Section, page inside the section and lane (row on the page) of every line."""
    s = line_scan(section_ids(lines, gap_ms=gap_ms), by=["track_id", "section_id"], __n=row_index())
    return s.select(
        *lines.columns,
        "section_id",
        F.floor((F.col("__n") - 1) / rows).alias("page_no"),
        F.pmod(F.col("__n") - 1, F.lit(rows)).alias("lane"),
    )


def seq_line_breaks(lines: DataFrame, *, seq: int = 2, pre: int = 1800, post: int = 1000, interval: int = 300) -> DataFrame:
    """Break before each line: ``paragraph`` when the next ``seq`` lines start late enough after everything before,
    ``page`` after every ``seq`` lines of a paragraph, else ``none``.

    The paragraph test looks at the latest end of all earlier lines rather than of the current page only.
    """
    s = line_scan(lines, __i=row_index(), __reach=running_max(F.col("end_ms"), inclusive=False))
    s = framed(s, by=TRACK, position="__i", width=4096, before=0, after=seq - 1, __begin=lambda w: F.min("start_ms").over(w))
    para = F.col("__reach").isNull() | (F.col("__begin") - F.col("__reach") >= pre + post + interval)
    s = line_islands(s, para, "__para")
    s = line_scan(s, by=["track_id", "__para"], __n=row_index())
    first = F.col("__n") == 1
    kind = (
        F.when(F.col("__reach").isNull(), "none")
        .when(first, "paragraph")
        .when(F.pmod(F.col("__n") - 1, F.lit(seq)) == 0, "page")
        .otherwise("none")
    )
    return s.select(*lines.columns, kind.alias("break_before"))


def section_edges(lines: DataFrame) -> DataFrame:
    """First and last line of every section."""
    s = line_scan(lines, by=["track_id", "section_id"], __a=row_index(), __z=row_index(forward=False))
    return s.where((F.col("__a") == 1) | (F.col("__z") == 1)).select(
        *lines.columns, (F.col("__a") == 1).alias("is_first"), (F.col("__z") == 1).alias("is_last")
    )


def prev_next_nonempty(lines: DataFrame, *, filled: Column) -> DataFrame:
    """Nearest earlier and later line for which ``filled`` holds; -1 when none."""
    no = F.when(filled, F.col("line_no"))
    s = line_scan(lines, prev_line=last_known(no, inclusive=False), next_line=next_known(no, inclusive=False))
    return s.withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("prev_line", "next_line")})


# ------------------------------------------------------------------ display windows
def protect_ms(pre: int, post: int, manual: int = 0) -> int:
    return min(manual, pre, post) if manual > 0 else min(pre, post) // 2


def display_windows(lines: DataFrame, *, lead_ms: int = 1800, tail_ms: int = 1000, protect: int = 0) -> DataFrame:
    """Show / hide time of each line; neighbours in a lane are cut where they meet, keeping a protected margin.

    One pass: each line looks at its lane neighbours only.
    """
    keep = protect_ms(lead_ms, tail_ms, protect)
    s = line_scan(lines, by=["track_id", "lane"], __p=previous_row("end_ms"), __n=following_row("start_ms"))
    hide = lambda end, nxt: F.least(end + tail_ms, F.greatest(end + keep, nxt - keep))
    start, end = F.col("start_ms"), F.col("end_ms")
    return s.select(
        *lines.columns,
        F.greatest(
            F.lit(0).cast("long"), F.greatest(start - lead_ms, F.least(start - keep, hide(F.col("__p.end_ms"), start)))
        ).alias("show_ms"),
        F.when(F.col("__n").isNull(), end + tail_ms).otherwise(hide(end, F.col("__n.start_ms"))).alias("hide_ms"),
    )


def window_compression_report(windows: DataFrame, *, lead_ms: int = 1800, tail_ms: int = 1000) -> DataFrame:
    """How far each window is from the ideal one: entry delayed and exit advanced, in ms."""
    late = F.col("show_ms") - F.greatest(F.col("start_ms") - lead_ms, F.lit(0))
    early = F.col("end_ms") + tail_ms - F.col("hide_ms")
    return windows.where((late > 0) | (early > 0)).select(
        "track_id", "line_no", late.alias("entry_delayed_ms"), early.alias("exit_advanced_ms"),
        F.when((late > 0) & (early > 0), "both").when(late > 0, "entry").otherwise("exit").alias("kind"),
    )


# ------------------------------------------------------------------ timing quality
def line_beats(chars: DataFrame) -> DataFrame:
    """Per line: beats, timed characters, short characters and the start of the last timed one.

    Chars need start_ms, end_ms and beats (0 = untimed).
    """
    timed = F.col("beats") > 0
    return chars.groupBy("track_id", "line_no").agg(
        F.sum(F.when(timed, F.greatest("beats", F.lit(1)))).alias("beats"),
        F.count_if(timed).alias("timed"),
        F.count_if(timed & (F.col("end_ms") - F.col("start_ms") < 45)).alias("short"),
        F.max(F.when(timed, F.col("start_ms"))).alias("last_start_ms"),
    )


def timing_qa(lines: DataFrame, beats: DataFrame) -> DataFrame:
    """Level (ok / warn / bad) and notes of every line: speed, tiny characters, overlap with the next line."""
    s = line_scan(lines, __n=following_row("start_ms")).join(beats, ["track_id", "line_no"], "left")
    dur = F.greatest(F.lit(10), F.least("end_ms", F.col("last_start_ms") + 1200) - F.col("start_ms"))
    fast = F.col("beats") * 1000 > dur * 11
    slow = ~fast & (F.col("beats") * 1000 < dur) & (dur > 4000)
    short = F.col("short") >= F.greatest(F.lit(2), F.floor(F.col("timed") / 3))
    many = F.col("short") >= F.floor(F.col("timed") / 2)
    over = F.col("end_ms") > F.col("__n.start_ms") + 50
    none = F.coalesce("timed", F.lit(0)) == 0
    level = F.greatest(
        F.when(none, 2).when(fast, 2).when(slow, 1).otherwise(0),
        F.when(short & many, 2).when(short, 1).otherwise(0),
        F.when(over, 1).otherwise(0),
    )
    notes = F.array_compact(
        F.array(F.when(none, "untimed"), F.when(fast, "fast"), F.when(slow, "slow"), F.when(short, "short"), F.when(over, "overlap"))
    )
    return s.select(
        "track_id",
        "line_no",
        F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("bad")), level + 1).alias("flag"),
        F.array_join(notes, ",").alias("notes"),
    )


def qa_summary(qa: DataFrame) -> DataFrame:
    return qa.groupBy("track_id").agg(
        *[F.count_if(F.col("flag") == f).alias(f) for f in ("ok", "warn", "bad")], F.count("*").alias("lines")
    )


def backward_alerts(lines: DataFrame, *, order: Sequence[str] = ("line_no",), block: Column | None = None) -> DataFrame:
    """Stamps that are earlier than one already written before them."""
    block = F.floor(F.col(order[0]) / 65536) if block is None else block
    s = scan(lines, by=TRACK, order=order, block=block, __hi=running_max(F.col("start_ms"), inclusive=False))
    return s.where(F.col("start_ms") < F.col("__hi")).select(*lines.columns, (F.col("__hi") - F.col("start_ms")).alias("behind_ms"))


def monotonic_fix(lines: DataFrame, *, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Starts raised to the running maximum; an end below it becomes that maximum + 50 ms."""
    s = scan(lines, by=TRACK, order=order, block=F.floor(F.col(order[0]) / 65536), __hi=running_max(F.col("start_ms")))
    end = F.when(F.col("end_ms") < F.col("__hi"), F.col("__hi") + 50).otherwise(F.col("end_ms"))
    keep = [c for c in lines.columns if c not in ("start_ms", "end_ms")]
    return s.select(*keep, F.col("__hi").alias("start_ms"), end.alias("end_ms"))


def fill_untimed(lines: DataFrame) -> DataFrame:
    """Untimed rows (null start) take the previous end, no later than the next start; at the head the next start."""
    s = scan(
        lines, by=TRACK, order=["line_no"], block=F.floor(F.col("line_no") / 65536),
        __e=last_known(F.when(F.col("start_ms").isNotNull(), F.col("end_ms")), inclusive=False),
        __s=next_known(F.col("start_ms"), inclusive=False),
    )
    at = F.coalesce(F.least("__e", "__s"), F.col("__s"))
    keep = [c for c in lines.columns if c not in ("start_ms", "end_ms")]
    return s.select(*keep, F.coalesce("start_ms", at).alias("start_ms"), F.coalesce(F.when(F.col("start_ms").isNotNull(), F.col("end_ms")), at).alias("end_ms"))


def interpolate_lines(lines: DataFrame, *, value: str = "est_ms") -> DataFrame:
    """Unknown estimates become the straight line, by position, between the known neighbours."""
    block = F.floor(F.col("line_no") / 65536)
    s = scan(lines, by=TRACK, order=["line_no"], block=block, __i=row_index())
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("__i").alias("i")))
    s = scan(s, by=TRACK, order=["line_no"], block=block, __p=last_known(known), __n=next_known(known))
    p, n, i = F.col("__p"), F.col("__n"), F.col("__i")
    mid = p["v"] + (n["v"] - p["v"]) * (i - p["i"]) / (n["i"] - p["i"])
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(p.isNotNull() & n.isNotNull(), mid)
    return s.select(*[c for c in lines.columns if c != value], F.round(F.coalesce(filled, p["v"].cast("double"), n["v"].cast("double")), 3).alias(value))


def borrow_line_ends(lines: DataFrame, *, block_ms: int = 4096) -> DataFrame:
    """Lines without an end take the start of the next line that has characters, past blank ones, but never end before their last character;
    the last of a track ends with it.

    ``lines``: track_id, line_no, start_ms and last_ms of the first and last character (null on blank lines), end_ms.
    """
    s = scan(lines, by=TRACK, order=["line_no"], block=F.floor(F.col("line_no") / block_ms), __next=Running("near", F.col("start_ms"), False, False))
    borrowed = F.when(F.col("__next") >= F.col("last_ms"), F.col("__next")).otherwise(F.col("last_ms"))
    return s.select(*[F.coalesce("end_ms", F.when(F.col("start_ms").isNotNull(), borrowed)).alias(c) if c == "end_ms" else F.col(c) for c in lines.columns])


def run_length(rows: DataFrame, *, by: Sequence[str], order: str, value: str, block_rows: int = 65536) -> DataFrame:
    """Consecutive equal values -> (value, first, last, n)."""
    s = islands_after(
        rows, by=by, order=[order], block=F.floor(F.col(order) / block_rows), cols=[value],
        starts=lambda prev, cur: ~prev[value].eqNullSafe(cur[value]), name="run_no",
    )
    return s.groupBy(*by, "run_no").agg(
        F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")
    )


def fill_forward_backward(rows: DataFrame, *, by: Sequence[str], order: str, value: str, block_rows: int = 65536) -> DataFrame:
    """Missing values take the nearest earlier one, else the nearest later one."""
    s = scan(rows, by=by, order=[order], block=F.floor(F.col(order) / block_rows), __b=last_known(F.col(value)), __a=next_known(F.col(value)))
    return s.select(*[c for c in rows.columns if c != value], F.coalesce("__b", "__a").alias(value))


def monotone_chain(hits: DataFrame, *, confident: Column) -> DataFrame:
    """Order-preserving subset of (line_no, pos) matches: not before a confident hit of an earlier line, nor after one
    of a later line."""
    pos = F.when(confident, F.col("pos"))
    s = scan(
        hits, by=TRACK, order=["line_no", "pos"], block=F.floor(F.col("line_no") / 4096),
        __lo=running_max(pos, inclusive=False), __hi=running_min(pos, inclusive=False, forward=False),
    )
    good = (F.col("__lo").isNull() | (F.col("pos") >= F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("pos") <= F.col("__hi")))
    return s.where(good).select(*hits.columns)


# ------------------------------------------------------------------ characters (one line at a time)
LINE = ("track_id", "line_no")


def _line(order: str = "char_no") -> Window:
    return Window.partitionBy(*LINE).orderBy(order)


def _before(order: str = "char_no"):
    return Window.partitionBy(*LINE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _after(order: str = "char_no"):
    return Window.partitionBy(*LINE).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)


def char_windows(chars: DataFrame) -> DataFrame:
    """Start and end of every character in ms.

    A timed character ends at its own release, else at the next timed start, else at the line end, else after 400 ms,
    and never before its last checkpoint. Untimed characters collapse onto the previous end (or the next start).
    """
    first, last = F.get("cps_ms", F.lit(0)), F.try_element_at("cps_ms", F.lit(-1))
    whole = Window.partitionBy(*LINE)
    line_end = F.greatest(F.max("release_ms").over(whole), F.max(last).over(whole))
    s = chars.withColumns({"__s": first, "__l": last, "__n": F.last(first, True).over(_after()), "__le": line_end})
    end = F.coalesce(
        F.col("release_ms"), F.col("__n"), F.when(F.col("__le") > F.col("__s"), F.col("__le")), F.col("__s") + 400
    )
    s = s.withColumn("__e", F.when(F.col("__s").isNotNull(), F.greatest(end, "__l")))
    at = F.coalesce(F.last("__e", True).over(_before()), F.col("__n"))
    s = s.withColumn("__at", at)
    return s.select(*chars.columns, F.coalesce("__s", "__at").alias("start_ms"), F.coalesce("__e", "__at").alias("end_ms"))


def char_intervals(chars: DataFrame) -> DataFrame:
    """Characters that share one stamp split its block by display width. Needs block_start, block_end, width."""
    key = [*LINE, "block_start", "block_end"]
    w = Window.partitionBy(*key).orderBy("char_no")
    total = F.sum("width").over(Window.partitionBy(*key))
    upto = F.sum("width").over(w)
    span = F.col("block_end") - F.col("block_start")
    cut = lambda x: (F.col("block_start") + F.floor(span * x / total)).cast("long")
    return chars.select(*chars.columns, cut(upto - F.col("width")).alias("start_ms"), cut(upto).alias("end_ms"))


def estimate_char_times(lines: DataFrame) -> DataFrame:
    """Characters of line-stamped text spread evenly up to the next line (or a length guessed from the text)."""
    s = line_scan(lines, __n=following_row("start_ms"))
    visible = F.length(F.regexp_replace("text", r"[\s　]", ""))
    guess = F.col("start_ms") + F.least(F.greatest(F.greatest(visible, F.lit(1)) * 140, F.lit(1200)), F.lit(7000))
    end = F.when(F.col("__n.start_ms") > F.col("start_ms"), F.col("__n.start_ms")).otherwise(guess)
    span = F.greatest(end - F.col("start_ms"), visible * 40)
    s = s.withColumns({"__v": visible, "__span": span}).where(F.col("__v") > 0)
    chars = s.select(*LINE, "start_ms", "__v", "__span", F.posexplode(F.split(F.regexp_replace("text", r"[\s　]", ""), "")).alias("k", "ch"))
    step = F.greatest(F.floor(F.col("__span") / F.col("__v")), F.lit(40))
    return chars.select(*LINE, F.col("k").cast("long").alias("char_no"), "ch", (F.col("start_ms") + F.least(F.col("k") * step, F.col("__span"))).alias("char_ms"))


def word_groups(chars: DataFrame) -> DataFrame:
    """Characters joined into words along ``linked`` (true = continues into the next character)."""
    prev = F.lag("linked").over(_line())
    gid = F.sum(F.when(F.coalesce(prev, F.lit(False)), 0).otherwise(1)).over(_line())
    g = chars.withColumn("__g", gid).groupBy(*LINE, F.col("__g").alias("group_no")).agg(
        F.array_sort(F.collect_list(F.struct("char_no", "ch", "parts"))).alias("x")
    )
    return g.select(
        *LINE,
        F.col("group_no").cast("long").alias("group_no"),
        F.array_join(F.transform("x", lambda v: v["ch"]), "").alias("text"),
        F.array_join(F.transform("x", lambda v: F.array_join(v["parts"], "")), "").alias("reading"),
        F.size("x").cast("long").alias("n"),
    )


def reading_unit_times(units: DataFrame) -> DataFrame:
    """Reading units of a span: given offsets clamped to be non-decreasing, the rest spread evenly.

    Units need unit_no (0-based), n, start_ms, end_ms and offset_ms (null = unknown).
    """
    w = Window.partitionBy(*LINE, "char_no").orderBy("unit_no")
    spread = F.bround((F.col("end_ms") - F.col("start_ms")) * F.col("unit_no") / F.col("n")).cast("long")
    raw = F.least(F.coalesce("offset_ms", spread), F.col("end_ms") - F.col("start_ms"))
    s = units.withColumn("unit_ms", F.col("start_ms") + F.max(raw).over(w))
    return s.select(*units.columns, "unit_ms", F.coalesce(F.lead("unit_ms").over(w), F.col("end_ms")).alias("unit_end_ms"))


def smooth_timing(chars: DataFrame, *, strength: float = 0.5, max_ms: int = 80, min_gap: int = 20) -> DataFrame:
    """Two passes toward the middle of the neighbours, at most ``max_ms`` from the original, across gaps up to 1 s."""
    w = _line()
    s = chars.withColumn("__t", F.col("start_ms").cast("double"))
    for _ in range(2):
        p, n = F.lag("__t").over(w), F.lead("__t").over(w)
        free = (n - p).isNotNull() & (F.col("__t") - p <= 1000) & (n - F.col("__t") <= 1000)
        moved = F.col("__t") + ((p + n) / 2 - F.col("__t")) * strength
        s = s.withColumn("__m", F.when(free, F.least(F.greatest(moved, F.col("start_ms") - max_ms), F.col("start_ms") + max_ms)).otherwise(F.col("__t")))
        s = s.drop("__t").withColumnRenamed("__m", "__t")
    floor = F.coalesce(F.lag("__t").over(w) + min_gap, F.col("__t"))
    return s.withColumn("smooth_ms", F.floor(F.greatest("__t", floor) + 0.5)).drop("__t")


def mirror_reversed_lines(chars: DataFrame) -> DataFrame:
    """A line whose starts and end strictly fall is mirrored around its first and last boundary and flagged."""
    whole = Window.partitionBy(*LINE)
    nxt = F.coalesce(F.lead("start_ms").over(_line()), F.col("line_end_ms"))
    falls = F.min(F.coalesce(nxt < F.col("start_ms"), F.lit(False))).over(whole)
    high = F.max("start_ms").over(whole)
    s = chars.withColumns({"__rev": falls, "__hi": high})
    keep = [c for c in chars.columns if c not in ("start_ms", "line_end_ms")]
    return s.select(
        *keep,
        F.when(F.col("__rev"), F.col("line_end_ms") + F.col("__hi") - F.col("start_ms")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(F.col("__rev"), F.col("__hi")).otherwise(F.col("line_end_ms")).alias("line_end_ms"),
        F.col("__rev").alias("reversed"),
    )


def apply_head_offset(chars: DataFrame, *, delta_ms: int) -> DataFrame:
    """Move only the characters that share the line's first stamp, between 0 and the next different stamp (or the end)."""
    whole = Window.partitionBy(*LINE)
    head = F.first("start_ms").over(_line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = chars.withColumn("__head", head)
    broken = F.max(F.when(F.col("start_ms") != F.col("__head"), 1).otherwise(0)).over(_line().rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("__in", broken == 0)
    limit = F.min_by(F.when(~F.col("__in"), F.col("start_ms")), F.when(~F.col("__in"), F.col("char_no"))).over(whole)
    s = s.withColumn("__limit", F.coalesce(limit, F.col("line_end_ms")))
    to = F.greatest(F.lit(0).cast("long"), F.col("__head") + delta_ms)
    to = F.when(F.lit(delta_ms > 0) & F.col("__limit").isNotNull(), F.least(to, "__limit")).otherwise(to)
    keep = [c for c in chars.columns if c != "start_ms"]
    return s.select(*keep, F.when(F.col("__in"), to).otherwise(F.col("start_ms")).alias("start_ms"))


def merge_combining(chars: DataFrame) -> DataFrame:
    """Combining marks join the character before them."""
    gid = F.sum(F.when(F.col("ch").rlike(r"^\p{M}"), 0).otherwise(1)).over(_line())
    g = chars.withColumn("__g", gid).groupBy(*LINE, "__g").agg(F.array_sort(F.collect_list(F.struct("char_no", "ch"))).alias("x"))
    return g.select(*LINE, F.get("x", F.lit(0))["char_no"].alias("char_no"), F.array_join(F.transform("x", lambda v: v["ch"]), "").alias("ch"))
