"""Alignment blocks: lines of a track cut at instrumental breaks, and long blocks split at their largest gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.operators.intervals import asof_join
from verseline.operators.ordered import following_row, last_known, next_known, previous_row, running_sum, salted_lookup, scan
from verseline.session import cut_lineage

BLOCK_LINES = 4096


def _centi(ms: Column) -> Column:
    """To hundredths of a second, halves up."""
    return (F.floor((ms + 5) / 10) * 10).cast("long")


def filled_estimates(lines: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """(by, line_no, est): missing estimates on the straight line between their known neighbours, at the ends those of the nearest one."""
    known = F.when(F.col("est").isNotNull(), F.struct("line_no", "est"))
    s = scan(lines.select(*by, "line_no", "est"), by=by, order=["line_no"], block=F.floor(F.col("line_no") / BLOCK_LINES), __b=last_known(known), __a=next_known(known))
    between = F.col("__b.est") + (F.col("__a.est") - F.col("__b.est")) * (F.col("line_no") - F.col("__b.line_no")) / (F.col("__a.line_no") - F.col("__b.line_no"))
    return s.select(*by, "line_no", F.coalesce(F.col("est").cast("double"), between, F.col("__b.est").cast("double"), F.col("__a.est").cast("double")).alias("est"))


def align_blocks(
    lines: DataFrame, activity: DataFrame, windows: DataFrame, *, by: Sequence[str] = ("track_id",), max_span: int = 95_000, rounds: int | None = 1, min_gap: int = 1_000
) -> DataFrame:
    """(by, first_line, lines, start_ms, end_ms): blocks of lines with the part of the recording that each is looked for in.

    ``lines``: by, line_no (dense), est (ms or null); ``activity``: by, a, b (regions with voice, apart from each other); ``windows``: by,
    start_ms, end_ms. A block begins at a line if voice stops after the line before (its estimate + 800 ms) for ``min_gap`` or more and starts
    again before the line (its estimate + 600 ms); the last such break counts, 350 ms before its onset, but not before the end of the line
    before. A track with fewer than three, or half its lines, known estimates, or without voice, is one block. A block over ``max_span``
    with more than four lines is split half a second before the line after the largest gap between estimates (the first of equal ones):
    once, or ``rounds`` times, or until none is left (None). All blocks of all tracks split at once in a round.
    """
    by = list(by)
    size = lines.groupBy(*by).agg(F.count("*").alias("__n"), F.count("est").alias("__known"), F.min("line_no").alias("__first"))
    voiced = activity.select(*by).distinct().withColumn("__voice", F.lit(True))
    track = windows.join(size, by).join(voiced, by, "left")
    usable = F.coalesce("__voice", F.lit(False)) & (F.col("__known") >= F.greatest(F.lit(3), F.floor(F.col("__n") / 2)))
    track = cut_lineage(track.select(*by, "start_ms", "end_ms", "__n", "__first", usable.alias("__usable")))

    # a break between two regions, at the onset that ends it
    order = ["a", "b"]
    pauses = scan(activity.select(*by, *order), by=by, order=order, block=F.floor(F.col("a") / 60_000), __next=following_row("a"))
    pauses = pauses.where(F.col("__next.a") - F.col("b") >= min_gap).select(*by, F.col("b").alias("__stop"), F.col("__next.a").alias("__onset"))
    placed = scan(filled_estimates(lines, by=by), by=by, order=["line_no"], block=F.floor(F.col("line_no") / BLOCK_LINES), __prev=previous_row("est"))
    placed = cut_lineage(placed.select(*by, "line_no", "est", F.col("__prev.est").alias("__before")))
    asked = placed.where("__before is not null").withColumn("__until", F.floor(F.col("est") + 600).cast("long"))
    hit = asof_join(asked, pauses.withColumn("__at", F.col("__onset")), by=by, left_t="__until", right_t="__at", payload=["__stop", "__onset"])
    cuts = hit.where(F.col("__stop") >= F.col("__before") + 800).select(*by, "line_no", _centi(F.greatest(F.col("__before") + 800, F.col("__onset") - 350)).alias("__cut"))
    cuts = cuts.join(track.where("__usable").select(*by), by, "left_semi")

    marks = placed.join(cuts, [*by, "line_no"], "left")
    first = last_known(F.when(F.col("__cut").isNotNull(), F.col("line_no")))
    owned = scan(marks, by=by, order=["line_no"], block=F.floor(F.col("line_no") / BLOCK_LINES), __own=first)
    owned = salted_lookup(owned, track.select(*by, "__first", "__usable"), by)
    gap = F.when(F.col("__usable"), F.col("est") - F.col("__before"))
    rows = cut_lineage(owned.select(*by, "line_no", "est", F.coalesce("__own", "__first").alias("first_line"), gap.alias("gap")))

    starts = cuts.select(*by, F.col("line_no").alias("first_line"), F.col("__cut").alias("start_ms")).unionByName(track.select(*by, F.col("__first").alias("first_line"), _centi(F.col("start_ms")).alias("start_ms")))
    ends = scan(starts, by=by, order=["first_line"], block=F.floor(F.col("first_line") / BLOCK_LINES), __next=following_row("start_ms"))
    last = track.select(*by, _centi(F.col("end_ms")).alias("__last"))
    blocks = cut_lineage(salted_lookup(ends, last, by).select(*by, "first_line", "start_ms", F.coalesce("__next.start_ms", "__last").alias("end_ms")))

    key = [*by, "first_line"]
    while rounds is None or rounds > 0:
        inner = F.when((F.col("line_no") > F.col("first_line")) & F.col("gap").isNotNull(), F.struct("gap", (-F.col("line_no")).alias("no"), "est"))
        widest = rows.groupBy(*key).agg(F.count("*").alias("__n"), F.max(inner).alias("__g"))
        split = blocks.where(F.col("end_ms") - F.col("start_ms") > max_span).join(widest, key).where("__n > 4 and __g is not null")
        split = cut_lineage(split.select(*key, (-F.col("__g.no")).alias("__at"), _centi(F.col("__g.est") - 500).alias("__mid")))
        if split.isEmpty():
            break
        halves = blocks.join(split, key, "left")
        low = halves.select(*key, "start_ms", F.coalesce("__mid", "end_ms").alias("end_ms"))
        high = halves.where("__at is not null").select(*by, F.col("__at").alias("first_line"), F.col("__mid").alias("start_ms"), "end_ms")
        moved = rows.join(split.select(*key, "__at"), key, "left")
        rows = cut_lineage(moved.withColumn("first_line", F.when(F.col("line_no") >= F.col("__at"), F.col("__at")).otherwise(F.col("first_line"))).drop("__at"))
        blocks = cut_lineage(low.unionByName(high))
        rounds = None if rounds is None else rounds - 1
    counts = rows.groupBy(*key).agg(F.count("*").alias("lines"))
    return blocks.join(counts, key).select(*key, "lines", "start_ms", "end_ms")
