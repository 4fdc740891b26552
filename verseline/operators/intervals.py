"""Interval and as-of joins without nested loops.

Interval joins add an equi-key: each interval is placed on a bucket grid whose width grows with the interval's length
class, so a long interval never fills thousands of buckets, and each point looks once per class. As-of joins are one
ordered scan over both sides (see ``ordered``), so one hot key is split by time blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.operators.ordered import following_row, islands, islands_after, last_known, multiplied, next_known, running_max, scan

BASE_MS = 2_000
GROWTH = 32
CLASSES = 4
BLOCK_MS = 60_000


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    *,
    by: Sequence[str],
    t: str,
    start: str,
    end: str,
    closed: str = "left",
    salts: int = 4,
    base: int = BASE_MS,
) -> DataFrame:
    """All (point, interval) pairs with ``start <= t < end`` (``closed='left'``) or ``<= end`` (``'both'``).

    Columns of the two sides must differ except for ``by``. Points are salted and intervals repeated per salt, so a
    crowded bucket is served by several tasks.
    """
    widths = [base * GROWTH**k for k in range(CLASSES)]
    length = F.col(end) - F.col(start)
    klass = F.lit(0)
    for k in range(1, CLASSES):
        klass = F.when(length > widths[k], F.lit(k)).otherwise(klass)
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("__class") + 1)
    bucketed = (
        intervals.where(F.col(end) >= F.col(start))
        .withColumn("__class", klass)
        .withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    probes = points.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.lit(salts)).cast("int")).withColumn(
        "__probe",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("k"), F.floor(F.col(t) / w).alias("b"))
                    for k, w in enumerate(widths)
                ]
            )
        ),
    )
    probes = probes.withColumns({"__class": F.col("__probe.k"), "__bucket": F.col("__probe.b")}).drop("__probe")
    inside = (F.col(t) >= F.col(start)) & ((F.col(t) < F.col(end)) if closed == "left" else (F.col(t) <= F.col(end)))
    return probes.join(multiplied(bucketed), [*by, "__class", "__bucket", "__salt"]).where(inside).drop("__class", "__bucket", "__salt")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bucket: int = BASE_MS,
) -> DataFrame:
    """Pairs whose half-open spans overlap, for spans that are short next to ``bucket``.

    Both sides go to every bucket they touch; a pair is kept only in the bucket of the later start, so it appears once.
    """
    (ls, le), (rs, re_) = left_span, right_span
    put = lambda df, a, z: df.withColumn(
        "__bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(z) - 1, F.col(a)) / bucket)))
    )
    pairs = put(left, ls, le).join(multiplied(put(right, rs, re_)), [*by, "__bucket"])
    home = F.floor(F.greatest(F.col(ls), F.col(rs)) / bucket)
    return pairs.where((F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs)) & (F.col("__bucket") == home)).drop("__bucket")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    direction: str = "backward",
    strict: bool = False,
    tie: str | None = None,
    block_ms: int = BLOCK_MS,
    wide: bool = False,
) -> DataFrame:
    """Attach to every left row the ``payload`` of the nearest right row at or before (``backward``), at or after
    (``forward``) or on either side (``nearest``; an equal distance takes the earlier one).

    Null payload columns mean no partner. Among right rows of one time, the ``tie`` column decides: the highest wins
    looking back, the lowest looking ahead. Output: all left columns plus the payload. ``wide`` is that of ``scan``.
    """
    by = list(by)
    tied = F.col(tie) if tie else F.lit(0).cast("long")
    lrow, rrow = F.struct(*[F.col(c) for c in left.columns]), F.struct(F.col(right_t).alias("__t"), *payload)
    # order inside one time: 0 right rows seen by both, 1 left rows, 2 nothing; strict moves right rows out of sight
    right_rank = {"backward": 2 if strict else 0, "forward": 0 if strict else 2}.get(direction, 0)
    uid = F.xxhash64(*[F.col(c) for c in left.columns])
    lhs = left.select(*by, F.col(left_t).cast("long").alias("__t"), F.lit(1).alias("__o"), uid.alias("__u"), lrow.alias("__l"))
    rhs = right.select(*by, F.col(right_t).cast("long").alias("__t"), F.lit(right_rank).alias("__o"), tied.cast("long").alias("__u"), rrow.alias("__r"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    want = {}
    if direction in ("backward", "nearest", "both"):
        want["__back"] = last_known(F.col("__r"))
    if direction in ("forward", "nearest", "both"):
        want["__ahead"] = next_known(F.col("__r"))
    s = scan(both, by=by, order=["__t", "__o", "__u"], block=F.floor(F.col("__t") / block_ms), wide=wide, **want).where(F.col("__l").isNotNull())
    if direction == "both":
        return s.select(
            *[F.col(f"__l.{c}") for c in left.columns], *[F.col(f"__back.{c}") for c in payload], *[F.col(f"__ahead.{c}").alias(f"next_{c}") for c in payload]
        )
    if direction == "backward":
        hit = F.col("__back")
    elif direction == "forward":
        hit = F.col("__ahead")
    else:
        back, ahead, t = F.col("__back"), F.col("__ahead"), F.col("__t")
        closer = ahead.isNotNull() & (back.isNull() | (ahead["__t"] - t < t - back["__t"]))
        hit = F.when(closer, ahead).otherwise(back)
    return s.withColumn("__hit", hit).select(*[F.col(f"__l.{c}") for c in left.columns], *[F.col(f"__hit.{c}") for c in payload])


def in_any(points: DataFrame, regions: DataFrame, *, by: Sequence[str], t: str, start: str, end: str, pad: int = 0, name: str = "inside") -> DataFrame:
    """Flag points that lie in at least one region widened by ``pad`` (closed ends).

    A point is inside exactly when, of the regions begun by then, the furthest end has not passed: one running maximum
    replaces the join, so overlapping regions cost nothing.
    """
    by = list(by)
    prow = F.struct(*[F.col(c) for c in points.columns])
    uid = F.xxhash64(*[F.col(c) for c in points.columns])
    lhs = points.select(*by, F.col(t).cast("long").alias("__t"), F.lit(1).alias("__o"), uid.alias("__u"), prow.alias("__p"))
    rhs = regions.select(*by, (F.col(start) - pad).cast("long").alias("__t"), F.lit(0).alias("__o"), F.xxhash64(end).alias("__u"), (F.col(end) + pad).cast("long").alias("__e"))
    s = scan(
        lhs.unionByName(rhs, allowMissingColumns=True),
        by=by,
        order=["__t", "__o", "__u"],
        block=F.floor(F.col("__t") / BLOCK_MS),
        __reach=running_max(F.col("__e")),
    ).where(F.col("__p").isNotNull())
    inside = F.coalesce(F.col("__reach") >= F.col("__t"), F.lit(False))
    return s.select(*[F.col(f"__p.{c}") for c in points.columns], inside.alias(name))


def merge_windows(windows: DataFrame, *, by: Sequence[str], start: str, end: str, gap: int = 0, tie: str | None = None) -> DataFrame:
    """Union of overlapping (or up to ``gap`` apart) windows: one row per merged window."""
    order = [start, end] + ([tie] if tie else [])
    block = F.floor(F.col(start) / BLOCK_MS)
    reach = scan(windows, by=by, order=order, block=block, __reach=running_max(F.col(end), inclusive=False))
    fresh = F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap)
    runs = islands(reach, by=by, order=order, block=block, starts=fresh, name="__run")
    return runs.groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__run")


def active_line_at(points: DataFrame, lines: DataFrame, *, lead_ms: int = 0) -> DataFrame:
    """Of the lines that cover a point (from ``lead_ms`` before their start), the one that started last."""
    spans = lines.select("track_id", F.col("line_no").alias("active_line"), (F.col("start_ms") - lead_ms).alias("__s"), F.col("end_ms").alias("__e"))
    hits = interval_join(points, spans, by=["track_id"], t="t_ms", start="__s", end="__e")
    best = hits.groupBy(*points.columns).agg(F.max(F.struct("__s", "active_line")).alias("b"))
    return best.select(*points.columns, F.col("b.active_line").alias("active_line"))


def visible_lines_at(points: DataFrame, windows: DataFrame) -> DataFrame:
    return interval_join(points, windows, by=["track_id"], t="t_ms", start="show_ms", end="hide_ms").select(*points.columns, "line_no")


def section_at(points: DataFrame, sections: DataFrame, *, default: str = "verse") -> DataFrame:
    """Kind of the section (disjoint, half open) a point lies in."""
    hit = asof_join(points, sections, by=["track_id"], left_t="t_ms", right_t="sec_start", payload=["sec_end", "kind"])
    return hit.select(*points.columns, F.when(F.col("t_ms") < F.col("sec_end"), F.col("kind")).otherwise(default).alias("kind"))


def words_in_window(spans: DataFrame, asr: DataFrame, *, before: int = 1500, after: int = 500, cap: int = 4000) -> DataFrame:
    """Recognised words that overlap ``[start - before, min(end + after, start + cap))`` of each span, joined in order."""
    win = spans.withColumns(
        {"__a": F.col("start_ms") - before, "__z": F.least(F.col("end_ms") + after, F.col("start_ms") + cap)}
    )
    words = asr.select("track_id", F.col("start_ms").alias("__ws"), F.col("end_ms").alias("__we"), "word")
    pairs = overlap_join(win, words, by=["track_id"], left_span=("__a", "__z"), right_span=("__ws", "__we"))
    return pairs.groupBy(*spans.columns).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__ws", "word"))), lambda x: x["word"]), "").alias("heard")
    )


def resolve_coverage(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Every moment of ``0..duration`` goes to the earliest-added segment that covers it; the rest is gaps.

    Segments: track_id, seg_no (order of adding), start_ms, end_ms. Slivers under 20 ms are dropped and neighbouring
    pieces of one segment are joined.
    """
    seg = segments.join(durations, "track_id").select(
        "track_id", "seg_no", F.greatest("start_ms", F.lit(0)).alias("__s"), F.least("end_ms", "duration_ms").alias("__e")
    ).where(F.col("__e") - F.col("__s") > 50)
    bounds = (
        seg.select("track_id", F.col("__s").alias("t0"))
        .union(seg.select("track_id", "__e"))
        .union(durations.select("track_id", F.lit(0).cast("long")))
        .union(durations.select("track_id", "duration_ms"))
        .distinct()
    )
    block = F.floor(F.col("t0") / BLOCK_MS)
    cells = scan(bounds, by=["track_id"], order=["t0"], block=block, nxt=following_row("t0"))
    cells = cells.select("track_id", "t0", F.col("nxt.t0").alias("t1")).where(F.col("t1") - F.col("t0") >= 20)
    cells = cells.withColumn("mid", F.floor((F.col("t0") + F.col("t1")) / 2))
    hits = interval_join(cells, seg, by=["track_id"], t="mid", start="__s", end="__e", closed="both")
    winner = hits.groupBy("track_id", "t0").agg(F.min("seg_no").alias("seg_no"))
    owned = cells.join(winner, ["track_id", "t0"], "left").select("track_id", "t0", "t1", F.coalesce("seg_no", F.lit(-1)).alias("seg_no"))
    runs = islands_after(
        owned, by=["track_id"], order=["t0"], block=block, cols=["seg_no"], starts=lambda prev, cur: prev["seg_no"] != cur["seg_no"], name="run"
    )
    return runs.groupBy("track_id", "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("seg_no").alias("seg_no")).drop("run")
