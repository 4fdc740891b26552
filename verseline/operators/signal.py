"""Frame-table operators (track_id, frame_no, value): envelopes, thresholds, regions, cuts, beats, lags.

Frames are numbered densely, so every neighbourhood is a bounded row frame over blocks of frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseline.operators.ordered import dealt, following_row, framed, islands_after, running_max, salted_lookup, scan
from verseline.operators.stats import exact_percentiles

WIDTH = 65536
TRACK = ["track_id"]


def _block() -> Column:
    return F.floor(F.col("frame_no") / WIDTH)


def neighbours(frames: DataFrame, before: int, after: int, **values) -> DataFrame:
    return framed(frames, by=TRACK, position="frame_no", width=WIDTH, before=before, after=after, **values)


def peaks(frames: DataFrame, *, hop: int) -> DataFrame:
    """Largest magnitude per bucket, scaled by its 99.5th percentile and clipped to 0..1."""
    p = frames.groupBy("track_id", F.floor(F.col("frame_no") / hop).alias("bucket")).agg(F.max(F.abs("value")).alias("peak"))
    top = exact_percentiles(p, by=TRACK, value="peak", top=0.995)
    scale = F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))
    return salted_lookup(p, top, TRACK).select("track_id", "bucket", F.round(F.least(F.col("peak") / scale, F.lit(1.0)), 3).alias("peak"))


def rms_envelope(samples: DataFrame, *, hop: int) -> DataFrame:
    return samples.groupBy("track_id", F.floor(F.col("frame_no") / hop).alias("frame_no")).agg(
        F.round(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12), 4).alias("value")
    )


def max_pyramid(frames: DataFrame, *, levels: int) -> DataFrame:
    """Maximum over groups of 2^k frames for k = 1..levels; an odd tail is kept.

    Frames of one bucket of the top level meet in one task, so the levels below it need no shuffle of their own.
    """
    bucket = lambda k: F.floor(F.col("frame_no") / F.pow(F.lit(2.0), k))
    rows = dealt(frames.select("track_id", "frame_no", "value", bucket(F.lit(levels)).alias("__top")), "track_id", "__top")
    level = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    top = level.groupBy("track_id", "__top", "level", bucket(F.col("level")).alias("bucket")).agg(F.max("value").alias("value"))
    return top.select("track_id", "level", "bucket", "value")


def band_thresholds(frames: DataFrame, *, lo: float = 0.20, hi: float = 0.98, k: float = 0.35) -> DataFrame:
    """Threshold between the floor and peak percentiles of a track."""
    p = exact_percentiles(frames, by=TRACK, value="value", floor=lo, peak=hi)
    return p.select("track_id", "floor", "peak", (F.col("floor") + (F.col("peak") - F.col("floor")) * k).alias("threshold"))


def mark_voiced(frames: DataFrame, thresholds: DataFrame) -> DataFrame:
    return salted_lookup(frames, thresholds.select("track_id", "threshold"), TRACK).withColumn("voiced", F.col("value") > F.col("threshold")).drop("threshold")


def voiced_share(spans: DataFrame, voiced: DataFrame) -> DataFrame:
    """Share of frames above threshold in each span (track_id, span_no, first_frame, last_frame)."""
    ids = spans.withColumn("frame_no", F.explode(F.sequence("first_frame", "last_frame")))
    return ids.join(voiced, ["track_id", "frame_no"]).groupBy("track_id", "span_no").agg(F.round(F.avg(F.col("voiced").cast("double")), 4).alias("share"))


def activity_regions(voiced: DataFrame, *, min_gap: int, min_len: int) -> DataFrame:
    """Voiced runs, joined across gaps shorter than ``min_gap`` frames, at least ``min_len`` frames long (half open)."""
    on = voiced.where("voiced")
    # two voiced frames belong to one region when the unvoiced stretch between them is short
    apart = lambda prev, cur: cur["frame_no"] - prev["frame_no"] - 1 >= max(min_gap, 1)
    runs = islands_after(on, by=TRACK, order=["frame_no"], block=_block(), cols=["frame_no"], starts=apart, name="region_no")
    regions = runs.groupBy("track_id", "region_no").agg(F.min("frame_no").alias("first_frame"), (F.max("frame_no") + 1).alias("end_frame"))
    return regions.where(F.col("end_frame") - F.col("first_frame") >= min_len).drop("region_no")


def longest_gap(voiced: DataFrame, spans: DataFrame) -> DataFrame:
    """Longest unvoiced run inside each span, as (gap_start, gap_end); the first of equals."""
    ids = spans.withColumn("frame_no", F.explode(F.sequence("first_frame", "last_frame")))
    off = ids.join(voiced, ["track_id", "frame_no"]).where(~F.col("voiced"))
    by = ["track_id", "span_no"]
    runs = islands_after(
        off, by=by, order=["frame_no"], block=_block(), cols=["frame_no"], starts=lambda prev, cur: cur["frame_no"] - prev["frame_no"] > 1, name="run"
    )
    g = runs.groupBy(*by, "run").agg(F.min("frame_no").alias("s"), (F.max("frame_no") + 1).alias("e"))
    return g.groupBy(*by).agg(F.max(F.struct((F.col("e") - F.col("s")).alias("n"), (-F.col("s")).alias("neg"))).alias("b")).select(
        *by, (-F.col("b.neg")).alias("gap_start"), (-F.col("b.neg") + F.col("b.n")).alias("gap_end")
    )


def refine_heads(voiced: DataFrame, lines: DataFrame, *, need: int = 3, back: int = 1, min_move: int = 4) -> DataFrame:
    """Onset for lines whose head lies in silence: the first frame that completes ``need`` voiced frames in
    [first_frame, last_frame), moved ``back`` frames earlier; kept when it is at least ``min_move`` frames later."""
    ids = lines.withColumn("frame_no", F.explode(F.sequence("first_frame", F.col("last_frame") - 1)))
    j = ids.join(voiced, ["track_id", "frame_no"])
    run = framed(j, by=["track_id", "span_no"], position="frame_no", width=WIDTH, before=need - 1, after=0, hits=lambda w: F.sum(F.col("voiced").cast("int")).over(w))
    head_quiet = F.min(F.when(F.col("frame_no") < F.col("first_frame") + need, F.col("voiced"))).alias("__loud")
    g = run.groupBy("track_id", "span_no", "first_frame").agg(
        head_quiet, F.min(F.when((F.col("hits") == need) & (F.col("frame_no") >= F.col("first_frame") + need - 1), F.col("frame_no"))).alias("done")
    )
    onset = F.col("done") - (need - 1) - back
    return g.where(~F.col("__loud") & (onset - F.col("first_frame") >= min_move)).select("track_id", "span_no", onset.alias("onset_frame"))


# ------------------------------------------------------------------ local operators
def moving_average(frames: DataFrame, *, radius: int = 2) -> DataFrame:
    return neighbours(frames, radius, radius, smooth=lambda w: F.round(F.avg("value").over(w), 4))


def detrend(frames: DataFrame, *, before: int, after: int) -> DataFrame:
    """Value above its own moving average, never negative."""
    d = neighbours(frames, before, after, __m=lambda w: F.avg("value").over(w))
    return d.select("track_id", "frame_no", F.greatest(F.round(F.col("value") - F.col("__m"), 6), F.lit(0.0)).alias("value"))


def onset_decay(frames: DataFrame, *, gate: float = 0.45, keep: float = 0.82) -> DataFrame:
    """acc = max(value if above the gate, keep * acc), in closed form: the running maximum of ln(value) - i * ln(keep)."""
    step = float(np.log(keep))
    lifted = F.when(F.col("value") > gate, F.log("value") - F.col("frame_no") * step)
    s = scan(frames, by=TRACK, order=["frame_no"], block=_block(), __hi=running_max(lifted))
    return s.select("track_id", "frame_no", F.coalesce(F.round(F.exp(F.col("__hi") + F.col("frame_no") * step), 4), F.lit(0.0)).alias("onset"))


def local_peaks(frames: DataFrame, *, radius: int) -> DataFrame:
    """Frames that are positive and the largest within ``radius`` on both sides."""
    p = neighbours(frames, radius, radius, __top=lambda w: F.max("value").over(w))
    return p.where((F.col("value") > 0) & (F.col("value") == F.col("__top"))).drop("__top")


def detect_cuts(frames: DataFrame, *, min_diff: float, ratio: float = 2.6, plus: float = 0.02, reach: int = 8) -> DataFrame:
    """Frames whose jump is above ``min_diff`` and well above the median of the jumps around them; of adjacent ones every second."""
    d = neighbours(frames, 1, 0, __p=lambda w: F.first("value").over(w), __n=lambda w: F.count("*").over(w))
    d = d.where(F.col("__n") == 2).select("track_id", "frame_no", F.abs(F.col("value") - F.col("__p")).alias("diff"))
    near = framed(d, by=TRACK, position="frame_no", width=WIDTH, before=reach, after=reach, __near=lambda w: F.collect_list("diff").over(w))
    near = near.withColumn("__near", F.sort_array("__near"))
    n = F.size("__near") - 1
    self_at = F.array_position("__near", F.col("diff")).cast("int") - 1
    other = lambda k: F.get("__near", k + F.when(k >= self_at, 1).otherwise(0))
    mid = (other(F.floor((n - 1) / 2).cast("int")) + other(F.floor(n / 2).cast("int"))) / 2
    local = near.withColumn("local", F.when(n == 0, 0.0).otherwise(mid)).drop("__near")
    cand = local.withColumn("__c", ((F.col("diff") > min_diff) & (F.col("diff") > F.col("local") * ratio + plus)).cast("int"))
    cand = framed(cand, by=TRACK, position="frame_no", width=WIDTH, before=1, after=0, __two=lambda w: F.sum("__c").over(w)).where(F.col("__c") == 1)
    first = F.when(F.col("__two") == 1, F.col("frame_no"))
    run = scan(cand, by=TRACK, order=["frame_no"], block=_block(), __from=running_max(first))
    return run.where(F.pmod(F.col("frame_no") - F.col("__from"), F.lit(2)) == 0).select("track_id", "frame_no")


def shots_from_cuts(cuts: DataFrame, spans: DataFrame, *, trim: int = 2, min_len: int = 6, max_len: int = 54, piece_len: int = 42) -> DataFrame:
    """Stretches between cuts, trimmed at both ends; long ones are split into equal pieces, short ones dropped.

    ``spans``: first and end frame of each track. Lengths are in frames.
    """
    bounds = cuts.unionByName(spans.select("track_id", F.col("first_frame").alias("frame_no"))).unionByName(spans.select("track_id", F.col("end_frame").alias("frame_no"))).distinct()
    s = scan(bounds, by=TRACK, order=["frame_no"], block=_block(), n=following_row("frame_no")).where(F.col("n").isNotNull())
    a, z = F.col("frame_no") + trim, F.col("n.frame_no") - trim
    shot = s.select("track_id", a.alias("a"), z.alias("z")).where(F.col("z") - F.col("a") >= min_len)
    length = F.col("z") - F.col("a")
    pieces = F.when(length > max_len, F.ceil(length / piece_len)).otherwise(1).cast("int")
    out = shot.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = lambda k: (F.col("a") + F.floor(k * (F.col("z") - F.col("a")) / F.col("pieces"))).cast("long")
    out = out.select("track_id", cut(F.col("piece")).alias("first_frame"), cut(F.col("piece") + 1).alias("end_frame"))
    return out.where(F.col("end_frame") - F.col("first_frame") >= min_len)


def shot_metrics(shots: DataFrame, frames: DataFrame) -> DataFrame:
    ids = shots.withColumn("frame_no", F.explode(F.sequence("first_frame", F.col("end_frame") - 1)))
    return ids.join(frames, ["track_id", "frame_no"]).groupBy("track_id", "first_frame", "end_frame").agg(
        F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def quiet_cut_points(frames: DataFrame, *, every: int, reach: int) -> DataFrame:
    """Quietest frame within ``reach`` of each multiple of ``every`` (the first of equals)."""
    k = F.floor(F.col("frame_no") / every + 0.5)
    near = frames.withColumn("boundary", k).where((F.col("boundary") > 0) & (F.abs(F.col("frame_no") - F.col("boundary") * every) <= reach))
    return near.groupBy("track_id", "boundary").agg(F.min(F.struct("value", "frame_no")).alias("b")).select("track_id", "boundary", F.col("b.frame_no").alias("frame_no"))


def first_sound(frames: DataFrame, *, least: float = 0.002, share: float = 0.03) -> DataFrame:
    top = exact_percentiles(frames, by=TRACK, value="value", p95=0.95)
    j = salted_lookup(frames, top, TRACK)
    loud = F.col("value") > F.greatest(F.lit(least), F.col("p95") * share)
    return j.groupBy("track_id").agg(F.min(F.when(loud, F.col("frame_no"))).alias("frame_no"))


def key_moments(frames: DataFrame, *, intro: int) -> DataFrame:
    """Intro frame, calm frame of the first half (nearest the 40th percentile) and loudest frame of each track."""
    span = frames.groupBy("track_id").agg(F.min("frame_no").alias("a"), F.max("frame_no").alias("z"), F.max(F.struct("value", -F.col("frame_no"))).alias("top"))
    calm = exact_percentiles(frames, by=TRACK, value="value", p40=0.4)
    j = salted_lookup(frames, span.join(calm, "track_id"), TRACK)
    half = F.col("a") + F.greatest(F.floor((F.col("z") - F.col("a") + 1) / 2), F.lit(1))
    near = F.when(F.col("frame_no") < half, F.struct(F.round(F.abs(F.col("value") - F.col("p40")), 6).alias("d"), F.col("frame_no").alias("f")))
    g = j.groupBy("track_id", "a", "z", "top").agg(F.min(near).alias("c"))
    return g.select("track_id", F.least(F.col("a") + intro, F.col("z")).alias("intro"), F.col("c.f").alias("calm"), (-F.col("top.col2")).alias("peak"))


# ------------------------------------------------------------------ beats
def beat_phase(frames: DataFrame, *, period: int) -> DataFrame:
    """Phase (frame modulo period) with the largest onset sum; the smallest of equals."""
    s = frames.groupBy("track_id", F.pmod("frame_no", F.lit(period)).alias("phase")).agg(F.sum("value").alias("score"))
    return s.groupBy("track_id").agg(F.max(F.struct(F.round("score", 4).alias("s"), (-F.col("phase")).alias("p"))).alias("b")).select(
        "track_id", (-F.col("b.p")).alias("phase"), F.col("b.s").alias("score")
    )


def bar_phase(beats: DataFrame, *, per_bar: int = 4) -> DataFrame:
    """(track_id, phase): which of every ``per_bar`` beats carries most bass on average, the first on ties; beats: track_id, beat_no, bass."""
    mean = beats.groupBy("track_id", F.pmod("beat_no", F.lit(per_bar)).alias("p")).agg(F.avg("bass").alias("m"))
    every = beats.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(per_bar - 1).cast("long"))).alias("p"))
    filled = every.join(mean.withColumn("p", F.col("p").cast("long")), ["track_id", "p"], "left")
    return filled.groupBy("track_id").agg(F.max(F.struct(F.coalesce("m", F.lit(0.0)).alias("m"), (-F.col("p")).alias("p")))["p"].alias("p")).select("track_id", (-F.col("p")).alias("phase"))


def beat_grid(frames: DataFrame, phases: DataFrame, *, period: int, gain: float = 1.2) -> DataFrame:
    """Beats at phase + k * period, each moved to the strongest onset within a sixth of the period when clearly stronger.

    The grid itself stays fixed.
    """
    win = max(1, period // 6)
    j = salted_lookup(frames, phases.select("track_id", "phase"), TRACK)
    k = F.floor((F.col("frame_no") - F.col("phase")) / period + 0.5)
    at = F.col("phase") + F.col("k") * period
    near = j.withColumn("k", k).withColumn("at", at).where((F.col("k") >= 0) & (F.abs(F.col("frame_no") - F.col("at")) <= win))
    g = near.groupBy("track_id", "k", "at").agg(
        F.max(F.struct("value", (-F.col("frame_no")).alias("neg"))).alias("b"), F.max(F.when(F.col("frame_no") == F.col("at"), F.col("value"))).alias("here")
    ).where(F.col("here").isNotNull())
    beat = F.when(F.col("b.value") > F.col("here") * gain, -F.col("b.neg")).otherwise(F.col("at"))
    return g.select("track_id", F.col("k").alias("beat_no"), beat.alias("frame_no"))


# ------------------------------------------------------------------ lag correlation
def lag_scores(left: DataFrame, right: DataFrame, *, max_lag: int, width: int = 8192, extra: tuple[str, ...] = ()) -> DataFrame:
    """For every lag L in -max_lag..max_lag the sum of left[i + L] * right[i], with the number of overlapping frames.

    Both tables are cut into blocks of ``width`` frames, the left one with ``max_lag`` helper frames on each side, and
    each block is correlated by numpy in one task; block sums are then added per track. Shuffled rows: about one per
    frame, not one per (frame, lag). ``extra`` names further key columns (for example a time block) held by the right side.
    """
    if max_lag > width:
        raise ValueError("block width must be at least the largest lag")
    pos = F.col("frame_no")
    home = F.floor(pos / width)
    right_rows = right.select("track_id", *extra, home.alias("block"), "frame_no", "value", F.lit(1).alias("side"))
    reach = F.array_distinct(F.array(F.floor((pos - max_lag) / width), home, F.floor((pos + max_lag) / width)))
    left_rows = left.select("track_id", F.explode(reach).alias("block"), "frame_no", "value", F.lit(0).alias("side"))
    keys = ["track_id", "block"]
    extra_types = "".join(f", {c} long" for c in extra)
    schema = f"track_id {dict(right.dtypes)['track_id']}{extra_types}, lag int, score double, n long"

    def correlate(key, a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        out = []
        base = key[1] * width - max_lag
        sig = np.zeros(width + 2 * max_lag)
        has = np.zeros(width + 2 * max_lag)
        at = (a["frame_no"] - base).to_numpy()
        ok = (at >= 0) & (at < len(sig))
        sig[at[ok]], has[at[ok]] = a["value"].to_numpy()[ok], 1.0
        groups = z.groupby(list(extra)) if extra else [((), z)]
        for name, part in groups:
            tgt, one = np.zeros(width), np.zeros(width)
            i = (part["frame_no"] - key[1] * width).to_numpy()
            tgt[i], one[i] = part["value"].to_numpy(), 1.0
            score, n = np.correlate(sig, tgt), np.correlate(has, one)
            frame = pd.DataFrame({"track_id": key[0], "lag": np.arange(-max_lag, max_lag + 1, dtype="int32"), "score": score, "n": np.rint(n).astype("int64")})
            for c, v in zip(extra, name if isinstance(name, tuple) else (name,)):
                frame[c] = v
            out.append(frame[frame["n"] > 0])
        return pd.concat(out)[["track_id", *extra, "lag", "score", "n"]] if out else pd.DataFrame(columns=["track_id", *extra, "lag", "score", "n"])

    # fresh column identities, so a table can be correlated with itself
    left_rows, right_rows = left_rows.toDF(*left_rows.columns), right_rows.toDF(*right_rows.columns)
    blocks = left_rows.groupBy(*keys).cogroup(right_rows.groupBy(*keys)).applyInPandas(correlate, schema)
    return blocks.groupBy("track_id", *extra, "lag").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))


def estimate_lag(scores: DataFrame, *, min_overlap: int, exclude: int, by: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Best lag, and how far it stands above the best one further than ``exclude`` away (``confidence``)."""
    ok = scores.where(F.col("n") >= min_overlap).withColumn("score", F.round("score", 4))
    best = ok.groupBy(*by).agg(F.max(F.struct("score", (-F.col("lag")).alias("neg"))).alias("b")).select(
        *by, (-F.col("b.neg")).alias("best_lag"), F.col("b.score").alias("best_score")
    )
    rest = ok.join(best, list(by)).where(F.abs(F.col("lag") - F.col("best_lag")) > exclude).groupBy(*by).agg(F.max("score").alias("second"))
    j = best.join(rest, list(by), "left")
    conf = F.when(F.col("best_score") > 0, F.round(1 - F.coalesce("second", F.lit(0.0)) / F.col("best_score"), 4)).otherwise(0.0)
    return j.select(*by, F.col("best_lag").cast("int").alias("lag"), F.col("best_score").alias("score"), conf.alias("confidence"))


def lag_consistency(local: DataFrame, whole: DataFrame, *, max_median: float, max_any: float) -> DataFrame:
    """Do the lags of single time blocks agree with the lag of the whole track?"""
    d = local.join(whole.select("track_id", F.col("lag").alias("whole")), "track_id").withColumn("dev", F.abs(F.col("lag") - F.col("whole")).cast("double"))
    med = exact_percentiles(d, by=TRACK, value="dev", median=0.5)
    top = d.groupBy("track_id").agg(F.max("dev").alias("worst"), F.count("*").alias("blocks"))
    return med.join(top, "track_id").select("track_id", "median", "worst", "blocks", ((F.col("median") < max_median) & (F.col("worst") < max_any)).alias("consistent"))


def tempo_period(scores: DataFrame, *, fps: float, lo: int, hi: int) -> DataFrame:
    """Beat period from autocorrelation scores: prior around 120 a minute, halved when half the lag is nearly as strong,
    refined by a parabola. ``scores``: lag_scores of an envelope with itself."""
    s = scores.where(F.col("lag").between(lo, hi)).select("track_id", "lag", F.round("score", 4).alias("ac"))
    bpm = F.lit(60.0 * fps) / F.col("lag")
    weighted = F.round(F.col("ac") * F.exp(-0.5 * F.pow(F.log2(bpm / 120.0) / 0.9, F.lit(2))), 4)
    best = s.groupBy("track_id").agg(F.max(F.struct(weighted.alias("w"), (-F.col("lag")).alias("neg"))).alias("b"))
    best = best.select("track_id", (-F.col("b.neg")).alias("k")).withColumn("half", F.bround(F.col("k") / 2).cast("int"))
    get = lambda col, name: s.select("track_id", F.col("lag").alias(col), F.col("ac").alias(name))
    j = best.join(get("k", "ac_k"), ["track_id", "k"]).join(get("half", "ac_half"), ["track_id", "half"], "left")
    twice = (F.col("half") >= lo) & (60.0 * fps / F.col("k") < 100) & (F.col("ac_half") >= 0.75 * F.col("ac_k"))
    j = j.select("track_id", F.when(F.coalesce(twice, F.lit(False)), F.col("half")).otherwise(F.col("k")).alias("k"))
    j = j.withColumns({"__l": F.col("k") - 1, "__r": F.col("k") + 1})
    j = j.join(get("k", "y1"), ["track_id", "k"]).join(get("__l", "y0"), ["track_id", "__l"], "left").join(get("__r", "y2"), ["track_id", "__r"], "left")
    den = F.col("y0") - 2 * F.col("y1") + F.col("y2")
    shift = F.when(den != 0, 0.5 * (F.col("y0") - F.col("y2")) / den)
    return j.select("track_id", F.col("k").cast("int").alias("lag"), F.round(F.col("k") + F.coalesce(shift, F.lit(0.0)), 4).alias("period"))


def tempo_spectral(onsets: DataFrame, *, fps: float, bpm_lo: float, bpm_hi: float, step: float) -> DataFrame:
    """Tempo whose Fourier component of the onsets is strongest under a log-normal prior around 120.

    The rows are the onsets times the tempo grid; onsets are the sparse peaks, not the frames.
    """
    n = int(round((bpm_hi - bpm_lo) / step))
    grid = onsets.select("track_id", "frame_no", "value", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("g"))
    bpm = F.col("g") * step + bpm_lo
    angle = 2 * np.pi * F.col("frame_no") * bpm / (60.0 * fps)
    s = grid.groupBy("track_id", "g").agg(F.sum(F.col("value") * F.cos(angle)).alias("c"), F.sum(F.col("value") * F.sin(angle)).alias("s"))
    power = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) * F.exp(-0.5 * F.pow(F.log2(bpm / 120.0) / 0.9, F.lit(2)))
    return s.groupBy("track_id").agg(F.max(F.struct(F.round(power, 3).alias("p"), (-F.col("g")).alias("neg"))).alias("b")).select(
        "track_id", (-F.col("b.neg") * step + bpm_lo).alias("bpm"), F.col("b.p").alias("power")
    )
