"""Queries over frame tables, statistics and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseline.operators import signal as sg
from verseline.operators import stats as st
from verseline.plans import bindings as b
from verseline.plans.editing import RND3
from verseline.plans.formats import CHARS_SQL, timed_chars
from verseline.plans.registry import query

_F = "WITH " + b.FRAMES_SQL
_L = "WITH " + b.LINES_SQL
_T = "thr AS (SELECT track_id, quantile_cont(value, 0.2) AS floor, quantile_cont(value, 0.98) AS peak FROM frames GROUP BY 1)"
_V = _T + ", voiced AS (SELECT f.*, value > floor + (peak - floor) * 0.35::DOUBLE AS voiced FROM frames f JOIN thr USING (track_id))"
_SP = "spans AS (SELECT track_id, k AS span_no, k * 26 AS a, k * 26 + 19 AS z FROM (SELECT DISTINCT track_id FROM frames), (SELECT unnest(range(0, 14)) AS k))"


def _spans(frames):
    return frames.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))).alias("span_no")).select(
        "track_id", "span_no", (F.col("span_no") * 26).alias("first_frame"), (F.col("span_no") * 26 + 19).alias("last_frame")
    )


def _voiced(spark, sf):
    f = b.frames(spark, sf)
    return sg.mark_voiced(f, sg.band_thresholds(f))


@query(
    f"""{_F}, p AS (SELECT track_id, frame_no // 4 AS bucket, max(abs(value)) AS peak FROM frames GROUP BY 1, 2), t AS (SELECT track_id, quantile_cont(peak, 0.995) AS top FROM p GROUP BY 1)
SELECT track_id, bucket, {RND3.format("least(peak / CASE WHEN top = 0 THEN 1.0::DOUBLE ELSE top END, 1.0::DOUBLE)")} AS peak FROM p JOIN t USING (track_id)"""
)
def peaks(spark, sf):
    return sg.peaks(b.frames(spark, sf), hop=4)


@query(f"{_F} SELECT track_id, frame_no // 8 AS frame_no, round(sqrt(avg(value * value) + 1e-12), 4) AS value FROM frames GROUP BY 1, 2")
def rms_envelope(spark, sf):
    return sg.rms_envelope(b.frames(spark, sf), hop=8)


@query(f"{_F} SELECT track_id, CAST(lv AS INTEGER) AS level, frame_no // CAST(2 ** lv AS BIGINT) AS bucket, max(value) AS value FROM frames, (SELECT unnest(range(1, 5)) AS lv) GROUP BY 1, 2, 3")
def max_pyramid(spark, sf):
    return sg.max_pyramid(b.frames(spark, sf), levels=4)


@query(f"{_F}, {_T} SELECT track_id, round(floor, 6) AS floor, round(peak, 6) AS peak, round(floor + (peak - floor) * 0.35::DOUBLE, 6) AS threshold FROM thr")
def band_thresholds(spark, sf):
    return sg.band_thresholds(b.frames(spark, sf)).select("track_id", *[F.round(c, 6).alias(c) for c in ("floor", "peak", "threshold")])


@query(f"{_F}, {_V}, {_SP} SELECT s.track_id, s.span_no, round(avg(CASE WHEN voiced THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS share FROM spans s JOIN voiced v ON v.track_id = s.track_id AND v.frame_no BETWEEN s.a AND s.z GROUP BY 1, 2")
def voiced_share(spark, sf):
    v = _voiced(spark, sf)
    return sg.voiced_share(_spans(v), v)


@query(
    f"""{_F}, {_V}, r AS (SELECT *, CASE WHEN voiced AND NOT coalesce(lag(voiced) OVER w, false) THEN 1 ELSE 0 END AS s FROM voiced WINDOW w AS (PARTITION BY track_id ORDER BY frame_no)),
i AS (SELECT *, sum(s) OVER (PARTITION BY track_id ORDER BY frame_no) AS run FROM r), runs AS (SELECT track_id, run, min(frame_no) AS a, max(frame_no) + 1 AS z FROM i WHERE voiced GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN a - lag(z) OVER w < 3 THEN 0 ELSE 1 END AS s FROM runs WINDOW w AS (PARTITION BY track_id ORDER BY a)), g AS (SELECT *, sum(s) OVER (PARTITION BY track_id ORDER BY a) AS reg FROM m)
SELECT track_id, min(a) AS first_frame, max(z) AS end_frame FROM g GROUP BY track_id, reg HAVING max(z) - min(a) >= 4"""
)
def activity_regions(spark, sf):
    return sg.activity_regions(_voiced(spark, sf), min_gap=3, min_len=4)


@query(
    f"""{_F}, {_V}, {_SP}, o AS (SELECT s.track_id, s.span_no, v.frame_no, v.frame_no - row_number() OVER (PARTITION BY s.track_id, s.span_no ORDER BY v.frame_no) AS grp FROM spans s JOIN voiced v ON v.track_id = s.track_id AND v.frame_no BETWEEN s.a AND s.z WHERE NOT v.voiced),
g AS (SELECT track_id, span_no, min(frame_no) AS s, max(frame_no) + 1 AS e FROM o GROUP BY track_id, span_no, grp)
SELECT track_id, span_no, s AS gap_start, e AS gap_end FROM g QUALIFY row_number() OVER (PARTITION BY track_id, span_no ORDER BY e - s DESC, s) = 1"""
)
def longest_gap(spark, sf):
    v = _voiced(spark, sf)
    return sg.longest_gap(v, _spans(v))


@query(
    f"""{_F}, {_V}, {_SP}, j AS (SELECT s.track_id, s.span_no, s.a, v.frame_no, v.voiced, sum(CASE WHEN voiced THEN 1 ELSE 0 END) OVER (PARTITION BY s.track_id, s.span_no ORDER BY v.frame_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits
  FROM spans s JOIN voiced v ON v.track_id = s.track_id AND v.frame_no >= s.a AND v.frame_no < s.z),
g AS (SELECT track_id, span_no, a, bool_and(voiced) FILTER (frame_no < a + 3) AS loud, min(frame_no) FILTER (hits = 3 AND frame_no >= a + 2) - 3 AS onset FROM j GROUP BY 1, 2, 3)
SELECT track_id, span_no, onset AS onset_frame FROM g WHERE NOT loud AND onset - a >= 4"""
)
def refine_heads_tails(spark, sf):
    v = _voiced(spark, sf)
    return sg.refine_heads(v, _spans(v))


@query(f"{_F} SELECT track_id, frame_no, value, round(avg(value) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS smooth FROM frames")
def moving_average(spark, sf):
    return sg.moving_average(b.frames(spark, sf))


_DET = "det AS (SELECT track_id, frame_no, greatest(round(value - avg(value) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), 6), 0.0::DOUBLE) AS value FROM frames)"


def _env(spark, sf):
    return sg.detrend(b.frames(spark, sf), before=4, after=3)


@query(f"{_F}, {_DET} SELECT * FROM det")
def detrend(spark, sf):
    return _env(spark, sf)


@query(
    f"""WITH RECURSIVE {b.FRAMES_SQL}, n AS (SELECT track_id, frame_no, value / 197 AS v, row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS i FROM frames),
acc AS (SELECT track_id, frame_no, i, CASE WHEN v > 0.45 THEN v ELSE 0.0::DOUBLE END AS a FROM n WHERE i = 1 UNION ALL
 SELECT n.track_id, n.frame_no, n.i, greatest(CASE WHEN n.v > 0.45 THEN n.v ELSE 0.0::DOUBLE END, acc.a * 0.82::DOUBLE) FROM acc JOIN n ON n.track_id = acc.track_id AND n.i = acc.i + 1)
SELECT track_id, frame_no, round(a, 4) AS onset FROM acc"""
)
def onset_decay(spark, sf):
    return sg.onset_decay(b.frames(spark, sf).withColumn("value", F.col("value") / 197))


@query(f"{_F} SELECT track_id, frame_no, value FROM (SELECT *, max(value) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM frames) WHERE value > 0 AND value = top")
def local_peaks(spark, sf):
    return sg.local_peaks(b.frames(spark, sf), radius=3)


_CUTS = """d AS (SELECT track_id, frame_no, abs(value - p) AS diff FROM (SELECT *, lag(value) OVER (PARTITION BY track_id ORDER BY frame_no) AS p FROM frames) WHERE p IS NOT NULL),
l AS (SELECT *, list_concat(coalesce(list(diff) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []), coalesce(list(diff) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), [])) AS near FROM d),
c AS (SELECT track_id, frame_no FROM l WHERE diff > 20 AND diff > list_median(near) * 2.6::DOUBLE + 0.02::DOUBLE),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, grp ORDER BY frame_no) AS k FROM (SELECT *, frame_no - row_number() OVER (PARTITION BY track_id ORDER BY frame_no) AS grp FROM c)),
cuts AS (SELECT track_id, frame_no FROM r WHERE k % 2 = 1)"""


def _cuts(spark, sf):
    return sg.detect_cuts(b.frames(spark, sf), min_diff=20.0)


@query(f"{_F}, {_CUTS} SELECT * FROM cuts")
def detect_cuts(spark, sf):
    return _cuts(spark, sf)


_SHOTS = """ext AS (SELECT track_id, min(frame_no) AS a, max(frame_no) + 1 AS z FROM frames GROUP BY 1), bd AS (SELECT track_id, frame_no FROM cuts UNION SELECT track_id, a FROM ext UNION SELECT track_id, z FROM ext),
s AS (SELECT track_id, frame_no + 2 AS a, lead(frame_no) OVER (PARTITION BY track_id ORDER BY frame_no) - 2 AS z FROM bd), s2 AS (SELECT *, CASE WHEN z - a > 54 THEN CAST(ceil((z - a) / 42.0) AS BIGINT) ELSE 1 END AS n FROM s WHERE z - a >= 6),
p AS (SELECT track_id, a, z, n, unnest(range(0, n)) AS k FROM s2), shots AS (SELECT * FROM (SELECT track_id, a + k * (z - a) // n AS first_frame, a + (k + 1) * (z - a) // n AS end_frame FROM p) WHERE end_frame - first_frame >= 6)"""


def _extent(frames):
    return frames.groupBy("track_id").agg(F.min("frame_no").alias("first_frame"), (F.max("frame_no") + 1).alias("end_frame"))


@query(
    f"""{_F}, {_CUTS}, {_SHOTS} SELECT s.*, round(avg(f.value), 4) AS mean, min(f.value) AS low, max(f.value) AS high FROM shots s JOIN frames f ON f.track_id = s.track_id AND f.frame_no >= s.first_frame AND f.frame_no < s.end_frame GROUP BY ALL"""
)
def shots_from_cuts(spark, sf):
    f = b.frames(spark, sf)
    return sg.shot_metrics(sg.shots_from_cuts(_cuts(spark, sf), _extent(f)), f)


@query(f"{_F}, n AS (SELECT *, CAST(floor(frame_no / 26.0 + 0.5) AS BIGINT) AS k FROM frames) SELECT track_id, k AS boundary, arg_min(frame_no, value * 100000 + frame_no) AS frame_no FROM n WHERE k > 0 AND abs(frame_no - k * 26) <= 5 GROUP BY 1, 2")
def quiet_cut_points(spark, sf):
    return sg.quiet_cut_points(b.frames(spark, sf), every=26, reach=5)


@query(f"{_F}, t AS (SELECT track_id, quantile_cont(value, 0.95) AS p FROM frames GROUP BY 1) SELECT f.track_id, min(frame_no) AS frame_no FROM frames f JOIN t USING (track_id) WHERE value > greatest(0.002, p * 0.6::DOUBLE) GROUP BY 1")
def first_sound(spark, sf):
    return sg.first_sound(b.frames(spark, sf), share=0.6)


@query(
    f"""{_F}, e AS (SELECT track_id, min(frame_no) AS a, max(frame_no) AS z, quantile_cont(value, 0.4) AS p40, arg_max(frame_no, value * 100000 - frame_no) AS peak FROM frames GROUP BY 1)
SELECT f.track_id, least(a + 8, z) AS intro, arg_min(frame_no, round(abs(value - p40), 6) * 100000 + frame_no) FILTER (frame_no < a + greatest((z - a + 1) // 2, 1)) AS calm, peak FROM frames f JOIN e USING (track_id) GROUP BY f.track_id, a, z, peak"""
)
def key_moments(spark, sf):
    return sg.key_moments(b.frames(spark, sf), intro=8)


_PH = "ph AS (SELECT track_id, p AS phase, s AS score FROM (SELECT track_id, frame_no % 13 AS p, round(sum(value), 4) AS s FROM frames GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY s DESC, p) = 1)"


@query(f"{_F}, {_PH} SELECT * FROM ph")
def beat_phase(spark, sf):
    return sg.beat_phase(b.frames(spark, sf), period=13)


@query(
    f"""{_F}, {_PH}, g AS (SELECT f.track_id, f.frame_no, f.value, phase, CAST(floor((frame_no - phase) / 13.0 + 0.5) AS BIGINT) AS k FROM frames f JOIN ph USING (track_id)), n AS (SELECT *, phase + k * 13 AS at_ FROM g WHERE k >= 0 AND abs(frame_no - phase - k * 13) <= 2),
b AS (SELECT track_id, k, at_, arg_max(frame_no, value * 100000 - frame_no) AS f, max(value) AS v, max(value) FILTER (frame_no = at_) AS here FROM n GROUP BY 1, 2, 3)
SELECT track_id, k AS beat_no, CASE WHEN v > here * 1.2::DOUBLE THEN f ELSE at_ END AS frame_no FROM b WHERE here IS NOT NULL"""
)
def beat_grid(spark, sf):
    f = b.frames(spark, sf)
    return sg.beat_grid(f, sg.beat_phase(f, period=13), period=13)


@query(
    f"""{_F}, bt AS (SELECT track_id, frame_no // 3 AS beat_no, value AS bass FROM frames WHERE frame_no % 3 = 0), m AS (SELECT track_id, beat_no % 4 AS p, avg(bass) AS m FROM bt GROUP BY 1, 2)
SELECT track_id, arg_min(p, rn) AS phase FROM (SELECT t.track_id, p.p, row_number() OVER (PARTITION BY t.track_id ORDER BY coalesce(m.m, 0) DESC, p.p) AS rn FROM (SELECT DISTINCT track_id FROM bt) t CROSS JOIN (SELECT unnest(range(4)) AS p) p LEFT JOIN m ON m.track_id = t.track_id AND m.p = p.p) GROUP BY 1"""
)
def bar_phase(spark, sf):
    """Every third week as a beat: the first beat of the bars of each track."""
    f = b.frames(spark, sf).where(F.pmod("frame_no", F.lit(3)) == 0)
    return sg.bar_phase(f.select("track_id", F.floor(F.col("frame_no") / 3).alias("beat_no"), F.col("value").alias("bass")))


# the same series seven frames later, under another name
_LAG = f"""lags AS (SELECT unnest(range(-40, 41)) AS lag), sc AS (SELECT a.track_id, l.lag, sum(b.value * a.value) AS score, count(*) AS n FROM frames a, lags l, (SELECT track_id, frame_no + 7 AS frame_no, value FROM frames) b
  WHERE b.track_id = a.track_id AND b.frame_no = a.frame_no + l.lag GROUP BY 1, 2)"""


def _shifted(frames):
    return frames.select("track_id", (F.col("frame_no") + 7).alias("frame_no"), "value")


@query(
    f"""{_F}, {_LAG}, ok AS (SELECT track_id, CAST(lag AS INTEGER) AS lag, round(score, 4) AS score FROM sc WHERE n >= 100), b AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) = 1)
SELECT b.track_id, b.lag, b.score, CASE WHEN b.score > 0 THEN {{r}} ELSE 0.0::DOUBLE END AS confidence FROM b LEFT JOIN (SELECT o.track_id, max(o.score) AS second FROM ok o JOIN b ON b.track_id = o.track_id WHERE abs(o.lag - b.lag) > 3 GROUP BY 1) s ON s.track_id = b.track_id""".replace("{r}", "round(1 - coalesce(second, 0.0::DOUBLE) / b.score, 4)")
)
def estimate_lag(spark, sf):
    f = b.frames(spark, sf)
    return sg.estimate_lag(sg.lag_scores(_shifted(f), f, max_lag=40), min_overlap=100, exclude=3)


@query(
    f"""{_F}, lags AS (SELECT unnest(range(-40, 41)) AS lag), sc AS (SELECT a.track_id, a.frame_no // 90 AS blk, l.lag, round(sum(b.value * a.value), 4) AS score, count(*) AS n FROM frames a, lags l, (SELECT track_id, frame_no + 7 AS frame_no, value FROM frames) b
  WHERE b.track_id = a.track_id AND b.frame_no = a.frame_no + l.lag GROUP BY 1, 2, 3), loc AS (SELECT * FROM sc WHERE n >= 30 QUALIFY row_number() OVER (PARTITION BY track_id, blk ORDER BY score DESC, lag) = 1),
w AS (SELECT track_id, lag FROM (SELECT track_id, lag, round(sum(score), 4) AS score, sum(n) AS n FROM sc GROUP BY 1, 2) WHERE n >= 100 QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) = 1)
SELECT loc.track_id, quantile_cont(CAST(abs(loc.lag - w.lag) AS DOUBLE), 0.5) AS median, max(CAST(abs(loc.lag - w.lag) AS DOUBLE)) AS worst, count(*) AS blocks, quantile_cont(CAST(abs(loc.lag - w.lag) AS DOUBLE), 0.5) < 2 AND max(abs(loc.lag - w.lag)) < 12 AS consistent FROM loc JOIN w USING (track_id) GROUP BY 1"""
)
def lag_consistency(spark, sf):
    f = b.frames(spark, sf)
    right = f.withColumn("blk", F.floor(F.col("frame_no") / 90))
    local = sg.estimate_lag(sg.lag_scores(_shifted(f), right, max_lag=40, extra=("blk",)), min_overlap=30, exclude=3, by=("track_id", "blk"))
    whole = sg.estimate_lag(sg.lag_scores(_shifted(f), f, max_lag=40), min_overlap=100, exclude=3)
    return sg.lag_consistency(local, whole, max_median=2.0, max_any=12.0)


_TEMPO = """l AS (SELECT unnest(range(12, 41)) AS lag), ac AS (SELECT a.track_id, l.lag, round(sum(a.value * b.value), 4) AS ac FROM det a, l, det b WHERE b.track_id = a.track_id AND b.frame_no = a.frame_no + l.lag GROUP BY 1, 2),
w AS (SELECT *, round(ac * exp(-0.5::DOUBLE * pow(log2(60.0::DOUBLE * 40 / lag / 120) / 0.9::DOUBLE, 2)), 4) AS wt FROM ac), k0 AS (SELECT track_id, lag AS k FROM w QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY wt DESC, lag) = 1),
h AS (SELECT k0.track_id, k, CAST(round_even(k / 2.0, 0) AS BIGINT) AS half FROM k0),
k1 AS (SELECT h.track_id, CASE WHEN half >= 12 AND 60.0 * 40 / k < 100 AND b.ac >= 0.75 * a.ac THEN half ELSE k END AS k FROM h JOIN ac a ON a.track_id = h.track_id AND a.lag = h.k LEFT JOIN ac b ON b.track_id = h.track_id AND b.lag = h.half)
SELECT k1.track_id, CAST(k AS INTEGER) AS lag, round(k + coalesce(CASE WHEN y0.ac - 2 * y1.ac + y2.ac <> 0 THEN 0.5::DOUBLE * (y0.ac - y2.ac) / (y0.ac - 2 * y1.ac + y2.ac) END, 0.0::DOUBLE), 4) AS period FROM k1
 JOIN ac y1 ON y1.track_id = k1.track_id AND y1.lag = k LEFT JOIN ac y0 ON y0.track_id = k1.track_id AND y0.lag = k - 1 LEFT JOIN ac y2 ON y2.track_id = k1.track_id AND y2.lag = k + 1"""


@query(f"{_F}, {_DET}, {_TEMPO}")
def tempo_period(spark, sf):
    e = _env(spark, sf)
    return sg.tempo_period(sg.lag_scores(e, e, max_lag=40), fps=40, lo=12, hi=40)


@query(
    f"""{_F}, pk AS (SELECT track_id, frame_no, value FROM (SELECT *, max(value) OVER (PARTITION BY track_id ORDER BY frame_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM frames) WHERE value > 0 AND value = top),
g AS (SELECT track_id, g, 60.0::DOUBLE + g * 0.5::DOUBLE AS bpm, sum(value * cos(2 * pi() * frame_no * (60.0::DOUBLE + g * 0.5::DOUBLE) / 2400.0::DOUBLE)) AS c, sum(value * sin(2 * pi() * frame_no * (60.0::DOUBLE + g * 0.5::DOUBLE) / 2400.0::DOUBLE)) AS s FROM pk, (SELECT unnest(range(0, 261)) AS g) GROUP BY 1, 2, 3),
p AS (SELECT *, round(sqrt(c * c + s * s) * exp(-0.5::DOUBLE * pow(log2(bpm / 120) / 0.9::DOUBLE, 2)), 3) AS power FROM g)
SELECT track_id, bpm, power FROM p QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY power DESC, g) = 1"""
)
def tempo_spectral(spark, sf):
    return sg.tempo_spectral(sg.local_peaks(b.frames(spark, sf), radius=3), fps=40, bpm_lo=60, bpm_hi=190, step=0.5)


# ---------------------------------------------------------------- statistics and audits
_TAP = "taps AS (SELECT track_id, start_ms, CASE WHEN start_ms >= 0 THEN (round_even(start_ms / 1000.0::DOUBLE / 0.5::DOUBLE, 0) * 0.5::DOUBLE - start_ms / 1000.0::DOUBLE) * 1000 END AS off, line_no FROM lines)"


def _taps(spark, sf):
    s = F.col("start_ms") / 1000
    return b.lines(spark, sf).select("track_id", "line_no", st.tap_offset(s, F.lit(0.0), F.lit(0.5)).alias("off"))


@query(f"{_L}, {_TAP} SELECT track_id, line_no, round(off, 6) AS off FROM taps")
def tap_offset(spark, sf):
    return _taps(spark, sf).withColumn("off", F.round("off", 6))


@query(
    f"""{_L}, {_TAP}, o AS (SELECT track_id, round(off, 6) AS v, row_number() OVER (PARTITION BY track_id ORDER BY round(off, 6)) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM taps),
q AS (SELECT track_id, max(v) FILTER (i = n // 4) AS q1, max(v) FILTER (i = n * 3 // 4) AS q3 FROM o GROUP BY 1),
k AS (SELECT o.track_id, v, row_number() OVER (PARTITION BY o.track_id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY o.track_id) AS n FROM o JOIN q USING (track_id) WHERE n < 4 OR v BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1))
SELECT track_id, round(avg(v), 4) AS robust_mean FROM k WHERE i >= n // 10 AND i < n - n // 10 GROUP BY 1"""
)
def robust_mean(spark, sf):
    t = _taps(spark, sf).withColumn("off", F.round("off", 6))
    return st.robust_mean(t, by=["track_id"], value="off").withColumn("robust_mean", F.round("robust_mean", 4))


@query(f"{_L} SELECT text, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.995), 6) AS p995 FROM lines GROUP BY 1")
def exact_percentiles(spark, sf):
    ln = b.lines(spark, sf, "value")
    p = st.exact_percentiles(ln, by=["text"], value="value", p50=0.5, p90=0.9, p995=0.995)
    return p.select("text", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p995")])


@query(
    f"""WITH {CHARS_SQL}, l AS (SELECT track_id, line_no, count(*) AS c, count(t) + count(release_ms) AS s, sum(CASE WHEN char_no % 2 = 0 THEN 1 ELSE 0 END) + count(release_ms) AS p FROM chars GROUP BY 1, 2)
SELECT track_id, count(*) AS total_lines, CAST(sum(c) AS BIGINT) AS total_chars, CAST(sum(s) AS BIGINT) AS total_timetags, CAST(sum(p) AS BIGINT) AS total_checkpoints, count(*) AS completed_lines, 1.0::DOUBLE AS completion_rate FROM l GROUP BY 1"""
)
def timing_stats(spark, sf):
    return st.timing_stats(timed_chars(spark, sf))


@query(f"{_L}, o AS (SELECT track_id, line_no, row_number() OVER (PARTITION BY track_id ORDER BY line_no) AS rank, count(*) OVER (PARTITION BY track_id) AS total FROM lines WHERE value < 60) SELECT track_id, line_no, CAST(rank AS INTEGER) AS rank, total FROM o WHERE rank <= 10")
def untimed_report(spark, sf):
    return st.untimed_report(b.lines(spark, sf, "value"), done=F.col("value") >= 60)


@query(
    """WITH s AS (SELECT DISTINCT conv_id, role FROM conversations WHERE conv_id % 5 <> 0 AND (conv_id % 5 <> 1 OR role = 'user'))
SELECT conv_id AS track_id, 'no singer' AS error, 1 AS n FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0
UNION ALL SELECT conv_id, 'no default singer', 1 FROM (SELECT conv_id, max(CASE WHEN role = 'user' AND conv_id % 5 <> 2 THEN 1 ELSE 0 END) AS d FROM s GROUP BY 1) WHERE d = 0
UNION ALL SELECT c.conv_id, 'unknown singer', count(*) FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.role = c.role WHERE s.role IS NULL GROUP BY 1"""
)
def validate_tracks(spark, sf):
    conv = b.table(spark, sf, "conversations", F.col("conv_id").alias("track_id"), F.col("role").alias("singer_id"))
    k = F.pmod("track_id", F.lit(5))
    singers = conv.distinct().where((k != 0) & ((k != 1) | (F.col("singer_id") == "user"))).withColumn("is_default", (F.col("singer_id") == "user") & (k != 2))
    out = st.validate_tracks(conv.select("track_id").distinct(), singers, conv)
    return out.withColumn("n", F.col("n").cast("long"))


@query(f"WITH {CHARS_SQL} SELECT track_id, line_no, char_no, 1 AS n_parts, 2 AS check_count, upper(ch) || '|^' AS preview FROM chars WHERE char_no % 4 = 0")
def ruby_part_mismatch(spark, sf):
    c = timed_chars(spark, sf)
    c = c.withColumn("check_count", F.when(F.pmod("char_no", F.lit(4)) == 0, 2).otherwise(F.col("check_count")))
    return st.ruby_part_mismatch(c)


@query(f"{_L} SELECT track_id, text, round(avg(end_ms - start_ms), 4) AS score, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM lines GROUP BY 1, 2")
def merge_token_spans(spark, sf):
    """Mean score and outer span of each unit's tokens."""
    ln = b.lines(spark, sf)
    return ln.groupBy("track_id", "text").agg(F.round(F.avg(F.col("end_ms") - F.col("start_ms")), 4).alias("score"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    f"""{_L}, t AS (SELECT track_id, line_no, line_no // 2 AS tid, start_ms - line_no % 5 * 900 AS s, end_ms - line_no % 7 * 900 AS e FROM lines), h AS (SELECT *, max(s) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM t),
i AS (SELECT track_id, count(*) - count(DISTINCT tid) AS r FROM t GROUP BY 1)
SELECT h.track_id, count(*) FILTER (s > e) AS inverted, count(*) FILTER (s < hi) AS backward, count(*) AS tokens, any_value(r) AS repeated_ids FROM h JOIN i USING (track_id) GROUP BY 1"""
)
def audit_alignment(spark, sf):
    t = b.lines(spark, sf).select(
        "track_id", F.col("line_no").alias("token_no"), F.floor(F.col("line_no") / 2).alias("token_id"),
        (F.col("start_ms") - F.pmod("line_no", F.lit(5)) * 900).alias("start_ms"), (F.col("end_ms") - F.pmod("line_no", F.lit(7)) * 900).alias("end_ms"),
    )
    return st.audit_alignment(t)


@query(f"{_L}, f AS (SELECT track_id, text, min(line_no) AS first_at FROM lines GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY track_id ORDER BY first_at, text) AS INTEGER) AS rank FROM f")
def roles_in_order(spark, sf):
    return st.roles_in_order(b.lines(spark, sf), by=["track_id"], role="text", order="line_no")


_D = "WITH " + b.DOC_LINES_SQL
_REP = """bl AS (SELECT doc_id AS track_id, (line_no - 1) // 4 AS block_no, regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}]', '', 'g') AS key FROM doc_lines), f AS (SELECT track_id, key, min(block_no) AS src FROM bl GROUP BY 1, 2),
v AS (SELECT b.track_id, b.block_no, src, count(*) AS votes FROM bl b JOIN f USING (track_id, key) WHERE src < b.block_no GROUP BY 1, 2, 3), z AS (SELECT track_id, block_no, count(*) AS lines FROM bl GROUP BY 1, 2),
rep AS (SELECT v.track_id, v.block_no, src AS repeat_of, votes FROM v JOIN z USING (track_id, block_no) WHERE TRUE QUALIFY row_number() OVER (PARTITION BY v.track_id, v.block_no ORDER BY votes DESC, src) = 1 AND votes >= greatest(2, CAST(floor(lines * 0.6) AS BIGINT)))"""


def _blocks(spark, sf):
    from verseline.functions.textnorm import line_key

    return b.doc_lines(spark, sf).select(F.col("doc_id").alias("track_id"), F.floor((F.col("line_no") - 1) / 4).alias("block_no"), line_key(F.col("text")).alias("key"))


@query(f"{_D}, {_REP} SELECT track_id, block_no, repeat_of, votes FROM rep")
def majority_source(spark, sf):
    return st.majority_source(_blocks(spark, sf))


@query(f"{_D}, {_REP} SELECT z.track_id, z.block_no, z.lines, CASE WHEN EXISTS (SELECT 1 FROM rep r WHERE r.track_id = z.track_id AND (r.block_no = z.block_no OR r.repeat_of = z.block_no)) THEN 'chorus' ELSE 'verse' END AS kind FROM z")
def chorus_kinds(spark, sf):
    bl = _blocks(spark, sf)
    sizes = bl.groupBy("track_id", "block_no").agg(F.count("*").alias("lines"))
    return st.chorus_kinds(sizes, st.majority_source(bl))


@query(
    f"""{_L}, m AS (SELECT track_id, start_ms, end_ms, value / 100 AS score FROM lines), g AS (SELECT track_id, min(start_ms) FILTER (score >= 0.5) AS a, max(end_ms) FILTER (score >= 0.5) AS z, round(count(*) FILTER (score >= 0.5) / CAST(count(*) AS DOUBLE), 2) AS confidence, max(end_ms) + 5000 AS d FROM m GROUP BY 1),
t AS (SELECT g.track_id, max(l.end_ms) AS tail FROM g JOIN lines l ON l.track_id = g.track_id AND l.text = 'view' AND g.z BETWEEN l.start_ms AND l.end_ms GROUP BY 1)
SELECT g.track_id, coalesce(greatest(0, a - 2000), 0) AS start_ms, CASE WHEN a IS NULL THEN d ELSE least(d, greatest(least(d, z + 2500), coalesce(tail + 1500, 0))) END AS end_ms, confidence FROM g LEFT JOIN t USING (track_id)"""
)
def suggest_segment(spark, sf):
    ln = b.lines(spark, sf, "value")
    regions = ln.where(F.col("text") == "view").select("track_id", F.col("start_ms").alias("region_start"), F.col("end_ms").alias("region_end"))
    dur = ln.groupBy("track_id").agg((F.max("end_ms") + 5000).alias("duration_ms"))
    return st.suggest_segment(ln.withColumn("score", F.col("value") / 100), regions, dur)
