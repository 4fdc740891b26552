"""Queries over lines on a timeline: sections, pages, display windows, quality checks, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseline.operators import intervals as iv
from verseline.operators import windows as wn
from verseline.plans import bindings as b
from verseline.plans.formats import CHARS_SQL, timed_chars
from verseline.plans.registry import query

_L = "WITH " + b.LINES_SQL
_W = "WINDOW w AS (PARTITION BY track_id ORDER BY start_ms, line_no)"
_COLS = "track_id, line_no, text, start_ms, end_ms"

# ---------------------------------------------------------------- sections and pages
_SECTION = f"""sec AS (SELECT {_COLS}, CAST(sum(f) OVER w AS BIGINT) AS section_id FROM
  (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w > 3500 THEN 1 ELSE 0 END AS f FROM lines {_W}) {_W})"""
_BLOCKS = f"""blk AS (SELECT {_COLS}, CAST(sum(f) OVER w AS BIGINT) AS block_no FROM
  (SELECT *, CASE WHEN reach IS NULL OR start_ms - reach > 3500 THEN 1 ELSE 0 END AS f FROM
    (SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines)) {_W})"""


def sectioned(spark, sf):
    return wn.section_ids(b.lines(spark, sf), gap_ms=3500)


@query(f"{_L}, {_SECTION} SELECT * FROM sec")
def section_ids(spark, sf):
    return sectioned(spark, sf)


@query(f"{_L}, {_BLOCKS} SELECT track_id, block_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS lines FROM blk GROUP BY 1, 2")
def lyric_sections(spark, sf):
    return wn.lyric_sections(b.lines(spark, sf))


@query(f"{_L}, {_SECTION} SELECT track_id, section_id, max(end_ms) + 500 AS end_ms FROM sec GROUP BY 1, 2")
def section_ends(spark, sf):
    return wn.section_ends(sectioned(spark, sf), tail_ms=500)


@query(
    f"""{_L}, bl AS (SELECT * REPLACE (CASE WHEN line_no % 6 = 0 THEN '' ELSE text END AS text) FROM lines),
pg AS (SELECT *, sum(CASE WHEN text = '' THEN 1 ELSE 0 END) OVER w AS page FROM bl {_W}),
n AS (SELECT *, max(end_ms) OVER (PARTITION BY track_id, page ORDER BY start_ms, line_no) AS reach,
  min(start_ms) OVER (PARTITION BY track_id, page ORDER BY start_ms, line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM pg WHERE text <> '')
SELECT {_COLS}, nxt IS NULL OR nxt - reach >= 3100 AS paragraph_end FROM n UNION ALL SELECT {_COLS}, false FROM bl WHERE text = ''"""
)
def paragraph_flags(spark, sf):
    ln = b.lines(spark, sf).withColumn("text", F.when(F.pmod("line_no", F.lit(6)) == 0, "").otherwise(F.col("text")))
    return wn.paragraph_flags(ln)


_PAGES = f"pg AS (SELECT *, row_number() OVER (PARTITION BY track_id, section_id ORDER BY start_ms, line_no) - 1 AS k FROM sec), plan AS (SELECT {_COLS}, section_id, k // 2 AS page_no, k % 2 AS lane FROM pg)"


def paged(spark, sf):
    return wn.page_plan(b.lines(spark, sf), rows=2, gap_ms=3500)


@query(f"{_L}, {_SECTION}, {_PAGES} SELECT * FROM plan")
def page_plan(spark, sf):
    return paged(spark, sf)


@query(
    f"""{_L}, r AS (SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  min(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, line_no ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS begins FROM lines),
p AS (SELECT *, sum(CASE WHEN reach IS NULL OR begins - reach >= 3100 THEN 1 ELSE 0 END) OVER w AS para FROM r {_W}),
n AS (SELECT *, row_number() OVER (PARTITION BY track_id, para ORDER BY start_ms, line_no) AS n FROM p)
SELECT {_COLS}, CASE WHEN reach IS NULL THEN 'none' WHEN n = 1 THEN 'paragraph' WHEN (n - 1) % 2 = 0 THEN 'page' ELSE 'none' END AS break_before FROM n"""
)
def seq_line_breaks(spark, sf):
    return wn.seq_line_breaks(b.lines(spark, sf))


@query(
    f"""{_L}, {_SECTION}, e AS (SELECT *, row_number() OVER (PARTITION BY track_id, section_id ORDER BY start_ms, line_no) AS a,
 row_number() OVER (PARTITION BY track_id, section_id ORDER BY start_ms DESC, line_no DESC) AS z FROM sec)
SELECT {_COLS}, section_id, a = 1 AS is_first, z = 1 AS is_last FROM e WHERE a = 1 OR z = 1"""
)
def section_edges(spark, sf):
    return wn.section_edges(sectioned(spark, sf))


@query(
    f"""{_L}, f AS (SELECT *, CASE WHEN text <> 'view' THEN line_no END AS no FROM lines)
SELECT {_COLS}, coalesce(last_value(no IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY start_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_line,
 coalesce(first_value(no IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY start_ms, line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_line FROM f"""
)
def prev_next_nonempty(spark, sf):
    return wn.prev_next_nonempty(b.lines(spark, sf), filled=F.col("text") != "view")


# ---------------------------------------------------------------- display windows
_WIN = f"""win AS (SELECT {_COLS}, section_id, page_no, lane,
  greatest(0, start_ms - 1800, least(start_ms - 500, least(pe + 1000, greatest(pe + 500, start_ms - 500)))) AS show_ms,
  CASE WHEN ns IS NULL THEN end_ms + 1000 ELSE least(end_ms + 1000, greatest(end_ms + 500, ns - 500)) END AS hide_ms
  FROM (SELECT *, lag(end_ms) OVER v AS pe, lead(start_ms) OVER v AS ns FROM plan WINDOW v AS (PARTITION BY track_id, lane ORDER BY start_ms, line_no)))"""


@query(f"{_L}, {_SECTION}, {_PAGES}, {_WIN} SELECT * FROM win")
def display_windows(spark, sf):
    return wn.display_windows(paged(spark, sf))


@query(
    f"""{_L}, {_SECTION}, {_PAGES}, {_WIN}, d AS (SELECT track_id, line_no, show_ms - greatest(start_ms - 1800, 0) AS entry_delayed_ms, end_ms + 1000 - hide_ms AS exit_advanced_ms FROM win)
SELECT *, CASE WHEN entry_delayed_ms > 0 AND exit_advanced_ms > 0 THEN 'both' WHEN entry_delayed_ms > 0 THEN 'entry' ELSE 'exit' END AS kind FROM d WHERE entry_delayed_ms > 0 OR exit_advanced_ms > 0"""
)
def window_compression_report(spark, sf):
    return wn.window_compression_report(wn.display_windows(paged(spark, sf)))


@query(
    f"""{_L}, {_SECTION}, {_PAGES}, {_WIN}, p AS (SELECT *, 0 AS z FROM win)
SELECT a.track_id, a.section_id, a.lane, a.line_no AS line_a, b.line_no AS line_b, least(a.hide_ms, b.hide_ms) - greatest(a.show_ms, b.show_ms) AS overlap_ms
FROM p a JOIN p b ON a.track_id = b.track_id AND a.section_id = b.section_id AND a.lane = b.lane AND b.page_no = a.page_no + 1 AND a.show_ms < b.hide_ms AND b.show_ms < a.hide_ms"""
)
def overlapping_pairs(spark, sf):
    """Same-lane lines of consecutive pages whose display windows overlap."""
    from verseline.operators.catalogue import overlapping_pages

    return overlapping_pages(wn.display_windows(paged(spark, sf)))


@query(
    f"""{_L} SELECT a.track_id, a.line_no, count(b.line_no) AS overlaps FROM lines a LEFT JOIN lines b ON a.track_id = b.track_id AND a.line_no <> b.line_no AND a.start_ms <= a.end_ms AND b.start_ms <= b.end_ms AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY 1, 2"""
)
def overlap_counts(spark, sf):
    """How many other lines overlap each line, by counting starts and ends instead of building pairs."""
    from verseline.operators.catalogue import overlap_counts as counts

    return counts(b.lines(spark, sf))


# ---------------------------------------------------------------- quality
def even_chars(spark, sf):
    """Every event line cut evenly into its characters, one beat each."""
    ln = b.lines(spark, sf)
    n = F.length("text")
    step = F.floor((F.col("end_ms") - F.col("start_ms")) / n)
    return ln.select("track_id", "line_no", "start_ms", step.alias("step"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k")).select(
        "track_id",
        "line_no",
        (F.col("start_ms") + F.col("k") * F.col("step")).alias("start_ms"),
        (F.col("start_ms") + (F.col("k") + 1) * F.col("step")).alias("end_ms"),
        F.lit(1).alias("beats"),
    )


_QA = f"""q AS (SELECT *, length(text) AS n, (end_ms - start_ms) // length(text) AS step, lead(start_ms) OVER w AS nxt FROM lines {_W}),
d AS (SELECT *, greatest(10, least(end_ms, start_ms + (n - 1) * step + 1200) - start_ms) AS dur, CASE WHEN step < 45 THEN n ELSE 0 END AS short FROM q),
f AS (SELECT *, n * 1000 > dur * 11 AS fast, NOT (n * 1000 > dur * 11) AND n * 1000 < dur AND dur > 4000 AS slow, short >= greatest(2, n // 3) AS sh, short >= n // 2 AS many, coalesce(end_ms > nxt + 50, false) AS over FROM d),
v AS (SELECT *, greatest(CASE WHEN fast THEN 2 WHEN slow THEN 1 ELSE 0 END, CASE WHEN sh AND many THEN 2 WHEN sh THEN 1 ELSE 0 END, CASE WHEN over THEN 1 ELSE 0 END) AS lv FROM f),
qa AS (SELECT track_id, line_no, CASE lv WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'bad' END AS flag,
  concat_ws(',', CASE WHEN fast THEN 'fast' END, CASE WHEN slow THEN 'slow' END, CASE WHEN sh THEN 'short' END, CASE WHEN over THEN 'overlap' END) AS notes FROM v)"""


def _qa(spark, sf):
    return wn.timing_qa(b.lines(spark, sf), wn.line_beats(even_chars(spark, sf)))


@query(f"{_L}, {_QA} SELECT * FROM qa")
def timing_qa(spark, sf):
    return _qa(spark, sf)


@query(
    f"""{_L}, {_QA} SELECT track_id, count(*) FILTER (flag = 'ok') AS ok, count(*) FILTER (flag = 'warn') AS warn, count(*) FILTER (flag = 'bad') AS bad, count(*) AS lines FROM qa GROUP BY 1"""
)
def qa_summary(spark, sf):
    return wn.qa_summary(_qa(spark, sf))


# stamps written out of order: the line order is (event_id * 7919) % 10007
_WRITTEN = "wr AS (SELECT track_id, (line_no * 7919) % 1000003 * 1000000 + line_no AS line_no, text, start_ms, end_ms FROM lines)"


def _written(spark, sf):
    return b.lines(spark, sf).withColumn("line_no", F.pmod(F.col("line_no") * 7919, F.lit(1000003)) * 1000000 + F.col("line_no"))


@query(
    f"""{_L}, {_WRITTEN} SELECT {_COLS}, hi - start_ms AS behind_ms FROM (SELECT *, max(start_ms) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM wr) WHERE start_ms < hi"""
)
def backward_alerts(spark, sf):
    return wn.backward_alerts(_written(spark, sf), block=F.floor(F.col("line_no") / 10**11))


@query(
    f"""{_L}, h AS (SELECT *, max(start_ms - line_no % 5 * 900) OVER (PARTITION BY track_id ORDER BY line_no) AS hi FROM lines)
SELECT track_id, line_no, text, hi AS start_ms, CASE WHEN end_ms < hi THEN hi + 50 ELSE end_ms END AS end_ms FROM h"""
)
def monotonic_fix(spark, sf):
    return wn.monotonic_fix(b.lines(spark, sf).withColumn("start_ms", F.col("start_ms") - F.pmod("line_no", F.lit(5)) * 900))


@query(
    f"""{_L}, u AS (SELECT track_id, line_no, text, CASE WHEN line_no % 3 > 0 THEN start_ms END AS s, CASE WHEN line_no % 3 > 0 THEN end_ms END AS e FROM lines),
n AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
 first_value(s IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM u)
SELECT track_id, line_no, text, coalesce(s, least(pe, ns), ns) AS start_ms, coalesce(e, least(pe, ns), ns) AS end_ms FROM n"""
)
def fill_untimed(spark, sf):
    known = F.pmod("line_no", F.lit(3)) > 0
    return wn.fill_untimed(b.lines(spark, sf).withColumns({"start_ms": F.when(known, F.col("start_ms")), "end_ms": F.when(known, F.col("end_ms"))}))


@query(
    f"""{_L}, u AS (SELECT track_id, line_no, CASE WHEN line_no % 4 = 0 THEN start_ms END AS v, row_number() OVER (PARTITION BY track_id ORDER BY line_no) AS i FROM lines),
n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM u
 WINDOW b AS (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, line_no, CAST(round(CASE WHEN v IS NOT NULL THEN CAST(v AS DOUBLE) WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE CAST(coalesce(pv, nv) AS DOUBLE) END, 3) AS DOUBLE) AS est_ms FROM n"""
)
def interpolate_lines(spark, sf):
    ln = b.lines(spark, sf).select("track_id", "line_no", F.when(F.pmod("line_no", F.lit(4)) == 0, F.col("start_ms")).alias("est_ms"))
    return wn.interpolate_lines(ln)


@query(
    f"""{_L}, p AS (SELECT *, CASE WHEN lag(text) OVER w IS NULL OR lag(text) OVER w <> text THEN 1 ELSE 0 END AS f FROM lines WINDOW w AS (PARTITION BY track_id ORDER BY line_no)),
r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY track_id ORDER BY line_no) AS BIGINT) AS run_no FROM p)
SELECT track_id, run_no, any_value(text) AS text, min(line_no) AS first, max(line_no) AS last, count(*) AS n FROM r GROUP BY 1, 2"""
)
def run_length(spark, sf):
    return wn.run_length(b.lines(spark, sf), by=["track_id"], order="line_no", value="text")


@query(
    """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN role END AS v FROM conversations)
SELECT conv_id, turn, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS singer_id FROM r"""
)
def fill_singers(spark, sf):
    conv = b.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.pmod("turn", F.lit(3)) != 0, F.col("role")).alias("singer_id"))
    return wn.fill_forward_backward(conv, by=["conv_id"], order="turn", value="singer_id")


@query(
    f"""{_L}, h AS (SELECT track_id, line_no, start_ms + (line_no * 37) % 9001 AS pos, line_no % 3 = 0 AS sure FROM lines),
n AS (SELECT *, max(CASE WHEN sure THEN pos END) OVER (PARTITION BY track_id ORDER BY line_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
 min(CASE WHEN sure THEN pos END) OVER (PARTITION BY track_id ORDER BY line_no, pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM h)
SELECT track_id, line_no, pos, sure FROM n WHERE (lo IS NULL OR pos >= lo) AND (hi IS NULL OR pos <= hi)"""
)
def monotone_chain(spark, sf):
    hits = b.lines(spark, sf).select(
        "track_id", "line_no", (F.col("start_ms") + F.pmod(F.col("line_no") * 37, F.lit(9001))).alias("pos"), (F.pmod("line_no", F.lit(3)) == 0).alias("sure")
    )
    return wn.monotone_chain(hits, confident=F.col("sure"))


# ---------------------------------------------------------------- characters
@query(
    f"""WITH {CHARS_SQL}, le AS (SELECT *, max(release_ms) OVER (PARTITION BY track_id, line_no) AS line_end,
 first_value(t IGNORE NULLS) OVER (PARTITION BY track_id, line_no ORDER BY char_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM chars),
e AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(coalesce(release_ms, nt, CASE WHEN line_end > t THEN line_end END, t + 400), t) END AS e FROM le),
p AS (SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY track_id, line_no ORDER BY char_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), nt) AS snap FROM e)
SELECT track_id, line_no, char_no, ch, coalesce(t, snap) AS start_ms, coalesce(e, snap) AS end_ms FROM p"""
)
def char_windows(spark, sf):
    return wn.char_windows(timed_chars(spark, sf)).select("track_id", "line_no", "char_no", "ch", "start_ms", "end_ms")


@query(
    f"""WITH {CHARS_SQL}, w AS (SELECT *, start_ms AS bs, start_ms + 1000 AS be, 1 + char_no % 3 AS width FROM chars),
c AS (SELECT *, sum(width) OVER (PARTITION BY track_id, line_no) AS total, sum(width) OVER (PARTITION BY track_id, line_no ORDER BY char_no) AS upto FROM w)
SELECT track_id, line_no, char_no, CAST(bs + 1000 * (upto - width) // total AS BIGINT) AS start_ms, CAST(bs + 1000 * upto // total AS BIGINT) AS end_ms FROM c"""
)
def char_intervals(spark, sf):
    ln = b.lines(spark, sf).select(
        "track_id", "line_no", F.col("start_ms").alias("block_start"), (F.col("start_ms") + 1000).alias("block_end"),
        F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("k"),
    )
    chars = ln.select("track_id", "line_no", "block_start", "block_end", F.col("k").cast("long").alias("char_no"), (F.pmod("k", F.lit(3)) + 1).alias("width"))
    return wn.char_intervals(chars).select("track_id", "line_no", "char_no", "start_ms", "end_ms")


@query(
    f"""{_L}, n AS (SELECT *, length(text) AS v, lead(start_ms) OVER w AS nxt FROM lines {_W}),
s AS (SELECT *, greatest(CASE WHEN nxt > start_ms THEN nxt ELSE start_ms + least(greatest(v * 140, 1200), 7000) END - start_ms, v * 40) AS span FROM n),
c AS (SELECT *, unnest(range(0, v)) AS char_no FROM s)
SELECT track_id, line_no, char_no, text[char_no + 1] AS ch, start_ms + least(char_no * greatest(span // v, 40), span) AS char_ms FROM c"""
)
def estimate_char_times(spark, sf):
    return wn.estimate_char_times(b.lines(spark, sf))


@query(
    f"""WITH {CHARS_SQL}, p AS (SELECT *, sum(CASE WHEN coalesce(pl, false) THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, line_no ORDER BY char_no) AS g FROM
 (SELECT *, lag(linked) OVER (PARTITION BY track_id, line_no ORDER BY char_no) AS pl FROM chars))
SELECT track_id, line_no, CAST(g AS BIGINT) AS group_no, string_agg(ch, '' ORDER BY char_no) AS text, string_agg(upper(ch), '' ORDER BY char_no) AS reading, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def word_groups(spark, sf):
    return wn.word_groups(timed_chars(spark, sf))


@query(
    f"""{_L}, u AS (SELECT track_id, line_no, start_ms, end_ms, 4 AS n, unnest([0, 1, 2, 3]) AS unit_no FROM lines),
o AS (SELECT *, CASE WHEN (line_no + unit_no) % 3 = 0 THEN (line_no * 13) % 500 END AS offset_ms, CAST(round_even((end_ms - start_ms) * unit_no / 4.0, 0) AS BIGINT) AS spread FROM u),
m AS (SELECT *, start_ms + max(least(coalesce(offset_ms, spread), end_ms - start_ms)) OVER (PARTITION BY track_id, line_no ORDER BY unit_no) AS unit_ms FROM o)
SELECT track_id, line_no, unit_no, unit_ms, coalesce(lead(unit_ms) OVER (PARTITION BY track_id, line_no ORDER BY unit_no), end_ms) AS unit_end_ms FROM m"""
)
def reading_unit_times(spark, sf):
    u = b.lines(spark, sf).select("track_id", "line_no", "start_ms", "end_ms", F.lit(4).alias("n"), F.lit(0).alias("char_no"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("unit_no"))
    u = u.withColumn("offset_ms", F.when(F.pmod(F.col("line_no") + F.col("unit_no"), F.lit(3)) == 0, F.pmod(F.col("line_no") * 13, F.lit(500))))
    return wn.reading_unit_times(u).select("track_id", "line_no", "unit_no", "unit_ms", "unit_end_ms")


def _jittered(spark, sf):
    chars = timed_chars(spark, sf).where(F.col("char_no") < 99)
    return chars.select("track_id", "line_no", "char_no", (F.get("cps_ms", F.lit(0))).alias("t"), "release_ms")


@query(
    f"""{_L}, j AS (SELECT track_id, line_no, unnest(range(0, length(text))) AS char_no, start_ms FROM lines),
s0 AS (SELECT track_id, line_no, char_no, start_ms + char_no * 200 + (line_no * 31 + char_no * 57) % 90 AS start_ms FROM j),
a AS (SELECT *, CAST(start_ms AS DOUBLE) AS t FROM s0),
b1 AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM a WINDOW w AS (PARTITION BY track_id, line_no ORDER BY char_no)),
c1 AS (SELECT track_id, line_no, char_no, start_ms, CASE WHEN p IS NOT NULL AND n IS NOT NULL AND t - p <= 1000 AND n - t <= 1000 THEN least(greatest(t + ((p + n) / 2 - t) * 0.5, start_ms - 80), start_ms + 80) ELSE t END AS t FROM b1),
b2 AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS n FROM c1 WINDOW w AS (PARTITION BY track_id, line_no ORDER BY char_no)),
c2 AS (SELECT track_id, line_no, char_no, start_ms, CASE WHEN p IS NOT NULL AND n IS NOT NULL AND t - p <= 1000 AND n - t <= 1000 THEN least(greatest(t + ((p + n) / 2 - t) * 0.5, start_ms - 80), start_ms + 80) ELSE t END AS t FROM b2)
SELECT track_id, line_no, char_no, CAST(floor(greatest(t, coalesce(lag(t) OVER (PARTITION BY track_id, line_no ORDER BY char_no) + 20, t)) + 0.5) AS BIGINT) AS smooth_ms FROM c2"""
)
def smooth_timing(spark, sf):
    ln = b.lines(spark, sf).select("track_id", "line_no", "start_ms", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("k"))
    chars = ln.select(
        "track_id", "line_no", F.col("k").cast("long").alias("char_no"),
        (F.col("start_ms") + F.col("k") * 200 + F.pmod(F.col("line_no") * 31 + F.col("k") * 57, F.lit(90))).alias("start_ms"),
    )
    return wn.smooth_timing(chars).select("track_id", "line_no", "char_no", "smooth_ms")


_FALL = f"""{_L}, f AS (SELECT track_id, line_no, start_ms + 5000 AS base, length(text) AS n, unnest(range(0, length(text))) AS char_no FROM lines),
c AS (SELECT track_id, line_no, char_no, n, base, CASE WHEN line_no % 2 = 0 THEN base - char_no * 100 ELSE base + char_no * 100 END AS start_ms, CASE WHEN line_no % 2 = 0 THEN base - n * 100 ELSE base + n * 100 END AS line_end_ms FROM f)"""


def _falling(spark, sf):
    ln = b.lines(spark, sf).select("track_id", "line_no", (F.col("start_ms") + 5000).alias("base"), F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("k"))
    sign = F.when(F.pmod("line_no", F.lit(2)) == 0, -100).otherwise(100)
    return ln.select("track_id", "line_no", F.col("k").cast("long").alias("char_no"), (F.col("base") + F.col("k") * sign).alias("start_ms"), (F.col("base") + F.col("n") * sign).alias("line_end_ms"))


@query(
    f"""{_FALL} SELECT track_id, line_no, char_no, CASE WHEN line_no % 2 = 0 THEN base - n * 100 + char_no * 100 ELSE start_ms END AS start_ms,
 CASE WHEN line_no % 2 = 0 THEN base ELSE line_end_ms END AS line_end_ms, line_no % 2 = 0 AS reversed FROM c"""
)
def mirror_reversed_lines(spark, sf):
    return wn.mirror_reversed_lines(_falling(spark, sf))


@query(
    f"""{_L}, f AS (SELECT track_id, line_no, start_ms AS base, length(text) AS n, unnest(range(0, length(text))) AS char_no FROM lines)
SELECT track_id, line_no, char_no, CASE WHEN char_no < 2 THEN least(base + 300, base + 200) ELSE base + char_no // 2 * 200 END AS start_ms, base + n * 100 AS line_end_ms FROM f"""
)
def apply_head_offset(spark, sf):
    ln = b.lines(spark, sf).select("track_id", "line_no", "start_ms", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("k"))
    chars = ln.select("track_id", "line_no", F.col("k").cast("long").alias("char_no"), (F.col("start_ms") + F.floor(F.col("k") / 2) * 200).alias("start_ms"), (F.col("start_ms") + F.col("n") * 100).alias("line_end_ms"))
    return wn.apply_head_offset(chars, delta_ms=300)


@query(
    f"""{_L}, f AS (SELECT track_id, line_no, text, unnest(range(0, length(text))) AS k FROM lines)
SELECT track_id, line_no, k * 2 AS char_no, text[k + 1] || chr(769) AS ch FROM f"""
)
def merge_combining(spark, sf):
    ln = b.lines(spark, sf).select("track_id", "line_no", F.posexplode(F.split(F.regexp_replace("text", "(.)", "$1́"), "(?!^)(?=.)")).alias("p", "ch"))
    return wn.merge_combining(ln.select("track_id", "line_no", F.col("p").cast("long").alias("char_no"), "ch"))


# ---------------------------------------------------------------- points and intervals
_PTS = "pts AS (SELECT track_id, line_no AS point_id, start_ms + 700 AS t_ms FROM lines)"


def _points(spark, sf):
    return b.lines(spark, sf).select("track_id", F.col("line_no").alias("point_id"), (F.col("start_ms") + 700).alias("t_ms"))


@query(
    f"""{_L}, {_PTS}, reg AS (SELECT track_id, start_ms AS s, end_ms AS e FROM lines WHERE text = 'purchase')
SELECT p.*, EXISTS (SELECT 1 FROM reg r WHERE r.track_id = p.track_id AND p.t_ms BETWEEN r.s - 1000 AND r.e + 1000) AS inside FROM pts p"""
)
def in_activity(spark, sf):
    regions = b.lines(spark, sf).where(F.col("text") == "purchase").select("track_id", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return iv.in_any(_points(spark, sf), regions, by=["track_id"], t="t_ms", start="s", end="e", pad=1000)


@query(
    f"""{_L}, {_PTS} SELECT p.*, arg_max(l.line_no, l.start_ms * 10000000 + l.line_no) AS active_line FROM pts p JOIN lines l ON l.track_id = p.track_id AND p.t_ms >= l.start_ms - 200 AND p.t_ms < l.end_ms GROUP BY ALL"""
)
def active_line_at(spark, sf):
    return iv.active_line_at(_points(spark, sf), b.lines(spark, sf), lead_ms=200)


@query(
    f"""{_L}, tick AS (SELECT track_id, unnest(range(0, max(end_ms) + 1, 20000)) AS t_ms FROM lines GROUP BY 1)
SELECT t.*, l.line_no FROM tick t JOIN lines l ON l.track_id = t.track_id AND t.t_ms >= l.start_ms - 1000 AND t.t_ms < l.end_ms + 1000"""
)
def visible_lines_at(spark, sf):
    ln = b.lines(spark, sf)
    ticks = ln.groupBy("track_id").agg(F.max("end_ms").alias("e")).select("track_id", F.explode(F.expr("sequence(0L, e, 20000L)")).alias("t_ms"))
    win = ln.select("track_id", "line_no", (F.col("start_ms") - 1000).alias("show_ms"), (F.col("end_ms") + 1000).alias("hide_ms"))
    return iv.visible_lines_at(ticks, win)


@query(
    f"""{_L}, {_PTS} SELECT p.*, (SELECT l.line_no FROM lines l WHERE l.track_id = p.track_id AND l.start_ms > p.t_ms ORDER BY l.start_ms, l.line_no LIMIT 1) AS upcoming_line FROM pts p"""
)
def upcoming_line(spark, sf):
    right = b.lines(spark, sf).select("track_id", F.col("start_ms").alias("rs"), F.col("line_no").alias("upcoming_line"))
    return iv.asof_join(_points(spark, sf), right, by=["track_id"], left_t="t_ms", right_t="rs", payload=["upcoming_line"], direction="forward", strict=True, tie="upcoming_line")


@query(
    f"""{_L}, {_PTS}, sl AS (SELECT track_id, text AS singer_id, line_no, start_ms FROM lines), q AS (SELECT p.*, s.singer_id FROM pts p JOIN sl s ON s.track_id = p.track_id AND s.line_no = p.point_id)
SELECT q.*, coalesce((SELECT l.line_no FROM sl l WHERE l.track_id = q.track_id AND l.singer_id = q.singer_id AND l.start_ms <= q.t_ms - 5000 ORDER BY l.start_ms DESC, l.line_no DESC LIMIT 1),
 (SELECT l.line_no FROM sl l WHERE l.track_id = q.track_id AND l.singer_id = q.singer_id ORDER BY l.start_ms, l.line_no LIMIT 1)) AS singer_line FROM q"""
)
def singer_line_at(spark, sf):
    from verseline.operators.catalogue import singer_line_at as op

    ln = b.lines(spark, sf).withColumnRenamed("text", "singer_id")
    pts = ln.select("track_id", "singer_id", F.col("line_no").alias("point_id"), (F.col("start_ms") + 700).alias("t_ms"), (F.col("start_ms") - 4300).alias("look_ms"))
    return op(pts, ln, t="look_ms").drop("look_ms")


@query(
    f"""{_L}, {_BLOCKS}, {_PTS}, s AS (SELECT track_id, block_no, min(start_ms) AS a, max(end_ms) AS z, count(*) AS n FROM blk GROUP BY 1, 2)
SELECT p.*, coalesce((SELECT CASE WHEN s.n >= 3 THEN 'chorus' ELSE 'bridge' END FROM s WHERE s.track_id = p.track_id AND p.t_ms >= s.a AND p.t_ms < s.z), 'verse') AS kind FROM pts p"""
)
def section_at(spark, sf):
    secs = wn.lyric_sections(b.lines(spark, sf)).select(
        "track_id", F.col("start_ms").alias("sec_start"), F.col("end_ms").alias("sec_end"), F.when(F.col("lines") >= 3, "chorus").otherwise("bridge").alias("kind")
    )
    return iv.section_at(_points(spark, sf), secs)


@query(
    f"""WITH {b.ASR_SQL}, sp AS (SELECT conv_id AS track_id, turn, turn * 10000 + 1000 AS a, turn * 10000 + 2500 AS z FROM conversations)
SELECT s.track_id, s.turn, s.a AS start_ms, s.z AS end_ms, string_agg(w.word, '' ORDER BY w.start_ms, w.word) AS heard FROM sp s JOIN asr_words w ON w.track_id = s.track_id AND w.start_ms < least(s.z + 500, s.a + 4000) AND w.end_ms > s.a - 1500 GROUP BY ALL"""
)
def words_in_window(spark, sf):
    conv = b.table(spark, sf, "conversations")
    spans = conv.select(F.col("conv_id").alias("track_id"), "turn", (F.col("turn") * 10000 + 1000).alias("start_ms"), (F.col("turn") * 10000 + 2500).alias("end_ms"))
    return iv.words_in_window(spans, b.asr_words(spark, sf))


@query(
    f"""{_L}, m AS (SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, line_no) AS run FROM m)
SELECT track_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY track_id, run"""
)
def merge_windows(spark, sf):
    return iv.merge_windows(b.lines(spark, sf), by=["track_id"], start="start_ms", end="end_ms", tie="line_no")


@query(
    f"""{_L}, dur AS (SELECT track_id, max(end_ms) + 3000 AS d FROM lines GROUP BY 1),
seg AS (SELECT l.track_id, l.line_no AS seg_no, greatest(start_ms, 0) AS s, least(end_ms, d) AS e FROM lines l JOIN dur USING (track_id) WHERE least(end_ms, d) - greatest(start_ms, 0) > 50),
bd AS (SELECT track_id, s AS t FROM seg UNION SELECT track_id, e FROM seg UNION SELECT track_id, 0 FROM dur UNION SELECT track_id, d FROM dur),
cell AS (SELECT * FROM (SELECT track_id, t AS t0, lead(t) OVER (PARTITION BY track_id ORDER BY t) AS t1 FROM bd) WHERE t1 - t0 >= 20),
own AS (SELECT c.*, coalesce(min(s.seg_no), -1) AS seg_no FROM cell c LEFT JOIN seg s ON s.track_id = c.track_id AND (c.t0 + c.t1) // 2 BETWEEN s.s AND s.e GROUP BY ALL),
r AS (SELECT *, sum(f) OVER (PARTITION BY track_id ORDER BY t0) AS run FROM (SELECT *, CASE WHEN lag(seg_no) OVER w IS NULL OR lag(seg_no) OVER w <> seg_no THEN 1 ELSE 0 END AS f FROM own WINDOW w AS (PARTITION BY track_id ORDER BY t0)))
SELECT track_id, min(t0) AS t0, max(t1) AS t1, any_value(seg_no) AS seg_no FROM r GROUP BY track_id, run"""
)
def resolve_coverage(spark, sf):
    ln = b.lines(spark, sf)
    dur = ln.groupBy("track_id").agg((F.max("end_ms") + 3000).alias("duration_ms"))
    return iv.resolve_coverage(ln.select("track_id", F.col("line_no").alias("seg_no"), "start_ms", "end_ms"), dur)


# raw word source: the recognised words moved by a few ms, with lengths
_RAW = "raw AS (SELECT track_id, start_ms + (seg_no * 7 + word_no * 5) % 31 - 15 AS r, 150 + word_no % 50 AS dur FROM asr_words)"


@query(
    f"""WITH {b.ASR_SQL}, {_RAW} SELECT w.track_id, w.seg_no, w.word_no, w.start_ms, (SELECT CASE WHEN abs(r.r - w.start_ms) <= 12 THEN r.dur END FROM raw r WHERE r.track_id = w.track_id ORDER BY abs(r.r - w.start_ms), r.r LIMIT 1) AS dur_ms FROM asr_words w"""
)
def attach_word_durations(spark, sf):
    from verseline.operators.catalogue import attach_word_durations as op

    words = b.asr_words(spark, sf).select("track_id", "seg_no", "word_no", "start_ms")
    raw = words.select(
        "track_id", (F.col("start_ms") + F.pmod(F.col("seg_no") * 7 + F.col("word_no") * 5, F.lit(31)) - 15).alias("raw_ms"), (F.pmod("word_no", F.lit(50)) + 150).alias("dur_ms")
    )
    return op(words, raw)


@query(
    f"""{_L}, g AS (SELECT track_id, unnest(range(0, max(start_ms) + 1, 1730)) AS beat_ms FROM lines GROUP BY 1)
SELECT l.track_id, l.line_no, l.start_ms, arg_min(g.beat_ms, abs(g.beat_ms - l.start_ms) * 10000000 + g.beat_ms) AS beat_ms FROM lines l JOIN g ON g.track_id = l.track_id AND abs(g.beat_ms - l.start_ms) <= 2000 GROUP BY ALL"""
)
def snap_to_grid(spark, sf):
    ln = b.lines(spark, sf)
    grid = ln.groupBy("track_id").agg(F.max("start_ms").alias("e")).select("track_id", F.explode(F.expr("sequence(0L, e, 1730L)")).alias("beat_ms"))
    return iv.asof_join(ln.select("track_id", "line_no", "start_ms"), grid.withColumn("g", F.col("beat_ms")), by=["track_id"], left_t="start_ms", right_t="g", payload=["beat_ms"], direction="nearest")
