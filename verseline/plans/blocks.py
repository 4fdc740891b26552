"""Queries over alignment blocks and order-preserving matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from verseline.operators import blocks as bl
from verseline.operators.ordered import following_row, row_index, scan
from verseline.plans import bindings as b
from verseline.plans.registry import query

TRACK = ["track_id"]

# lines of a track in order of time, every fifth without an estimate; a voice from 200 ms before every line to 1.5 s after, or to the next
_TRACKS = f"""{b.LINES_SQL}, o AS (SELECT track_id, start_ms, line_no AS id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, line_no) AS line_no, lead(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, line_no) AS nxt FROM lines),
ln AS (SELECT track_id, line_no, CASE WHEN id % 5 > 0 THEN start_ms END AS est FROM o),
acts AS (SELECT * FROM (SELECT track_id, start_ms - 200 AS a, least(start_ms + 1500, nxt - 300) AS b FROM o) WHERE b > a AND track_id <> '7'),
win AS (SELECT track_id, 0 AS w0, max(start_ms) + 5003 AS w1, count(*) AS n, count(CASE WHEN id % 5 > 0 THEN 1 END) AS known FROM o GROUP BY 1)"""
_CENTI = "CAST(floor(({x} + 5) / 10) * 10 AS BIGINT)"


def _tracks(spark, sf):
    rows = b.lines(spark, sf).withColumnRenamed("line_no", "id")
    o = scan(rows.select("track_id", "start_ms", "id"), by=TRACK, order=["start_ms", "id"], block=F.floor(F.col("start_ms") / 60_000), line_no=row_index(), __next=following_row("start_ms"))
    ln = o.select("track_id", "line_no", F.when(F.pmod("id", F.lit(5)) > 0, F.col("start_ms")).alias("est"))
    acts = o.select("track_id", (F.col("start_ms") - 200).alias("a"), F.least(F.col("start_ms") + 1500, F.col("__next.start_ms") - 300).alias("b")).where("b > a and track_id <> '7'")
    win = o.groupBy("track_id").agg((F.max("start_ms") + 5003).alias("end_ms")).select("track_id", F.lit(0).cast("long").alias("start_ms"), "end_ms")
    return ln, acts, win


@query(
    f"""WITH {_TRACKS},
near AS (SELECT *, last_value(CASE WHEN est IS NOT NULL THEN {{'n': line_no, 'e': est}} END IGNORE NULLS) OVER w AS p, first_value(CASE WHEN est IS NOT NULL THEN {{'n': line_no, 'e': est}} END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
  FROM ln WINDOW w AS (PARTITION BY track_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT track_id, line_no, coalesce(CAST(est AS DOUBLE), p.e + (q.e - p.e) * (line_no - p.n) / (q.n - p.n), p.e, q.e) AS est FROM near),
g AS (SELECT *, lag(est) OVER (PARTITION BY track_id ORDER BY line_no) AS before FROM f),
pauses AS (SELECT * FROM (SELECT track_id, b AS stop, lead(a) OVER (PARTITION BY track_id ORDER BY a) AS onset FROM acts) WHERE onset - stop >= 1000),
ok AS (SELECT track_id FROM win WHERE known >= greatest(3, n // 2) AND track_id IN (SELECT track_id FROM acts)),
hit AS (SELECT g.track_id, g.line_no, g.before, p.stop, p.onset FROM g ASOF JOIN pauses p ON p.track_id = g.track_id AND p.onset <= CAST(floor(g.est + 600) AS BIGINT) WHERE g.before IS NOT NULL AND g.track_id IN (FROM ok)),
cut AS (SELECT track_id, line_no, {_CENTI.format(x='greatest(before + 800, onset - 350)')} AS t FROM hit WHERE stop >= before + 800),
st AS (SELECT track_id, line_no AS first_line, t AS start_ms FROM cut UNION ALL SELECT track_id, 1, 0 FROM win),
bk AS (SELECT st.track_id, first_line, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY st.track_id ORDER BY first_line), {_CENTI.format(x='w1')}) AS end_ms FROM st JOIN win USING (track_id)),
own AS (SELECT g.track_id, g.line_no, g.est, g.est - g.before AS gap, bk.first_line, bk.start_ms, bk.end_ms FROM g ASOF JOIN bk ON bk.track_id = g.track_id AND bk.first_line <= g.line_no),
sp AS (SELECT track_id, first_line, line_no AS pos, {_CENTI.format(x='est - 500')} AS mid FROM (SELECT *, count(*) OVER (PARTITION BY track_id, first_line) AS k FROM own)
  WHERE end_ms - start_ms > 20000 AND k > 4 AND line_no > first_line AND track_id IN (FROM ok) QUALIFY row_number() OVER (PARTITION BY track_id, first_line ORDER BY gap DESC, line_no) = 1)
SELECT track_id, CASE WHEN line_no >= pos THEN pos ELSE o.first_line END AS first_line, count(*) AS lines, CASE WHEN line_no >= pos THEN mid ELSE start_ms END AS start_ms, CASE WHEN line_no < pos THEN mid ELSE end_ms END AS end_ms
FROM own o LEFT JOIN sp USING (track_id, first_line) GROUP BY 1, 2, 4, 5"""
)
def align_blocks(spark, sf):
    """Blocks of the lines of every track, those over 20 seconds split once."""
    return bl.align_blocks(*_tracks(spark, sf), max_span=20_000)
