"""Sequential walks as pointers on a functional graph, followed by doubling.

A greedy walk along a track ("the next cut is the first one far enough after the last") looks sequential, but every possible stop has one
fixed successor. So the successor of every node is found at once with as-of joins, and the nodes that the walk really visits are marked in
logarithmic rounds: each round follows pointers that are twice as long as those of the round before. No track is gathered, however hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.operators.intervals import asof_join
from verseline.operators.ordered import last_known, next_known, scan
from verseline.session import cut_lineage


def follow(pointers: DataFrame, starts: DataFrame, *, by: Sequence[str], node: str, to: str) -> DataFrame:
    """(by, node): every node that is reached from ``starts`` along ``pointers`` (by, node, to), the starts included.

    ``node`` must be unique in a group; a pointer without ``to`` ends the walk. A cycle is walked once.
    """
    by = list(by)
    jump = cut_lineage(pointers.where(F.col(to).isNotNull()).select(*by, node, to))
    reached = cut_lineage(starts.select(*by, node).distinct())
    size = reached.count()
    while True:
        # ``reached`` holds all nodes less than 2**k steps away, ``jump`` leads 2**k steps on
        ahead = reached.join(jump, [*by, node]).select(*by, F.col(to).alias(node))
        reached = cut_lineage(reached.unionByName(ahead).distinct())
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
        onward = jump.select(*by, F.col(node).alias(to), F.col(to).alias("__far"))
        jump = cut_lineage(jump.join(onward, [*by, to]).select(*by, node, F.col("__far").alias(to)))


def min_gap_pick(times: DataFrame, *, by: Sequence[str], t: str, min_gap: int, block_ms: int = 60_000) -> DataFrame:
    """(by, t): the first time of every group, and from each kept one the next that lies at least ``min_gap`` later."""
    by = list(by)
    grid = times.where(F.col(t).isNotNull()).select(*by, F.col(t).cast("long").alias(t)).distinct()
    seen = grid.withColumn("__from", F.col(t) + min_gap)
    pointers = asof_join(seen, grid.withColumn("__to", F.col(t)), by=by, left_t="__from", right_t=t, payload=["__to"], direction="forward", block_ms=block_ms)
    return follow(pointers, grid.groupBy(*by).agg(F.min(t).alias(t)), by=by, node=t, to="__to")


def _successors(nodes: DataFrame, bars: DataFrame, forced: DataFrame, takes: DataFrame, ends: DataFrame, by: list[str], every: float, min_shot: int, max_shot: int, block_ms: int) -> DataFrame:
    """(by, t, to): the next cut after a cut at t, null where the plan ends.

    Two scans look everything up: one at the stops, one at the three times that each stop asks about. A scan reads its input twice, so what
    the first found is written down; a chain of one lookup after the other would read the first one's input over and over.
    """
    row = lambda df, t, order, *cols: df.select(*by, F.col(t).cast("long").alias("__t"), F.lit(order).alias("__o"), *cols)
    merged = lambda a, *rest: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rest, a)
    kw = {"by": by, "block": F.floor(F.col("__t") / block_ms)}
    # a bar or take that starts at a stop lies behind it
    stops = row(nodes.join(ends, by), "t", 1, "t", "end")
    began = merged(stops, row(bars, "t", 0, F.struct("energy", "pace", "bar_ms").alias("__b")), row(takes, "t0", 0, F.struct("t0", "t1").alias("__k")))
    s = scan(began, order=["__t", "__o"], __bar=last_known(F.col("__b")), __in=last_known(F.col("__k")), __next=next_known(F.col("__k")), **kw).where("__o = 1")
    # before the first bar: its values
    first = bars.groupBy(*by).agg(F.min_by(F.struct("energy", "pace", "bar_ms"), "t").alias("__first"))
    s = s.join(first, by).withColumns({c: F.coalesce(f"__bar.{c}", f"__first.{c}") for c in ("energy", "pace", "bar_ms")})
    s = s.select(*by, "t", "end", "energy", "pace", "bar_ms", F.col("__in.t1").cast("long").alias("__t1"), F.col("__next.t0").alias("__take"))
    wished = F.lit(float(every)) * F.when(F.col("energy") > 0.72, 0.5).when(F.col("energy") < 0.28, 2.0).otherwise(1.0) * F.col("pace")
    s = s.withColumn("__most", F.least(F.lit(max_shot).cast("long"), F.col("__take") - F.col("t")))
    s = s.withColumn("__target", F.least(F.col("t") + F.round(F.greatest(F.lit(1.0), wished) * F.col("bar_ms")).cast("long"), F.col("t") + F.col("__most")))
    s = s.withColumns({"__lo": F.col("t") + min_shot, "__hi": F.col("t") + F.col("__most")}).withColumn("__at", F.greatest("__target", "__lo"))
    # inside one time: those who look ahead (0), bars and forced cuts (1), those who look back (2)
    asks = [F.struct(F.col(t).cast("long").alias("t"), F.lit(o).alias("o"), F.lit(k).alias("k")) for k, t, o in ((0, "__lo", 0), (1, "__target", 2), (2, "__at", 0))]
    stop = [*by, "t", "end", "__t1", "__target", "__lo", "__hi"]
    s = cut_lineage(s.select(*stop, "__at"))
    asked = s.select(*stop, F.explode(F.array(*asks)).alias("__a")).select(*stop, F.col("__a.t").alias("__t"), F.col("__a.o").alias("__o"), F.col("__a.k").alias("__ask"))
    grid = merged(asked, row(bars, "t", 1, F.col("t").cast("long").alias("__b")), row(forced, "t", 1, F.col("t").cast("long").alias("__f")))
    found = scan(grid, order=["__t", "__o", "__ask", "t"], __below=last_known(F.col("__b")), __above=next_known(F.col("__b")), __force=next_known(F.col("__f")), **kw)
    answer = [F.max(F.when(F.col("__ask") == k, F.col(c))).alias(c) for k, c in ((0, "__force"), (1, "__below"), (2, "__above"))]
    s = found.where(F.col("__ask").isNotNull()).groupBy(*stop).agg(*answer)
    low = F.when(F.col("__below").between(F.col("__lo"), F.col("__hi")), F.col("__below"))
    high = F.when(F.col("__above").between(F.col("__lo"), F.col("__hi")), F.col("__above"))
    nearest = F.when(low.isNull() | (high - F.col("__target") < F.col("__target") - low), F.coalesce(high, low)).otherwise(low)
    to = F.coalesce(F.when(F.col("__force") <= F.col("__target") + 10, F.col("__force")), nearest, F.least(F.col("end"), F.col("__hi")))
    to = F.when(F.col("__t1") > F.col("t"), F.col("__t1")).when(F.col("end") - to >= min_shot, to)
    return s.select(*by, "t", F.when(F.col("t") < F.col("end") - min_shot, to).alias("to"))


def walk_cuts(bars: DataFrame, forced: DataFrame, takes: DataFrame, ends: DataFrame, *, by: Sequence[str] = ("track_id",), every: float = 2, min_shot: int = 1_000, max_shot: int = 12_000, block_ms: int = 60_000) -> DataFrame:
    """(by, t0, t1): the shots of a walk over the song that starts at 0.

    ``bars``: by, t, energy, pace, bar_ms (what holds from a bar on); ``forced``: by, t; ``takes``: by, t0, t1 (shots without cuts inside,
    apart from each other); ``ends``: by, end. From a cut the next is wished ``every`` bars later (half when loud, twice when quiet, times
    the pace; one bar at least), at most ``max_shot`` and not past the next take. A forced cut up to there wins, else the bar nearest to it
    (the earlier on ties) that is ``min_shot`` to ``max_shot`` away, else the limit itself. A cut inside a take leads to its end. A last
    piece shorter than ``min_shot`` joins the one before.
    """
    by = list(by)
    zero = ends.select(*by, F.lit(0).cast("long").alias("t"))
    rest = {"by": by, "every": every, "min_shot": min_shot, "max_shot": max_shot, "block_ms": block_ms}
    on_grid = zero.unionByName(bars.select(*by, "t")).unionByName(forced.select(*by, "t")).unionByName(takes.select(*by, F.col("t0").alias("t"))).unionByName(takes.select(*by, F.col("t1").alias("t"))).distinct()
    done, new = None, cut_lineage(on_grid)
    # where no bar is in reach the walk stops beside the grid: such stops get successors of their own until none is new
    while done is None or new.head(1):
        found = cut_lineage(_successors(new, bars, forced, takes, ends, **rest))
        done = found if done is None else done.unionByName(found)
        new = cut_lineage(found.where("`to` is not null").select(*by, F.col("to").alias("t")).distinct().join(done.select(*by, "t"), [*by, "t"], "left_anti"))
    cuts = follow(done, zero, by=by, node="t", to="to")
    last = cuts.join(done, [*by, "t"]).join(ends, by)
    return last.select(*by, F.col("t").alias("t0"), F.coalesce("to", "end").alias("t1")).where(F.col("t1") - F.col("t0") > 50)
