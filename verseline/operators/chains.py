"""The best order-preserving choice among matches: an exact weighted chain, block by block."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.operators.ordered import running_max, running_min, running_sum, scan
from verseline.operators.walks import follow
from verseline.session import cut_lineage

STEP = "hit long, line long, start long, end long, best long, pred struct<line:long,start:long,end:long>"


def _prefix_chain(frame):
    """Rows of one block in, their best sums and predecessors out; ``base`` holds the best that earlier blocks offer to each row."""
    return _solved(frame.itertuples(index=False))


def _solved(rows: Iterable) -> list[tuple]:
    import bisect

    rows = sorted(rows, key=lambda r: (r.line, r.start, r.end))
    ends = sorted({r.end for r in rows})
    tree: list = [None] * (len(ends) + 1)  # Fenwick tree of the best (sum, -end, -line, -start) up to each end

    def best_before(limit):
        i, out = bisect.bisect_left(ends, limit), None
        while i:
            if tree[i] is not None and (out is None or tree[i] > out):
                out = tree[i]
            i -= i & -i
        return out

    def put(end, value):
        i = bisect.bisect_left(ends, end) + 1
        while i < len(tree):
            if tree[i] is None or value > tree[i]:
                tree[i] = value
            i += i & -i

    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j].line == rows[i].line:
            j += 1
        new = []
        for r in rows[i:j]:  # rows of one line do not follow each other
            before = best_before(r.start + r.slack)
            if r.base is not None:
                early = tuple(r.base)
                before = early if before is None or early > before else before
            total = r.weight + (before[0] if before else 0)
            out.append((r.hit, r.line, r.start, r.end, total, (-before[2], -before[3], -before[1]) if before else None))
            new.append((r.end, (total, -r.end, -r.line, -r.start)))
        for end, value in new:
            put(end, value)
        i = j
    return out


_Hit = namedtuple("_Hit", "hit line start end weight slack base")


def small_chain(hits: Iterable[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(line, at) of the heaviest chain of one small group of (line, at, weight): ``best_chain`` without slack, in memory."""
    rows = [(h[1:4], h[4], h[5]) for h in _solved(_Hit(i, line, at, at, weight, 0, None) for i, (line, at, weight) in enumerate(hits))]
    before = {spot: pred for spot, _, pred in rows}
    spot, out = max(rows, key=lambda r: (r[1], -r[0][2], -r[0][0], -r[0][1]))[0] if rows else None, []
    while spot is not None:
        out.append(spot[:2])
        spot = before[spot]
    return out


def best_chain(hits: DataFrame, *, by: Sequence[str], slack: int = 0, block: int = 20_000, block_lines: int = 4096) -> DataFrame:
    """The hits (by, line, start, end, weight) of the heaviest chain of every group: at most one hit of a line, and along the lines every
    hit starts after the one before ends (``start > end - slack``). All columns are longs; of equal hits the heaviest counts.

    Ties: the predecessor of the greatest sum, then of the least end, line and start.

    Lines before and after a place that no hit straddles are chained by themselves. Such a component is cut into blocks of lines with about
    ``block`` hits. All first blocks are solved at once, then all second ones, each row with the best sum that earlier blocks offer it (an
    as-of maximum over their ends), so a group of any size is never gathered; the chain is read off the predecessors by pointer doubling.
    """
    by = list(by)
    spot = ["line", "start", "end"]
    rows = cut_lineage(hits.groupBy(*by, *spot).agg(F.max("weight").alias("weight")))
    line = rows.groupBy(*by, "line").agg(F.min("start").alias("__lo"), F.max("end").alias("__hi"), F.count("*").alias("__n"))
    at = F.floor(F.col("line") / block_lines)
    s = scan(line, by=by, order=["line"], block=at, __before=running_max(F.col("__hi"), inclusive=False), __after=running_min(F.col("__lo"), forward=False))
    starts = F.coalesce(F.col("__before") < F.col("__after") + slack, F.lit(True))
    s = scan(s, by=by, order=["line"], block=at, part=running_sum(F.when(starts, 1).otherwise(0).cast("long")))
    own = [*by, "part"]
    s = scan(s, by=own, order=["line"], block=at, __cum=running_sum(F.col("__n"), inclusive=False))
    # a line with more hits than a block is a block of its own, in pieces: its hits do not follow each other
    heavy = F.col("__n") > block
    place = 2 * F.floor(F.coalesce("__cum", F.lit(0)) / block) + F.when(heavy, 1).otherwise(0)
    s = s.select(*own, "line", place.cast("long").alias("block"), F.when(heavy, F.ceil(F.col("__n") / block)).otherwise(1).alias("__pieces"))
    rows = cut_lineage(rows.join(s, [*by, "line"]).withColumn("piece", F.pmod(F.xxhash64("start", "end"), F.col("__pieces"))).drop("__pieces"))
    rounds = [r["block"] for r in rows.select("block").distinct().orderBy("block").collect()]

    kind = ", ".join(f"`{c}` {t}" for c, t in rows.select(*own).dtypes) + ", " + STEP.removeprefix("hit long, ")

    def solve(frame):
        import pandas as pd

        frame = frame.assign(hit=range(len(frame)), base=[None if b is None else (int(b["best"]), int(b["e"]), int(b["l"]), int(b["s"])) for b in frame["base"]])
        out = pd.DataFrame(_prefix_chain(frame), columns=["hit", "line", "start", "end", "best", "pred"])
        for c in own:
            out[c] = frame[c].iloc[0]
        out["pred"] = [None if p is None else {"line": p[0], "start": p[1], "end": p[2]} for p in out["pred"]]
        return out[[*own, "line", "start", "end", "best", "pred"]]

    done = None
    offer = F.struct("best", (-F.col("end")).alias("e"), (-F.col("line")).alias("l"), (-F.col("start")).alias("s"))
    for n in rounds:
        now = rows.where(F.col("block") == n).withColumn("slack", F.lit(slack).cast("long"))
        if done is None:
            now = now.withColumn("base", F.lit(None).cast("struct<best:long,e:long,l:long,s:long>"))
        else:
            # earlier ends and today's starts on one axis; an end must lie before start + slack
            past = done.join(now.select(*own).distinct(), own, "left_semi").select(*own, F.col("end").alias("__t"), F.lit(1).alias("__o"), offer.alias("__offer"), F.lit(None).cast("struct<line:long,start:long,end:long,weight:long,piece:long>").alias("__row"))
            asks = now.select(*own, (F.col("start") + slack).alias("__t"), F.lit(0).alias("__o"), F.lit(None).cast("struct<best:long,e:long,l:long,s:long>").alias("__offer"), F.struct("line", "start", "end", "weight", F.col("piece").cast("long").alias("piece")).alias("__row"))
            both = past.unionByName(asks).withColumn("__id", F.xxhash64("__row", "__offer"))
            seen = scan(both, by=own, order=["__t", "__o", "__id"], block=F.floor(F.col("__t") / block), base=running_max(F.col("__offer"))).where("__row is not null")
            now = seen.select(*own, "__row.*", F.lit(n).alias("block"), "base", F.lit(slack).cast("long").alias("slack"))
        found = cut_lineage(now.groupBy(*own, "block", "piece").applyInPandas(solve, kind))
        done = found if done is None else done.unionByName(found)

    node = F.struct(*spot).alias("node")
    last = done.groupBy(*own).agg(F.max(F.struct("best", (-F.col("end")).alias("e"), (-F.col("line")).alias("l"), (-F.col("start")).alias("s"))).alias("m"))
    ends = last.select(*own, F.struct((-F.col("m.l")).alias("line"), (-F.col("m.s")).alias("start"), (-F.col("m.e")).alias("end")).alias("node"))
    chain = follow(done.select(*own, node, "pred"), ends, by=own, node="node", to="pred")
    return chain.select(*by, "node.*").join(rows.select(*by, *spot, "weight"), [*by, *spot])
