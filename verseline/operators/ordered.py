"""Ordered scans that split one group over many tasks.

A plain ``Window.partitionBy(track)`` puts a whole track in one task. Here every group is cut into *blocks* along its
order (for example one minute of song time). Each block is summarised with a map-side combined aggregate, the
summaries -- one row per block -- are scanned in order to give every block its carry-in, and the rows are then
windowed inside their own block only. Rows are shuffled once, on (group, block), however large one group is.

``block`` must be monotone in ``order``: rows of a lower block all come before rows of a higher one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running value. ``forward`` looks back (prefix); otherwise it looks ahead (suffix)."""

    kind: str
    value: Column
    forward: bool = True
    inclusive: bool = True


def running_sum(value: Column, *, inclusive: bool = True, forward: bool = True) -> Running:
    return Running("sum", value, forward, inclusive)


def running_max(value: Column, *, inclusive: bool = True, forward: bool = True) -> Running:
    return Running("max", value, forward, inclusive)


def running_min(value: Column, *, inclusive: bool = True, forward: bool = True) -> Running:
    return Running("min", value, forward, inclusive)


def last_known(value: Column, *, inclusive: bool = True) -> Running:
    """Nearest non-null value at or before the row."""
    return Running("near", value, True, inclusive)


def next_known(value: Column, *, inclusive: bool = True) -> Running:
    """Nearest non-null value at or after the row."""
    return Running("near", value, False, inclusive)


def previous_row(*cols: Column | str) -> Running:
    """The row before, as a struct of ``cols`` (null on the first row)."""
    return Running("near", F.struct(*cols), True, False)


def following_row(*cols: Column | str) -> Running:
    """The row after, as a struct of ``cols`` (null on the last row)."""
    return Running("near", F.struct(*cols), False, False)


def row_index(*, forward: bool = True) -> Running:
    """1-based position in the group (from the end when not ``forward``)."""
    return Running("sum", F.lit(1).cast("long"), forward, True)


def group_total(value: Column) -> Running:
    return Running("total", value)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled on ``keys`` into as many partitions as the session allows.

    Spark would join small partitions to one for every core, and what a task sorts would grow with the input divided by the cores.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scan(
    df: DataFrame,
    *,
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    wide: bool = False,
    **values: Running,
) -> DataFrame:
    """Add one column per running value. ``order`` must be a total order inside a group.

    ``wide``: rows are many or long for their input (letters and words of files), so they are dealt to all partitions of the session.
    """
    by, order = list(by), list(order)
    inputs = {name: f"__in_{name}" for name in values}
    base = df.withColumn(BLOCK, block).withColumns({inputs[n]: v.value for n, v in values.items()})
    base = dealt(base, *by, BLOCK) if wide else base  # before the summary too, whose aggregate of structs sorts what a task reads

    key = F.struct(*[F.col(c) for c in order])
    summary_cols = []
    for name, v in values.items():
        c = F.col(inputs[name])
        if v.kind in ("sum", "total"):
            agg = F.sum(c)
        elif v.kind == "max":
            agg = F.max(c)
        elif v.kind == "min":
            agg = F.min(c)
        elif v.forward:
            agg = F.max_by(c, F.when(c.isNotNull(), key))
        else:
            agg = F.min_by(c, F.when(c.isNotNull(), key))
        summary_cols.append(agg.alias(name))
    summary = base.groupBy(*by, BLOCK).agg(*summary_cols)

    ahead = Window.partitionBy(*by).orderBy(F.col(BLOCK).asc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*by).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carry = summary.select(
        *by,
        BLOCK,
        *[
            _combine(v.kind, F.col(n), whole if v.kind == "total" else ahead if v.forward else behind).alias(f"__carry_{n}")
            for n, v in values.items()
        ],
    )

    inner_fwd = Window.partitionBy(*by, BLOCK).orderBy(*[F.col(c).asc() for c in order])
    inner_bwd = Window.partitionBy(*by, BLOCK).orderBy(*[F.col(c).desc() for c in order])
    local = {}
    for name, v in values.items():
        if v.kind != "total":
            w = (inner_fwd if v.forward else inner_bwd).rowsBetween(Window.unboundedPreceding, Window.currentRow if v.inclusive else -1)
            local[f"__local_{name}"] = _combine(v.kind, F.col(inputs[name]), w)
    # windows before the join, which then needs no sort of its own; merged, as Spark's guess of a side that comes from exploded or packed rows may be far too small
    joined = base.withColumns(local).join(carry.hint("merge"), [*by, BLOCK])
    out = [F.col(c) for c in df.columns if c not in values]
    for name, v in values.items():
        carried, here = F.col(f"__carry_{name}"), F.col(f"__local_{name}")
        if v.kind == "total":
            out.append(carried.alias(name))
            continue
        if v.kind == "sum":
            both = F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif v.kind == "max":
            both = F.greatest(carried, here)
        elif v.kind == "min":
            both = F.least(carried, here)
        else:
            both = F.coalesce(here, carried)
        out.append(both.alias(name))
    return joined.select(*out)


def _combine(kind: str, col: Column, w) -> Column:
    if kind in ("sum", "total"):
        return F.sum(col).over(w)
    if kind == "max":
        return F.max(col).over(w)
    if kind == "min":
        return F.min(col).over(w)
    return F.last(col, ignorenulls=True).over(w)


def islands(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], block: Column, starts: Column, name: str = "island"
) -> DataFrame:
    """Number runs of rows: a new run begins on every row where ``starts`` is true (first run = 1 when it is true there)."""
    return scan(
        df,
        by=by,
        order=order,
        block=block,
        **{name: running_sum(F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0).cast("long"))},
    )


def islands_after(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], block: Column, cols: Sequence[str], starts, name: str = "island"
) -> DataFrame:
    """Like ``islands`` when a run start depends on the row before only, in one pass instead of two.

    ``starts(prev, cur)`` gets structs of ``cols``. Inside a block the rows are compared directly; across blocks the last
    row of one summary is compared with the first row of the next. The first row of a group always starts a run.
    """
    by = list(by)
    cur = F.struct(*cols)
    one = lambda flag: F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0).cast("long")
    w = Window.partitionBy(*by, BLOCK).orderBy(*order)
    prev = F.lag(F.struct(*cols)).over(w)
    rows = df.withColumn(BLOCK, block).withColumn("__prev", prev)
    rows = rows.withColumn("__f", F.when(F.col("__prev").isNull(), F.lit(0).cast("long")).otherwise(one(starts(F.col("__prev"), cur))))
    key = F.struct(*order)
    summary = rows.groupBy(*by, BLOCK).agg(F.sum("__f").alias("f"), F.min_by(cur, key).alias("first"), F.max_by(cur, key).alias("last"))
    wb = Window.partitionBy(*by).orderBy(BLOCK)
    edges = summary.withColumn("__before", F.lag("last").over(wb))
    edges = edges.withColumn("e", F.when(F.col("__before").isNull(), F.lit(1).cast("long")).otherwise(one(starts(F.col("__before"), F.col("first")))))
    carry = edges.select(*by, BLOCK, (F.sum(F.col("f") + F.col("e")).over(wb) - F.col("f")).alias("__carry"))
    out = rows.withColumn("__local", F.sum("__f").over(w)).join(carry.hint("merge"), [*by, BLOCK])
    return out.select(*df.columns, (F.col("__carry") + F.col("__local")).alias(name))


def framed(
    df: DataFrame, *, by: Sequence[str], position: str, width: int, before: int, after: int, **values
) -> DataFrame:
    """Row frames over a dense integer ``position`` without a whole-group window.

    Every row goes to block ``position div width`` and, when near an edge, also to the neighbour as a helper row.
    ``values`` are callables ``window -> Column``; the window spans ``before`` rows back to ``after`` rows ahead.
    """
    if max(before, after) > width:
        raise ValueError("block width must be at least the frame reach")
    pos = F.col(position)
    home = F.floor(pos / width)
    offsets = F.array_compact(
        F.array(
            F.lit(0).cast("long"),
            F.when(F.pmod(pos, F.lit(width)) >= width - before, F.lit(1).cast("long")) if before else F.lit(None).cast("long"),
            F.when(F.pmod(pos, F.lit(width)) < after, F.lit(-1).cast("long")) if after else F.lit(None).cast("long"),
        )
    )
    spread = df.withColumn("__shift", F.explode(offsets)).withColumn(BLOCK, home + F.col("__shift"))
    w = Window.partitionBy(*by, BLOCK).orderBy(pos).rowsBetween(-before, after)
    return (
        spread.withColumns({n: fn(w) for n, fn in values.items()}).where(F.col("__shift") == 0).drop("__shift", BLOCK)
    )


def multiplied(df: DataFrame) -> DataFrame:
    """A side of an equi-join whose rows an ``explode`` has multiplied, for the join to shuffle both sides.

    Spark takes the size from before the explode, so a side of many times its broadcast threshold could pass whole through the driver.
    """
    return df.hint("merge")


def salted_lookup(
    df: DataFrame, per_key: DataFrame, on: Sequence[str], *, salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Join a one-row-per-key table onto rows whose keys may be very skewed.

    The key table is repeated once per salt and the rows are spread over the salts, so a hot key is served by many tasks.
    """
    row_salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
    many = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", row_salt).join(multiplied(many), [*on, "__salt"], how).drop("__salt")
