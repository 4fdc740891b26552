"""Written time <-> milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stamp shapes of the text formats.
LRC_STAMP = r"\[(\d{1,3}):(\d{2})(?:[.:](\d{2,3}))?\]"
LRC_STAMP_BARE = r"\[\d{1,3}:\d{2}(?:[.:]\d{2,3})?\]"
ANY_STAMP = r"[\[<]\d{1,3}:\d{2}(?:[.:]\d{2,3})?[\]>]"
WORD_STAMP = r"\[(\d{1,2}):(\d{2})[:.](\d{2,3})\]"
ENHANCED_STAMP = r"<(\d{1,2}):(\d{2})[:.](\d{2,3})>"
SRT_RANGE = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{3})"


def _num(c: Column) -> Column:
    return c.cast("bigint")


def clock_ms(minutes: Column, seconds: Column, fraction: Column) -> Column:
    """Minutes, seconds and a 0-3 digit fraction (right padded) as milliseconds."""
    return _num(minutes) * 60000 + _num(seconds) * 1000 + _num(F.rpad(F.coalesce(fraction, F.lit("")), 3, "0"))


def stamp_ms(stamp: Column) -> Column:
    """``[mm:ss.xx]`` or ``<mm:ss.xxx>`` as milliseconds; null when it is not a stamp."""
    shape = r"^[\[<](\d{1,9}):(\d{2})(?:[.:](\d{2,3}))?[\]>]$"
    return F.when(
        stamp.rlike(shape),
        clock_ms(
            F.regexp_extract(stamp, shape, 1), F.regexp_extract(stamp, shape, 2), F.regexp_extract(stamp, shape, 3)
        ),
    )


def _parts(total: Column, per_second: int) -> tuple[Column, Column, Column]:
    minute = 60 * per_second
    return (
        F.floor(total / minute),
        F.floor(F.pmod(total, F.lit(minute)) / per_second),
        F.pmod(total, F.lit(per_second)),
    )


def _digits(n: Column, width: int) -> Column:
    """A whole number with leading zeros up to ``width``; plain string functions, as a formatter call costs more than the rest of a stamp."""
    text = n.cast("string")
    return F.when((n >= 0) & (n < 10 ** (width - 1)), F.lpad(text, width, "0")).otherwise(text)


def _clock(parts: tuple[Column, Column, Column], point: str, width: int) -> Column:
    m, s, f = parts
    fixed = lambda n, w: F.substring(F.concat(F.lit("0" * (w - 1)), n.cast("string")), -w, w)  # noqa: E731  (below 10 ** w)
    return F.concat(_digits(m, 2), F.lit(":"), fixed(s, 2), F.lit(point), fixed(f, width))


def lrc_clock(ms: Column, precision: str = "cs") -> Column:
    """``mm:ss.xx`` (rounded half up to centiseconds) or ``mm:ss.xxx``."""
    ms = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    if precision == "cs":
        return _clock(_parts(F.floor((ms + 5) / 10), 100), ".", 2)
    return _clock(_parts(ms, 1000), ".", 3)


def lrc_stamp(ms: Column, precision: str = "cs") -> Column:
    return F.concat(F.lit("["), lrc_clock(ms, precision), F.lit("]"))


def inline_clock(ms: Column) -> Column:
    """``mm:ss:cc`` with the fraction cut to centiseconds."""
    return _clock(_parts(F.floor(ms.cast("bigint") / 10), 100), ":", 2)


def srt_clock(ms: Column) -> Column:
    m, s, f = _parts(F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint")), 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(m / 60), F.pmod(m, F.lit(60)), s, f)


def ass_clock(ms: Column) -> Column:
    m, s, f = _parts(F.floor((F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint")) + 5) / 10), 100)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(m / 60), F.pmod(m, F.lit(60)), s, f)


def ass_clock_ms(text: Column) -> Column:
    shape = r"^\s*(\d+):(\d{1,2}):(\d{1,2})[.](\d{2,3})\s*$"
    g = lambda i: F.regexp_extract(text, shape, i)
    return F.when(text.rlike(shape), _num(g(1)) * 3600000 + clock_ms(g(2), g(3), g(4)))


def srt_clock_ms(block: Column, start: bool) -> Column:
    o = 0 if start else 4
    g = lambda i: F.regexp_extract(block, SRT_RANGE, o + i)
    return F.when(block.rlike(SRT_RANGE), _num(g(1)) * 3600000 + clock_ms(g(2), g(3), g(4)))


def timecode_ms(text: Column) -> Column:
    """Seconds, ``m:ss.mmm`` or ``h:mm:ss`` as milliseconds; empty is 0, anything else null."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    shape = r"^(?:(?:(\d+):)?(\d+):)?(\d+)(?:\.(\d*))?$"
    g = lambda i: F.regexp_extract(t, shape, i)
    part = lambda i: F.coalesce(F.nullif(g(i), F.lit("")), F.lit("0")).cast("bigint")
    ms = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + F.rpad(F.substring(g(4), 1, 3), 3, "0").cast("bigint")
    return F.when(t == "", F.lit(0).cast("bigint")).when(t.rlike(shape), ms)


def timecode(ms: Column) -> Column:
    """``m:ss.mmm``."""
    m, s, f = _parts(ms.cast("bigint"), 1000)
    return F.format_string("%d:%02d.%03d", m, s, f)
