"""Picture hashes and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bits(values: Column, bits: int = 64) -> Column:
    """Bit i is 1 where element i is at least the mean of the whole vector; bit 63 is the sign of the long."""
    doubles = F.transform(values, lambda v: v.cast("double"))
    mean = F.aggregate(doubles, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    flagged = F.transform(F.slice(doubles, 1, bits), lambda v: F.when(v >= mean, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(flagged), F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def clip_id(key: Column, t_in: Column) -> Column:
    """``c`` + ten hex digits of the SHA-1 of ``key|t`` with the time at two decimals."""
    return F.concat(F.lit("c"), F.substring(F.sha1(F.concat(key, F.lit("|"), F.format_string("%.2f", t_in))), 1, 10))


def person_id(name: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.md5(name), 1, 6))
