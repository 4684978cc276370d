"""The byte codecs as expressions over columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.codec import LEAD_BITS, FormatError, deflate, inflate


def _by_extra(of) -> Column:
    """A map from the number of extra bytes to of(it)."""
    return F.create_map(*(F.lit(x) for extra in LEAD_BITS for x in (extra, of(extra))))


def _prefix(extra: int) -> int:
    return 0x7F if extra == 8 else (0x7F << (7 - extra)) & 0x7F


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def integer_bytes(value: Column | str) -> Column:
    """The narrowest encoding of each integer, without leaving the JVM."""
    v = _column(value).cast("long")
    least = F.lit(-(1 << 63))
    size = F.when(v == least, v).otherwise(F.abs(v))  # the least one's bits are those of its size
    extra = reduce(lambda rest, x: F.when((size >= 0) & (size < F.lit(1 << (x[1] + 8 * x[0]))), x[0]).otherwise(rest), reversed([x for x in LEAD_BITS.items() if x[0] < 8]), F.lit(8))
    digits = F.lpad(F.hex(size), 16, "0")
    lead = F.when(v < 0, 0x80).otherwise(0).bitwiseOR(F.element_at(_by_extra(_prefix), extra)).cast("long")
    top = F.when(extra == 8, F.lit("0")).otherwise(F.substring(digits, F.lit(1), 16 - 2 * extra))
    lead = lead.bitwiseOR(F.conv(top, 16, 10).cast("long"))
    return F.unhex(F.concat(F.lpad(F.hex(lead), 2, "0"), F.substring(digits, 17 - 2 * extra, 2 * extra)))


def integer_of(data: Column | str) -> Column:
    """The integer at the beginning of each value; null where it is cut off, or where it does not fit into 64 bits with a sign."""
    raw = _column(data)
    lead = F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")
    body = lead.bitwiseAND(0x7F)
    extra = reduce(lambda rest, x: F.when(body < x[1], x[0]).otherwise(rest), reversed([(n, 0x80 - (0x40 >> n)) for n in range(7)]), F.lit(8))
    held = body.bitwiseAND(F.element_at(_by_extra(lambda n: (1 << LEAD_BITS[n]) - 1), extra))
    digits = F.concat(F.lpad(F.hex(held), 2, "0"), F.hex(F.substring(raw, F.lit(2), extra)))
    size = F.conv(digits, 16, 10).cast("decimal(20,0)")
    value = F.when(lead >= 0x80, -size).otherwise(size).cast("decimal(20,0)")
    return F.when(F.octet_length(raw) > extra, value.try_cast("long"))


@F.pandas_udf(T.BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else deflate(x) for x in data])


def _inflated(data: bytes | None) -> bytes | None:
    try:
        return None if data is None else inflate(data)
    except (FormatError, IndexError):
        return None


@F.pandas_udf(T.BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    """What each blob expands to; null for a damaged one."""
    return pd.Series([_inflated(x) for x in data])
