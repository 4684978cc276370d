"""Scalar expressions. All stay in the JVM but for counts of single characters, which are one pass in numpy there."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entropy(codes: np.ndarray) -> float:
    n = np.unique(codes, return_counts=True)[1]
    share = n / max(1, n.sum())
    return float(-(share * np.log2(share)).sum()) if len(n) > 1 else 0.0


@F.pandas_udf(T.DoubleType())
def _char_entropy(text: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _entropy(np.frombuffer(x.encode("utf-32-le"), np.uint32)) for x in text], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _byte_entropy(data: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else _entropy(np.frombuffer(x, np.uint8)) for x in data], dtype="float64")


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters in bits; 0 for the empty string, null for null."""
    return _char_entropy(text)


def byte_entropy(data: Column) -> Column:
    """Shannon entropy of a binary value in bits a byte."""
    return _byte_entropy(data)


def rarest_symbol(text: Column, symbols: list[str]) -> Column:
    """(symbol, n) of the least frequent of symbols; ties go to the first, null text has none."""

    @F.pandas_udf("symbol string, n long")
    def least(texts: pd.Series) -> pd.DataFrame:
        found = [(None, None) if x is None else min((x.count(s), i) for i, s in enumerate(symbols)) for x in texts]
        return pd.DataFrame({"symbol": [None if i is None else symbols[i] for _, i in found], "n": pd.array([n for n, _ in found], "Int64")})

    return least(text)


def rarest_byte(data: Column) -> Column:
    """(byte, n) of the least frequent byte value; ties go to the smallest."""

    @F.pandas_udf("byte int, n long")
    def least(values: pd.Series) -> pd.DataFrame:
        counts = [np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256) for x in values]
        return pd.DataFrame({"byte": [int(n.argmin()) for n in counts], "n": [int(n.min()) for n in counts]})

    return least(data)


def percent(part: Column, whole: Column) -> Column:
    """A share as text with one decimal; of nothing it is 100."""
    return F.format_string("%.1f%%", F.when(whole == 0, 100.0).otherwise(100.0 * part / whole))


def duration(seconds: Column) -> Column:
    """Seconds as text: whole seconds, from 90 on whole minutes, from 5,400 on hours with one decimal."""
    return F.when(seconds < 90, F.format_string("%ds", seconds.cast("long"))).when(seconds < 5400, F.format_string("%dm", (seconds / 60).cast("long"))).otherwise(F.format_string("%.1fh", seconds / 3600.0))


def rate_and_rest(done: Column, total: Column, seconds: Column) -> Column:
    """(rate, rest): work a second so far, and the seconds that what is left will take; 0 where neither is known."""
    rate = F.when(seconds > 0, done / seconds).otherwise(0.0)
    return F.struct(rate.alias("rate"), F.when(rate > 0, (total - done) / rate).otherwise(0.0).alias("rest"))


def version_key(name: Column) -> Column:
    """The numbers in a name, for an order in which 10 comes after 9; a name without any is 0."""
    found = F.transform(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("decimal(38,0)")))


def frame_slot(slot: Column, method: Column, n_params: Column) -> Column:
    """The name of a frame slot: s below zero, then this in methods, then a for parameters, then v."""
    first = method.cast("int")
    named = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    return F.when(slot < 0, named("s", -slot)).when(method & (slot == 0), "this").when((slot >= first) & (slot < first + n_params), named("a", slot - first)).otherwise(named("v", slot))


def opposite(condition: Column) -> Column:
    """The opposite of a condition: a plain comparison turns its sign, a negation goes, all else gets one."""
    parts = lambda i: F.regexp_extract(condition, r"(?U)^(\S+) (==|!=|<=|>=|<|>) (\S+)\z", i)
    turned = F.element_at(F.create_map(*(F.lit(x) for pair in (("==", "!="), ("<", ">="), (">", "<=")) for a, b in (pair, pair[::-1]) for x in (a, b))), parts(2))
    inner = F.substring(condition, F.lit(3), F.length(condition) - 3)
    return (
        F.when(parts(2) != "", F.concat_ws(" ", parts(1), turned, parts(3)))
        .when(F.startswith(condition, F.lit("!(")) & F.endswith(condition, F.lit(")")), inner)
        .when(F.startswith(condition, F.lit("!")), F.substring(condition, F.lit(2), F.length(condition)))
        .otherwise(F.concat(F.lit("!("), condition, F.lit(")")))
    )


def quote_literal(text: Column, limit: int = 60) -> Column:
    """A literal for display: cut at limit, with backslash, quote, NUL and line feed escaped."""
    out = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\0", "\\0"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def cores(text: Column, pad: str) -> Column:
    """What a padded literal may stand for: trimmed, without padding, and its pieces; distinct, none empty."""
    trimmed = F.btrim(text, F.lit(f" {pad}"))
    pieces = F.transform(F.split(text, f"[{pad}]", -1), lambda x: F.trim(x))
    every = F.concat(F.array(trimmed, F.replace(trimmed, F.lit(pad), F.lit(""))), pieces)
    return F.array_distinct(F.filter(every, lambda x: F.length(x) > 0))
