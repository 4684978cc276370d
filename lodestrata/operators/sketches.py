"""States of distinct counts and quantiles that are kept by fine groups and merged upwards, beside exact counts.

Rows are read once; every coarser group merges the states of finer ones, a few KB each, so that no level goes back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of registers (HyperLogLog), log2 of entries (theta), and the size of quantile sketches: relative errors of about 1, 2 and 1 percent.
HLL_BITS, THETA_BITS, KLL_SIZE = 14, 13, 400


def states(rows: DataFrame, by: list[str], key: Column, value: Column) -> DataFrame:
    """by, n, total, and states of the distinct keys (hll, theta) and of the distribution of value (kll). Null keys and values count in n alone."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(value).alias("total"),
        F.hll_sketch_agg(key, HLL_BITS).alias("hll"),
        F.theta_sketch_agg(key, THETA_BITS).alias("theta"),
        F.kll_sketch_agg_double(value.cast("double"), KLL_SIZE).alias("kll"),
    )


def merged(parts: DataFrame, sets: list[list[str]], names: list[str]) -> DataFrame:
    """States for each of the grouping sets of names, from states of finer groups; level is the number of names that are rolled up."""
    frame = parts.groupingSets([[F.col(c) for c in s] for s in sets], *names)
    level = sum((F.grouping(c).cast("int") for c in names), F.lit(0))
    return frame.agg(
        level.alias("level"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_BITS).alias("theta"),
        F.kll_merge_agg_double("kll", KLL_SIZE).alias("kll"),
    )


def told(rows: DataFrame, at: list[float]) -> DataFrame:
    """rows with estimates in place of states: distinct_hll, distinct_theta, and quantiles (an array, one for each of at)."""
    quantiles = F.array(*(F.kll_sketch_get_quantile_double("kll", F.lit(q)) for q in at))
    return rows.withColumns({"distinct_hll": F.hll_sketch_estimate("hll"), "distinct_theta": F.theta_sketch_estimate("theta"), "quantiles": quantiles}).drop("hll", "theta", "kll")
