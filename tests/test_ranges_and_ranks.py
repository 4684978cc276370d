import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators.relational import dyadic_cells, globally_ranked, in_ranges, ordered_slice


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_hold_what_comparisons_tell(spark, seed):
    rng = random.Random(seed)
    points = [(i, rng.choice("ab"), rng.choice([rng.randrange(-60, 60), rng.randrange(-(10**12), 10**12), None])) for i in range(300)]
    ranges = [(i, rng.choice("ab"), rng.randrange(-70, 60), rng.choice([0, 1, 2, 7, 64, rng.randrange(100), -3, None])) for i in range(120)]
    ranges += [(900, "a", -(10**12), 2 * 10**12), (901, "b", -(2**61), 2**62), (902, "a", None, 5), (903, "a", 10**12, 1)]
    p = spark.createDataFrame(points, "p int, k string, at long")
    r = spark.createDataFrame(ranges, "r int, k string, lo long, n long")
    inside = lambda x, lo, n: None not in (x, lo, n) and lo <= x < lo + n
    want = sorted((i, j) for i, k, x in points for j, b, lo, n in ranges if k == b and inside(x, lo, n))
    assert sorted(map(tuple, in_ranges(p, r, "at", "lo", "n", ["k"]).select("p", "r").collect())) == want
    apart = in_ranges(p, r.drop("k"), "at", "lo", "n").select("p", "r").collect()
    assert sorted(map(tuple, apart)) == sorted((i, j) for i, _, x in points for j, _, lo, n in ranges if inside(x, lo, n))


def test_cells_fill_their_range_and_are_few(spark):
    ranges = [(lo, n) for lo in range(-9, 9) for n in range(1, 20)] + [(-(10**9), 3 * 10**9), (5, 2**40 - 1)]
    cells = dyadic_cells(spark.createDataFrame(ranges, "lo long, n long"), "lo", "n").collect()
    for lo, n in ranges:
        own = sorted((c._cell << c._level, (c._cell + 1) << c._level) for c in cells if (c.lo, c.n) == (lo, n))
        assert own[0][0] == lo and own[-1][1] == lo + n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert len(own) <= 2 * n.bit_length()


def test_one_wide_range_costs_no_comparisons(spark):
    """20,000 narrow ranges and one over everything: the join makes as many rows as there are results."""
    points = spark.range(20000).select(F.col("id").alias("at"))
    narrow = spark.range(20000).select(F.col("id").alias("r"), (F.col("id") * 3 % 20000).alias("lo"), F.lit(2).cast("long").alias("n"))
    wide = narrow.union(spark.createDataFrame([(-1, -5, 10**15)], "r long, lo long, n long"))
    out = in_ranges(points, wide, "at", "lo", "n").groupBy().agg(F.count("*").alias("n"), F.count_if(F.col("r") == -1).alias("w"))
    assert "Cartesian" not in plan(out) and "NestedLoop" not in plan(out)
    assert out.head() == (sum(min(2, 20000 - (i * 3 % 20000)) for i in range(20000)) + 20000, 20000)


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_are_those_of_a_window(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1.5, 2.5, 2.5, 2.5, rng.random()]), rng.choice(["x", "y", None])) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, a double, b string").repartition(5)
    order = {"p": -F.col("a"), "q": F.col("b")}
    got = globally_ranked(df, order, "place", parts)
    want = df.select("*", F.rank().over(Window.orderBy(F.expr("-a").asc_nulls_first(), F.col("b").asc_nulls_first())).cast("long").alias("place"))
    assert "SinglePartition" not in plan(got) and sorted(got.columns) == sorted(["i", "a", "b", "p", "q", "place"])
    assert sorted(map(tuple, got.select("i", "place").collect())) == sorted(map(tuple, want.select("i", "place").collect()))
    some = ordered_slice(df, {"a": F.col("a"), "i": F.col("i")}, 5, 9).select("place")
    assert sorted(r.place for r in some.collect()) == [5, 6, 7, 8]
    assert globally_ranked(df.where("false"), order).count() == 0
