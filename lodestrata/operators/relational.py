"""Shapes of work on ordinal-addressed tables, for any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.sources.scratch import kept, place


def ordinal_lookup(refs: DataFrame, target: DataFrame, ref: str, key: str) -> DataFrame:
    """refs with target's columns; null where the ordinal is out of range."""
    return refs.join(target, refs[ref] == target[key], "left")


def resolved_share(looked_up: DataFrame, by: list[str], key: str) -> DataFrame:
    """References, resolved references and their share in percent."""
    n, found = F.count("*"), F.count(key)
    return looked_up.groupBy(*by).agg(n.alias("n_refs"), found.alias("n_resolved"), F.round(100.0 * found / n, 6).alias("pct_resolved"))


def range_saturation(rows: DataFrame, by: list[str], refs: dict[str, str], tables: dict[str, DataFrame]) -> DataFrame:
    """For each group and reference column the largest ordinal against the size of its table.

    One pass over rows takes all maxima; the sizes are one row a table.
    """
    tops = rows.groupBy(*by).agg(*(F.max(c).alias(f"_{t}") for t, c in refs.items()))
    stacked = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"_{t}").alias("top")) for t in refs)))
    sizes = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("target"), "n") for t, df in tables.items()])
    out = tops.select(*by, stacked.alias("x")).select(*by, "x.target", "x.top").join(F.broadcast(sizes), "target")
    return out.select(*by, "target", F.col("top").alias("max_ordinal"), F.col("n").alias("table_size"), (F.col("top") == F.col("n") - 1).alias("saturates"))


def text_runs(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Every run of a text that matches, with its number."""
    return rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("seq", "run")).select(key, F.col("seq").cast("long").alias("seq"), "run")


def adjacent_runs(rows: DataFrame, by: list[str], order: str, value: str, most: int = 4, glue: str = "\0") -> DataFrame:
    """Runs of 2 to most neighbouring values, joined; one window serves all widths."""
    w = Window.partitionBy(*by).orderBy(order)
    wide = rows.select(*by, order, F.array(*(F.lead(value, i).over(w) for i in range(most))).alias("_v"))
    joins = F.filter(F.array(*(F.struct(F.lit(n).cast("long").alias("width"), F.get("_v", F.lit(n - 1)).alias("last"), F.array_join(F.slice("_v", 1, n), glue).alias("joined")) for n in range(2, most + 1))), lambda x: x["last"].isNotNull())
    return wide.select(*by, order, F.explode(joins).alias("j")).select(*by, order, "j.width", "j.joined")


def first_source_wins(parts: dict[str, DataFrame]) -> DataFrame:
    """value and the first harvester that has it; a minimum, so copies fold before the shuffle."""
    names = list(parts)
    rows = reduce(DataFrame.union, [df.select(F.col(df.columns[0]).alias("value"), F.lit(i).alias("_p")) for i, df in enumerate(parts.values())])
    best = rows.where("value IS NOT NULL").groupBy("value").agg(F.min("_p").alias("_p"))
    return best.select("value", F.get(F.array(*map(F.lit, names)), F.col("_p")).alias("harvester"))


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """id and the number of the first source (from 1) that has it."""
    rows = reduce(DataFrame.union, [df.select(F.col(df.columns[0]).alias("id"), F.lit(i).alias("_p")) for i, df in enumerate(parts, 1)])
    return rows.groupBy("id").agg(F.min("_p").alias("first_source"))


def with_blocks(rows: DataFrame, by: list[str], order: list[str], ends: Column) -> DataFrame:
    """rows with block: how many terminators came before, from 0."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("block", F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0).cast("long")))


def as_of(rows: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last value that is not null at or before each."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def first_reference_labels(rows: DataFrame, by: list[str], order: list[str], target: str) -> DataFrame:
    """Labels numbered from 1 in the order in which targets are first referenced."""
    first = rows.groupBy(*by, target).agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(*by, target, F.dense_rank().over(Window.partitionBy(*by).orderBy("_f")).cast("long").alias("label"))


def islands(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: first place and length."""
    w = Window.partitionBy(*by).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("_c", change.cast("int"))
    numbered = marked.withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_g", value).agg(F.min(order).alias("first"), F.count("*").alias("length")).drop("_g")


def bounded_reach(edges: DataFrame, depth: int) -> DataFrame:
    """(src, node, depth): nodes that a source reaches within depth steps, with the fewest; duplicates fold at each step."""
    found = edges.select("src", F.col("dst").alias("node"), F.lit(1).cast("long").alias("depth")).distinct()
    front = found
    for k in range(2, depth + 1):
        e = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        front = front.join(e, front.node == e._a).select("src", F.col("_b").alias("node"), F.lit(k).cast("long").alias("depth")).distinct()
        found = found.unionByName(front)
    return found.groupBy("src", "node").agg(F.min("depth").alias("depth"))


def closure(edges: DataFrame, depth: int, sources: DataFrame | None = None) -> DataFrame:
    """(src, node, depth): nodes that each source (column src; else every src) reaches within depth steps, with the fewest, for any depth.

    A step joins the nodes that the last one found with the edges and lets go of what is known. What it finds is written as one more part
    of a table, so that the plan of a step is the same at every depth. It ends where a step finds nothing new. Null ends lead nowhere.
    """
    spark = edges.sparkSession
    pairs = kept(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    at, first = place(spark, "reached"), pairs if sources is None else pairs.join(sources.select("src").distinct(), "src", "left_semi")
    front = first.select("src", F.col("dst").alias("node"))
    shape = T.StructType([*front.schema.fields, T.StructField("depth", T.LongType())])
    found = lambda: spark.read.schema(shape).parquet(at)
    for k in range(1, depth + 1):
        front.write.parquet(f"{at}/depth={k}")
        front = found().where(F.col("depth") == k).select("src", "node")
        if front.isEmpty():
            break
        ahead = front.join(pairs.select(F.col("src").alias("node"), "dst"), "node").select("src", F.col("dst").alias("node")).distinct()
        front = ahead.join(found().select("src", "node"), ["src", "node"], "left_anti")
    return found()


def stage_rows(rows: DataFrame, by: list[str], stages: list[str]) -> DataFrame:
    """Long form (.., stage, ok) of boolean columns; null is a stage that was not reached."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("ok")) for s in stages)))
    return rows.select(*by, each.alias("x")).select(*by, "x.stage", "x.ok")


def tri_state(stages: DataFrame, by: list[str]) -> DataFrame:
    """FAIL if any stage failed, PASS if all passed, PARTIAL if some were not reached."""
    fail, passed = F.bool_or(~F.col("ok")), F.count(F.when(F.col("ok"), 1)) == F.count("*")
    return stages.groupBy(*by).agg(F.when(fail, "FAIL").when(passed, "PASS").otherwise("PARTIAL").alias("status"))


def stage_matrix(stages: DataFrame, title: str, names: list[str]) -> DataFrame:
    """One row a title with the number of passes of each stage."""
    return stages.groupBy(title).pivot("stage", names).agg(F.sum(F.coalesce(F.col("ok"), F.lit(False)).cast("long")))


# fixed values: wording of the lines "entries" and "more", which readers of the commands' reports look for
def first_lines(rows: DataFrame, by: list[str], order: str, line: str, limit: int, head: str = "%d entries") -> DataFrame:
    """by, place and line: a head with the number of rows of each group, the first of them in order, and how many more there are."""
    own = Window.partitionBy(*by)
    numbered = rows.select(*by, F.row_number().over(own.orderBy(order)).alias("_i"), F.count("*").over(own).alias("_n"), F.col(line).alias("_line"))
    some = numbered.where(F.col("_i") <= limit + 1)
    text = F.when(F.col("_i") <= limit, F.col("_line")).otherwise(F.format_string("  ... %d more", F.col("_n") - limit))
    lines = F.array(F.struct(F.col("_i").cast("long").alias("place"), text.alias("line")))
    heads = F.when(F.col("_i") == 1, F.array(F.struct(F.lit(0).cast("long").alias("place"), F.format_string(head, "_n").alias("line")))).otherwise(F.array().cast("array<struct<place:bigint,line:string>>"))
    return some.select(*by, F.explode(F.concat(heads, lines)).alias("x")).select(*by, "x.place", "x.line")


#: Sizes of cells are powers of two up to this one.
TOP_CELL = 62


def dyadic_cells(ranges: DataFrame, start: str, size: str) -> DataFrame:
    """ranges with _level and _cell: [start, start + size) cut into aligned cells of 2^level numbers, at most two of a level.

    On each level what is left begins at the first boundary at or after start and ends at the last one at or before the end;
    an odd boundary is where a cell has no sibling in the range, so that it is taken here and not on the next level.
    """
    lo, hi = f"(- shiftright(- {start}, k))", f"shiftright({start} + {size}, k)"
    left = f"IF({lo} < {hi} AND {lo} % 2 <> 0, array(named_struct('_level', k, '_cell', {lo})), array())"
    right = f"IF({lo} < {hi} AND {hi} % 2 <> 0, array(named_struct('_level', k, '_cell', {hi} - 1)), array())"
    top = f"least({TOP_CELL}, cast(log2({size}) AS INT) + 1)"
    wide = ranges.where(F.col(size) > 0).withColumns({start: F.col(start).cast("long"), size: F.col(size).cast("long")})
    return wide.select("*", F.inline(F.expr(f"flatten(transform(sequence(0, {top}), k -> concat({left}, {right})))")))


def in_ranges(points: DataFrame, ranges: DataFrame, point: str, start: str, size: str, by: Sequence[str] = ()) -> DataFrame:
    """points with the columns of each range [start, start + size) of the same `by` that holds them; a point in none is left out.

    Coordinates are whole numbers. A range stands in at most 2 log2(size) dyadic cells, which it fills, and a point looks up one cell
    on each level that ranges use: an equi-join whose matches are the results themselves, however wide any range is.
    Null points and ranges, and ranges of no size, match nothing. A cell that very many points ask for is split by skew handling of the join.
    """
    cells = dyadic_cells(ranges, start, size)
    levels = F.broadcast(cells.select("_level").distinct())  # at most TOP_CELL + 1 rows
    asked = points.select("*", F.explode(F.sequence(F.lit(0), F.lit(TOP_CELL))).alias("_level")).join(levels, "_level")
    asked = asked.withColumn("_cell", F.expr(f"shiftright(cast({point} AS BIGINT), _level)"))
    return asked.join(cells, [*by, "_level", "_cell"]).drop("_level", "_cell")


def globally_ranked(rows: DataFrame, order: dict[str, Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with name: one more than the number of rows before each in order (new columns by name), as rank() has it.

    No task sees all rows: rows are counted by their distinct keys, keys are dealt out in ranges, each range sums its counts, and only the
    sums of the ranges, one a part, are added up outside. Nulls come first. Rows of one key, however many, are never brought together.
    """
    spark = rows.sparkSession
    keyed, keys = rows.withColumns(order), list(order)
    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).repartitionByRange(n, *(F.col(k).asc_nulls_first() for k in keys))
    # written, for its parts must stay as they are while their sums are made
    counts = kept(counts.withColumn("_part", F.spark_partition_id()), "keys")
    sums = sorted(counts.groupBy("_part").agg(F.sum("_n")).collect())  # one number a part
    before = accumulate((n for _, n in sums), initial=0)
    firsts = spark.createDataFrame([(part, b) for (part, _), b in zip(sums, before, strict=False)], "_part int, _before long")
    own = Window.partitionBy("_part").orderBy(*(F.col(k).asc_nulls_first() for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(F.broadcast(firsts), "_part").select(*keys, (F.col("_before") + F.coalesce(F.sum("_n").over(own), F.lit(0)) + 1).alias(name))
    renamed = ranked.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [keyed[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return keyed.join(renamed, same).drop(*(f"_k_{k}" for k in keys))


def ordered_slice(rows: DataFrame, order: dict[str, Column], start: int, stop: int, name: str = "place") -> DataFrame:
    """Rows of the places from start up to stop (exclusive, from 1) in a global order, with their places; all of one key share the first of theirs."""
    return globally_ranked(rows, order, name).where((F.col(name) >= start) & (F.col(name) < stop))
