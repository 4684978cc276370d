"""Integers as expressions, table functions in SQL, closures, bucketed lookups, sketches and variants against plain definitions."""

import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.functions import tables, variants
from lodestrata.functions.bytes import integer_bytes, integer_of
from lodestrata.functions.codec import decode_int, encode_int
from lodestrata.functions.scalars import frame_slot, opposite
from lodestrata.operators import catalog, lift, sketches
from lodestrata.operators.disasm import decode_span
from lodestrata.operators.relational import closure


def plan(df):
    return df._jdf.queryExecution().toString()


def test_integers_as_expressions(spark):
    rng = random.Random(2)
    edges = [s * ((1 << k) + d) for k in (0, 6, 13, 20, 27, 34, 41, 48, 56, 62) for d in (-1, 0, 1) for s in (1, -1)]
    values = [*edges, (1 << 63) - 1, -(1 << 63), *(rng.randrange(-(1 << 63), 1 << 63) >> rng.randrange(63) for _ in range(200)), None]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", integer_bytes("v").alias("raw"))
    rows = df.select("v", "raw", integer_of("raw").alias("back"), integer_of(F.substring("raw", F.lit(1), F.octet_length("raw") - 1)).alias("cut"), integer_of(F.concat("raw", F.lit(b"xyz"))).alias("more")).collect()
    assert "ArrowEvalPython" not in plan(df)
    for r in rows:
        assert (None if r.raw is None else bytes(r.raw)) == (None if r.v is None else encode_int(r.v))
        assert r.back == r.v and r.cut is None and r.more == r.v
    raws = [bytes(rng.randrange(256) for _ in range(rng.randrange(11))) for _ in range(300)] + [b"\xff" + b"\xff" * 8, b"\x7f" + b"\xff" * 8, b"\xff\x80" + b"\0" * 7]

    def want(raw):
        try:
            v = decode_int(raw, 0)[0]
        except IndexError:
            return None
        return v if -(1 << 63) <= v < 1 << 63 else None

    got = spark.createDataFrame([(x,) for x in raws], "x binary").select("x", integer_of("x").alias("v")).collect()
    assert [r.v for r in got] == [want(bytes(r.x)) for r in got]


def test_slots_and_conditions_as_expressions(spark):
    slots = [(s, m, n) for s in range(-3, 6) for m in (True, False) for n in range(4)]
    got = spark.createDataFrame(slots, "s int, m boolean, n int").select("s", "m", "n", frame_slot(F.col("s"), F.col("m"), F.col("n")).alias("x")).collect()
    assert all(r.x == lift.slot_name(r.s, r.m, r.n) for r in got)
    conditions = ["a == b", "a != 1", "x < y", "x >= y", "a <= b", "b > é", "!(a)", "!x", "!(a) && (b)", "a b", "a == b c", "", "!", "!(", "f(a, b)", "a == b\n"]
    got = spark.createDataFrame([(c,) for c in conditions], "c string").select("c", opposite(F.col("c")).alias("x")).collect()
    assert [r.x for r in got if r.c != "!("] == [lift.negated(r.c) for r in got if r.c != "!("]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_printable_runs_go_on_from_chunk_to_chunk(spark, size):
    tables.register(spark)
    rng = random.Random(size)
    texts = {f"k{i}": bytes(rng.choice([0x41, 0x20, 0x7E, 0x1F, 0x80] if i % 2 else [0x42, 0x43, 0x44, 0]) for _ in range(rng.randrange(150))) for i in range(12)}
    rows = [(k, i, t[lo : lo + size]) for k, t in texts.items() for i, lo in enumerate(range(0, len(t), size))] + [("none", 0, None), ("none", 1, b"abcde"), ("none", 2, b""), ("none", 3, b"fg")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, data binary").repartition(3)
    got = spark.sql("SELECT * FROM printable_runs(rows => TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY i, least => 3)", df=df)
    want = [(k, n, m.start(), m[0].decode()) for k, t in (texts | {"none": b"abcdefg"}).items() for n, m in enumerate(re.finditer(rb"[\x20-\x7E]{3,}", t))]
    assert got.columns == ["k", "seq", "at", "run"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_table_functions_tell_what_they_need(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, 2, 3)], "k int, i int, data int")
    with pytest.raises(PySparkException, match="data is int"):
        spark.sql("SELECT * FROM printable_runs(rows => TABLE(SELECT * FROM {df}) PARTITION BY k ORDER BY i, least => 3)", df=df).collect()
    with pytest.raises(PySparkException, match="positive whole number"):
        spark.sql("SELECT * FROM printable_runs(rows => TABLE(SELECT k, i, 'x' AS data FROM {df}) PARTITION BY k ORDER BY i, least => 0)", df=df).collect()


def test_instructions_of_bodies(spark):
    tables.register(spark)
    ops = {0: {"name": "RET", "operands": 0}, 1: {"name": "ADD", "operands": 2}}
    codes = [(1, b"\1\2\3\0\0"), (2, b"\1\2"), (3, b"\7"), (4, None), (5, b"")]
    got = spark.sql("SELECT * FROM instructions(rows => TABLE(SELECT * FROM {df}), opcodes => {ops})", df=spark.createDataFrame(codes, "k int, code binary"), ops=json.dumps(ops))
    assert sorted(map(tuple, got.collect())) == sorted((k, i, *x) for k, c in codes for i, x in enumerate(decode_span(c or b"", ops)))


def test_closure_of_a_graph_with_cycles(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(0, 0), (None, 3), (3, None)]
    after = defaultdict(set)
    for a, b in edges:
        if None not in (a, b):
            after[a].add(b)

    def reach(src, depth):
        out, front = {}, {src}
        for k in range(1, depth + 1):
            front = {y for x in front for y in after[x]} - set(out)
            out |= {y: k for y in front}
        return {(src, y, k) for y, k in out.items()}

    df = spark.createDataFrame(edges, "src int, dst int").repartition(3)
    for depth in (1, 4, 40):
        got = closure(df, depth)
        assert {tuple(r) for r in got.collect()} == {x for s in list(after) for x in reach(s, depth)} and got.count() == len(got.collect())
        assert plan(got).count("Join") == 0  # the result is a table: depth does not show in the plan
    some = closure(df, 40, spark.createDataFrame([(0,), (5,)], "src int"))
    assert {tuple(r) for r in some.collect()} == {x for s in (0, 5) if after[s] for x in reach(s, 40)}
    assert closure(df.where("false"), 5).count() == 0


def test_bucketed_lookups_need_no_exchange(spark):
    refs = catalog.bucketed(spark.range(500).select((F.col("id") * 7 % 90).alias("ref")), ["ref"], "refs", 4)
    targets = {n: catalog.bucketed(spark.range(k).select(F.col("id").alias("k")), ["k"], n, 4) for n, k in (("a", 30), ("b", 80))}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.lookups(refs, targets, "ref", "k").groupBy("ref", "a", "b").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan(out)
        assert {tuple(r) for r in out.collect()} == {(r, r < 30, r < 80, sum(i * 7 % 90 == r for i in range(500))) for r in range(90)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_sketches_merge_upwards(spark):
    rows = spark.range(60000).select((F.col("id") % 4).alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") * 2654435761 % 20011).alias("key"), (F.col("id") % 1000).cast("double").alias("v"))
    fine = sketches.states(rows, ["a", "b"], F.col("key"), F.col("v"))
    out = sketches.told(sketches.merged(fine, [["a", "b"], ["a"], []], ["a", "b"]), [0.1, 0.5]).collect()
    assert len(out) == 12 + 4 + 1 and {r.level for r in out} == {0, 1, 2}
    for r in out:
        own = rows.where(F.lit(True) if r.a is None else F.col("a") == r.a).where(F.lit(True) if r.b is None else F.col("b") == r.b)
        n, keys, total = own.agg(F.count("*"), F.count_distinct("key"), F.sum("v")).head()
        assert (r.n, r.total) == (n, total)
        assert abs(r.distinct_hll - keys) <= 0.04 * keys and abs(r.distinct_theta - keys) <= 0.05 * keys
        assert abs(r.quantiles[0] - 100) <= 30 and abs(r.quantiles[1] - 500) <= 30


def test_variants_are_read_by_paths(spark):
    texts = ['{"k": 1, "a": [1, {"b": 2.5}]}', '{"k": "x"}', "[1]", "null", "{broken", None, '{"k": null, "z": true}', '{"k": 12345678901234567890}']
    rows = variants.shredded(variants.with_variant(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "v"), "texts")
    got = rows.select("i", variants.at(F.col("v"), "$.k", "bigint").alias("k"), variants.at(F.col("v"), "$.a[1].b", "double").alias("b"), "v_error").orderBy("i").collect()
    assert [(r.k, r.b, r.v_error) for r in got] == [(1, 2.5, False), (None, None, False), (None, None, False), (None, None, False), (None, None, True), (None, None, False), (None, None, False), (None, None, False)]
    shapes = variants.fields(rows.where("i IN (0, 1, 6)"), "v", [])
    assert {tuple(r) for r in shapes.collect()} == {("k", "BIGINT", 1), ("a", "ARRAY<VARIANT>", 1), ("k", "STRING", 1), ("k", "VOID", 1), ("z", "BOOLEAN", 1)}
