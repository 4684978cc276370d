import struct

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.codec import FormatError, encode_int
from lodestrata.operators import disasm, rewrite
from lodestrata.sources import module, opcodes

OPS = {
    0: {"name": "CALLSYS", "operands": 1}, 1: {"name": "RET", "operands": 1}, 2: {"name": "STR", "operands": 1}, 3: {"name": "JMP", "operands": 1}, 4: {"name": "JZ", "operands": 1},
    5: {"name": "CMPIi", "operands": 2}, 6: {"name": "SetV4", "operands": 2}, 7: {"name": "ALLOC", "operands": 2}, 8: {"name": "PGA", "operands": 1}, 9: {"name": "ADDSi", "operands": 2},
    10: {"name": "ADDi", "operands": 3}, 11: {"name": "JMPP", "operands": 1}, 12: {"name": "PSF", "operands": 1}, 13: {"name": "LoadThisR", "operands": 2}, 14: {"name": "RDR4", "operands": 1}, 15: {"name": "Strange", "operands": 0},
}
OP = {v["name"]: k for k, v in OPS.items()}
e = encode_int


class Builder:
    """Bytes of a module in either dialect."""

    def __init__(self, dialect):
        self.new = dialect == module.NEW

    def s(self, text):
        raw = text.encode("latin-1")
        if self.new:
            return e(2 * len(raw)) + raw
        return b"n" + e(len(raw)) + raw if raw else b"\0"

    def ref(self, i):
        return e(2 * i + 1) if self.new else b"r" + e(i)

    def decl(self, name, flags=0, size=8):
        return self.s(name) + struct.pack(">I", flags) + e(size) + self.s("")

    def prim(self, token):
        return e(0) + e(token) + b"\0"

    def code(self, *instructions):
        return e(len(instructions)) + b"".join(bytes([OP[n]]) + b"".join(map(e, a)) for n, *a in instructions)

    def fn(self, name, code, owner=b"\0", params=()):
        lists = e(0) if params or not self.new else b""
        sig = self.s(name) + self.prim(80) + e(len(params)) + b"".join(map(self.prim, params)) + lists + e(1) + lists + owner
        sig += b"\0" if owner != b"\0" else self.s("")
        if self.new:
            return b"f" + sig + b"\0" + code + e(4)
        return b"f" + sig + code + e(4) + e(0) + e(0) + b"\0"

    def used(self, name, owner=b"\0", params=()):
        lists = e(0) if params or not self.new else b""
        return b"a" + self.s(name) + self.prim(68) + e(len(params)) + b"".join(map(self.prim, params)) + lists + e(0) + lists + owner + (b"\0" if owner != b"\0" else self.s(""))

    def named(self, name):
        return b"o" + self.s(name) + self.s("")

    def whole(self, methods):
        flag = module.SCRIPT_OBJECT[module.NEW if self.new else module.OLD]
        out = b"\0" + e(1) + self.decl("Color", module.ENUM, 4) + e(2) + self.s("red") + struct.pack(">i", -1) + self.s("blue") + struct.pack(">i", 300)
        out += e(2) + self.decl("Ship", flag, 16) + self.decl("IShape", flag, 0) + e(0)
        # interfaces first
        out += b"\0" + e(0) + e(0) + e(0)
        out += b"\0" + e(0) + b"\0" + e(0) + e(len(methods)) + b"".join(methods) + e(0)
        out += e(2) + self.s("x") + self.prim(68) + e(0) + self.s("y") + self.prim(79) + e(2)
        main = [("STR", 0), ("CALLSYS", 0), ("CMPIi", 1, 5), ("JZ", 2), ("SetV4", 1, 7), ("JMP", -6 if False else 1), ("ALLOC", 0, 2), ("RET", 0)]
        tail = e(0) + e(0) + e(1) + self.fn("main", self.code(*main)) + e(0) + e(0)
        tail += e(1) + self.named("Ship") + e(1) + self.prim(75)
        tail += e(3) + self.used("print", params=(68,)) + self.used("$beh0", owner=self.named("Ship")) + b"\0"
        tail += e(1) + self.s("score") + self.s("") + self.prim(68) + b"\1"
        tail += e(1) + self.s('say "hi"\0' + "z" * 70)
        tail += e(1) + self.named("Ship") + (e(1) if self.new else self.s("y"))
        return out + tail


def sample(dialect):
    b = Builder(dialect)
    pointer = 1 if b.new else 0
    step = [("PGA", pointer), ("ADDSi", 0, 0), ("LoadThisR", 0, 0), ("RDR4", 2), ("CALLSYS", 99), ("RET", 0)]
    return b.whole([b.fn("step", b.code(*step), b.named("Ship"), (68, 79)), b.fn("idle", b.code(("RET", 0)), b.named("Ship"))])


@pytest.fixture(scope="module")
def modules(spark):
    return spark.createDataFrame([(d, bytearray(sample(d))) for d in (module.OLD, module.NEW)] + [("junk", bytearray(b"\0\1\2"))], "module_id string, content binary")


@pytest.fixture(scope="module")
def tables(spark, modules, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("decoded"))
    module.decoded(modules, OPS).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


@pytest.mark.parametrize("dialect", [module.OLD, module.NEW])
def test_a_module_is_read_to_its_end(dialect):
    walk, facts = module.decode(sample(dialect), {k: v["operands"] for k, v in OPS.items()})
    assert (facts["dialect"], facts["reached"], facts["error"], facts["end"]) == (dialect, "tail", None, facts["size"])
    r = walk.rows
    assert [(x["name"], x["value"]) for x in r["enum_members"]] == [("red", -1), ("blue", 300)]
    assert [(x["name"], x["is_interface"]) for x in r["classes"]] == [("Ship", False), ("IShape", True)]
    assert [f["signature"] for f in r["functions"] if f.get("body_start")] == ["void Ship::step(int, float)", "void Ship::idle()", "void <global>::main()"]
    assert not r["parse_errors"] and [x["name"] for x in r["sections"]][-1] == "used object properties"


@pytest.mark.parametrize("dialect", [module.OLD, module.NEW])
def test_a_bad_body_costs_one_function(dialect):
    b = Builder(dialect)
    good = [b.fn(n, b.code(("RET", 0)), b.named("Ship")) for n in ("one", "two", "three")]
    broken = good[1].replace(b.code(("RET", 0)), e(1) + b"\xee\0")
    walk, facts = module.decode(b.whole([good[0], broken, good[2]]), {k: v["operands"] for k, v in OPS.items()})
    assert facts["reached"] == "tail" and len(walk.rows["parse_errors"]) == 1
    assert "unknown opcode" in walk.rows["parse_errors"][0]["error"]
    assert {"one", "three", "main"} <= {f["name"] for f in walk.rows["functions"] if f.get("body_start") and f.get("body_end")}


def test_a_trailing_byte_is_an_error():
    _, facts = module.decode(sample(module.NEW) + b"\0", {k: v["operands"] for k, v in OPS.items()})
    assert facts["reached"] == "blocks" and "tail ended" in facts["error"]


def test_literals_at_any_offset():
    found = module.literals(sample(module.NEW))
    assert b"score" in found and len(found) == len(set(found))


def test_operands_are_named(tables):
    rows = {(r.module_id, r.name, r.place): r.text for r in disasm.resolved(tables, OPS).where("role IS NOT NULL").collect()}
    for m in (module.OLD, module.NEW):
        assert rows[m, "STR", 0].startswith('"say \\"hi\\"\\0zzz') and rows[m, "STR", 0].endswith('..."')
        assert rows[m, "PGA", 0] == "score" and rows[m, "ADDSi", 0] == "Ship::y" and rows[m, "ADDSi", 1] == "uint"
        assert rows[m, "ALLOC", 0] == "Ship" and rows[m, "ALLOC", 1] == "Ship::$beh0"
        assert rows[m, "JZ", 0] == "L0" and rows[m, "JMP", 0] == "L1"
    share = {r.module_id: (r.n, r.n_resolved) for r in disasm.resolution(disasm.resolved(tables, OPS), ["module_id"]).collect()}
    assert share[module.NEW][0] - share[module.NEW][1] == 1  # the call out of range is null, not a placeholder


def test_callers_and_listing(tables):
    assert sorted((r.module_id, r.name) for r in disasm.callers_of(tables, OPS, "PRINT").collect()) == [("len2", "main"), ("tagged", "main")]
    assert {r.name for r in disasm.callers_of(tables, OPS, "ship::$beh0").collect()} == {"main"}
    assert disasm.callers_of(tables, OPS, "nothing").count() == 0
    text = {(r.module_id, r.label): r.text for r in disasm.listing(tables, OPS).collect()}
    assert "L0:\n    JMP" in text["len2", "<global>::main"] or "L0:" in text["len2", "<global>::main"]
    assert "MISMATCH" not in "".join(text.values())
    assert disasm.collected(tables).count() == 6 and disasm.find(tables, "SHIP::st").count() == 2


def test_rewriting_is_exact(tables, modules):
    trace = module.table_of(tables, "trace")
    facts = module.module_facts(tables)
    assert {r.module_id: r.identical for r in rewrite.round_trip(rewrite.written(trace, facts), modules.where("module_id <> 'junk'")).collect()} == {"tagged": True, "len2": True}
    changed = rewrite.replace_literal(trace, F.lit(bytearray(b"score")), F.lit(bytearray(b"a much longer name")))
    out = {r.module_id: bytes(r.content) for r in rewrite.written(changed, facts).collect()}
    for raw in out.values():
        walk, f = module.decode(raw, {k: v["operands"] for k, v in OPS.items()})
        assert f["reached"] == "tail" and walk.rows["used_global_props"][0]["name"] == "a much longer name"
    assert rewrite.literals(trace).where("literal = X'73636f7265'").count() == 2
    with pytest.raises(Exception, match="no such literal"):
        rewrite.replace_literal(trace, F.lit(bytearray(b"absent")), F.lit(bytearray(b"x"))).collect()


def test_edits_reach_one_module(tables):
    trace = module.table_of(tables, "trace")
    seq = trace.where("module_id = 'len2' AND kind = 'op'").agg(F.min("seq")).head()[0]
    after = rewrite.replace_instruction(trace, "len2", seq, 12, [5]).where(F.col("seq") == seq)
    assert {r.module_id: (r.op, r.operands) for r in after.collect()}["len2"] == (12, [5])
    changed = rewrite.replace_instruction(trace, "len2", seq, 12, [5]).exceptAll(trace).count()
    assert changed == 1
    for module_id, at in (("len2", 0), ("len2", 10**6), ("absent", seq)):
        with pytest.raises(Exception, match=f"no entry at {at} of absent|no entry at 1000000|, not an instruction, at 0 of len2"):
            rewrite.replace_instruction(trace, module_id, at, 1, [0]).collect()


def test_edits_are_a_table(spark, tables):
    trace = module.table_of(tables, "trace")
    firsts = trace.where("kind = 'op'").groupBy("module_id").agg(F.min("seq").alias("seq"))
    edits = firsts.select("module_id", "seq", F.lit(12).alias("op"), F.array(F.lit(5)).alias("operands"))
    after = rewrite.replace_instructions(trace, edits)
    assert after.columns == trace.columns and after.count() == trace.count()
    assert {(r.op, tuple(r.operands)) for r in after.join(firsts, ["module_id", "seq"]).collect()} == {(12, (5,))}
    nowhere = edits.withColumn("seq", F.lit(None).cast("long"))
    assert after.exceptAll(trace).count() == firsts.count() and rewrite.replace_instructions(trace, nowhere).exceptAll(trace).count() == 0
    with pytest.raises(Exception, match="two edits at"):
        rewrite.replace_instructions(trace, edits.union(edits)).collect()


def test_first_differences_of_long_modules(spark):
    data = bytes(range(256)) * 2000
    at = [0, 1, 4095, 4096, 300_000, len(data) - 1]
    rows = [(str(i), bytearray(data), bytearray(data[:i] + b"\xaa\xbb"[data[i] == 0xAA :][:1] + data[i + 1 :])) for i in at]
    rows += [("same", bytearray(data), bytearray(data)), ("short", bytearray(data), bytearray(data[:9])), ("long", bytearray(data[:4096]), bytearray(data[:4097])), ("none", bytearray(b"ab"), None), ("empty", bytearray(), bytearray())]
    df = spark.createDataFrame(rows, "module_id string, content binary, b binary")
    got = {r.module_id: (r.identical, r.first_difference) for r in rewrite.round_trip(df.select("module_id", F.col("b").alias("content")), df.select("module_id", "content")).collect()}
    assert got == {str(i): (False, i) for i in at} | {"same": (True, None), "short": (False, 9), "long": (False, 4096), "none": (False, 0), "empty": (True, None)}


def test_spans_stop_where_they_should(spark):
    table = {1: {"name": "RET", "operands": 1}, 2: {"name": "STR", "operands": 1}}
    assert disasm.decode_span(b"\x02\x05\x01\x00\x02\x05", table) == [(0, 2, "STR", [5]), (2, 1, "RET", [0])]
    assert disasm.decode_span(b"\x02\x05\xee\x00", table) == [(0, 2, "STR", [5]), (2, 0xEE, "UNKNOWN_EE", [])]
    assert disasm.decode_span(b"\x02\x05\x02\x40", table) == [(0, 2, "STR", [5])] and disasm.decode_span(b"", table) == []
    assert disasm.decode_span(b"\x02\x05\x02\x06\x01\x00", table, 2, 1) == [(2, 2, "STR", [6])]
    rows = spark.createDataFrame([("m", 0, bytearray(b"\x01\x00")), ("m", 1, None)], "module_id string, function long, code binary")
    assert [tuple(r) for r in disasm.spans(rows, table).collect()] == [("m", 0, 0, 0, 1, "RET", [0])]


def test_traces_are_whole_or_an_error():
    ops = {k: v["operands"] for k, v in OPS.items()}
    assert module.trace_of(sample(module.NEW), ops)[0]["kind"] == "raw"
    for bad in (sample(module.NEW)[:-1], b"\0\1\2", b""):
        with pytest.raises(FormatError):
            module.trace_of(bad, ops)
    assert module.peek(sample(module.OLD)) == {"no_debug": False, "enums": 1, "dialect": module.OLD} and module.peek(b"")["enums"] is None


def test_tables_are_typed_and_stored_by_name(spark, modules, tmp_path):
    made = module.stored(modules, OPS, str(tmp_path / "t"), ["functions", "properties"])
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"table=functions", "table=properties", "table=modules"}
    own = module.table_of(made, "properties")
    assert own.schema["type"].dataType.simpleString() == "bigint" and own.where("module_id = 'len2'").orderBy("nr").select("name").collect()[0][0] == "x"
    plan = module.table_of(made, "properties")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "table" in plan


def test_of_classes_of_one_name_the_last_counts(spark):
    rows = [("m", "used_object_props", 0, {"ordinal": 0, "owner_text": "K", "name": None, "place": 0}), ("m", "properties", 0, {"class": "K", "ordinal": 0, "name": "zz"}), ("m", "properties", 1, {"class": "K", "ordinal": 0, "name": "aa"})]
    shape = ", ".join(f"`{t}` struct<{', '.join(f'`{c}`: {k.replace("long", "bigint")}' for c, k in module.columns_of(t))}>" for t in module.TABLES)
    made = spark.createDataFrame([(m, t, n, *(x if t == c else None for c in module.TABLES)) for m, t, n, x in rows], f"module_id string, `table` string, nr long, {shape}")
    assert [r._text for r in disasm.names(made).where("_nt = 'objprop'").collect()] == ["K::aa"]


def test_opcode_tables_are_found():
    names = [b"Zero", *(b"Op%d" % i for i in range(12)), b"Last"]
    at, places, blob = 0x400, [], b""
    for n in names:
        places.append(0x1000 + at - 0x200 + len(blob))
        blob += n + b"\0"
    blob += b"\0" * (-len(blob) % 4)
    rows = b"".join(struct.pack("<Iiihh", 0x400000 + p, i, 2 if i % 2 else 1, -i, 0) for i, p in enumerate(places))
    pe = b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 224, 0) + b"\0" * 28 + struct.pack("<I", 0x400000) + b"\0" * 192
    section = b".data\0\0\0" + struct.pack("<IIII", 0x2000, 0x1000, 0x1000, 0x200) + b"\0" * 16
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 0x40)
    exe = (head + pe + section).ljust(0x400, b"\0") + blob + rows + b"\0" * 64
    table = opcodes.find(exe.ljust(0x1200, b"\0"))
    assert len(table) == len(names) - 1 and table[0]["name"] == "Op0" and table[1] == {"name": "Op1", "type": 2, "stackInc": -1, "operands": 1, "dwords": 1}
    assert opcodes.from_json(opcodes.to_json(table)) == table
    with pytest.raises(FormatError):
        opcodes.find((head + pe + section).ljust(0x1200, b"\0"))
