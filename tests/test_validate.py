import json

from pyspark.sql import functions as F
from test_module import OPS, modules, sample, tables  # noqa: F401

from lodestrata import cli
from lodestrata.functions.strings import candidates, fresh_by_harvester, string_decrypt, string_encrypt, string_key
from lodestrata.functions.codec import encode_int
from lodestrata.operators import validate
from lodestrata.operators.disasm import bodies
from lodestrata.operators.validate import STAGES, passed, report, stages, summary, totals
from lodestrata.sources import module


def test_stages_and_status(modules, tables):  # noqa: F811
    rows = stages(modules, tables, OPS)
    got = {(r.module_id, r.stage): r.ok for r in rows.collect()}
    assert len(got) == 3 * len(STAGES)
    assert got["junk", "unpack"] and got["junk", "dialect"] is False and got["junk", "tail"] is None
    assert all(got[m, s] for m in ("len2", "tagged") for s in STAGES)
    status = {r.module_id: r.status for r in report(rows).collect()}
    assert status == {"junk": "FAIL", "len2": "PASS", "tagged": "PASS"}
    assert tuple(passed(rows).head()) == (2, 3)
    assert {r.stage: (r.passed, r.failed, r.not_reached) for r in totals(rows).collect()}["tail"] == (2, 0, 1)
    counts = {r.module_id: (r.enum_members, r.bodies, r.classes) for r in summary(tables).where("dialect IS NOT NULL").collect()}
    assert set(counts.values()) == {(2, 3, 2)}


def test_a_sample_of_bodies_is_checked(modules, tables, monkeypatch):  # noqa: F811
    monkeypatch.setattr(validate, "SAMPLE", 1)
    own = bodies(tables, modules, 1)
    assert own.count() == 2 and bodies(tables, modules).count() == 6
    assert stages(modules, tables, OPS, deep=True).where("stage = 'disasm' AND ok").count() == 2


def test_one_bad_module_ends_no_batch(spark, monkeypatch):
    def failing(data, operands, tracing=True, real=module.decode):
        if data.startswith(b"boom"):
            raise MemoryError("too large")
        return real(data, operands, tracing)

    monkeypatch.setattr(module, "decode", failing)
    found = module.read_module(b"boom", {})
    assert found["modules"][0]["reached"] == "nothing" and "MemoryError" in found["modules"][0]["error"]
    deep = sample(module.OLD)[:1] + encode_int(1) + b"nXoops"
    rows = [("deep", bytearray(deep)), ("none", None), ("good", bytearray(sample(module.NEW)))]
    made = module.decoded(spark.createDataFrame(rows, "module_id string, content binary"), OPS, ["functions"])
    assert {r.module_id: r.reached for r in module.module_facts(made).collect()} == {"deep": "nothing", "none": "nothing", "good": "tail"}


def test_harvest(spark):
    lits = spark.createDataFrame([("m", 0, "one"), ("m", 1, "\0two\0three\0"), ("m", 2, "four")], "module_id string, ordinal int, text string")
    blobs = spark.createDataFrame([(bytearray(b"\1\2hello world\0abc\0four\0"),)], "content binary")
    found = {r.value: r.harvester for r in candidates(lits, blobs).collect()}
    assert found["one"] == found["four"] == "literal" and found["two"] == "core" and found["twothree"] == "core"
    assert found["hello world"] == "printable" and "abc" not in found and found["one\0\0two\0three\0"] == "run"
    assert sum(r.n_fresh for r in fresh_by_harvester(candidates(lits, blobs)).collect()) == len(found)


def test_commands(tmp_path, capsys, spark):
    (tmp_path / "m.bin").write_bytes(sample(module.NEW))
    table = {"table": {str(k): {**v, "type": 0, "stackInc": 0, "dwords": 1} for k, v in OPS.items()}}
    (tmp_path / "ops.json").write_text(json.dumps(table))
    at = [str(tmp_path / "m.bin"), str(tmp_path / "ops.json")]
    assert cli.main(["asm", *at]) == 0 and "identical" in capsys.readouterr().out
    assert cli.main(["lift", *at, "--calls", "print"]) == 0 and "void <global>::main()" in capsys.readouterr().out
    assert cli.main(["disasm", *at, "-f", "nothing"]) == 1
    assert cli.main(["validate", *at]) == 0 and "1/1 modules" in capsys.readouterr().out
    assert cli.main(["opcodes", str(tmp_path / "absent"), "x"]) == 2
    assert cli.main(["lift", str(tmp_path / "absent"), at[1]]) == 2
    assert cli.main(["asm", *at, "--out", str(tmp_path / "made")]) == 0
    assert [p.read_bytes() for p in (tmp_path / "made").iterdir()] == [sample(module.NEW)]
    capsys.readouterr()
    assert cli.main(["asm", *at, "--literals", "3"]) == 0 and " more" in capsys.readouterr().out
    assert cli.main(["disasm", *at, "--json", str(tmp_path / "json")]) == 0 and list((tmp_path / "json").glob("*.json"))
    assert F is not None


def test_strings_come_back(spark):
    df = spark.createDataFrame([(bytearray(b"hello \xff" * k), bytearray(p)) for k in (0, 1, 2, 3) for p in (b"key", b"key\0rest", b"other")], "d binary, p binary")
    out = df.select("d", "p", string_encrypt(F.col("d"), string_key(F.col("p"))).alias("e"))
    rows = out.select("d", string_decrypt(F.col("e"), string_key(F.col("p"))).alias("same"), string_decrypt(F.col("e"), string_key(F.lit(bytearray(b"key")))).alias("key"), "p").collect()
    for r in rows:
        assert r.same == (r.d or None) and (r.key == (r.d or None)) == (r.p != b"other" or not r.d)
