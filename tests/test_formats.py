import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import codec
from lodestrata.functions.aes import cbc_decrypt, ecb_decrypt, ecb_encrypt, tag_of
from lodestrata.functions.scalars import byte_entropy
from lodestrata.sources import overlay, packs


@pytest.mark.parametrize("value", [0, 1, 63, 64, 8191, 8192, (1 << 20) - 1, 1 << 20, (1 << 27) - 1, 1 << 34, 1 << 41, (1 << 49) - 1, 1 << 49, (1 << 64) - 1, -1, -63, -64, -8192])
def test_integers_come_back(value):
    raw = codec.encode_int(value)
    assert codec.decode_int(raw + b"x", 0) == (value, len(raw))


def test_integer_widths():
    assert [len(codec.encode_int(v)) for v in (63, 64, 8191, 8192, (1 << 48) - 1, 1 << 48)] == [1, 2, 2, 3, 7, 9]
    assert codec.encode_int(63) == b"\x3f" and codec.encode_int(64) == b"\x40\x40"
    for v in range(5000):
        assert codec.decode_int(codec.encode_int(v), 0)[0] == v
    with pytest.raises(IndexError):
        codec.decode_int(b"\x40", 0)


def test_blobs_come_back_and_damage_shows():
    rng = random.Random(1)
    for data in (b"", b"a", bytes(range(256)) * 3, b"abc" * 5000, bytes(rng.randrange(4) for _ in range(3000))):
        assert codec.inflate(codec.deflate(data), len(data)) == data
    assert codec.inflate(b"\xffab\xff\x06\x02c") == b"abababab" + b"c"
    assert codec.inflate(b"\xff\xff\x00x") == b"\xffx"
    with pytest.raises(codec.FormatError):
        codec.inflate(b"\xffab\xff\x04\x09")
    with pytest.raises(codec.FormatError):
        codec.inflate(codec.deflate(b"abcdef"), 7)
    assert codec.key_material(0x11)[:7].hex() == "33050f2d050f2d"


def test_the_longest_copy_is_taken():
    data = b"abcdX" + b"abcdefgY" + b"abcdQ" + b"abcdefgh"
    assert codec.longest_match(data, 18, [0, 5, 13], 1 << 16, 4096) == (7, 13)
    assert codec.longest_match(data, 18, [0, 5, 13], 12, 4096) == (4, 5) and codec.longest_match(data, 18, [], 99, 99) == (0, 0)
    assert codec.longest_match(b"x" * 300, 100, list(range(100)), 1 << 16, 4096) == (200, 1)
    assert codec.longest_match(b"abcabc", 3, [0], 99, 2) == (2, 3)
    rng = random.Random(7)
    for _ in range(200):
        data = bytes(rng.choices(b"ab", k=40))
        at = rng.randrange(1, 40)
        want = max(next((n for n in range(len(data) - at, -1, -1) if data[i : i + n] == data[at : at + n]), 0) for i in range(at))
        assert codec.longest_match(data, at, list(range(at)), 99, 99)[0] == want
    assert len(codec.deflate(data * 20)) < len(data) * 3


def test_aes_without_padding(spark):
    key, iv = bytes(range(32)), bytes(16)
    df = spark.createDataFrame([(bytearray(b"0123456789abcdef" * 3), bytearray(key), bytearray(iv))], "d binary, k binary, iv binary")
    enc = F.substring(F.aes_encrypt("d", "k", F.lit("CBC"), F.lit("PKCS"), F.col("iv")), 17, 48)
    r = df.select(ecb_decrypt(ecb_encrypt(F.col("d"), F.col("k")), F.col("k")).alias("e"), cbc_decrypt(F.concat(enc, F.lit(b"xx")), F.col("k"), F.col("iv")).alias("c"), F.octet_length(tag_of(F.col("k"))).alias("t")).head()
    assert bytes(r.e) == bytes(r.c) == b"0123456789abcdef" * 3 and r.t == 16


def executable(spark, module, seed, embedded=b""):
    blob = codec.deflate(module) + b" %d" % len(module)
    plain = b"A0" * 16 + b"=1 printf%d\0" % len(blob) + blob
    plain += b"\0" * (-len(plain) % 16)
    key = codec.key_of_seed(seed)
    df = spark.createDataFrame([(bytearray(plain), bytearray(key), bytearray(key[:16]))], "p binary, k binary, iv binary")
    enc = bytes(df.select(F.substring(F.aes_encrypt("p", "k", F.lit("CBC"), F.lit("PKCS"), F.col("iv")), 17, len(plain))).head()[0])
    stub = b"MZ" + b"\x90" * 510
    return stub + b"%d " % len(embedded) + embedded + enc + b"xproc10\0" + struct.pack("<I", 512)


def test_unpack_chain(spark):
    module = b"module bytes " * 300
    rows = [("a", executable(spark, module, 0x11)), ("b", executable(spark, module[:50], 2, b"EMB")), ("c", b"short"), ("d", b"x" * 100 + b"xproc10\0" + struct.pack("<I", 9999)), ("e", None)]
    files = spark.createDataFrame([(p, bytearray(c) if c else None) for p, c in rows], "path string, content binary")
    got = {r.path: r for r in overlay.unpacked(files).collect()}
    assert bytes(got["a"].bytecode) == module and got["a"].seed == 0x11 and got["a"].error is None
    assert bytes(got["b"].bytecode) == module[:50] and got["b"].seed == 2 and bytes(got["b"].embedded) == b"EMB"
    assert got["c"].error == "no trailer" and got["d"].error == "overlay offset out of range" and got["e"].bytecode is None
    assert {r.path for r in overlay.unpacked(files, 2).where("error IS NULL").collect()} == {"b"}


def test_entropy(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"aaaa"),), (bytearray(range(256)),)], "b binary")
    assert [round(r[0], 6) for r in df.select(byte_entropy(F.col("b"))).collect()] == [0, 0, 8]


def pack_bytes(items):
    out = struct.pack(packs.RECORD, packs.PACK, 1, len(items), 0)
    for name, data in items:
        out += struct.pack(packs.RECORD, packs.PACK, len(name.encode()), 0, len(data)) + name.encode() + data
    return out


def test_packs(spark, tmp_path):
    items = [("a.txt", b"hello"), ("dir/é.bin", b""), ("x", b"\0" * 40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.dat").write_bytes(pack_bytes(items))
    spark.dataSource.register(packs.PackSource)
    df = spark.read.format("pack").load(str(tmp_path / "in"))
    assert [(r.name, bytes(r.data)) for r in df.orderBy("ordinal").collect()] == items
    light = spark.read.format("pack").option("payload", "false").load(str(tmp_path / "in"))
    assert [(r.name, r.data, r.size) for r in light.orderBy("ordinal").collect()] == [(n, None, len(d)) for n, d in items]
    key = F.lit(bytearray(range(32)))
    shut = df.withColumn("data", F.when(F.col("name") == "a.txt", packs.seal(F.col("data"), key)).otherwise(F.col("data")))
    got = {r.name: r for r in packs.opened(shut, key).collect()}
    assert bytes(got["a.txt"].plain) == b"hello" and got["a.txt"].encrypted and got["a.txt"].plain_size == 5 and not got["x"].encrypted
    wrong = {r.name: r.plain for r in packs.opened(shut, F.lit(bytearray(32))).collect()}
    assert wrong["a.txt"] is None and bytes(wrong["x"]) == b"\0" * 40
    keys = spark.createDataFrame([(bytearray(range(32)),), (bytearray(32),)], "key binary")
    assert [r.name for r in packs.key_matches(shut, keys).collect()] == ["a.txt"]
    assert [(r.n, r.names) for r in packs.tag_groups(shut).collect()] == [(1, ["a.txt"])]
    new = spark.createDataFrame([("a.txt", bytearray(b"changed!"))], "name string, new_data binary")
    again = packs.replaced(shut, new, key)
    assert bytes({r.name: r.plain for r in packs.opened(again, key).collect()}["a.txt"]) == b"changed!"
    with pytest.raises(Exception, match="a key is needed"):
        packs.replaced(shut, new).collect()
    whole = packs.built(df).head()
    assert bytes(whole.content) == pack_bytes(items)
    out = packs.extract(df.unionByName(df.withColumn("name", F.concat(F.lit("../"), "name"))), str(tmp_path / "out")).collect()
    assert sum(r.error is not None for r in out) == 3 and (tmp_path / "out" / "dir" / "é.bin").read_bytes() == b"" and not (tmp_path / "a.txt").exists()
    assert packs.from_files(overlay.read_files(spark, str(tmp_path / "in"))).count() == 3


def test_faults_of_packs_are_rows(spark):
    raw = pack_bytes([("a", b"hello"), ("b", b""), ("c", b"bye")])
    bad = {"whole": raw, "short": raw[:-1], "tail": raw + b"x", "empty": b"", "null": None, "head": raw[1:], "record": raw[:-20] + b"?" + raw[-19:], "version": raw[:4] + b"\2" + raw[5:]}
    files = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in bad.items()], "path string, content binary")
    rows = packs.checked(files).collect()
    names = {k: [r.name for r in rows if r.pack == k and r.error is None] for k in bad}
    assert names == {"whole": ["a", "b", "c"], "short": ["a", "b"], "tail": ["a", "b", "c"], "empty": [], "null": [], "head": [], "record": ["a", "b"], "version": []}
    assert {r.pack: r.ordinal for r in rows if r.error} == {"short": 2, "tail": 3, "empty": 0, "null": 0, "head": 0, "record": 2, "version": 0}
    assert packs.checked(files.limit(0)).count() == 0
    with pytest.raises(Exception, match="short: entry 2"):
        packs.from_files(files.where("path IN ('whole', 'short')")).collect()


def test_tables_of_operations_as_json(spark):
    from lodestrata.sources import opcodes

    table = {3: {"name": "a\"b", "type": 1, "stackInc": -2, "operands": 1, "dwords": 2}, 11: {"name": "op11", "type": 2, "stackInc": 0, "operands": 0, "dwords": 1}}
    found = spark.createDataFrame([("x", k, *v.values(), None) for k, v in reversed(table.items())] + [("bad", *[None] * 6, "no table")], "path string, op long, name string, type long, stackInc long, operands long, dwords long, error string")
    made = opcodes.as_json(found).collect()
    assert [r.path for r in made] == ["x"] and opcodes.from_json(made[0].json) == table
    files = spark.createDataFrame([("x", bytearray(opcodes.to_json(table).encode())), ("y", bytearray(b"{")), ("z", None)], "path string, content binary")
    rows = opcodes.from_json_files(files).collect()
    assert {r.op: {c: r[c] for c in table[3]} for r in rows if r.path == "x"} == table
    assert sorted((r.path, r.op, r.error) for r in rows if r.path != "x") == [("y", None, "no table of operations"), ("z", None, "no table of operations")]


def test_pack_reports(spark):
    rows = spark.createDataFrame([("p", i, f"n{i}", bytearray(b"x" * i)) for i in range(5)], "pack string, ordinal int, name string, data binary").withColumn("size", F.octet_length("data").cast("long"))
    rows = rows.withColumn("data", F.when(F.col("ordinal") > 2, packs.seal(F.col("data"), F.lit(bytearray(32)))).otherwise(F.col("data")))
    assert tuple(packs.counted(rows).head()) == ("p", 5, 2, 1, 10, 7)
    lines = [r.line for r in packs.listing(rows, 2).orderBy("place").collect()]
    assert lines[0] == "5 entries" and lines[-1] == "  ... 3 more" and len(lines) == 4
    twice = spark.createDataFrame([("n0", bytearray(b"a")), ("n0", bytearray(b"b"))], "name string, new_data binary")
    with pytest.raises(Exception, match="two replacements"):
        packs.replaced(rows, twice, F.lit(bytearray(32))).collect()
    once = twice.limit(1).union(twice.limit(1))
    assert packs.replaced(rows, once, F.lit(bytearray(32))).count() == 5


def test_blobs_of_equal_names_do_not_meet(spark, tmp_path):
    rows = spark.createDataFrame([(f"file:/{d}/game.exe", bytearray(d.encode()), bytearray(b"c"), None) for d in ("a", "b")], "path string, bytecode binary, compressed binary, embedded binary")
    wrote = overlay.write_blobs(rows, str(tmp_path / "out")).collect()
    assert len({r.place for r in wrote}) == 4 and all(r.error is None for r in wrote)
    assert sorted(p.read_bytes() for p in (tmp_path / "out").glob("*_bytecode.bin")) == [b"a", b"b"]


def test_opcode_tables_as_rows(spark):
    from lodestrata.plans.samples import opcode_image
    from lodestrata.sources import opcodes

    files = spark.createDataFrame([("a", bytearray(opcode_image([f"Op{i}" for i in range(12)], [1] * 12))), ("bad", bytearray(b"MZ"))], "path string, content binary")
    got = opcodes.tables(files).collect()
    assert [r.name for r in got if r.path == "a"] == [f"Op{i}" for i in range(12)] and [r.error is None for r in got if r.path == "bad"] == [False]
    parts = opcodes.section_tables(files)
    asked = spark.createDataFrame([("a", 0x401000), ("a", 0x401200), ("a", 0x400FFF), ("bad", 5)], "path string, address long")
    places = opcodes.located(asked, parts)
    assert {r.address: r.at for r in places.collect()} == {0x401000: 0x200, 0x401200: 0x400}
    assert {r.at: r.text for r in opcodes.strings_at(places, files).collect()} == {0x200: None, 0x400: "Zero"}


@pytest.mark.parametrize("raw", [b"nope", pack_bytes([("a", b"b")]) + b"x", pack_bytes([("a", b"bcd")])[:-1]])
def test_bad_packs(raw):
    with pytest.raises(codec.FormatError):
        list(packs.entries(io.BytesIO(raw), len(raw)))
