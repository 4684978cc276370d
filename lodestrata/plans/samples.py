"""Small binary inputs made of the driver's rows, for queries over the formats: modules, executables and opcode tables."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.codec import deflate, encode_int, key_of_seed
from lodestrata.session import table
from lodestrata.sources import module
from lodestrata.sources.overlay import TRAILER

OPS = {
    0: {"name": "CALLSYS", "operands": 1}, 1: {"name": "RET", "operands": 1}, 2: {"name": "STR", "operands": 1},
    3: {"name": "SetV4", "operands": 2}, 4: {"name": "ADDi", "operands": 3}, 5: {"name": "CpyVtoR4", "operands": 1},
}
#: Of functions whose flow has one form each.
FLOW = {
    0: {"name": "CMPIi", "operands": 2}, 1: {"name": "RET", "operands": 1}, 2: {"name": "JZ", "operands": 1}, 3: {"name": "SetV4", "operands": 2},
    4: {"name": "JNZ", "operands": 1}, 5: {"name": "JMP", "operands": 1}, 6: {"name": "JNS", "operands": 1}, 7: {"name": "JS", "operands": 1}, 8: {"name": "IncVi", "operands": 1}, 9: {"name": "JMPP", "operands": 1},
}
#: Of functions whose operands name something in every way there is, and one operation that nobody knows.
NAMING = {
    0: {"name": "PshC4", "operands": 1}, 1: {"name": "RET", "operands": 1}, 2: {"name": "PSF", "operands": 1}, 3: {"name": "ALLOC", "operands": 2}, 4: {"name": "PGA", "operands": 1},
    5: {"name": "ADDSi", "operands": 2}, 6: {"name": "PopPtr", "operands": 0}, 7: {"name": "LoadThisR", "operands": 2}, 8: {"name": "RDR4", "operands": 1}, 9: {"name": "LoadVObjR", "operands": 3},
    10: {"name": "WRTV4", "operands": 1}, 11: {"name": "CpyGtoV4", "operands": 2}, 12: {"name": "TYPEID", "operands": 1}, 13: {"name": "FREE", "operands": 2}, 14: {"name": "Strange", "operands": 1},
}
OP, FLOW_OP, NAMING_OP = ({x["name"]: op for op, x in table.items()} for table in (OPS, FLOW, NAMING))
NONE = encode_int(0)


class Writer:
    """Fields of a module in a dialect."""

    def __init__(self, dialect: str):
        self.new = dialect == module.NEW

    def text(self, text: str) -> bytes:
        raw = text.encode("latin-1")
        if self.new:
            return encode_int(2 * len(raw)) + raw
        return b"n" + encode_int(len(raw)) + raw if raw else b"\0"

    def declared(self, name: str, flags: int, size: int) -> bytes:
        return self.text(name) + struct.pack(">I", flags) + encode_int(size) + self.text("")

    def many(self, items: list[bytes]) -> bytes:
        return encode_int(len(items)) + b"".join(items)

    def primitive(self, token: int) -> bytes:
        return NONE + encode_int(token) + b"\0"

    def named(self, name: str) -> bytes:
        return b"o" + self.text(name) + self.text("")

    def signature(self, name: str, returns: int, params: list[int], kind: int, owner: bytes | None) -> bytes:
        lists = NONE if params or not self.new else b""
        head = self.text(name) + self.primitive(returns) + self.many([self.primitive(p) for p in params])
        return head + lists + encode_int(kind) + lists + (owner + b"\0" if owner else b"\0" + self.text(""))

    def function(self, name: str, returns: int, params: list[int], code: list[tuple], owner: bytes | None = None, ops: dict[str, int] = OP) -> bytes:
        body = self.many([bytes([ops.get(n, 0xEE)]) + b"".join(map(encode_int, a)) for n, *a in code]) + encode_int(4)
        head = b"f" + self.signature(name, returns, params, 1, owner)
        return head + b"\0" + body if self.new else head + body + NONE + NONE + b"\0"


def module_bytes(dialect: str, nation: int, members: list[tuple[int, int, str, str]], broken: bool = False) -> bytes:
    """A module with an enum of members (key, value, name, segment), a class and a string for each fifth key, and a function that prints those strings.

    A broken one has a method in each class whose body begins with an unknown operation.
    """
    w = Writer(dialect)
    chosen = [m for m in members if m[0] % 5 == 0]
    enum = w.declared("Balance", module.ENUM, 4) + w.many([w.text(f"c{k}") + struct.pack(">i", v) for k, v, *_ in members])
    flag = module.SCRIPT_OBJECT[dialect]
    out = b"\0" + w.many([enum]) + w.many([w.declared(f"K{k}", flag, 8) for k, *_ in chosen]) + NONE
    for k, *_ in chosen:
        methods = [("get", [("SetV4", 2, k), ("ADDi", 2, 2, 1), ("CpyVtoR4", 2), ("RET", 0)])]
        methods = [("bad", [("nothing",)]), *methods] if broken else methods
        out += b"\0" + NONE + b"\0" + NONE + w.many([w.function(n, 68, [68], code, w.named(f"K{k}")) for n, code in methods]) + NONE
    for *_, segment in chosen:
        out += w.many([w.text(f"seg_{segment}") + w.primitive(68) + NONE, w.text("bal") + w.primitive(79) + encode_int(1)])
    main = [x for i in range(len(chosen)) for x in (("STR", i), ("CALLSYS", i % 3))] + [("RET", 0)]
    out += NONE + NONE + w.many([w.function("main", 80, [], main)]) + NONE + NONE
    out += w.many([w.named(f"K{k}") for k, *_ in chosen[:1]]) + w.many([w.primitive(75)])
    out += w.many([b"a" + w.signature("print", 80, [68, 75], 0, None), b"m" + w.signature("note", 68, [68, 75], 0, None)])
    out += w.many([w.text(f"g{nation}") + w.text("") + w.primitive(68) + b"\1"])
    return out + w.many([w.text(name) for _, _, name, _ in chosen]) + w.many([w.named("K") + (NONE if w.new else w.text("x"))])


def modules(spark: SparkSession, d: str) -> DataFrame:
    """module_id, nation and content: a module for each nation and 500 customer keys, so none grows with the data. Even nations write the newer dialect."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c_custkey")
        nation = int(pdf["c_nationkey"].iloc[0])
        members = list(zip(pdf["c_custkey"].tolist(), pdf["cents"].tolist(), pdf["c_name"].tolist(), pdf["c_mktsegment"].tolist(), strict=True))
        data = module_bytes(module.NEW if nation % 2 == 0 else module.OLD, nation, members, nation % 7 == 1)
        data = data[:-1] if nation % 7 == 3 else b"" if nation % 7 == 5 else data
        return pd.DataFrame({"module_id": [pdf["module_id"].iloc[0]], "nation": [nation], "content": [data]})

    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("int").alias("cents"))
    name = F.format_string("m%d_%d", "c_nationkey", F.floor(F.col("c_custkey") / 500))
    return rows.withColumn("module_id", name).groupBy("module_id").applyInPandas(one, "module_id string, nation int, content binary")


def flow_code(form: int, k: int) -> list[tuple]:
    """A branch of two arms, one of one arm, a loop tested first, one tested last, one without end, a switch."""
    return [
        [("CMPIi", 1, k), ("JZ", 2), ("SetV4", 1, 1), ("JMP", 1), ("SetV4", 1, 2), ("RET", 0)],
        [("CMPIi", 1, k), ("JNZ", 1), ("SetV4", 1, 1), ("RET", 0)],
        [("CMPIi", 1, k), ("JNS", 2), ("IncVi", 1), ("JMP", -4), ("RET", 0)],
        [("IncVi", 1), ("CMPIi", 1, k), ("JS", -3), ("RET", 0)],
        [("IncVi", 1), ("JMP", -2)],
        [("JMPP", 1), ("SetV4", 1, k), ("RET", 0)],
    ][form]


def flow_modules(spark: SparkSession, d: str) -> DataFrame:
    """module_id and content: a module for each supplier, with one function whose flow has the form of its key."""

    def content(k: int) -> bytes:
        w = Writer(module.NEW if k % 2 else module.OLD)
        head = b"\0" + w.many([w.declared("E", module.ENUM, 4) + w.many([w.text("e") + struct.pack(">i", 1)])])
        head += w.many([w.declared("C", module.SCRIPT_OBJECT[module.NEW if w.new else module.OLD], 8)]) + NONE
        block = b"\0" + NONE + b"\0" + NONE + NONE + NONE + NONE
        form = w.function("form", 80, [], flow_code(k % 6, k), ops=FLOW_OP)
        return head + block + NONE + NONE + w.many([form]) + NONE * 8

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        return pd.Series([content(k) for k in key.tolist()])

    return table(spark, d, "supplier").select(F.format_string("s%d", "s_suppkey").alias("module_id"), made("s_suppkey").alias("content"))


def naming_modules(spark: SparkSession, d: str) -> DataFrame:
    """module_id and content: a module for each supplier with two classes of one name and a function that names a constructor, a global or
    string, properties by name or by place, types and type ids; some of these do not exist."""

    def content(k: int) -> bytes:
        w = Writer(module.NEW if k % 2 else module.OLD)
        p = k // 2
        # older modules count globals, newer ones strings and globals in turn
        pointer, there = ((1, 0, 3)[p % 3], 1) if w.new else (p % 2, 0)
        code = [
            ("PshC4", k), ("PSF", 3), ("ALLOC", 0, p % 4), ("PGA", pointer), ("ADDSi", 0, 0), ("PopPtr",), ("LoadThisR", 1, 0), ("RDR4", 2),
            ("LoadVObjR", 3, 0, 0), ("WRTV4", 2), ("CpyGtoV4", 4, there), ("TYPEID", 0), ("PopPtr",), ("FREE", 3, 0), ("Strange", k), ("RET", 0),
        ]
        out = b"\0" + w.many([w.declared("E", module.ENUM, 4) + w.many([w.text("e") + struct.pack(">i", 1)])])
        out += w.many([w.declared("C", module.SCRIPT_OBJECT[module.NEW if w.new else module.OLD], 8)] * 2) + NONE
        out += (b"\0" + NONE + b"\0" + NONE + NONE + NONE) * 2
        for last in ("first", f"last{k}"):
            out += w.many([w.text(n) + w.primitive(68) + encode_int(i) for i, n in enumerate(("x", last))])
        out += NONE + NONE + w.many([w.function("naming", 80, [], code, ops=NAMING_OP)]) + NONE + NONE
        out += w.many([w.named("C")]) + w.many([w.primitive(68)])
        out += w.many([b"a" + w.signature("$beh0", 80, [68], 0, w.named("C")), b"a" + w.signature("note", 80, [68], 0, None)])
        out += w.many([w.text(f"g{k}") + w.text("") + w.primitive(68) + b"\1"]) + w.many([w.text(f"s{k}")])
        return out + w.many([w.named("C") + (encode_int(place) if w.new else w.text(name)) for place, name in ((1, "named"), (7, "other"))])

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        return pd.Series([content(k) for k in key.tolist()])

    return table(spark, d, "supplier").select(F.format_string("n%d", "s_suppkey").alias("module_id"), made("s_suppkey").alias("content"))


def executables(spark: SparkSession, d: str, of: str = "nation") -> DataFrame:
    """path and content: for each row of a table a stub with an encrypted container of its name under a seed of its own; every sixth is cut short."""

    @F.pandas_udf("plain binary, key binary")
    def container(key: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = []
        for k, n in zip(key, name, strict=True):
            text = (n + " ").encode() * 40
            blob = deflate(text) + b" %d" % len(text)
            plain = b"0123456789abcdef" * 2 + b"=1 printf%d\0" % len(blob) + blob
            rows.append((plain + b"\0" * (-len(plain) % 16), key_of_seed(17 if k % 2 else k % 255 + 1)))
        return pd.DataFrame(rows, columns=["plain", "key"])

    key = f"{of[0]}_{of}key" if of == "nation" else f"{of[0]}_{of[:4]}key"
    rows = table(spark, d, of).select(F.col(key).alias("k"), container(key, f"{of[0]}_name").alias("c"))
    sealed = F.aes_encrypt("c.plain", F.col("c.key"), F.lit("CBC"), F.lit("PKCS"), F.substring("c.key", 1, 16))
    text = F.substring(sealed, F.lit(17), F.octet_length("c.plain"))
    stub = F.unhex(F.concat(F.lit("4D5A"), F.repeat(F.lit("90"), 510)))
    end = F.concat(F.lit(TRAILER), F.unhex(F.lit("00")), F.unhex(F.lit("00020000")))
    whole = F.concat(stub, F.lit(b"3 EMB"), text, end)
    content = F.when(F.col("k") % 6 == 5, F.substring(whole, 1, 300)).otherwise(whole)
    return rows.select(F.format_string(f"{of[0]}%d.exe", "k").alias("path"), content.alias("content"))


def opcode_image(names: list[str], kinds: list[int]) -> bytes:
    """An executable of one section that holds names and a table of rows that refer to them; a row's name is the one before its own."""
    base, rva, raw = 0x400000, 0x1000, 0x200
    blob, places = b"", []
    for n in ["Zero", *names]:
        places.append(base + rva + 0x200 + len(blob))
        blob += n.encode() + b"\0"
    blob += b"\0" * (-len(blob) % 4)
    rows = b"".join(struct.pack("<Iiihh", p, i, (kinds + [1])[i], -i, 0) for i, p in enumerate(places))
    head = b"MZ" + b"\0" * 58 + struct.pack("<I", 0x40)
    head += b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 1, 0, 0, 0, 224, 0) + b"\0" * 28 + struct.pack("<I", base) + b"\0" * 192
    size = 0x200 + len(blob) + len(rows) + 64
    section = b".data\0\0\0" + struct.pack("<IIII", size, rva, size, raw) + b"\0" * 16
    return (head + section).ljust(raw + 0x200, b"\0") + blob + rows + b"\0" * 64


def opcode_images(spark: SparkSession, d: str, of: str = "region", key: str = "r_regionkey") -> DataFrame:
    """path and content: an executable for each row of a table, with one operation more than the key before, and ten again after five of them."""

    @F.pandas_udf("binary")
    def image(keys: pd.Series) -> pd.Series:
        return pd.Series([opcode_image([f"R{r}Op{i}" for i in range(10 + r % 5)], [i % 20 + 1 for i in range(10 + r % 5)]) for r in keys.tolist()])

    return table(spark, d, of).select(F.format_string("r%d.exe", key).alias("path"), image(key).alias("content"))
