"""Instructions to named operands, all relational: an operand's role picks the table that its ordinal counts in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.codec import decode_int
from lodestrata.functions.scalars import quote_literal
from lodestrata.sources.module import module_facts, table_of

#: fixed values: (role, place) of the operands that mean something else than a number or a slot
ROLES = {
    "CALL": [("function", 0)], "CALLSYS": [("function", 0)], "CALLINTF": [("function", 0)], "CALLBND": [("function", 0)], "Thiscall1": [("function", 0)],
    "STR": [("string", 0)],
    "PGA": [("globalptr", 0)], "PshGPtr": [("globalptr", 0)], "LDG": [("globalptr", 0)], "PshG4": [("globalptr", 0)], "SetG4": [("globalptr", 0)],
    "CpyGtoV4": [("globalptr", 1)], "CpyVtoG4": [("globalptr", 1)], "LdGRdR4": [("globalptr", 1)],
    "ADDSi": [("objprop", 0), ("typeid", 1)], "LoadThisR": [("objprop", 0), ("typeid", 1)],
    "LoadRObjR": [("objprop", 1), ("typeid", 2)], "LoadVObjR": [("objprop", 1), ("typeid", 2)],
    "TYPEID": [("typeid", 0)], "Cast": [("typeid", 0)],
    "ALLOC": [("objtype", 0), ("ctorfunc", 1)], "FREE": [("objtype", 1)], "REFCPY": [("objtype", 0)], "ObjType": [("objtype", 0)],
    "JMP": [("jump", 0)], "JZ": [("jump", 0)], "JNZ": [("jump", 0)], "JS": [("jump", 0)], "JNS": [("jump", 0)], "JP": [("jump", 0)], "JNP": [("jump", 0)],
    "JLowZ": [("jump", 0)], "JLowNZ": [("jump", 0)],
}
FUNCTION = ["module_id", "function"]


def dimension(spark: SparkSession, opcodes: dict[int, dict]) -> DataFrame:
    """op, name and roles (map of place to role); one row an opcode, at most 256."""
    rows = [(op, x["name"], {place: role for role, place in ROLES.get(x["name"], [])}) for op, x in opcodes.items()]
    return spark.createDataFrame(rows, "op long, name string, roles map<int,string>")


def operands(tables: DataFrame, opcodes: dict[int, dict]) -> DataFrame:
    """module_id, function, idx, offset, name, place, value, role; an instruction without operands has one row with null place."""
    dim = F.broadcast(dimension(tables.sparkSession, opcodes))
    rows = table_of(tables, "instructions").join(dim, "op", "left").withColumn("name", F.coalesce("name", F.format_string("UNKNOWN_%02X", "op")))
    each = rows.select(*FUNCTION, "idx", "offset", "name", "roles", F.posexplode_outer("operands").alias("place", "value"))
    return each.withColumn("role", F.try_element_at("roles", F.col("place"))).drop("roles")


def resolved(tables: DataFrame, opcodes: dict[int, dict]) -> DataFrame:
    """operands with text, null where the ordinal is out of range. Each table joins once, on (module, ordinal)."""
    facts = module_facts(tables).select("module_id", "dialect")
    rows = operands(tables, opcodes).join(facts, "module_id", "left")
    old, value = F.col("dialect") == "tagged", F.col("value")
    is_global = (F.col("role") == "globalptr") & (old | (value.bitwiseAND(1) == 1))
    is_string = (F.col("role") == "string") | ((F.col("role") == "globalptr") & ~old & (value.bitwiseAND(1) == 0))
    half = F.when(old | (F.col("role") != "globalptr"), value).otherwise(F.shiftright(value, 1))
    source = (
        F.when(F.col("role") == "function", F.struct(F.lit("function").alias("t"), value.alias("o")))
        .when((F.col("role") == "ctorfunc") & (value > 0), F.struct(F.lit("function").alias("t"), (value - 1).alias("o")))
        .when(is_global, F.struct(F.lit("global").alias("t"), half.alias("o")))
        .when(is_string, F.struct(F.lit("string").alias("t"), half.alias("o")))
        .when(F.col("role").isin("objprop", "typeid", "objtype"), F.struct(F.col("role").alias("t"), value.alias("o")))
    )
    rows = rows.select("*", source.alias("s")).select(*rows.columns, F.col("s.t").alias("_t"), F.col("s.o").alias("_o"))
    out = rows.join(names(tables), (rows.module_id == F.col("_m")) & (rows._t == F.col("_nt")) & (rows._o == F.col("_no")), "left")
    text = F.when((F.col("role") == "ctorfunc") & (value == 0), "<no constructor>").otherwise(F.col("_text"))
    return with_labels(out.select(*FUNCTION, "idx", "offset", "name", "place", "value", "role", text.alias("text")))


def names(tables: DataFrame) -> DataFrame:
    """Everything that an operand can name: (_m, _nt, _no) -> _text."""
    one = lambda t, kind, text: table_of(tables, t).select(F.col("module_id").alias("_m"), F.lit(kind).alias("_nt"), F.col("ordinal").alias("_no"), text.alias("_text"))
    props = table_of(tables, "used_object_props")
    own = table_of(tables, "properties").groupBy("module_id", F.col("class").alias("owner_text"), F.col("ordinal").alias("place")).agg(F.max_by("name", "nr").alias("member"))  # of classes of one name the last
    found = props.join(own, ["module_id", "owner_text", "place"], "left")
    member = F.concat(F.col("owner_text"), F.lit("::"), F.coalesce(F.nullif("name", F.lit("")), "member", F.concat(F.lit("prop["), F.col("place").cast("string"), F.lit("]"))))
    props = found.select(F.col("module_id").alias("_m"), F.lit("objprop").alias("_nt"), F.col("ordinal").alias("_no"), member.alias("_text"))
    return (
        one("used_functions", "function", F.col("label"))
        .unionByName(one("used_strings", "string", quote_literal(F.decode("value", "ISO-8859-1"))))
        .unionByName(one("used_global_props", "global", F.col("name")))
        .unionByName(one("used_type_ids", "typeid", F.col("text")))
        .unionByName(one("used_types", "objtype", F.col("text")))
        .unionByName(props)
    )


def with_labels(rows: DataFrame) -> DataFrame:
    """rows with target of jumps (index + 1 + operand), and their text: labels in the order of first reference."""
    own = Window.partitionBy(*FUNCTION)
    target = F.when(F.col("role") == "jump", F.col("idx") + 1 + F.col("value"))
    rows = rows.withColumn("_n", F.max("idx").over(own) + 1).withColumn("target", target)
    inside = F.col("target").between(0, F.col("_n") - 1)
    first = F.min(F.when(inside, F.struct("idx", "place"))).over(Window.partitionBy(*FUNCTION, "target"))
    rows = rows.withColumn("_first", F.when(inside, first))
    number = F.dense_rank().over(own.orderBy(F.col("_first").asc_nulls_last())) - 1
    return rows.withColumn("text", F.when(inside, F.concat(F.lit("L"), number.cast("string"))).otherwise(F.col("text"))).drop("_n", "_first")


def resolution(rows: DataFrame, by: list[str]) -> DataFrame:
    """Operands with a role, how many have a text, and the share. A text that is missing is null."""
    own = rows.where("role IS NOT NULL")
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.count("text").alias("n_resolved"), F.round(100 * F.count("text") / F.count("*"), 6).alias("pct"))


def _matches(needle: str) -> Column:
    return F.contains(F.lower("label"), F.lit(needle.lower()))


def decode_span(code: bytes, table: dict[int, dict], start: int = 0, limit: int | None = None) -> list[tuple[int, int, str, list[int]]]:
    """(offset, op, name, operands) from start on, up to the first RET.

    An unknown operation is the last entry, named UNKNOWN_ and its number; an instruction that is cut off is left out.
    """
    out, at, end = [], start, len(code) if limit is None else min(len(code), start + limit)
    while at < end:
        op, args, nxt = code[at], [], at + 1
        known = table.get(op)
        if known is None:
            return [*out, (at, op, f"UNKNOWN_{op:02X}", [])]
        try:
            while len(args) < known["operands"]:
                value, nxt = decode_int(code, nxt)
                args.append(value)
        except IndexError:
            return out
        out.append((at, op, known["name"], args))
        if known["name"] == "RET":
            return out
        at = nxt
    return out


def spans(bodies: DataFrame, opcodes: dict[int, dict]) -> DataFrame:
    """module_id, function, idx, offset, op, name and operands of bodies (module_id, function, code), each decoded by itself up to its first RET."""
    table = {int(k): v for k, v in opcodes.items()}

    def run(batches):
        for batch in batches:
            rows = [(m, f, i, *x) for m, f, code in zip(*(batch.column(c).to_pylist() for c in ("module_id", "function", "code")), strict=True) for i, x in enumerate(decode_span(code or b"", table))]
            kinds = {"module_id": pa.string(), "function": pa.int64(), "idx": pa.int64(), "offset": pa.int64(), "op": pa.int64(), "name": pa.string(), "operands": pa.list_(pa.int64())}
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    return bodies.select("module_id", "function", "code").mapInArrow(run, "module_id string, function long, idx long, offset long, op long, name string, operands array<long>")


def bodies(tables: DataFrame, modules: DataFrame, first: int | None = None) -> DataFrame:
    """module_id, function, declared and code of functions with bodies, in the order of their sources; only the first so many of each module if that is given."""
    rows = collected(tables).where("body_end IS NOT NULL")
    if first is not None:
        place = F.row_number().over(Window.partitionBy("module_id").orderBy("source_order", "ordinal"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= first)
    code = F.substring("content", F.col("body_start").cast("int") + 1, (F.col("body_end") - F.col("body_start")).cast("int"))
    return rows.join(modules.select("module_id", "content"), "module_id").select("module_id", F.col("ordinal").alias("function"), "declared", code.alias("code"))


def find(tables: DataFrame, needle: str) -> DataFrame:
    """Functions whose label holds a text, in either case."""
    return table_of(tables, "functions").where(_matches(needle))


def callers_of(tables: DataFrame, opcodes: dict[int, dict], needle: str) -> DataFrame:
    """Functions whose body makes at least one call to a matching function: two semi joins."""
    wanted = table_of(tables, "used_functions").where(_matches(needle)).select("module_id", F.col("ordinal").alias("callee"))
    calls = operands(tables, opcodes).where("role = 'function' OR (role = 'ctorfunc' AND value > 0)")
    calls = calls.select(*FUNCTION, F.when(F.col("role") == "function", F.col("value")).otherwise(F.col("value") - 1).alias("callee"))
    hit = calls.join(wanted, ["module_id", "callee"], "left_semi").withColumnRenamed("function", "ordinal")
    return table_of(tables, "functions").join(hit, ["module_id", "ordinal"], "left_semi")


def collected(tables: DataFrame, with_initialisers: bool = True) -> DataFrame:
    """Functions with bodies, in the order of their sources: class members, module and global functions, initialisers."""
    functions = table_of(tables, "functions").where("body_start IS NOT NULL")
    starts = table_of(tables, "global_properties").where("init IS NOT NULL").select("module_id", F.col("init").alias("ordinal"))
    kind = F.when(F.col("context") == "module function", 2).when(F.col("context") == "global function", 3).otherwise(1)
    marked = functions.join(starts.distinct().withColumn("_init", F.lit(True)), ["module_id", "ordinal"], "left")
    marked = marked.withColumn("source_order", F.when(F.col("_init"), 4).otherwise(kind)).drop("_init")
    return marked if with_initialisers else marked.where("source_order < 4")


def listing(tables: DataFrame, opcodes: dict[int, dict]) -> DataFrame:
    """module_id, function, signature and the text of each disassembled function."""
    rows = resolved(tables, opcodes)
    args = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value", "text"))))
    lines = rows.groupBy(*FUNCTION, "idx", "name").agg(args.alias("args"))
    values = F.array_join(F.transform("args", lambda x: x["value"].cast("string")), " ")
    notes = F.array_join(F.filter(F.transform("args", lambda x: x["text"]), lambda x: x.isNotNull()), "  ")
    body = F.rtrim(F.concat(F.lit("    "), F.rpad("name", 10, " "), F.lit(" "), values))
    line = F.when(notes == "", body).otherwise(F.concat(F.when(F.length(body) < 32, F.rpad(body, 32, " ")).otherwise(body), F.lit(" ; "), notes))
    labels = rows.where("role = 'jump' AND text IS NOT NULL").groupBy(*FUNCTION, F.col("target").alias("idx")).agg(F.min("text").alias("label"))
    lines = lines.join(labels, [*FUNCTION, "idx"], "left").select(*FUNCTION, "idx", F.concat(F.coalesce(F.concat("label", F.lit(":\n")), F.lit("")), line).alias("line"))
    bodies = lines.groupBy(*FUNCTION).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("decoded"))
    heads = table_of(tables, "functions").withColumnRenamed("ordinal", "function")
    head = F.concat(F.lit("; === "), "signature", F.lit(" ===\n; instructions: "), F.col("decoded").cast("string"), F.lit(" decoded / "), F.col("declared").cast("string"), F.lit(" declared"), F.when(F.col("decoded") != F.col("declared"), "   <-- MISMATCH").otherwise(""), F.lit("\n\n"), "label", F.lit(":\n"))
    return heads.join(bodies, FUNCTION).select(*FUNCTION, "label", "signature", "declared", "decoded", F.concat(head, "body").alias("text"))
