"""Writing modules from their trace, and edits of traces. Counts of instructions come from what follows them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.codec import encode_int
from lodestrata.functions.scalars import quote_literal
from lodestrata.operators.relational import first_lines
from lodestrata.sources.files import write_file


def encode_string(value: bytes, dialect: str) -> bytes:
    """A new string, or the empty one, in a dialect."""
    if dialect == "len2":
        return encode_int(2 * len(value)) + value
    return b"\x6e" + encode_int(len(value)) + value if value else b"\0"


def encode_entry(kind: str, num, raw, op, args, dialect: str, n_ops: int) -> bytes:
    match kind:
        case "raw":
            return bytes(raw)
        case "eu":
            return encode_int(int(num))
        case "u32":
            return int(num).to_bytes(4, "big")
        case "i32":
            return int(num).to_bytes(4, "big", signed=True)
        case "strempty":
            return encode_string(b"", dialect)
        case "strnew":
            return encode_string(bytes(raw), dialect) if raw or dialect == "len2" else b"\x6e\0"
        case "strref":
            return encode_int(2 * int(num) + 1) if dialect == "len2" else b"\x72" + encode_int(int(num))
        case "opcount":
            return encode_int(n_ops)
        case "op":
            return bytes([int(op)]) + b"".join(encode_int(int(x)) for x in args)
    raise ValueError(f"trace kind {kind}")


@F.pandas_udf(T.BinaryType())
def _encoded(kind: pd.Series, num: pd.Series, raw: pd.Series, op: pd.Series, args: pd.Series, dialect: pd.Series, n_ops: pd.Series) -> pd.Series:
    return pd.Series([encode_entry(*row) for row in zip(kind, num, raw, op, args, dialect, n_ops, strict=True)])


def written(trace: DataFrame, dialects: DataFrame) -> DataFrame:
    """module_id and content of every traced module: encoded entry by entry, joined in order."""
    back = Window.partitionBy("module_id").orderBy("seq")
    body = F.sum(F.when(F.col("kind") == "opcount", 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0))
    rows = trace.withColumn("_b", body)
    rows = rows.withColumn("_n", F.sum(F.when(F.col("kind") == "op", 1).otherwise(0)).over(Window.partitionBy("module_id", "_b")))
    rows = rows.join(dialects.select("module_id", "dialect"), "module_id")
    rows = rows.select("module_id", "seq", _encoded("kind", F.col("num").cast("string"), "bytes", F.col("op").cast("string"), F.coalesce("operands", F.array().cast("array<long>")), "dialect", "_n").alias("out"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("out").alias("out")))), lambda x: x["out"])
    return rows.groupBy("module_id").agg(F.unhex(F.array_join(parts, "")).alias("content"))


def write_modules(made: DataFrame, folder: str) -> DataFrame:
    """Writes modules (module_id, content) below folder (a path or URI that all executors reach); module_id and place of each.

    A name is that of the module's last part with a digest of all of it, so equal names do not meet.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"module_id": pdf["module_id"], "place": [write_file(folder, n, c) for n, c in zip(pdf["name"], pdf["content"], strict=True)]})

    name = F.concat_ws("_", F.element_at(F.split("module_id", "/"), -1), F.substring(F.sha2("module_id", 256), 1, 8))
    return made.select("module_id", F.concat(name, F.lit(".bin")).alias("name"), "content").mapInPandas(run, "module_id string, place string")


#: Bytes that are compared at once in the search for the first difference.
PIECE = 1 << 12


def _first_difference(a: Column, b: Column) -> Column:
    """The first place at which two binary values differ, the shorter one's length if one begins the other; pieces first, then bytes."""
    most = F.greatest(F.octet_length(a), F.octet_length(b))
    starts = F.sequence(F.lit(0), most, F.lit(PIECE))
    differs = lambda at, n: ~F.substring(a, at + 1, F.lit(n)).eqNullSafe(F.substring(b, at + 1, F.lit(n)))
    piece = F.element_at(F.filter(starts, lambda at: differs(at, PIECE)), 1)
    places = F.sequence(piece, F.least(piece + PIECE - 1, most))
    return F.element_at(F.filter(places, lambda at: differs(at, 1)), 1).cast("long")


def round_trip(rewritten: DataFrame, modules: DataFrame) -> DataFrame:
    """module_id, identical, and the first place that differs (null if none does). A module that was not written differs from its first place on."""
    pairs = modules.select("module_id", F.coalesce("content", F.unhex(F.lit(""))).alias("a")).join(rewritten.select("module_id", F.col("content").alias("b")), "module_id", "left")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return pairs.select("module_id", same.alias("identical"), F.when(~same, _first_difference(F.col("a"), F.coalesce("b", F.unhex(F.lit(""))))).alias("first_difference"))


def literals(trace: DataFrame) -> DataFrame:
    return trace.where("kind = 'strnew'").select("module_id", "seq", F.col("bytes").alias("literal"))


def replace_literal(trace: DataFrame, old: Column, new: Column, most: int | None = None) -> DataFrame:
    """trace with a literal of any length replaced, at its first `most` places of each module or at all."""
    hit = (F.col("kind") == "strnew") & (F.col("bytes") == old)
    nth = F.sum(hit.cast("int")).over(Window.partitionBy("module_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    take = hit if most is None else hit & (nth <= most)
    rows = trace.withColumn("_take", take)
    missed = F.max("_take").over(Window.partitionBy("module_id"))
    new = F.when(missed, new).otherwise(F.raise_error(F.lit("no such literal")).cast("binary"))
    return rows.withColumn("bytes", F.when(F.col("_take") | ~missed, new).otherwise(F.col("bytes"))).drop("_take")


def replace_instructions(trace: DataFrame, edits: DataFrame) -> DataFrame:
    """trace with the instructions at the places of edits (module_id, seq, op, operands) replaced, by a join.

    When the result is read, an edit where no instruction is, and two edits of one place, are errors; edits with a null place do nothing.
    """
    place = ["module_id", "seq"]
    new = edits.select("module_id", F.col("seq").cast("long").alias("seq"), F.col("op").cast("long").alias("_op"), F.col("operands").cast("array<long>").alias("_operands"))
    new = new.where("module_id IS NOT NULL AND seq IS NOT NULL").groupBy(*place).agg(F.count("*").alias("_n"), F.first("_op").alias("_op"), F.first("_operands").alias("_operands"))
    kinds = trace.select(*place, "kind")
    what = F.when(F.col("_n") > 1, "two edits").when(F.col("kind").isNull(), "no entry").otherwise(F.concat("kind", F.lit(", not an instruction,")))
    bad = (F.col("_n") > 1) | F.coalesce(F.col("kind") != "op", F.lit(True))
    said = F.raise_error(F.concat(what, F.lit(" at "), F.col("seq").cast("string"), F.lit(" of "), F.col("module_id"))).cast("boolean")
    # no row passes this condition: it tells of edits that fit nowhere
    misfits = new.join(kinds, place, "left").where(F.when(bad, said).otherwise(F.lit(False))).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in trace.schema))
    hit = F.col("_n").isNotNull()
    rows = trace.join(new, place, "left").withColumns({"op": F.when(hit, F.col("_op")).otherwise(F.col("op")), "operands": F.when(hit, F.col("_operands")).otherwise(F.col("operands"))})
    return rows.select(*trace.columns).unionByName(misfits)


def replace_instruction(trace: DataFrame, module_id: str, seq: int, op: int, operands: list[int]) -> DataFrame:
    """trace with the instruction at seq of one module replaced."""
    edit = trace.sparkSession.createDataFrame([(module_id, seq, op, operands)], "module_id string, seq long, op long, operands array<long>")
    return replace_instructions(trace, edit)


# fixed values: width of places and the words "new-string fields", as in first_lines
def literal_report(trace: DataFrame, limit: int = 20) -> DataFrame:
    """module_id, place and line: how many literals a module has, the first of them, and how many more there are."""
    rows = literals(trace).withColumn("line", F.format_string("  [%6d] %s", "seq", quote_literal(F.decode("literal", "ISO-8859-1"))))
    return first_lines(rows, ["module_id"], "seq", "line", limit, "%d new-string fields")
