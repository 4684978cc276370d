"""Queries over the binary formats: samples are made of the driver's rows, read by the library, and told by SQL from the same rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import tables, variants
from lodestrata.functions.bytes import deflated, inflated, integer_bytes, integer_of
from lodestrata.functions.scalars import byte_entropy, duration, frame_slot, opposite, percent, rarest_byte, rate_and_rest, version_key
from lodestrata.functions.strings import candidates, fresh_by_harvester, string_decrypt, string_encrypt, string_key
from lodestrata.operators import catalog, disasm, lift, rewrite, sketches, validate
from lodestrata.operators.relational import closure, first_lines, globally_ranked, in_ranges, ordered_slice
from lodestrata.plans.base import query
from lodestrata.plans.samples import FLOW, NAMING, OPS, executables, flow_modules, modules, naming_modules, opcode_images
from lodestrata.session import table
from lodestrata.sources import opcodes, overlay, packs, sink
from lodestrata.sources.module import harvested, module_facts, peeked, stored, table_of
from lodestrata.sources.scratch import kept, place
from lodestrata.streaming import sessions

#: The rows that make modules, which of these can be read (whole: to the end), and the strings of each.
MODULES = """
    rows_ AS (SELECT 'm' || c_nationkey || '_' || (c_custkey // 500) AS module_id, c_nationkey AS nation, c_custkey AS k, CAST(round(c_acctbal * 100) AS INTEGER) AS cents, c_name AS name, c_mktsegment AS seg FROM customer),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY module_id) AS n FROM rows_ WHERE k % 5 = 0 AND nation % 7 <> 5),
    readable AS (SELECT DISTINCT module_id, nation, n FROM chosen),
    whole AS (SELECT * FROM readable WHERE nation % 7 <> 3)
"""
#: idx, name and operands of every instruction.
CODE = """
    code AS (SELECT module_id, 'int K' || k || '::get(int)' AS signature, unnest([0, 1, 2, 3]) AS idx, unnest(['SetV4', 'ADDi', 'CpyVtoR4', 'RET']) AS name, unnest(['2 ' || k, '2 2 1', '2', '0']) AS operands FROM chosen
        UNION ALL SELECT module_id, 'void <global>::main()', 2 * i, 'STR', CAST(i AS VARCHAR) FROM chosen
        UNION ALL SELECT module_id, 'void <global>::main()', 2 * i + 1, 'CALLSYS', CAST(i % 3 AS VARCHAR) FROM chosen
        UNION ALL SELECT module_id, 'void <global>::main()', 2 * n, 'RET', '0' FROM readable)
"""
CALLED = "['<global>::print', '<global>::note', NULL][i % 3 + 1]"


def _stored(made: DataFrame, ops: dict[int, dict], *only: str) -> DataFrame:
    """Tables of modules, decoded once; whoever reads one of them reads no other."""
    return stored(made, ops, place(made.sparkSession, "tables"), only or None)


def _tables(spark: SparkSession, d: str, *only: str) -> DataFrame:
    return _stored(modules(spark, d), OPS, *only)


def _made(spark: SparkSession, d: str) -> DataFrame:
    """The modules, written once for queries that also need their bytes."""
    return kept(modules(spark, d), "modules")


def _signed(tables: DataFrame) -> DataFrame:
    return table_of(tables, "functions").select("module_id", F.col("ordinal").alias("function"), "signature")


def _joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), " ")


@query("f01_enum_members", f"WITH {MODULES} SELECT module_id, 'c' || k AS name, CAST(cents AS BIGINT) AS value FROM rows_ SEMI JOIN readable USING (module_id)")
def enum_members(spark: SparkSession, d: str) -> DataFrame:
    return table_of(_tables(spark, d, "enum_members"), "enum_members").select("module_id", "name", "value")


@query("f02_classes", f"WITH {MODULES} SELECT module_id, 'K' || k AS name, 8::BIGINT AS size, false AS is_interface, 2::BIGINT AS properties FROM chosen")
def classes(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "classes", "properties")
    own = table_of(t, "properties").groupBy("module_id", F.col("class").alias("name")).agg(F.count("*").alias("properties"))
    return table_of(t, "classes").join(own, ["module_id", "name"], "left").select("module_id", "name", "size", "is_interface", "properties")


@query(
    "f03_properties",
    f"""
    WITH {MODULES} SELECT module_id, 'K' || k AS class, unnest([0, 1])::BIGINT AS ordinal, unnest(['seg_' || seg, 'bal']) AS name, unnest(['int', 'float']) AS type, unnest([0, 1])::BIGINT AS flags FROM chosen
    """,
)
def properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties with their types' text: data types are rows, references to them numbers."""
    t = _tables(spark, d, "properties", "data_types")
    types = table_of(t, "data_types").select("module_id", F.col("ordinal").alias("type"), F.col("text").alias("shown"))
    return table_of(t, "properties").join(types, ["module_id", "type"]).select("module_id", "class", "ordinal", "name", F.col("shown").alias("type"), "flags")


@query(
    "f04_functions",
    f"""
    WITH {MODULES} SELECT module_id, 'int K' || k || '::get(int)' AS signature, 4::BIGINT AS declared, 1::BIGINT AS n_params, 'K' || k AS owner FROM chosen
    UNION ALL SELECT module_id, 'void <global>::main()', 2 * n + 1, 0, NULL FROM readable
    """,
)
def functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table_of(_tables(spark, d, "functions"), "functions").where("body_end IS NOT NULL")
    return rows.select("module_id", "signature", "declared", "n_params", F.col("owner_text").alias("owner"))


@query("f05_instructions", f"WITH {MODULES}, {CODE} SELECT module_id, signature, CAST(idx AS BIGINT) AS idx, name, operands FROM code")
def instructions(spark: SparkSession, d: str) -> DataFrame:
    t = _tables(spark, d, "instructions", "functions")
    rows = table_of(t, "instructions").join(F.broadcast(disasm.dimension(spark, OPS)), "op").join(_signed(t), ["module_id", "function"])
    return rows.select("module_id", "signature", "idx", "name", _joined(F.col("operands")).alias("operands"))


@query("f06_spans", f"WITH {MODULES}, {CODE} SELECT module_id, signature, CAST(idx AS BIGINT) AS idx, name, operands FROM code")
def spans(spark: SparkSession, d: str) -> DataFrame:
    """The same by spans: each body is decoded by itself, so bodies of one module are spread."""
    made = _made(spark, d)
    t = _stored(made, OPS, "functions", "global_properties")
    rows = disasm.spans(disasm.bodies(t, made), OPS).join(_signed(t), ["module_id", "function"])
    return rows.select("module_id", "signature", "idx", "name", _joined(F.col("operands")).alias("operands"))


_NAMED = ("instructions", "functions", "used_functions", "used_strings", "used_global_props", "used_type_ids", "used_types", "used_object_props", "properties")


@query(
    "f07_operands",
    f"""
    WITH {MODULES} SELECT module_id, 2 * i AS idx, 'STR' AS name, '"' || name || '"' AS text FROM chosen
    UNION ALL SELECT module_id, 2 * i + 1, 'CALLSYS', {CALLED} FROM chosen
    """,
)
def resolved_operands(spark: SparkSession, d: str) -> DataFrame:
    """Operands by name; the third function does not exist, so its text is null."""
    return disasm.resolved(_tables(spark, d, *_NAMED), OPS).where("role IS NOT NULL").select("module_id", "idx", "name", "text")


@query(
    "f08_resolution",
    f"""
    WITH {MODULES}, c AS (SELECT module_id, 2 * count(*) AS n, count(*) + count(*) FILTER (i % 3 < 2) AS n_resolved FROM chosen GROUP BY module_id)
    SELECT *, round(100.0 * n_resolved / n, 6) AS pct FROM c
    """,
)
def resolution(spark: SparkSession, d: str) -> DataFrame:
    return disasm.resolution(disasm.resolved(_tables(spark, d, *_NAMED), OPS), ["module_id"])


@query("f09_callers", f"WITH {MODULES} SELECT module_id, '<global>::main' AS label FROM readable")
def callers(spark: SparkSession, d: str) -> DataFrame:
    return disasm.callers_of(_tables(spark, d, "instructions", "functions", "used_functions"), OPS, "PRINT").select("module_id", "label")


@query("f10_found", f"WITH {MODULES} SELECT module_id, 'K' || k || '::get' AS label FROM chosen WHERE contains('k' || k || '::get', '5::g')")
def found(spark: SparkSession, d: str) -> DataFrame:
    return disasm.find(_tables(spark, d, "functions"), "5::G").select("module_id", "label")


@query(
    "f11_lifted",
    rf"""
    WITH {MODULES}, said AS (SELECT module_id, i, '    ret = ' || CASE i % 3 WHEN 2 THEN 'callsys#2(...)' ELSE ['print', 'note'][i % 3 + 1] || '("' || name || '", <len>)' END || ';' AS line FROM chosen),
    bodies AS (SELECT module_id, string_agg(line, chr(10) ORDER BY i) AS body, 3 * count(*) FILTER (i % 3 = 2) AS residue, 2 * count(*) + 1 AS n FROM said GROUP BY module_id)
    SELECT module_id, 'K' || k || '::get' AS label, '// 4 instructions, 0 passthrough, 0 stack residue' || chr(10) || 'int K' || k || '::get(int)' || chr(10) || '{{' || chr(10)
        || '    v2 = ' || k || ';' || chr(10) || '    v2 = v2 + a0;' || chr(10) || '    return v2;' || chr(10) || '}}' AS text, 0::BIGINT AS residue FROM chosen
    UNION ALL SELECT module_id, '<global>::main', '// ' || n || ' instructions, 0 passthrough, ' || residue || ' stack residue' || chr(10) || 'void <global>::main()' || chr(10) || '{{' || chr(10)
        || body || chr(10) || '    return;' || chr(10) || '}}', residue FROM bodies
    """,
)
def lifted(spark: SparkSession, d: str) -> DataFrame:
    return lift.lifted(_tables(spark, d, *_NAMED), OPS).select("module_id", "label", "text", "residue")


@query(
    "f12_lift_totals",
    f"""
    WITH {MODULES}, c AS (SELECT (SELECT count(*) FROM chosen) AS k, (SELECT count(*) FROM readable) AS m, (SELECT count(*) FROM chosen WHERE i % 3 = 2) AS u)
    SELECT k + m AS functions, 6 * k + m AS instructions, 0::BIGINT AS passthrough, 0.0::DOUBLE AS passthrough_pct, 3 * u AS residue, 0::BIGINT AS gotos, k + m AS blocks, 0::BIGINT AS failed FROM c
    """,
)
def lift_totals(spark: SparkSession, d: str) -> DataFrame:
    return lift.totals(lift.lifted(_tables(spark, d, *_NAMED), OPS))


@query(
    "f13_lift_quality",
    f"""
    WITH {MODULES} SELECT module_id, count(*) + 1 AS functions, count(*) + CAST(count(*) < 3 AS INTEGER) AS empty_stack, 6 * count(*) + 1 AS instructions, 0::BIGINT AS passthrough, 0::BIGINT AS gotos, count(*) + 1 AS goto_free FROM chosen GROUP BY module_id
    """,
)
def lift_quality(spark: SparkSession, d: str) -> DataFrame:
    return lift.quality(lift.lifted(_tables(spark, d, *_NAMED), OPS))


@query(
    "f14_listing",
    f"""
    WITH {MODULES}, {CODE}, notes AS (SELECT module_id, 'void <global>::main()' AS signature, 2 * i AS idx, '"' || name || '"' AS note FROM chosen UNION ALL SELECT module_id, 'void <global>::main()', 2 * i + 1, {CALLED} FROM chosen),
    lines AS (SELECT c.*, rtrim('    ' || rpad(c.name, 10, ' ') || ' ' || operands) AS line, note FROM code c LEFT JOIN notes USING (module_id, signature, idx)),
    bodies AS (SELECT module_id, signature, count(*) AS n, string_agg(CASE WHEN note IS NULL THEN line ELSE rpad(line, 32, ' ') || ' ; ' || note END, chr(10) ORDER BY idx) AS body FROM lines GROUP BY module_id, signature)
    SELECT module_id, signature, '; === ' || signature || ' ===' || chr(10) || '; instructions: ' || n || ' decoded / ' || n || ' declared' || chr(10) || chr(10)
        || regexp_replace(regexp_replace(signature, '^[a-z]+ ', ''), '\\(.*$', '') || ':' || chr(10) || body AS text FROM bodies
    """,
)
def listing(spark: SparkSession, d: str) -> DataFrame:
    return disasm.listing(_tables(spark, d, *_NAMED), OPS).select("module_id", "signature", "text")


@query("f15_round_trip", f"WITH {MODULES} SELECT module_id, true AS identical, CAST(NULL AS BIGINT) AS first_difference FROM whole")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Modules written from their traces, byte for byte."""
    made = _made(spark, d)
    t = _stored(made, OPS, "trace")
    facts = module_facts(t).where("reached = 'tail'").select("module_id", "dialect")
    return rewrite.round_trip(rewrite.written(table_of(t, "trace"), facts), made.join(facts, "module_id", "left_semi"))


@query(
    "f16_first_difference",
    f"WITH {MODULES} SELECT module_id, false AS identical, CASE WHEN n % 2 = 0 THEN 0 ELSE 9 END::BIGINT AS first_difference FROM whole",
)
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    """Modules against others that differ in one byte."""
    rows = _made(spark, d)
    t = _stored(rows, OPS, "classes")
    n = table_of(t, "classes").groupBy("module_id").agg(F.count("*").alias("n")).join(module_facts(t).where("reached = 'tail'"), "module_id", "left_semi")
    at = F.when(F.col("n") % 2 == 0, 0).otherwise(9)
    other = F.concat(F.substring("content", F.lit(1), at), F.unhex(F.lit("FF")), F.substring("content", at + 2, F.octet_length("content")))
    whole = rows.join(n, "module_id")
    return rewrite.round_trip(whole.select("module_id", other.alias("content")), whole)


@query(
    "f17_renamed",
    f"WITH {MODULES} SELECT module_id, 'void <global>::a_longer_name()' AS signature FROM whole",
)
def renamed(spark: SparkSession, d: str) -> DataFrame:
    """A literal replaced by a longer one, the module written again and read again."""
    t = _tables(spark, d, "trace")
    facts = module_facts(t).where("reached = 'tail'").select("module_id", "dialect")
    trace = table_of(t, "trace").join(facts, "module_id", "left_semi")
    trace = rewrite.replace_literal(trace, F.lit(bytearray(b"main")), F.lit(bytearray(b"a_longer_name")))
    again = _stored(rewrite.written(trace, facts), OPS, "functions")
    return table_of(again, "functions").where("owner IS NULL AND body_end IS NOT NULL").select("module_id", "signature")


@query(
    "f18_edited",
    f"""
    WITH {MODULES}, {CODE}, one AS (SELECT min(module_id) AS m FROM whole), firsts AS (SELECT min(k) AS k FROM chosen JOIN one ON module_id = m)
    SELECT module_id, signature, CAST(idx AS BIGINT) AS idx, name, CASE WHEN module_id = m AND name = 'SetV4' AND operands = '2 ' || firsts.k THEN '2 777' ELSE operands END AS operands FROM code SEMI JOIN whole USING (module_id), one, firsts
    """,
)
def edited(spark: SparkSession, d: str) -> DataFrame:
    """One instruction of one module replaced; every other module stays."""
    t = _tables(spark, d, "trace")
    facts = module_facts(t).where("reached = 'tail'").select("module_id", "dialect")
    trace = table_of(t, "trace").join(facts, "module_id", "left_semi")
    first = trace.where(F.col("kind") == "op").where(F.col("op") == 3).agg(F.min(F.struct("module_id", "seq")).alias("x"))
    trace = rewrite.replace_instructions(trace, first.selectExpr("x.module_id", "x.seq", "3 AS op", "array(2, 777) AS operands"))
    again = _stored(rewrite.written(trace, facts), OPS, "functions", "instructions")
    rows = table_of(again, "instructions").join(F.broadcast(disasm.dimension(spark, OPS)), "op").join(_signed(again), ["module_id", "function"])
    return rows.select("module_id", "signature", "idx", "name", _joined(F.col("operands")).alias("operands"))


@query(
    "f19_literal_report",
    f"""
    WITH {MODULES}, c AS (SELECT module_id, 6 * n + nation % 2 + 7 + (SELECT count(*) FROM rows_ r WHERE r.module_id = w.module_id) AS t FROM whole w)
    SELECT module_id, 'lines' AS what, least(t, 22) + 1 AS n FROM c UNION ALL SELECT module_id, 'more', CASE WHEN t > 21 THEN t - 21 END FROM c
    """,
)
def literal_report(spark: SparkSession, d: str) -> DataFrame:
    """How many lines the report of a module's literals has, and how many literals it says are left."""
    t = _tables(spark, d, "trace")
    rows = rewrite.literal_report(table_of(t, "trace").join(module_facts(t).where("reached = 'tail'"), "module_id", "left_semi"), 21)
    more = F.regexp_extract("line", r"^  \.\.\. (\d+) more$", 1)
    counts = rows.groupBy("module_id").agg(F.count("*").alias("lines"), F.max(F.nullif(more, F.lit("")).cast("long")).alias("more"))
    each = F.explode(F.array(F.struct(F.lit("lines").alias("what"), F.col("lines").alias("n")), F.struct(F.lit("more").alias("what"), F.col("more").alias("n"))))
    return counts.select("module_id", each.alias("x")).select("module_id", "x.*")


_STATES = f"""{MODULES}, every AS (SELECT DISTINCT module_id, nation FROM rows_),
    states AS (SELECT module_id, CASE WHEN module_id IN (SELECT module_id FROM whole) THEN 'whole' WHEN module_id IN (SELECT module_id FROM readable) THEN 'cut' ELSE 'unread' END AS state FROM every),
    marks AS (SELECT state, unnest(['unpack', 'dialect', 'enums', 'classes', 'funcdefs', 'opcodes', 'blocks', 'tail', 'disasm', 'rewrite']) AS stage,
        unnest(CASE state WHEN 'whole' THEN [true, true, true, true, true, true, true, true, true, true] WHEN 'cut' THEN [true, true, true, true, true, true, true, false, NULL, NULL]
            ELSE [true, false, NULL, NULL, NULL, true, NULL, NULL, NULL, NULL] END) AS ok FROM (VALUES ('whole'), ('cut'), ('unread')) v(state))"""


def _stages(spark: SparkSession, d: str) -> DataFrame:
    made = _made(spark, d)
    return validate.stages(made.select("module_id", "content"), _stored(made, OPS), OPS)


@query("f20_stages", f"WITH {_STATES} SELECT module_id, stage, ok FROM states JOIN marks USING (state)")
def stages(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d)


@query(
    "f21_stage_totals",
    f"""
    WITH {_STATES} SELECT stage, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok IS NULL) AS not_reached FROM states JOIN marks USING (state) GROUP BY stage
    """,
)
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    return validate.totals(_stages(spark, d))


@query("f22_passed", f"WITH {_STATES} SELECT count(*) FILTER (state = 'whole') AS n_passed, count(*) AS n_modules FROM states")
def passed(spark: SparkSession, d: str) -> DataFrame:
    return validate.passed(_stages(spark, d))


@query(
    "f23_status",
    f"WITH {_STATES} SELECT module_id, CASE state WHEN 'whole' THEN 'PASS' ELSE 'FAIL' END AS status, CASE state WHEN 'whole' THEN 'ok' WHEN 'cut' THEN 'FAIL' ELSE '-' END AS tail FROM states",
)
def status(spark: SparkSession, d: str) -> DataFrame:
    return validate.report(_stages(spark, d)).select("module_id", "status", "tail")


@query(
    "f24_summary",
    f"""
    WITH {MODULES} SELECT module_id, 1::BIGINT AS enums, (SELECT count(*) FROM rows_ r WHERE r.module_id = w.module_id) AS enum_members, n AS classes, n + 1 AS bodies, n AS blocks,
        CASE WHEN nation % 7 = 1 THEN n ELSE 0 END AS parse_errors, 2::BIGINT AS used_functions, n AS used_strings, CASE WHEN nation % 7 = 3 THEN 0 ELSE 1 END::BIGINT AS used_object_props FROM readable w
    """,
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each module, those of enum members and parse errors among them."""
    columns = ("enums", "enum_members", "classes", "bodies", "blocks", "parse_errors", "used_functions", "used_strings", "used_object_props")
    return validate.summary(_tables(spark, d, *validate.COUNTED)).where("dialect IS NOT NULL").select("module_id", *columns)


@query(
    "f25_sections",
    f"""
    WITH {MODULES} SELECT module_id, unnest(['typedefs', 'global properties', 'module functions', 'global functions', 'bind info', 'used types', 'used type ids', 'used functions', 'used global properties', 'used strings', 'used object properties']) AS name,
        unnest([0, 0, 1, 0, 0, 1, 1, 2, 1, n, 1])::BIGINT AS n FROM readable
    """,
)
def sections(spark: SparkSession, d: str) -> DataFrame:
    return table_of(_tables(spark, d, "sections"), "sections").where("name NOT LIKE 'class %'").select("module_id", "name", "n")


@query(
    "f26_names",
    f"""
    WITH {MODULES} SELECT module_id, 'function' AS kind, unnest([0, 1])::BIGINT AS ordinal, unnest(['<global>::print', '<global>::note']) AS text FROM readable
    UNION ALL SELECT module_id, 'string', i, '"' || name || '"' FROM chosen UNION ALL SELECT module_id, 'global', 0, 'g' || nation FROM readable
    UNION ALL SELECT module_id, 'typeid', 0, 'uint' FROM readable UNION ALL SELECT module_id, 'objtype', 0, 'K' || k FROM chosen WHERE i = 0
    UNION ALL SELECT module_id, 'objprop', 0, CASE WHEN nation % 2 = 0 THEN 'K::prop[0]' ELSE 'K::x' END FROM whole
    """,
)
def names(spark: SparkSession, d: str) -> DataFrame:
    """Everything that an operand can name."""
    return disasm.names(_tables(spark, d, *_NAMED)).select(F.col("_m").alias("module_id"), F.col("_nt").alias("kind"), F.col("_no").alias("ordinal"), F.col("_text").alias("text"))


@query("f27_harvested", f"WITH {MODULES} SELECT module_id, name AS literal FROM chosen")
def harvest(spark: SparkSession, d: str) -> DataFrame:
    """Of the literals at any offset, those that are customers' names."""
    known = table(spark, d, "customer").select(F.col("c_name").alias("literal"))
    return harvested(modules(spark, d)).select("module_id", F.decode("literal", "ISO-8859-1").alias("literal")).join(known, "literal", "left_semi").select("module_id", "literal")


@query(
    "f28_peeked",
    """
    SELECT DISTINCT 'm' || c_nationkey || '_' || (c_custkey // 500) AS module_id, CASE WHEN c_nationkey % 7 <> 5 THEN false END AS no_debug, CASE WHEN c_nationkey % 7 <> 5 THEN 1 END::BIGINT AS enums,
        CASE WHEN c_nationkey % 7 <> 5 THEN ['len2', 'tagged'][c_nationkey % 2 + 1] END AS dialect FROM customer
    """,
)
def peek(spark: SparkSession, d: str) -> DataFrame:
    return peeked(modules(spark, d))


@query(
    "f29_parse_errors",
    f"WITH {MODULES} SELECT module_id, 'K' || k || ' method 0' AS context, true AS skipped FROM chosen WHERE nation % 7 = 1",
)
def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """A body with an unknown operation costs one function: its module is read on from the next."""
    return table_of(_tables(spark, d, "parse_errors"), "parse_errors").select("module_id", "context", (F.col("skipped") > 0).alias("skipped"))


@query(
    "f30_integers",
    """
    WITH v AS (SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (CAST(l_quantity AS BIGINT) ** (l_linenumber + 2))::BIGINT AS value FROM lineitem)
    SELECT *, CASE WHEN abs(value) < 64 THEN 1 WHEN abs(value) < 8192 THEN 2 WHEN abs(value) < 1048576 THEN 3 WHEN abs(value) < 134217728 THEN 4 WHEN abs(value) < 17179869184 THEN 5
        WHEN abs(value) < 2199023255552 THEN 6 WHEN abs(value) < 281474976710656 THEN 7 ELSE 9 END::BIGINT AS width FROM v
    """,
)
def integers(spark: SparkSession, d: str) -> DataFrame:
    """Integers encoded and decoded."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    power = F.aggregate(F.sequence(F.lit(1), n + 2), F.lit(1).cast("long"), lambda acc, _: acc * q)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", integer_bytes(F.when(n % 2 == 0, -power).otherwise(power)).alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", integer_of("raw").alias("value"), F.octet_length("raw").cast("long").alias("width"))


@query("f31_blobs", "SELECT conv_id, turn, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha, CASE WHEN length(text) >= 400 THEN true END AS shorter FROM conversations")
def blobs(spark: SparkSession, d: str) -> DataFrame:
    """Texts compressed and expanded again; long ones get shorter, as their words repeat. Of others it is not told."""
    rows = table(spark, d, "conversations")
    rows = rows.withColumn("raw", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).withColumn("blob", deflated("raw")).withColumn("back", inflated("blob"))
    return rows.select("conv_id", "turn", F.octet_length("back").cast("long").alias("size"), F.sha2("back", 256).alias("sha"), F.when(F.length("text") >= 400, F.octet_length("blob") < F.octet_length("raw")).alias("shorter"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """A pack for each conversation, with an entry for each turn."""
    rows = table(spark, d, "conversations").select(F.format_string("c%d", "conv_id").alias("pack"), F.col("turn").alias("ordinal"), F.format_string("%d/%s", "turn", "role").alias("name"), F.encode("text", "UTF-8").alias("data"))
    return packs.from_files(packs.built(rows).withColumnRenamed("pack", "path"))


_ENTRIES = "SELECT 'c' || conv_id AS pack, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, turn || '/' || role AS name, role, text, octet_length(encode(text)) AS size FROM conversations"


@query("f32_packs", f"SELECT pack, CAST(ordinal AS INTEGER) AS ordinal, name, size::BIGINT AS size, sha256(text) AS sha FROM ({_ENTRIES})")
def pack_entries(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("pack", "ordinal", "name", "size", F.sha2("data", 256).alias("sha"))


def _in_folder(spark: SparkSession, d: str, split: int) -> tuple[str, DataFrame]:
    """A folder with a pack for each seventh part of the conversations and role, written by the sink, and its reader."""
    folder = place(spark, "packs")
    rows = table(spark, d, "conversations").select(
        F.format_string("%s/p%d.pack", "role", F.col("conv_id") % 7).alias("pack"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"),
        F.format_string("%d/%d", "conv_id", "turn").alias("name"), F.encode("text", "UTF-8").alias("data"),
    )
    packs.register(spark)
    packs.packed_rows(rows).write.format("pack").mode("append").save(folder)
    return folder, packs.load(spark, folder, split)


_FOLDER = "SELECT role || '/p' || (conv_id % 7) || '.pack' AS pack, row_number() OVER (PARTITION BY role, conv_id % 7 ORDER BY conv_id, turn) - 1 AS ordinal, conv_id || '/' || turn AS name, coalesce(text, '') AS text FROM conversations"


@query("f59_pack_sink", f"SELECT pack, CAST(ordinal AS INTEGER) AS ordinal, name, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha FROM ({_FOLDER})")
def pack_sink(spark: SparkSession, d: str) -> DataFrame:
    """Packs written to a folder by the sink and read again in parts of 16 KB."""
    folder, rows = _in_folder(spark, d, 1 << 14)
    return rows.select(F.substring_index("pack", "/", -2).alias("pack"), "ordinal", "name", "size", F.sha2("data", 256).alias("sha"))


@query("f60_pack_pushdown", f"SELECT pack, CAST(ordinal AS INTEGER) AS ordinal, name, sha256(text) AS sha FROM ({_FOLDER}) WHERE name LIKE '1%' AND ordinal < 20 AND octet_length(encode(text)) > 60")
def pack_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """Of those packs the entries that conditions on the directory leave; the data of others is not read."""
    rows = _in_folder(spark, d, 1 << 20)[1].where(F.col("name").startswith("1") & (F.col("ordinal") < 20) & (F.col("size") > 60))
    return rows.select(F.substring_index("pack", "/", -2).alias("pack"), "ordinal", "name", F.sha2("data", 256).alias("sha"))


@query("f61_files_sink", f"SELECT pack || '/' || name AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha FROM ({_FOLDER})")
def files_sink(spark: SparkSession, d: str) -> DataFrame:
    """Entries of those packs extracted to a file each, all or none, and read as files."""
    folder = place(spark, "files")
    sink.register(spark)
    names = F.concat_ws("/", F.substring_index("pack", "/", -2), "name").alias("name")
    _in_folder(spark, d, 1 << 20)[1].select(names, "data").write.format("files").mode("append").save(folder)
    rows = overlay.read_files(spark, f"{folder}/*/*/*/*")
    return rows.select(F.substring_index("path", "/", -4).alias("path"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha"))


def _key(role: Column) -> Column:
    return F.unhex(F.sha2(role, 256))


def _sealed(spark: SparkSession, d: str) -> DataFrame:
    """Packs whose entries are encrypted under their role's key, but for each first one."""
    rows = _packed(spark, d)
    return rows.withColumn("data", F.when(F.col("ordinal") > 0, packs.seal(F.col("data"), _key(F.regexp_extract("name", "/(.*)$", 1)))).otherwise(F.col("data"))).withColumn("size", F.octet_length("data").cast("long"))


_SEALED = f"s AS (SELECT *, ordinal > 0 AS encrypted, CASE WHEN ordinal > 0 THEN 32 + (size + 15) // 16 * 16 ELSE size END AS stored FROM ({_ENTRIES}))"


@query(
    "f33_opened",
    f"WITH {_SEALED} SELECT pack, name, encrypted, size::BIGINT AS plain_size, CASE WHEN NOT encrypted OR role = 'assistant' THEN sha256(text) END AS sha FROM s",
)
def opened(spark: SparkSession, d: str) -> DataFrame:
    """Entries opened with the key of one role; others stay shut."""
    return packs.opened(_sealed(spark, d), _key(F.lit("assistant"))).select("pack", "name", "encrypted", F.col("plain_size").cast("long").alias("plain_size"), F.sha2("plain", 256).alias("sha"))


@query(
    "f34_pack_counts",
    f"""
    WITH {_SEALED} SELECT pack, count(*) AS n_entries, count(*) FILTER (encrypted) AS n_encrypted, count(DISTINCT role) FILTER (encrypted) AS n_keys, sum(stored)::BIGINT AS n_bytes,
        coalesce(sum(size) FILTER (encrypted), 0)::BIGINT AS n_plain FROM s GROUP BY pack
    """,
)
def pack_counts(spark: SparkSession, d: str) -> DataFrame:
    return packs.counted(_sealed(spark, d))


@query("f35_key_matches", f"WITH {_SEALED} SELECT pack, name, role FROM s WHERE encrypted AND role IN ('user', 'assistant')")
def key_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which supplied key opens which entry: a join on tags."""
    keys = spark.createDataFrame([("user",), ("assistant",), ("nobody",)], "role string").select("role", _key(F.col("role")).alias("key"))
    hit = packs.key_matches(_sealed(spark, d), keys).select("pack", "name", "key")
    return hit.join(F.broadcast(keys), "key").select("pack", "name", "role")


@query("f36_tag_groups", f"WITH {_SEALED} SELECT count(*) AS n, sha256(string_agg(DISTINCT name, ',' ORDER BY name)) AS names FROM s WHERE encrypted GROUP BY role")
def tag_groups(spark: SparkSession, d: str) -> DataFrame:
    return packs.tag_groups(_sealed(spark, d)).select("n", F.sha2(F.array_join("names", ","), 256).alias("names"))


@query(
    "f37_pack_listing",
    f"""
    WITH {_SEALED}, t AS (SELECT *, count(*) OVER (PARTITION BY pack) AS n FROM s)
    SELECT pack, ordinal + 1 AS place, CASE WHEN ordinal < 2 THEN printf('   %-52s %9d B%s', substring(name, 1, 52), stored, CASE WHEN encrypted THEN '  SWCR' ELSE '' END) ELSE printf('  ... %d more', n - 2) END AS line FROM t WHERE ordinal <= 2
    UNION ALL SELECT pack, 0, printf('%d entries', n) FROM t WHERE ordinal = 0
    """,
)
def pack_listing(spark: SparkSession, d: str) -> DataFrame:
    return packs.listing(_sealed(spark, d), 2)


@query(
    "f38_replaced",
    f"WITH {_SEALED} SELECT pack, CAST(ordinal AS INTEGER) AS ordinal, name, CASE WHEN name = '1/assistant' THEN 'a new text' WHEN NOT encrypted OR role = 'assistant' THEN text END AS plain FROM s",
)
def replaced(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a name replaced under their key, packs built and read again."""
    new = spark.createDataFrame([("1/assistant", bytearray(b"a new text"))], "name string, new_data binary")
    key = _key(F.lit("assistant"))
    again = packs.from_files(packs.built(packs.replaced(_sealed(spark, d), new, key)).withColumnRenamed("pack", "path"))
    return packs.opened(again, key).select("pack", "ordinal", "name", F.decode("plain", "UTF-8").alias("plain"))


@query("f39_wrapped", "SELECT conv_id, turn, CASE WHEN length(text) > 0 AND turn % 3 <> 2 THEN text END AS text FROM conversations")
def wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Strings wrapped and encrypted under a password and opened with it; each third is tried with another one."""
    key = lambda p: string_key(F.encode(p, "UTF-8"))
    rows = table(spark, d, "conversations").withColumn("shut", string_encrypt(F.encode("text", "UTF-8"), key(F.col("role"))))
    back = string_decrypt(F.col("shut"), key(F.when(F.col("turn") % 3 == 2, "wrong").otherwise(F.col("role"))))
    return rows.select("conv_id", "turn", F.decode(back, "UTF-8").alias("text"))


@query(
    "f40_unpacked",
    """
    SELECT 'n' || n_nationkey || '.exe' AS path, CASE WHEN n_nationkey % 6 <> 5 THEN CASE WHEN n_nationkey % 2 = 1 THEN 17 ELSE n_nationkey + 1 END END AS seed, CASE WHEN n_nationkey % 6 <> 5 THEN 'EMB' END AS embedded,
        CASE WHEN n_nationkey % 6 <> 5 THEN repeat(n_name || ' ', 40) END AS bytecode, CASE WHEN n_nationkey % 6 <> 5 THEN 512 END::BIGINT AS overlay_offset, CASE WHEN n_nationkey % 6 = 5 THEN 'no trailer' END AS error FROM nation
    """,
)
def unpacked(spark: SparkSession, d: str) -> DataFrame:
    """Trailer, overlay, seed, container and blob of executables; one that is cut short has a reason."""
    rows = overlay.unpacked(executables(spark, d))
    return rows.select("path", "seed", F.decode("embedded", "UTF-8").alias("embedded"), F.decode("bytecode", "UTF-8").alias("bytecode"), "overlay_offset", "error")


@query(
    "f41_opcodes",
    """
    WITH o AS (SELECT r_regionkey AS r, unnest(range(0, 10 + r_regionkey)) AS op FROM region)
    SELECT 'r' || r || '.exe' AS path, op, 'R' || r || 'Op' || op AS name, op % 20 + 1 AS type, -op AS "stackInc", [0, 1, 1, 1, 2, 1, 2, 3, 2, 2, 1, 2, 3, 2, 2, 2, 2, 2, 3, 3][op % 20 + 1]::BIGINT AS operands,
        [1, 1, 1, 2, 2, 3, 3, 2, 3, 2, 1, 2, 3, 2, 2, 4, 3, 2, 3, 3][op % 20 + 1]::BIGINT AS dwords FROM o
    """,
)
def opcode_tables(spark: SparkSession, d: str) -> DataFrame:
    return opcodes.tables(opcode_images(spark, d)).drop("error")


_SIZE = "512 + (5 + sum(length('R' || r || 'Op' || op) + 1) + 3) // 4 * 4 + 16 * (count(*) + 1) + 64"


@query(
    "f42_pe_sections",
    f"""
    WITH o AS (SELECT r_regionkey AS r, unnest(range(0, 10 + r_regionkey)) AS op FROM region)
    SELECT 'r' || r || '.exe' AS path, 4194304::BIGINT AS base, 4096::BIGINT AS rva, ({_SIZE})::BIGINT AS size, 512::BIGINT AS place FROM o GROUP BY r
    """,
)
def pe_sections(spark: SparkSession, d: str) -> DataFrame:
    return opcodes.section_tables(opcode_images(spark, d)).drop("error")


@query(
    "f43_located",
    f"""
    WITH o AS (SELECT r_regionkey AS r, unnest(range(0, 10 + r_regionkey)) AS op FROM region), sizes AS (SELECT r, {_SIZE} AS size FROM o GROUP BY r),
    x AS (SELECT r, size, unnest(range(0, 60)) * 37 - 500 AS x FROM sizes)
    SELECT 'r' || r || '.exe' AS path, 4194304 + 4096 + x AS address, 512 + x AS at, CASE x WHEN 536 - 24 THEN 'Zero' END AS text FROM x WHERE x >= 0 AND x < size AND (512 + x) % 2 = 0 AND x < 512
    """,
)
def located(spark: SparkSession, d: str) -> DataFrame:
    """Addresses to places in the file, by a range join with sections, and the names that stand there."""
    files = opcode_images(spark, d)
    asked = files.select("path", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i")).select("path", (4194304 + 4096 - 500 + F.col("i").cast("long") * 37).alias("address"))
    places = opcodes.located(asked, opcodes.section_tables(files)).where("at % 2 = 0 AND at < 1024")
    return opcodes.strings_at(places, files)


@query(
    "f44_byte_entropy",
    """
    WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part WHERE length(p_name) > 0), f AS (SELECT p_partkey, ch, count(*) AS n FROM c GROUP BY ALL),
    p AS (SELECT p_partkey, n, sum(n) OVER (PARTITION BY p_partkey) AS total FROM f)
    SELECT p_partkey, round(abs(sum(n / total * log2(n / total))), 6) AS entropy FROM p GROUP BY p_partkey
    """,
)
def bytes_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.length("p_name") > 0).select("p_partkey", F.round(F.abs(byte_entropy(F.encode("p_name", "UTF-8"))), 6).alias("entropy"))


@query("f45_rarest_byte", "SELECT s_suppkey, CAST(s_suppkey % 200 + 1 AS INTEGER) AS byte, 1::BIGINT AS n FROM supplier")
def rarest_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The escape of a compressor: all bytes once, and those up to a number once more."""
    every = F.unhex(F.lit("".join(f"{i:02X}" for i in range(256))))
    data = F.concat(every, F.substring(every, F.lit(1), (F.col("s_suppkey") % 200 + 1).cast("int")))
    return table(spark, d, "supplier").select("s_suppkey", rarest_byte(data).alias("r")).select("s_suppkey", "r.*")


@query(
    "f46_progress",
    """
    SELECT o_orderkey, printf('%.1f%%', 100.0 * (o_orderkey % 97) / 97) AS share, CASE WHEN s < 90 THEN printf('%ds', s) WHEN s < 5400 THEN printf('%dm', s // 60) ELSE printf('%.1fh', s / 3600.0) END AS lasts,
        round(CASE WHEN o_orderkey % 97 > 0 THEN (97 - o_orderkey % 97) / ((o_orderkey % 97) / 50.0) ELSE 0 END, 6)::DOUBLE AS rest FROM (SELECT o_orderkey, (o_orderkey % 200) * 360 + 7 AS s FROM orders)
    """,
)
def progress(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rest = rate_and_rest((k % 97).cast("double"), F.lit(97.0), F.lit(50.0))["rest"]
    return table(spark, d, "orders").select("o_orderkey", percent(k % 97, F.lit(97)).alias("share"), duration((k % 200) * 360 + 7).alias("lasts"), F.round(rest, 6).alias("rest"))


@query(
    "f47_versions",
    "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all('v' || p_size || '.0' || p_partkey || '-rc', '[0-9]+'), lambda x: CAST(x AS BIGINT)), '.') AS version, rank() OVER (ORDER BY p_size, p_partkey) AS place FROM part",
)
def versions(spark: SparkSession, d: str) -> DataFrame:
    """Names in the order of the numbers in them."""
    rows = globally_ranked(table(spark, d, "part"), {"key": version_key(F.format_string("v%d.0%d-rc", "p_size", "p_partkey"))})
    return rows.select("p_partkey", F.array_join(F.transform("key", lambda x: x.cast("string")), ".").alias("version"), "place")


@query(
    "f56_nested_ranges",
    """
    WITH s AS (SELECT s_suppkey, s_suppkey * 29 - 700 AS lo, CASE WHEN s_suppkey % 10 = 0 THEN 1000000 WHEN s_suppkey % 3 = 0 THEN (s_suppkey * s_suppkey) % 9000 ELSE s_suppkey % 64 END AS n FROM supplier)
    SELECT s_suppkey, count(*) AS n_orders, min(o_orderkey) AS first, max(o_orderkey) AS last FROM s JOIN orders ON o_orderkey - 300 >= lo AND o_orderkey - 300 < lo + n GROUP BY s_suppkey
    """,
)
def nested_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Points in ranges of all widths, some of which hold nearly everything; no plan of comparisons depends on the widest."""
    s = F.col("s_suppkey")
    wide = F.when(s % 10 == 0, F.lit(1000000)).when(s % 3 == 0, (s * s) % 9000).otherwise(s % 64)
    spans_ = table(spark, d, "supplier").select("s_suppkey", (s * 29 - 700).alias("lo"), wide.alias("n"))
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") - 300).alias("at"))
    return in_ranges(points, spans_, "at", "lo", "n").groupBy("s_suppkey").agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("f57_line_ranks", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity DESC, l_returnflag) AS place FROM lineitem")
def line_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Few keys that thousands of rows share, ranked over all rows."""
    return globally_ranked(table(spark, d, "lineitem"), {"most": -F.col("l_quantity"), "flag": F.col("l_returnflag")}).select("l_orderkey", "l_linenumber", "place")


@query("f58_page_of_orders", "SELECT o_orderkey, o_totalprice, place FROM (SELECT *, rank() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders) WHERE place >= 101 AND place < 151")
def page_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Places 101 to 150 of a global order."""
    return ordered_slice(table(spark, d, "orders"), {"price": F.col("o_totalprice"), "key": F.col("o_orderkey")}, 101, 151).select("o_orderkey", "o_totalprice", "place")


@query(
    "f48_negated",
    """
    WITH c AS (SELECT n_nationkey AS k, ['==', '!=', '<', '>=', '>', '<='][n_nationkey % 6 + 1] AS sign, ['!=', '==', '>=', '<', '<=', '>'][n_nationkey % 6 + 1] AS other FROM nation)
    SELECT k, CASE k % 4 WHEN 0 THEN 'v' || k || ' ' || other || ' 5' WHEN 1 THEN 'x' || k WHEN 2 THEN '!(f(a, ' || k || '))' ELSE 'a b' || k END AS negated FROM c
    """,
)
def negations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    sign = F.get(F.array(*map(F.lit, ("==", "!=", "<", ">=", ">", "<="))), k % 6)
    text = F.when(k % 4 == 0, F.concat(F.lit("v"), k, F.lit(" "), sign, F.lit(" 5"))).when(k % 4 == 1, F.concat(F.lit("!x"), k)).when(k % 4 == 2, F.concat(F.lit("f(a, "), k, F.lit(")"))).otherwise(F.concat(F.lit("!(a b"), k, F.lit(")")))
    return table(spark, d, "nation").select(k.alias("k"), opposite(text).alias("negated"))


@query(
    "f49_slots",
    """
    WITH x AS (SELECT s_suppkey AS k, s_suppkey % 7 - 2 AS slot, s_suppkey % 2 = 1 AS method, s_suppkey % 3 AS n FROM supplier)
    SELECT k, CASE WHEN slot < 0 THEN 's' || (-slot) WHEN method AND slot = 0 THEN 'this' WHEN slot >= CAST(method AS INTEGER) AND slot < CAST(method AS INTEGER) + n THEN 'a' || (slot - CAST(method AS INTEGER)) ELSE 'v' || slot END AS name FROM x
    """,
)
def slots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), frame_slot(k % 7 - 2, k % 2 == 1, k % 3).alias("name"))


@query(
    "f50_ranges",
    "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey * 3 >= s_suppkey * 41 AND p_partkey * 3 < s_suppkey * 41 + s_suppkey % 90",
)
def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Points in ranges that may overlap."""
    points = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("at"))
    spans_ = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 41).alias("lo"), (F.col("s_suppkey") % 90).alias("n"))
    return in_ranges(points, spans_, "at", "lo", "n").select("p_partkey", "s_suppkey")


@query(
    "f51_first_lines",
    """
    WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, i AS place, CASE WHEN i <= 3 THEN 'order ' || o_orderkey ELSE '  ... ' || (n - 3) || ' more' END AS line FROM o WHERE i <= 4 UNION ALL SELECT o_custkey, 0, n || ' entries' FROM o WHERE i = 1
    """,
)
def some_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("line"))
    return first_lines(rows, ["o_custkey"], "o_orderkey", "line", 3)




@query(
    "f52_forms",
    """
    WITH s AS (SELECT s_suppkey AS k, s_suppkey % 6 AS form, [6, 4, 5, 4, 2, 3][s_suppkey % 6 + 1] AS n FROM supplier),
    b AS (SELECT *, CASE form WHEN 0 THEN ['    if (v1 == ' || k || ') {', '        v1 = 2;', '    } else {', '        v1 = 1;', '    }', '    return;']
        WHEN 1 THEN ['    if (v1 == ' || k || ') {', '        v1 = 1;', '    }', '    return;'] WHEN 2 THEN ['    while (v1 < ' || k || ') {', '        v1++;', '    }', '    return;']
        WHEN 3 THEN ['    do {', '        v1++;', '    } while (v1 < ' || k || ');', '    return;'] WHEN 4 THEN ['    while (true) {', '        v1++;', '    }']
        ELSE ['    switch (v1) { /* jump table */ }', '    v1 = ' || k || ';', '    return;'] END AS lines FROM s)
    SELECT 's' || k AS module_id, n::BIGINT AS instructions, '// ' || n || ' instructions, 0 passthrough, 0 stack residue' || chr(10) || 'void <global>::form()' || chr(10) || '{' || chr(10) || array_to_string(lines, chr(10)) || chr(10) || '}' AS text,
        [4, 3, 3, 2, 1, 2][form + 1]::BIGINT AS blocks, 0::BIGINT AS gotos FROM b
    """,
)
def forms(spark: SparkSession, d: str) -> DataFrame:
    """Branches, loops and a switch told from jumps."""
    return lift.lifted(_stored(flow_modules(spark, d), FLOW, *_NAMED), FLOW).select("module_id", "instructions", "text", "blocks", "gotos")


@query(
    "f53_labels",
    """
    WITH j AS (SELECT s_suppkey AS k, unnest(CASE s_suppkey % 6 WHEN 0 THEN [1, 3] WHEN 1 THEN [1] WHEN 2 THEN [1, 3] WHEN 3 THEN [2] WHEN 4 THEN [1] ELSE [] END) AS idx,
        unnest(CASE s_suppkey % 6 WHEN 0 THEN [4, 5] WHEN 1 THEN [3] WHEN 2 THEN [4, 0] WHEN 3 THEN [0] WHEN 4 THEN [0] ELSE [] END) AS target FROM supplier)
    SELECT 's' || k AS module_id, idx::BIGINT AS idx, target::BIGINT AS target, 'L' || (row_number() OVER (PARTITION BY k ORDER BY idx) - 1) AS label FROM j
    """,
)
def jump_labels(spark: SparkSession, d: str) -> DataFrame:
    """Jumps with their targets, and labels in the order in which they are first referred to."""
    rows = disasm.resolved(_stored(flow_modules(spark, d), FLOW, *_NAMED), FLOW)
    return rows.where("role = 'jump'").select("module_id", "idx", "target", F.col("text").alias("label"))


@query(
    "f54_harvesters",
    r"""
    WITH l AS (SELECT conv_id, turn, role || '-' || turn AS v FROM conversations), w AS (SELECT *, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c, lead(v, 3) OVER o AS d FROM l WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
    u AS (SELECT v, 1 AS p FROM l UNION ALL SELECT v || chr(0) || b, 3 FROM w WHERE b IS NOT NULL UNION ALL SELECT v || chr(0) || b || chr(0) || c, 3 FROM w WHERE c IS NOT NULL
        UNION ALL SELECT v || chr(0) || b || chr(0) || c || chr(0) || d, 3 FROM w WHERE d IS NOT NULL UNION ALL SELECT unnest(regexp_extract_all(text, '[\x20-\x7E]{4,}')), 4 FROM conversations),
    f AS (SELECT v, min(p) AS p FROM u WHERE v IS NOT NULL GROUP BY v)
    SELECT ['literal', 'core', 'run', 'printable'][p] AS harvester, count(*) AS n_fresh FROM f GROUP BY p
    """,
)
def harvesters(spark: SparkSession, d: str) -> DataFrame:
    """Distinct strings by the harvester that has them first: literals, their cores, joined neighbours, printable runs."""
    rows = table(spark, d, "conversations")
    literals = rows.select(F.col("conv_id").alias("module_id"), F.col("turn").alias("ordinal"), F.concat_ws("-", "role", F.col("turn").cast("string")).alias("text"))
    return fresh_by_harvester(candidates(literals, rows.select(F.encode("text", "UTF-8").alias("content"))))


@query("f55_trace", f"WITH {MODULES}, {CODE} SELECT module_id, count(*) AS n_ops, count(DISTINCT signature) AS n_counts FROM code GROUP BY module_id")
def trace(spark: SparkSession, d: str) -> DataFrame:
    """Instructions and bodies in the trace of each module that could be read."""
    rows = table_of(_tables(spark, d, "trace"), "trace")
    return rows.groupBy("module_id").agg(F.count_if(F.col("kind") == "op").alias("n_ops"), F.count_if(F.col("kind") == "opcount").alias("n_counts")).where("n_ops > 0")


@query(
    "f62_runs_in_sql",
    r"""
    SELECT doc_id, generate_subscripts(r, 1) - 1 AS seq, length(unnest(r)) AS n, sha256(unnest(r)) AS sha FROM (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E]{24,}') AS r FROM documents)
    """,
)
def runs_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Printable runs of texts that come in chunks of 1,000 bytes, by a table function in SQL."""
    tables.register(spark)
    data = F.encode("text", "UTF-8")
    cut = F.explode(F.sequence(F.lit(0), F.floor(F.octet_length(data) / 1000).cast("int")))
    chunks = table(spark, d, "documents").select("doc_id", cut.alias("chunk"), data.alias("data")).select("doc_id", "chunk", F.substring("data", F.col("chunk") * 1000 + 1, F.lit(1000)).alias("data"))
    sql = """
        SELECT doc_id, seq, length(run) AS n, sha2(run, 256) AS sha
        FROM printable_runs(rows => TABLE(SELECT doc_id, chunk, data FROM {chunks}) PARTITION BY doc_id ORDER BY chunk, least => 24)
    """
    return spark.sql(sql, chunks=chunks)


@query("f63_instructions_in_sql", f"WITH {MODULES}, {CODE} SELECT module_id, signature, CAST(idx AS BIGINT) AS idx, name, operands FROM code")
def instructions_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Bodies decoded by a table function in SQL."""
    tables.register(spark)
    made = _made(spark, d)
    t = _stored(made, OPS, "functions", "global_properties")
    code = disasm.bodies(t, made).join(_signed(t), ["module_id", "function"]).select("module_id", "signature", "code")
    sql = "SELECT module_id, signature, idx, name, concat_ws(' ', transform(operands, x -> string(x))) AS operands FROM instructions(rows => TABLE(SELECT * FROM {code}), opcodes => {ops})"
    return spark.sql(sql, code=code, ops=json.dumps(OPS))


@query(
    "f64_bucketed_lookups",
    """
    WITH refs AS (SELECT l_orderkey, l_linenumber, l_partkey + (l_linenumber % 3) * 700 AS ref FROM lineitem), s AS (SELECT DISTINCT s_suppkey AS k FROM supplier), p AS (SELECT p_partkey AS k FROM part), o AS (SELECT o_orderkey AS k FROM orders)
    SELECT ref, count(*) AS n, ref IN (SELECT k FROM s) AS in_supplier, ref IN (SELECT k FROM p) AS in_part, ref IN (SELECT k FROM o) AS in_orders FROM refs GROUP BY ref
    """,
)
def bucketed_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals looked up in three tables and counted, with no exchange once all lie by their keys."""
    refs = table(spark, d, "lineitem").select((F.col("l_partkey") + (F.col("l_linenumber") % 3) * 700).alias("ref"))
    targets = {f"in_{t}": catalog.bucketed(table(spark, d, t).select(F.col(k).cast("long").alias("k")), ["k"], t) for t, k in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"))}
    found = catalog.lookups(catalog.bucketed(refs, ["ref"], "refs"), targets, "ref", "k")
    return found.groupBy("ref", *targets).agg(F.count("*").alias("n"))


@query(
    "f65_closure",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 300 AS a, (o_custkey % 300 * 7 + o_orderkey % 2) % 300 AS b FROM orders),
    r AS (SELECT a, b, 1 AS k FROM e WHERE a < 20 UNION SELECT r.a, e.b, r.k + 1 FROM r JOIN e ON r.b = e.a WHERE r.k < 50)
    SELECT a AS src, b AS node, CAST(min(k) AS BIGINT) AS depth FROM r GROUP BY a, b
    """,
)
def reached(spark: SparkSession, d: str) -> DataFrame:
    """What nodes reach in up to 50 steps of a graph that is full of cycles."""
    key = F.col("o_custkey") % 300
    edges = table(spark, d, "orders").select(key.alias("src"), ((key * 7 + F.col("o_orderkey") % 2) % 300).alias("dst"))
    return closure(edges, 50, edges.where("src < 20"))


@query(
    "f66_sketches",
    """
    SELECT l_returnflag, l_linestatus, year, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity, true AS near_hll, true AS near_theta, true AS near_median
    FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem)
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, year), (l_returnflag, l_linestatus), (l_returnflag), ())
    """,
)
def sketched(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts and sketches by month, merged upwards; estimates are held against exact values of each group."""
    names = ["l_returnflag", "l_linestatus", "year"]
    sets = [names, names[:2], names[:1], []]
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_orderkey", "l_quantity", "l_extendedprice")
    fine = sketches.states(rows.withColumn("price", F.col("l_extendedprice")), [*names, "month"], F.col("l_orderkey"), F.col("price"))
    quantity = rows.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(
        F.round(F.sum("l_quantity")).cast("long").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"), F.percentile("l_extendedprice", F.array(F.lit(0.47), F.lit(0.53))).alias("middle"), F.count("*").alias("rows_"),
    )
    found = sketches.told(sketches.merged(fine, sets, names), [0.5])
    same = [found[c].eqNullSafe(quantity[c]) for c in names]
    near = lambda x, share: F.abs(F.col(x) - F.col("orders")) <= F.greatest(F.lit(1.0), share * F.col("orders"))
    median = F.col("quantiles")[0].between(F.col("middle")[0], F.col("middle")[1]) | (F.col("rows_") < 30)
    return found.join(quantity, same[0] & same[1] & same[2]).select(*(found[c] for c in names), "n", "quantity", near("distinct_hll", 0.05).alias("near_hll"), near("distinct_theta", 0.06).alias("near_theta"), median.alias("near_median"))


@query(
    "f67_variants",
    """
    SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS least, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, 0::BIGINT AS errors, 'BIGINT' AS kinds
    FROM events GROUP BY ALL
    """,
)
def variant_paths(spark: SparkSession, d: str) -> DataFrame:
    """Events by a path into their properties, which are kept as shredded variants."""
    rows = variants.shredded(variants.with_variant(table(spark, d, "events"), "props", "v"), "events")
    rows = rows.withColumn("k", variants.at(F.col("v"), "$.k", "bigint"))
    kinds = F.array_join(F.array_sort(F.collect_set(F.schema_of_variant(variants.at(F.col("v"), "$.k", "variant")))), ",")
    return rows.groupBy("event_type", (F.col("k") % 10).alias("digit")).agg(F.count("*").alias("n"), F.min("k").alias("least"), F.sum("k").alias("total"), F.count_if("v_error").alias("errors"), kinds.alias("kinds"))


@query(
    "f68_stream_sessions",
    """
    WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t, value FROM events), m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS f FROM e),
    s AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t) AS s FROM m), g AS (SELECT key, min(t) AS start, max(t) AS last, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM s GROUP BY key, s)
    SELECT * FROM g WHERE last // 1000 + 21600000 <= (SELECT max(t) // 1000 - 3600000 FROM e)
    """,
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed as a stream of four batches: sessions with a gap of six hours that the watermark has closed."""
    sessions.prepared(spark)
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    source, out = place(spark, "replay"), place(spark, "sessions")
    first, last = rows.agg(F.min("ts"), F.max("ts")).head()
    for i in range(4):  # one after another, since the source takes files by their age
        lo, hi = first + (last - first) * i / 4, first + (last - first) * (i + 1) / 4
        rows.where((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < 3 else F.lit(True))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    told = sessions.of_stream(stream, 6 * 3600, 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
    told.trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(sessions.SESSION).parquet(out)
    return done.select("key", F.unix_micros("start").alias("start"), F.unix_micros("last").alias("last"), "n", F.round(F.col("total") * 100).cast("long").alias("cents"))


#: Suppliers' modules that name things in every way: made is whether a constructor is known, pointer what PGA names, one and two the properties.
_NAMINGS = """
    n AS (SELECT s_suppkey AS k, s_suppkey // 2 AS p, s_suppkey % 2 = 1 AS newer, 'g' || s_suppkey AS g FROM supplier),
    m AS (SELECT *, 'n' || k AS module_id, p % 4 IN (1, 2) AS made, CASE WHEN newer THEN [g, '"s' || k || '"', NULL][p % 3 + 1] WHEN p % 2 = 0 THEN g END AS pointer,
        CASE WHEN newer THEN 'last' || k ELSE 'named' END AS one, CASE WHEN newer THEN 'prop[7]' ELSE 'other' END AS two FROM n),
    texts AS (SELECT k, module_id, '// 16 instructions, 1 passthrough, ' || CASE WHEN made THEN 0 ELSE 1 END || ' stack residue' || chr(10) || 'void <global>::naming()' || chr(10) || '{' || chr(10) || '    v3 = C(' || CASE WHEN made THEN '' || k ELSE '' END || ');' || chr(10)
        || '    v2 = this.' || two || ';' || chr(10) || '    v3.' || one || ' = v2;' || chr(10) || '    v4 = ' || g || ';' || chr(10) || '    /* Strange ' || k || ' */' || chr(10) || '    return;' || chr(10) || '}' AS text FROM m)
"""


@query(
    "f69_named_operands",
    f"""
    WITH {_NAMINGS}, each AS (SELECT module_id, unnest([
        {{'idx': 2, 'name': 'ALLOC', 'place': 0, 'text': 'C'}}, {{'idx': 2, 'name': 'ALLOC', 'place': 1, 'text': ['<no constructor>', 'C::$beh0', '<global>::note', NULL][p % 4 + 1]}}, {{'idx': 3, 'name': 'PGA', 'place': 0, 'text': pointer}},
        {{'idx': 4, 'name': 'ADDSi', 'place': 0, 'text': 'C::' || one}}, {{'idx': 4, 'name': 'ADDSi', 'place': 1, 'text': 'int'}}, {{'idx': 6, 'name': 'LoadThisR', 'place': 0, 'text': 'C::' || two}}, {{'idx': 6, 'name': 'LoadThisR', 'place': 1, 'text': 'int'}},
        {{'idx': 8, 'name': 'LoadVObjR', 'place': 1, 'text': 'C::' || one}}, {{'idx': 8, 'name': 'LoadVObjR', 'place': 2, 'text': 'int'}}, {{'idx': 10, 'name': 'CpyGtoV4', 'place': 1, 'text': g}}, {{'idx': 11, 'name': 'TYPEID', 'place': 0, 'text': 'int'}}, {{'idx': 13, 'name': 'FREE', 'place': 1, 'text': 'C'}}
    ]) AS x FROM m) SELECT module_id, x.idx::BIGINT AS idx, x.name AS name, x.place::INTEGER AS place, x.text AS text FROM each
    """,
)
def named_operands(spark: SparkSession, d: str) -> DataFrame:
    """Operands of every role in both dialects: constructors counted from one, pointers to globals or strings, properties by name or, by two joins, by place in the last class of their name."""
    return disasm.resolved(_stored(naming_modules(spark, d), NAMING, *_NAMED), NAMING).where("role IS NOT NULL").select("module_id", "idx", "name", "place", "text")


@query("f70_lifted_files", f"WITH {_NAMINGS} SELECT module_id, text, CASE WHEN made THEN 0 ELSE 1 END::BIGINT AS residue, 1::BIGINT AS passthrough FROM m JOIN texts USING (module_id, k)")
def lifted_files(spark: SparkSession, d: str) -> DataFrame:
    """Modules written as files, read as files, decoded, lifted, and their texts written as JSON and read again."""
    folder, out = place(spark, "modules"), place(spark, "texts")
    sink.register(spark)
    naming_modules(spark, d).select(F.concat("module_id", F.lit(".bin")).alias("name"), F.col("content").alias("data")).write.format("files").mode("append").save(folder)
    found = overlay.read_files(spark, f"{folder}/*.bin").select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("module_id"), "content")
    lift.lifted(_stored(found, NAMING, *_NAMED), NAMING).write.json(out)
    return spark.read.schema(lift.RESULT).json(out).select("module_id", "text", "residue", "passthrough")


@query("f71_first_texts", f"WITH {_NAMINGS} SELECT module_id, text FROM (SELECT *, row_number() OVER (ORDER BY module_id) AS i FROM texts) WHERE i <= 25")
def first_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 texts in the order of modules and functions; only their functions are lifted."""
    tables_ = _stored(naming_modules(spark, d), NAMING, *_NAMED)
    own = table_of(tables_, "functions").where("body_end IS NOT NULL").select("module_id", "ordinal")
    some = ordered_slice(own, {"m": F.col("module_id"), "o": F.col("ordinal")}, 1, 26)
    return lift.lifted(tables_, NAMING, some).select("module_id", "text")


@query(
    "f72_unpacked_files",
    """
    WITH s AS (SELECT 's' || s_suppkey AS stem, s_suppkey % 6 = 5 AS cut, repeat(s_name || ' ', 40) AS text FROM supplier)
    SELECT stem, 'bytecode.bin' AS ending, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha, NULL AS error FROM s WHERE NOT cut
    UNION ALL SELECT stem, 'embedded.pack', 3, sha256('EMB'), NULL FROM s WHERE NOT cut UNION ALL SELECT stem, NULL, NULL, NULL, 'no trailer' FROM s WHERE cut
    """,
)
def unpacked_files(spark: SparkSession, d: str) -> DataFrame:
    """Executables written as files and read as files, unpacked, and their blobs written all or none and read again; those that are cut short have a reason."""
    sink.register(spark)
    folder, out = place(spark, "executables"), place(spark, "blobs")
    executables(spark, d, "supplier").select(F.col("path").alias("name"), F.col("content").alias("data")).write.format("files").mode("append").save(folder)
    rows = kept(overlay.unpacked(overlay.read_files(spark, f"{folder}/*.exe")), "unpacked")
    overlay.blobs(rows).select("name", "data").write.format("files").mode("append").save(out)
    name = F.element_at(F.split("path", "/"), -1)
    found = overlay.read_files(spark, f"{out}/*").select(F.split(name, "_")[0].alias("stem"), F.split(name, "_")[2].alias("ending"), "content")
    found = found.where("ending <> 'compressed.bin'").select("stem", "ending", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha"), F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("ending", "string"), ("size", "long"), ("sha", "string"))]
    return found.unionByName(rows.where("error IS NOT NULL").select(F.split(name, r"\.")[0].alias("stem"), *none, "error"))


@query(
    "f73_checked_packs",
    f"""
    WITH e AS (SELECT *, max(ordinal) OVER (PARTITION BY pack) AS last, CAST(substring(pack, 2) AS BIGINT) % 3 AS how FROM ({_ENTRIES})),
    t AS (SELECT pack, how, last, 16 + sum(16 + octet_length(encode(name)) + coalesce(size, 0)) AS total FROM e GROUP BY ALL)
    SELECT pack, CAST(ordinal AS INTEGER) AS ordinal, name, sha256(coalesce(text, '')) AS sha, NULL AS error FROM e WHERE how = 0 OR (how = 1 AND ordinal < last)
    UNION ALL SELECT pack, CAST(last AS INTEGER), NULL, NULL, 'entry ' || last || ': ' || 'it would end at ' || total || ' of ' || (total - 1) || ' bytes' FROM t WHERE how = 1
    UNION ALL SELECT pack, 0, NULL, NULL, 'not a pack' FROM t WHERE how = 2
    """,
)
def checked_packs(spark: SparkSession, d: str) -> DataFrame:
    """Packs of which a third lacks its last byte and a third its first: entries up to the fault, and what it is, in place of an error of the job."""
    rows = table(spark, d, "conversations").select(F.format_string("c%d", "conv_id").alias("pack"), F.col("turn").alias("ordinal"), F.format_string("%d/%s", "turn", "role").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    how, size = F.substring("pack", 2, 20).cast("long") % 3, F.octet_length("content")
    content = F.when(how == 0, F.col("content")).when(how == 1, F.substring("content", F.lit(1), size - 1)).otherwise(F.substring("content", F.lit(2), size))
    found = packs.checked(packs.built(rows).select(F.col("pack").alias("path"), content.alias("content")))
    return found.select("pack", "ordinal", "name", F.sha2("data", 256).alias("sha"), "error")


@query(
    "f74_edited_everywhere",
    f"""
    WITH {MODULES}, {CODE} SELECT module_id, signature, CAST(idx AS BIGINT) AS idx, name, CASE WHEN name = 'SetV4' THEN '2 ' || (CAST(split_part(operands, ' ', 2) AS BIGINT) + 1000) ELSE operands END AS operands FROM code SEMI JOIN whole USING (module_id)
    """,
)
def edited_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """An instruction of every function replaced by one join of the trace with a table of edits; modules are written and decoded again."""
    t = _tables(spark, d, "trace")
    facts = module_facts(t).where("reached = 'tail'").select("module_id", "dialect")
    trace = table_of(t, "trace").join(facts, "module_id", "left_semi")
    edits = trace.where("kind = 'op' AND op = 3").selectExpr("module_id", "seq", "op", "array(operands[0], operands[1] + 1000) AS operands")
    again = _stored(rewrite.written(rewrite.replace_instructions(trace, edits), facts), OPS, "functions", "instructions")
    rows = table_of(again, "instructions").join(F.broadcast(disasm.dimension(spark, OPS)), "op").join(_signed(again), ["module_id", "function"])
    return rows.select("module_id", "signature", "idx", "name", _joined(F.col("operands")).alias("operands"))


@query(
    "f75_opcode_files",
    """
    WITH o AS (SELECT s_suppkey AS r, unnest(range(0, 10 + s_suppkey % 5)) AS op FROM supplier)
    SELECT 'r' || r || '.json' AS path, op, 'R' || r || 'Op' || op AS name, op % 20 + 1 AS type, -op AS "stackInc", [0, 1, 1, 1, 2, 1, 2, 3, 2, 2, 1, 2, 3, 2, 2, 2, 2, 2, 3, 3][op % 20 + 1]::BIGINT AS operands,
        [1, 1, 1, 2, 2, 3, 3, 2, 3, 2, 1, 2, 3, 2, 2, 4, 3, 2, 3, 3][op % 20 + 1]::BIGINT AS dwords FROM o
    """,
)
def opcode_files(spark: SparkSession, d: str) -> DataFrame:
    """Tables of operations found in executables, written as a JSON file each, all or none, and read again."""
    sink.register(spark)
    folder = place(spark, "opcodes")
    made = opcodes.as_json(opcodes.tables(opcode_images(spark, d, "supplier", "s_suppkey")))
    made.select(F.regexp_replace("path", r"exe$", "json").alias("name"), F.encode("json", "UTF-8").alias("data")).write.format("files").mode("append").save(folder)
    rows = opcodes.from_json_files(overlay.read_files(spark, f"{folder}/*.json"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("path"), "op", "name", "type", "stackInc", "operands", "dwords")
