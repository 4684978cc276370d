"""Validation as tables: each invariant is a stage row with ok true, false or null (not reached)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.disasm import bodies, spans
from lodestrata.operators.relational import stage_rows, tri_state
from lodestrata.operators.rewrite import round_trip, written
from lodestrata.sources.module import module_facts, table_of

# fixed values: the stages in their order
STAGES = ("unpack", "dialect", "enums", "classes", "funcdefs", "opcodes", "blocks", "tail", "disasm", "rewrite")
#: Bodies of a module that the disassembly is checked on, unless the check is deep.
SAMPLE = 200
#: Tables that `summary` counts; of the first two some rows alone.
COUNTED = ("functions", "sections", "enums", "enum_members", "classes", "parse_errors", "used_functions", "used_strings", "used_global_props", "used_object_props")


def summary(tables: DataFrame) -> DataFrame:
    """One row a module: its facts, and how many enums, members, classes, class blocks, bodies, used names and parse errors it has; one pass counts all."""
    of = lambda name, more=F.lit(True): F.count_if((F.col("table") == name) & more)
    counts = {n: of(n) for n in COUNTED[2:]}
    counts |= {"bodies": of("functions", F.col("functions.body_end").isNotNull()), "blocks": of("sections", F.col("sections.name").startswith("class "))}
    own = tables.where(F.col("table").isin(*COUNTED)).groupBy("module_id").agg(*(c.alias(n) for n, c in counts.items()))
    return module_facts(tables).join(own, "module_id", "left").fillna(0, list(counts))


def stages(modules: DataFrame, tables: DataFrame, opcodes: dict[int, dict], deep: bool = False) -> DataFrame:
    """module_id, stage and ok for modules (module_id, content); one that could not be read still has its rows.

    The disassembly is checked on the first SAMPLE bodies of each module, or with deep on all of them.
    """
    facts = module_facts(tables)
    own = bodies(tables, modules, None if deep else SAMPLE)
    decoded = spans(own, opcodes).where("name NOT LIKE 'UNKNOWN%'").groupBy("module_id", "function").agg(F.count("*").alias("n"))
    exact = own.select("module_id", "function", "declared").join(decoded, ["module_id", "function"], "left").groupBy("module_id").agg(F.bool_and(F.coalesce("n", F.lit(0)) == F.col("declared")).alias("exact"))
    same = round_trip(written(table_of(tables, "trace"), facts.where("dialect IS NOT NULL")), modules).select("module_id", "identical")
    rows = modules.select("module_id", F.col("content").isNotNull().alias("has"))
    for other in (summary(tables), exact, same):
        rows = rows.join(other, "module_id", "left")
    read, tail = F.coalesce(F.col("dialect").isNotNull(), F.lit(False)), F.col("reached") == "tail"
    ok = rows.select(
        "module_id",
        F.col("has").alias("unpack"),
        F.when(F.col("has"), read).alias("dialect"),
        F.when(read, F.col("enums") == F.col("n_enums")).alias("enums"),
        F.when(read, F.coalesce(F.col("classes") == F.col("classes_declared"), F.lit(False))).alias("classes"),
        F.when(read, F.coalesce(F.col("funcdefs_read") == F.col("funcdefs_declared"), F.lit(False))).alias("funcdefs"),
        F.lit(bool(opcodes)).alias("opcodes"),
        F.when(read & (F.col("blocks") > 0), F.col("blocks") == F.col("classes")).alias("blocks"),
        F.when(read & F.col("reached").isin("blocks", "tail"), tail).alias("tail"),
        F.when(read & tail, F.col("exact")).alias("disasm"),
        F.when(read & tail, F.coalesce("identical", F.lit(False))).alias("rewrite"),
    )
    return stage_rows(ok, ["module_id"], list(STAGES))


def report(stage_table: DataFrame) -> DataFrame:
    """One row a module: status and a column for each stage."""
    cells = F.when(F.col("ok"), "ok").when(~F.col("ok"), "FAIL").otherwise("-")
    wide = stage_table.groupBy("module_id").pivot("stage", list(STAGES)).agg(F.first(cells))
    return wide.join(tri_state(stage_table, ["module_id"]), "module_id")


def totals(stage_table: DataFrame) -> DataFrame:
    """One row a stage: how many modules passed, failed and did not reach it."""
    return stage_table.groupBy("stage").agg(F.count_if(F.col("ok")).alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("not_reached"))


def passed(stage_table: DataFrame) -> DataFrame:
    """One row: how many modules passed every stage that they reached, of how many."""
    each = stage_table.groupBy("module_id").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))
    return each.agg(F.count_if("ok").alias("n_passed"), F.count("*").alias("n_modules"))
