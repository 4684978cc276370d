"""Commands over the library: info, unpack, opcodes, disasm, lift, pack list and extract, asm, validate.

Results that may be large are written by the tasks; what is printed is small or comes row by row. Exit codes: 0 all well, 1 partly or nothing found, 2 the call was wrong.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.codec import FormatError
from lodestrata.session import local_session
from lodestrata.sources import opcodes as ops


def _modules(spark, path: str) -> DataFrame:
    from lodestrata.sources.overlay import read_files

    return read_files(spark, path).select(F.col("path").alias("module_id"), "content")


def _tables(spark, args) -> tuple[DataFrame, dict, DataFrame]:
    from lodestrata.sources.module import stored
    from lodestrata.sources.scratch import place

    table = _opcodes(args.opcodes)
    found = _modules(spark, args.module)
    return found, table, stored(found, table, place(spark, "tables"))


def _opcodes(path: str) -> dict:
    raw = Path(path).read_bytes()
    return ops.from_json(raw.decode()) if path.endswith(".json") else ops.find(raw)


def _info(spark, args) -> int:
    from lodestrata.sources.overlay import containers, overlays, read_files, with_keys

    rows = containers(with_keys(overlays(read_files(spark, args.path)))).select("path", "overlay_offset", "seed", "container_flag", "declared", "bytecode_size", "error").collect()
    for r in rows:
        print(*r, sep="\t")
    return int(not rows or any(r.error or r.seed is None for r in rows))


def _unpack(spark, args) -> int:
    from lodestrata.sources.overlay import read_files, unpacked, write_blobs

    rows = unpacked(read_files(spark, args.path), args.seed).persist()
    wrote = write_blobs(rows, args.out).persist()
    bad = rows.where("error IS NOT NULL").select("path", "error").union(wrote.where("error IS NOT NULL").select("path", "error"))
    for r in wrote.where("error IS NULL").toLocalIterator():
        print(r.path, r.kind, r.place, sep="\t")
    n = 0
    for r in bad.toLocalIterator():
        n += 1
        print(r.path, r.error, file=sys.stderr)
    return int(n > 0)


def _find_opcodes(spark, args) -> int:
    Path(args.out).write_text(ops.to_json(ops.find(Path(args.path).read_bytes())))
    return 0


def _disasm(spark, args) -> int:
    from lodestrata.operators.disasm import find, listing

    _, table, tables = _tables(spark, args)
    out = listing(tables, table)
    if args.function:
        out = out.join(find(tables, args.function).select("module_id", F.col("ordinal").alias("function")), ["module_id", "function"], "left_semi")
    return _texts(out, args)


def _lift(spark, args) -> int:
    from lodestrata.operators.disasm import callers_of, find
    from lodestrata.operators.lift import lifted

    _, table, tables = _tables(spark, args)
    only = callers_of(tables, table, args.calls) if args.calls else find(tables, args.function) if args.function else None
    return _texts(lifted(tables, table, only), args)


def _texts(df: DataFrame, args) -> int:
    ordered = df.orderBy("module_id", "function")
    if args.limit:
        ordered = ordered.limit(args.limit)
    if args.json:
        ordered.write.mode("overwrite").json(args.json)
        return 0
    n = 0
    for r in ordered.select("text").toLocalIterator():
        print(r.text, end="\n\n")
        n += 1
    return int(n == 0)


def _pack(spark, args) -> int:
    from lodestrata.sources import packs

    packs.register(spark)
    rows = spark.read.format("pack").option("payload", str(args.out is not None).lower()).load(args.path)
    if args.out is None:
        n = 0
        for r in packs.listing(rows, args.limit).orderBy("pack", "place").toLocalIterator():
            n += 1
            print(r.line if r.place else f"{r.pack}: {r.line}")
        return int(n == 0)
    failed = packs.extract(rows, args.out).where("error IS NOT NULL").collect()
    for r in failed:
        print(r.name, r.error, file=sys.stderr)
    return int(bool(failed))


def _asm(spark, args) -> int:
    from lodestrata.operators import rewrite
    from lodestrata.sources.module import module_facts, table_of

    found, _, tables = _tables(spark, args)
    trace = table_of(tables, "trace")
    if args.replace:
        old, new = (F.lit(bytearray(x.encode("latin-1"))) for x in args.replace)
        trace = rewrite.replace_literal(trace, old, new, args.limit)
    if args.literals:
        for r in rewrite.literal_report(trace, args.literals).orderBy("module_id", "place").toLocalIterator():
            print(r.line if r.place else f"{r.module_id}: {r.line}")
        return 0
    made = rewrite.written(trace, module_facts(tables))
    if args.out:
        names = rewrite.write_modules(made, args.out)
        n = 0
        for r in names.toLocalIterator():
            n += 1
            print(r.module_id, r.place, sep="\t")
        return int(n == 0)
    same = rewrite.round_trip(made, found).collect()
    for r in same:
        print(r.module_id, "identical" if r.identical else f"differs at {r.first_difference}")
    return int(not all(r.identical for r in same))


def _validate(spark, args) -> int:
    from lodestrata.operators.validate import passed, report, stages

    found, table, tables = _tables(spark, args)
    checked = stages(found, tables, table, args.deep).persist()
    n = 0
    for r in report(checked).orderBy("module_id").toLocalIterator():
        n += 1
        print(*r, sep="\t")
    done = passed(checked).head()
    print(f"{done.n_passed}/{done.n_modules} modules passed every stage they reached")
    return int(done.n_passed < done.n_modules or not n)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrata")
    sub = top.add_subparsers(required=True)

    def command(name, f, *names):
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n)
        p.set_defaults(f=f)
        return p

    command("info", _info, "path")
    p = command("unpack", _unpack, "path", "out")
    p.add_argument("--seed", type=int)
    command("opcodes", _find_opcodes, "path", "out")
    for name, f in (("disasm", _disasm), ("lift", _lift)):
        p = command(name, f, "module", "opcodes")
        p.add_argument("-f", "--function")
        p.add_argument("--limit", type=int)
        p.add_argument("--json")
        if name == "lift":
            p.add_argument("--calls")
    p = command("pack", _pack, "path")
    p.add_argument("--out")
    p.add_argument("--limit", type=int, default=40)
    p = command("asm", _asm, "module", "opcodes")
    p.add_argument("--replace", nargs=2)
    p.add_argument("--limit", type=int)
    p.add_argument("--literals", type=int)
    p.add_argument("--out")
    p = command("validate", _validate, "module", "opcodes")
    p.add_argument("--deep", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.f(local_session(), args)
    except (FormatError, OSError, UnicodeError, AnalysisException) as e:
        print(e, file=sys.stderr)
        return 2


def _alone(name: str):
    """A command of its own: `lodestrata-unpack a b` is `lodestrata unpack a b`."""
    return lambda: main([name, *sys.argv[1:]])


unpack, disassemble, lift, validate, opcode_table, pack, assemble = map(_alone, ("unpack", "disasm", "lift", "validate", "opcodes", "pack", "asm"))


if __name__ == "__main__":
    sys.exit(main())
