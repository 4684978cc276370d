"""Table-valued functions, for SQL: `register(spark)`, then FROM name(rows => TABLE(t) PARTITION BY key ORDER BY place, ..).

Rows of a partition come one after another and results go out as they are found, so that a partition may be larger than memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestrata.operators.disasm import decode_span


def _table(argument: AnalyzeArgument, *kinds: tuple[type, ...]) -> list[DataType]:
    """The types of a table argument's last columns, which have to be of these kinds; the columns before them are the key."""
    if not argument.isTable or len(argument.dataType.fields) <= len(kinds):
        raise ValueError(f"the first argument has to be a table of key columns and {len(kinds)} more")
    for field, kind in zip(argument.dataType.fields[-len(kinds) :], kinds, strict=True):
        if not isinstance(field.dataType, kind):
            raise ValueError(f"{field.name} is {field.dataType.simpleString()}; it has to be one of {', '.join(k.typeName() for k in kind)}")
    return argument.dataType.fields[: -len(kinds)]


class PrintableRuns:
    """Key columns, seq (from 0), at (byte) and run of every run of at least `least` printable bytes in chunks of data.

    The table's last two columns are a chunk's place, by which it is ordered, and the chunk (binary or string); the others are the key,
    by which it is partitioned. A run may go on from chunk to chunk: only what is open at a chunk's end is held. Null chunks are empty.
    """

    PRINTABLE = re.compile(rb"[\x20-\x7E]+")

    @staticmethod
    def analyze(rows: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(least.value, int) or least.value < 1:
            raise ValueError("least has to be a positive whole number")
        schema = StructType(_table(rows, (DataType,), (BinaryType, StringType)))
        return AnalyzeResult(schema.add("seq", LongType()).add("at", LongType()).add("run", StringType()))

    def __init__(self):
        self.key, self.at, self.seq, self.open, self.least = None, 0, 0, b"", 1

    def closed(self, run: bytes, at: int) -> Iterator[tuple]:
        if len(run) >= self.least:
            yield *self.key, self.seq, at, run.decode("ascii")
            self.seq += 1

    def eval(self, rows, least: int) -> Iterator[tuple]:
        *key, _, data = rows  # one of them
        self.key, self.least = key, least
        data = data.encode() if isinstance(data, str) else bytes(data or b"")
        done = 0
        for m in self.PRINTABLE.finditer(data):
            if m.start() > 0 or not self.open:
                yield from self.closed(self.open, self.at - len(self.open))
                self.open = b""
            run, at = self.open + m[0], self.at + m.start() - len(self.open)
            if m.end() == len(data):
                self.open = run
            else:
                self.open = b""
                yield from self.closed(run, at)
            done = m.end()
        if data and done < len(data) and self.open:
            yield from self.closed(self.open, self.at - len(self.open))
            self.open = b""
        self.at += len(data)

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            yield from self.closed(self.open, self.at - len(self.open))


class Instructions:
    """Key columns, idx, at (byte), op, name and operands of the instructions of each row's code, up to its first return.

    The table's last column is the code, the others are the key. The second argument is an opcode table as JSON: {number: {name, operands}}.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, opcodes: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(opcodes.value, str) or not isinstance(json.loads(opcodes.value), dict):
            raise ValueError("opcodes has to be a JSON object")
        schema = StructType(_table(rows, (BinaryType,)))
        return AnalyzeResult(schema.add("idx", LongType()).add("at", LongType()).add("op", LongType()).add("name", StringType()).add("operands", ArrayType(LongType())))

    def __init__(self):
        self.table = None

    def eval(self, rows, opcodes: str) -> Iterator[tuple]:
        if self.table is None:
            self.table = {int(k): v for k, v in json.loads(opcodes).items()}
        *key, code = rows  # one of them
        for idx, (at, op, name, operands) in enumerate(decode_span(bytes(code or b""), self.table)):
            yield *key, idx, at, op, name, operands


def register(spark: SparkSession) -> None:
    """printable_runs and instructions, for SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("printable_runs", udtf(PrintableRuns))
    spark.udtf.register("instructions", udtf(Instructions))
