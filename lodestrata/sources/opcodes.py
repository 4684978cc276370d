"""Opcode tables: found in an executable by their shape, or read from JSON."""

from __future__ import annotations

import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.codec import FormatError
from lodestrata.operators.relational import in_ranges

#: fixed values: operand count and size in words of each operand type of the format
TYPES = {
    1: (0, 1), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (2, 2), 6: (1, 3), 7: (2, 3), 8: (3, 2), 9: (2, 3), 10: (2, 2),
    11: (1, 1), 12: (2, 2), 13: (3, 3), 14: (2, 2), 15: (2, 2), 16: (2, 4), 17: (2, 3), 18: (2, 2), 19: (3, 3), 20: (3, 3),
}
NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{1,23}\Z")
STRIDE, LEAST, MOST = 16, 8, 256


def sections(exe: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """Image base, and (address, size, place in the file) of each section."""
    pe = struct.unpack_from("<I", exe, 0x3C)[0] + 4
    n, optional = struct.unpack_from("<H", exe, pe + 2)[0], struct.unpack_from("<H", exe, pe + 16)[0]
    base = struct.unpack_from("<I", exe, pe + 20 + 28)[0]
    first = pe + 20 + optional
    return base, [struct.unpack_from("<III", exe, first + 40 * i + 12) for i in range(n)]


class Image:
    """Names by virtual address."""

    def __init__(self, exe: bytes):
        self.exe = exe
        self.base, self.sections = sections(exe)
        self.known: dict[int, str | None] = {}

    def name(self, address: int) -> str | None:
        if address not in self.known:
            found = None
            for rva, size, raw in self.sections:
                if rva <= address - self.base < rva + size:
                    at = raw + address - self.base - rva
                    end = self.exe.find(b"\0", at, at + 32)
                    if end > at and NAME.match(self.exe[at:end]):
                        found = self.exe[at:end].decode()
                    break
            self.known[address] = found
        return self.known[address]


def rows_at(image: Image, place: int, n: int) -> list[tuple[str | None, int, int, int]]:
    out = []
    for at in range(place, place + STRIDE * n, STRIDE):
        address, op, kind, inc = struct.unpack_from("<Iiih", image.exe, at)
        out.append((image.name(address), op, kind, inc))
    return out


def find(exe: bytes) -> dict[int, dict]:
    """op -> name, type, stackInc, operands and dwords, of the longest run of named 16-byte rows.

    A row's name belongs to the row before it. A run whose first row is not operation 0 is followed backwards while
    numbers descend by one.
    """
    image, best, length = Image(exe), 0, 0
    for _, size, raw in image.sections:
        runs: dict[int, int] = {}
        for at in range(min(raw + size, len(exe)) - STRIDE, raw - 1, -4):
            if image.name(struct.unpack_from("<I", exe, at)[0]):
                runs[at] = 1 + runs.get(at + STRIDE, 0)
        if runs:
            at, n = max(runs.items(), key=lambda x: (x[1], -x[0]))
            if n > length:
                best, length = at, n
    if length < LEAST:
        raise FormatError("no run of opcode rows")
    first = struct.unpack_from("<i", exe, best + 4)[0]
    back = 0
    while back < first and back < 8 and best >= STRIDE * (back + 1) and struct.unpack_from("<i", exe, best - STRIDE * (back + 1) + 4)[0] == first - back - 1:
        back += 1
    if back < first:
        back = 0
    rows = rows_at(image, best - STRIDE * back, min(length + back, MOST + 8))
    table = {}
    for op in range(min(len(rows) - 1, MOST)):
        _, number, kind, inc = rows[op]
        if number >= 200 and kind == 0:
            continue  # padding
        operands, dwords = TYPES.get(kind, (0, 1))
        table[op] = {"name": rows[op + 1][0] or f"op{number}", "type": kind, "stackInc": inc, "operands": operands, "dwords": dwords}
    return table


def from_json(text: str) -> dict[int, dict]:
    held = json.loads(text)
    return {int(k): v for k, v in held.get("table", held).items()}


def to_json(table: dict[int, dict]) -> str:
    return json.dumps({"count": len(table), "table": {str(k): v for k, v in sorted(table.items())}}, indent=1)


def _each(files: DataFrame, read, shape: str) -> DataFrame:
    """A row for each tuple that read makes of a file's bytes, after its path; a file that cannot be read has one row, with the error last."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = [c.split() for c in shape.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                try:
                    rows += [(path, *x, None) for x in read(data or b"")]
                except (FormatError, struct.error, IndexError) as e:
                    rows.append((path, *[None] * (len(columns) - 2), str(e) or type(e).__name__))
            yield pa.record_batch([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], [c for c, _ in columns])

    return files.select("path", "content").mapInArrow(run, shape)


def tables(files: DataFrame) -> DataFrame:
    """path, op, name, type, stackInc, operands, dwords of the opcode table of each file (path, content), or an error."""
    columns = ("name", "type", "stackInc", "operands", "dwords")
    return _each(files, lambda data: [(op, *(x[c] for c in columns)) for op, x in find(data).items()], "path string, op long, name string, type long, stackInc long, operands long, dwords long, error string")


#: What a table of operations is as JSON: see to_json.
AS_JSON = "count int, table map<string, struct<name: string, type: bigint, stackInc: bigint, operands: bigint, dwords: bigint>>"


def as_json(found: DataFrame) -> DataFrame:
    """path, and json with the operations of `tables` for that path; one without operations, or with an error, has none."""
    columns = ("name", "type", "stackInc", "operands", "dwords")
    rows = found.where("op IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("op", F.struct(*columns).alias("x")))).alias("t"))
    table = F.map_from_entries(F.transform("t", lambda e: F.struct(e["op"].cast("string"), e["x"])))
    return rows.select("path", F.to_json(F.struct(F.size("t").alias("count"), table.alias("table"))).alias("json"))


def from_json_files(files: DataFrame) -> DataFrame:
    """The rows of `tables` for files (path, content) that `as_json` or to_json made; one that does not hold such JSON has one row, with an error."""
    held = F.from_json(F.decode("content", "UTF-8"), AS_JSON)
    rows = files.select("path", held.alias("h")).select("path", F.explode_outer("h.table").alias("op", "x"))
    error = F.when(F.col("op").isNull(), F.lit("no table of operations"))
    return rows.select("path", F.col("op").cast("long").alias("op"), "x.name", "x.type", "x.stackInc", "x.operands", "x.dwords", error.alias("error"))


def section_tables(files: DataFrame) -> DataFrame:
    """path, base, rva, size and place in the file of each section of each file (path, content), or an error."""

    def read(data):
        base, found = sections(data)
        return [(base, *x) for x in found]

    return _each(files, read, "path string, base long, rva long, size long, place long, error string")


def located(addresses: DataFrame, found: DataFrame) -> DataFrame:
    """addresses (path, address) with at: the place in the file that each stands for; those in no section are left out.

    found has the sections of `section_tables`; the range join runs within each file.
    """
    own = found.where("error IS NULL").select(F.col("path").alias("_p"), "base", "rva", "size", "place")
    reach = own.groupBy("_p").agg(F.first("base").alias("base"))
    points = addresses.join(reach, addresses.path == reach["_p"]).select(*addresses.columns, (F.col("address") - F.col("base")).alias("_x"), F.col("path").alias("_f"))
    ranges = own.select(F.col("_p").alias("_f"), "rva", "size", "place")
    return in_ranges(points, ranges, "_x", "rva", "size", ["_f"]).select(*addresses.columns, (F.col("place") + F.col("_x") - F.col("rva")).alias("at"))


def strings_at(places: DataFrame, files: DataFrame, most: int = 32) -> DataFrame:
    """places (path, at) with text: the bytes from there to the next NUL, as Latin-1; null if none comes within `most`."""
    both = places.join(files.select("path", "content"), "path")
    raw = F.decode(F.substring("content", F.col("at").cast("int") + 1, F.lit(most)), "ISO-8859-1")
    return both.select(*places.columns, F.nullif(F.regexp_extract(raw, r"^([^\x00]+)\x00", 1), F.lit("")).alias("text"))
