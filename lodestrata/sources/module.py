"""Decoder of compiled script modules into tables.

A module is one sequential read: back-references count what was read before. A `Walk` therefore reads one module and
appends rows to named tables (see TABLES), with numbers instead of nesting: a reference to a type or a function is
its row number. Everything read is also traced, so a module can be written again byte for byte. Modules are
independent of each other, so they are what Spark spreads (`decoded`).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.codec import FormatError, decode_int

OLD, NEW = "tagged", "len2"
# fixed values: flags, token names and roles of the format
SHARED, ENUM, TYPEDEF = 0x00400000, 0x04000000, 0x10000000
SCRIPT_OBJECT = {OLD: 0x00100000, NEW: 0x00200000}
TOKENS = {65: "bool", 68: "int", 69: "int8", 70: "int16", 71: "int64", 75: "uint", 76: "uint8", 77: "uint16", 78: "uint64", 79: "float", 80: "void", 92: "double"}
IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{0,63}\Z")
RESYNC = 1 << 16
#: What a walk takes for damage; types nested without end run into the last of them.
DAMAGE = (FormatError, IndexError, RecursionError)
#: Rows of a table that travel together.
ROWS = 8192

#: Columns of each table, all after module_id and nr (the row's place in its table).
TABLES = {
    "modules": "dialect string, start long, size long, end long, reached string, error string, template_namespace boolean, n_enums long, classes_declared long, funcdefs_declared long, funcdefs_read long",
    "candidates": "dialect string, start long, n_enums long, complete long, parsed long, end long",
    "strings": "ordinal long, value binary",
    "types": "ordinal long, kind string, name string, namespace string, owner long, text string",
    "data_types": "ordinal long, token long, type long, flags long, funcdef long, text string",
    "functions": "ordinal long, name string, returns long, return_text string, kind long, owner long, owner_text string, namespace string, body_start long, body_end long, declared long, stack_needed long, vf_index long, flags long, is_template boolean, returns_object boolean, is_void boolean, n_params long, n_variable long, context string, label string, signature string, collect long",
    "params": "function long, ordinal long, type long, text string, in_out long, default_value binary",
    "object_variables": "function long, ordinal long, type_text string, place long, on_heap long",
    "spans": "function long, ordinal long, kind string, a long, b long, c long",
    "classes": "ordinal long, name string, flags long, size long, namespace string, is_interface boolean, derived_from long",
    "class_members": "class string, kind string, ordinal long, function long",
    "class_interfaces": "class string, ordinal long, type long, offset long",
    "properties": "class string, ordinal long, name string, type long, flags long",
    "enums": "ordinal long, name string, flags long, size long, namespace string",
    "enum_members": "enum long, ordinal long, name string, value long",
    "typedefs": "ordinal long, name string, namespace string, token long",
    "global_properties": "ordinal long, name string, namespace string, type long, init long",
    "used_types": "ordinal long, type long, text string",
    "used_type_ids": "ordinal long, type long, text string",
    "used_functions": "ordinal long, origin string, function long, label string",
    "used_global_props": "ordinal long, name string, namespace string, type long, of_module boolean",
    "used_strings": "ordinal long, value binary",
    "used_object_props": "ordinal long, owner_text string, name string, place long",
    "instructions": "function long, idx long, offset long, op long, operands array<long>",
    "sections": "name string, start long, n long",
    "parse_errors": "context string, offset long, error string, skipped long",
    "trace": "seq long, kind string, num long, bytes binary, op long, operands array<long>",
}


def plausible_literal(raw: bytes) -> bool:
    """Text: printable ASCII, at least one, with NUL, tab, line feed and carriage return between."""
    return re.fullmatch(rb"[\x20-\x7E\x00\t\n\r]*[\x20-\x7E][\x20-\x7E\x00\t\n\r]*", raw) is not None


class Walk:
    """One pass over one module under one set of assumptions."""

    def __init__(self, data: bytes, dialect: str, at: int = 0, operands: dict[int, int] | None = None, template_namespace: bool = True):
        self.data, self.dialect, self.at, self.operands, self.template_namespace = data, dialect, at, operands, template_namespace
        self.rows: dict[str, list[dict]] = {t: [] for t in TABLES}
        self.tracing, self.classes_declared, self.funcdefs_declared, self.funcdefs_read = True, None, None, 0
        #: Numbers of the functions that back-references count.
        self.saved: list[int] = []

    # rows and primitives

    def put(self, table: str, **row) -> int:
        rows = self.rows[table]
        rows.append({"ordinal": len(rows), **row} if "ordinal" in TABLES[table] and "ordinal" not in row else row)
        return len(rows) - 1

    def note(self, kind: str, num: int | None = None, raw: bytes | None = None, op: int | None = None, operands: list[int] | None = None) -> None:
        if self.tracing:
            self.put("trace", seq=len(self.rows["trace"]), kind=kind, num=num, bytes=raw, op=op, operands=operands)

    def bare_int(self) -> int:
        value, self.at = decode_int(self.data, self.at)
        return value

    def int(self) -> int:
        value = self.bare_int()
        self.note("eu", value)
        return value

    def take(self, n: int) -> bytes:
        end = self.at + n
        if n < 0 or end > len(self.data):
            raise IndexError("the module ends within a field")
        raw, self.at = self.data[self.at : end], end
        return raw

    def word(self, signed: bool = False) -> int:
        value = int.from_bytes(self.take(4), "big", signed=signed)
        self.note("i32" if signed else "u32", value)
        return value

    def raw(self, n: int) -> bytes:
        raw = self.take(n)
        self.note("raw", raw=raw)
        return raw

    def byte(self) -> int:
        return self.raw(1)[0]

    def count(self, most: int, what: str) -> int:
        n = self.int()
        if not 0 <= n <= most:
            raise FormatError(f"{n} {what} at {self.at}")
        return n

    def string(self) -> bytes:
        saved = self.rows["strings"]
        if self.dialect == NEW:
            code = self.bare_int()
            if code < 0:
                raise FormatError(f"negative string length at {self.at}")
            how, n = ("ref" if code & 1 else "new"), code >> 1
        else:
            tag = self.take(1)[0]
            how = {0x00: "none", 0x6E: "new", 0x72: "ref"}.get(tag)
            if how is None:
                raise FormatError(f"string tag {tag} at {self.at - 1}")
            n = 0 if how == "none" else self.bare_int()
        if how == "ref":
            self.note("strref", n)
            return saved[n]["value"] if 0 <= n < len(saved) else b"<ref%d>" % n
        value = self.take(n)
        if how == "none" or (not n and self.dialect == NEW):
            self.note("strempty")
            return b""
        self.put("strings", value=value)
        self.note("strnew", raw=value)
        return value

    def text(self) -> str:
        return self.string().decode("latin-1")

    # types

    def declaration(self) -> dict:
        name = self.string()
        if not IDENTIFIER.match(name):
            raise FormatError(f"{name[:24]!r} is no identifier at {self.at}")
        out = {"name": name.decode("latin-1"), "flags": self.word(), "size": self.int(), "namespace": self.text()}
        if self.dialect == NEW and out["flags"] & SHARED:
            self.byte()
        return out

    def type(self) -> int | None:
        """The row of a type reference; null for none. Parts have rows of their own, before it."""
        tag = chr(self.byte())
        if tag == "\0":
            return None
        shown = lambda i: "void" if i is None else self.rows["types"][i]["text"]
        row = {"kind": {"o": "named", "s": "subtype", "l": "list", "c": "child", "a": "template"}.get(tag), "name": None, "namespace": None, "owner": None}
        if tag == "o":
            row |= {"name": self.text(), "namespace": self.text()}
            row["text"] = row["name"] or "?"
        elif tag == "s":
            row["name"] = self.text()
            row["text"] = row["name"] or "T"
        elif tag == "l":
            row["owner"] = self.type()
            row["text"] = f"list<{shown(row['owner'])}>"
        elif tag == "c":
            row |= {"name": self.text()}
            row["owner"] = self.type()
            row["text"] = f"{shown(row['owner'])}::{row['name']}"
        elif tag == "a":
            row |= {"name": self.text(), "namespace": self.text() if self.template_namespace else ""}
            inner = []
            for _ in range(self.count(64, "subtypes")):
                inner.append(self.rows["data_types"][i]["text"] if self.byte() == 0x73 and (i := self.data_type()) is not None and i < len(self.rows["data_types"]) else f"typeid{self.int()}")
            row["text"] = f"{row['name']}<{', '.join(inner) or '?'}>"
        else:
            raise FormatError(f"type tag {tag!r} at {self.at - 1}")
        return self.put("types", **row)

    def data_type(self) -> int:
        """The row of a data type. Its number is taken before its parts are read."""
        back = self.int()
        if back:
            return back - 1
        row = {"token": None, "type": None, "flags": None, "funcdef": None, "text": "?"}
        at = self.put("data_types", **row)
        row = self.rows["data_types"][at]
        row["token"] = self.int()
        base = TOKENS.get(row["token"], f"tt{row['token']}")
        if row["token"] == 5:
            row["type"] = self.type()
            if row["type"] is not None:
                base = self.rows["types"][row["type"]]["text"]
        row["flags"] = flags = self.byte()
        if self.dialect == OLD and row["token"] == 5 and row["type"] is not None and self.rows["types"][row["type"]]["name"] == "_builtin_function_":
            row["funcdef"] = self.signature("funcdef value")
        row["text"] = ("const " if flags & 2 else "") + base + ("@" if flags & 1 else "") + ("&" if flags & 4 else "")
        return at

    def shown(self, data_type: int) -> str:
        known = self.rows["data_types"]
        return known[data_type]["text"] if 0 <= data_type < len(known) else f"T{data_type}"

    # functions

    def signature(self, context: str, at: int | None = None) -> int:
        """Reads a signature into a function row (a new one unless given); returns its number."""
        at = self.put("functions", context=context) if at is None else at
        row = self.rows["functions"][at]
        row["name"] = self.text()
        row["label"] = row["signature"] = f"<global>::{row['name']}"
        row |= {"n_params": 0, "n_variable": 0, "is_template": False, "returns_object": False, "is_void": False}
        if row["name"] == "$dlgte":
            return at
        row["returns"] = self.data_type()
        types = [self.data_type() for _ in range(self.count(256, "parameters"))]
        lists = self.dialect == OLD or bool(types)
        flags, defaults = [], []
        if lists:
            flags = self.listed(types, self.int)
        row["kind"] = self.int()
        if lists:
            defaults = self.listed(types, self.string)
        row["owner"] = self.type()
        if row["owner"] is not None:
            self.byte()
        elif row["kind"] == 4 and self.dialect == NEW:
            tag = self.byte()
            if tag == 0x6F:
                self.type()
            elif tag == 0x6E:
                row["namespace"] = self.text()
            else:
                raise FormatError(f"function definition tag {tag} at {self.at - 1}")
        else:
            row["namespace"] = self.text()
        for i, t in enumerate(types):
            self.put("params", function=at, ordinal=i, type=t, text=self.shown(t), in_out=flags[i] if i < len(flags) else None, default_value=defaults[i] if i < len(defaults) else None)
        known, kinds = self.rows["data_types"], self.rows["types"]
        back = known[row["returns"]] if 0 <= row["returns"] < len(known) else {}
        template = lambda i: i is not None and kinds[i]["kind"] == "template"
        row["is_template"] = template(row["owner"]) or template(back.get("type"))
        row["returns_object"] = back.get("type") is not None or bool((back.get("flags") or 0) & 1)
        row["is_void"] = back.get("token") == 80
        row["n_params"] = len(types)
        row["n_variable"] = sum(0 <= t < len(known) and known[t]["token"] == 59 for t in types)
        row["owner_text"] = kinds[row["owner"]]["text"] if row["owner"] is not None else None
        row["label"] = f"{row['owner_text'] or '<global>'}::{row['name']}"
        row["return_text"] = self.shown(row["returns"])
        row["signature"] = f"{row['return_text']} {row['label']}({', '.join(map(self.shown, types))})"
        return at

    def listed(self, types: list, read: Callable) -> list:
        n = self.int()
        if n < 0 or types and n > len(types):
            raise FormatError(f"{n} entries for {len(types)} parameters")
        return [read() for _ in range(n)]

    def body(self, at: int) -> None:
        row = self.rows["functions"][at]
        if self.operands is None:
            raise FormatError("bodies need an opcode table")
        n = self.bare_int()
        if not 0 <= n <= 1 << 20:
            raise FormatError(f"{n} instructions")
        self.note("opcount", n)
        row |= {"declared": n, "body_start": self.at}
        first = len(self.rows["instructions"])
        try:
            for i in range(n):
                start, op = self.at, self.take(1)[0]
                if op not in self.operands:
                    raise FormatError(f"unknown opcode {op} at {start}")
                args = [self.bare_int() for _ in range(self.operands[op])]
                self.note("op", op=op, operands=args)
                self.put("instructions", function=at, idx=i, offset=start - row["body_start"], op=op, operands=args)
        except DAMAGE:
            del self.rows["instructions"][first:]
            raise
        row |= {"body_end": self.at, "stack_needed": self.int()}

    def triples(self, at: int, kind: str, width: int = 3) -> None:
        for i in range(self.count(1 << 18, kind)):
            values = [self.int() for _ in range(width)] + [None] * (3 - width)
            self.put("spans", function=at, ordinal=i, kind=kind, a=values[0], b=values[1], c=values[2])

    def variables(self, at: int, fields: int) -> None:
        n = self.count(1 << 16, "object variables")
        held = []
        for _ in range(n):
            t = self.type()
            held.append((t, *(self.int() for _ in range(fields - 1))))
        heap = self.int() if n else None
        for i, (t, place, *_) in enumerate(held):
            self.put("object_variables", function=at, ordinal=i, type_text=self.rows["types"][t]["text"] if t is not None else "void", place=place, on_heap=heap)

    def function(self, context: str) -> int | None:
        """The number of a function: null, one read before, or a new one."""
        tag = self.byte()
        if tag == 0x00:
            return None
        if tag == 0x72:
            return self.saved[n] if 0 <= (n := self.int()) < len(self.saved) else None
        if tag != 0x66:
            raise FormatError(f"function tag {tag} at {self.at - 1}")
        at = self.put("functions", context=context, flags=None)
        self.rows["functions"][at]["collect"] = len(self.saved)
        self.saved.append(at)
        self.signature(context, at)
        row = self.rows["functions"][at]
        if row.get("kind") == 1 and self.dialect == OLD:
            self.body(at)
            self.variables(at, 3)
            self.triples(at, "object info")
            row["flags"] = self.byte()
        elif row.get("kind") == 1:
            row["flags"] = flags = self.byte()
            if not flags & 0x04:
                self.body(at)
                if flags & 0x08:
                    self.variables(at, 2)
                    self.triples(at, "object info")
                if flags & 0x10:
                    self.triples(at, "try and catch", 2)
        elif row.get("kind") in (2, 3):
            row["vf_index"] = self.int()
        elif row.get("kind") == 4 and self.dialect == NEW:
            self.byte()
        return at

    def function_or_error(self, context: str) -> int | None:
        """A function, or a row of parse_errors and the next place that looks like one."""
        start, traced = self.at, len(self.rows["trace"])
        try:
            return self.function(context)
        except DAMAGE as e:
            error = {"context": context, "offset": start, "error": f"{type(e).__name__}: {e}", "skipped": None}
            self.rows["parse_errors"].append(error)
            del self.rows["trace"][traced:]
            for at in range(start + 1, min(len(self.data), start + RESYNC)):
                if self.starts_function(at):
                    self.at, error["skipped"] = at, at - start
                    self.note("raw", raw=self.data[start:at])
                    return None
            raise FormatError(f"no function within {RESYNC} bytes of {start}") from e

    def starts_function(self, at: int) -> bool:
        if self.data[at] not in (0x66, 0x72):
            return False
        probe = Walk(self.data, self.dialect, at + 1)
        probe.tracing, probe.rows["strings"] = False, list(self.rows["strings"])
        try:
            if self.data[at] == 0x72:
                return 0 <= probe.int() < len(self.saved)
            return IDENTIFIER.match(probe.string()) is not None
        except DAMAGE:
            return False

    # sections

    def enum(self) -> None:
        row = self.declaration()
        at = self.put("enums", **row)
        for i in range(self.count(4096, "members")):
            self.put("enum_members", enum=at, ordinal=i, name=self.text(), value=self.word(signed=True))

    def class_blocks(self) -> None:
        classes = self.rows["classes"]
        late = [c for c in classes if not c["is_interface"]]
        for c in [c for c in classes if c["is_interface"]] + late:
            self.class_block(c)
        for c in late:
            for i in range(self.count(8192, "properties")):
                name, t = self.text(), self.data_type()
                self.put("properties", **{"class": c["name"]}, ordinal=i, name=name, type=t, flags=self.int())

    def class_block(self, c: dict) -> None:
        name = c["name"]
        member = lambda kind, i, f: self.put("class_members", **{"class": name}, kind=kind, ordinal=i, function=f)
        c["derived_from"] = self.type()
        for i in range(self.count(256, "interfaces")):
            t = self.type()
            offset = self.int() if not c["is_interface"] or self.dialect == OLD else None
            self.put("class_interfaces", **{"class": name}, ordinal=i, type=t, offset=offset)
        if not c["is_interface"] and c["flags"] not in (TYPEDEF, ENUM):
            member("destructor", 0, self.function_or_error(f"{name} destructor"))
            for i in range(self.count(8192, "constructors")):
                member("constructor", i, self.function_or_error(f"{name} constructor"))
                member("factory", i, self.function_or_error(f"{name} factory"))
        for kind in ("method", "virtual"):
            for i in range(self.count(8192, f"{kind}s")):
                member(kind, i, self.function_or_error(f"{name} {kind} {i}"))
        self.rows["sections"].append({"name": f"class {name}", "start": self.at, "n": 1})

    def section(self, name: str, most: int, read: Callable[[int], None]) -> None:
        n = self.count(most, name)
        self.rows["sections"].append({"name": name, "start": self.at, "n": n})
        for i in range(n):
            read(i)

    def typedef(self, i: int) -> None:
        row = self.declaration()
        self.put("typedefs", ordinal=i, name=row["name"], namespace=row["namespace"], token=self.int())

    def global_property(self, i: int) -> None:
        name, space, t = self.text(), self.text(), self.data_type()
        self.put("global_properties", ordinal=i, name=name, namespace=space, type=t, init=self.function_or_error(f"{name} initialiser"))

    def used_function(self, i: int) -> None:
        tag = self.byte()
        row = {"origin": None, "function": None, "label": None}
        if tag not in (0x00, 0x6E):
            at = self.signature("used function")
            row = {"origin": {0x61: "application", 0x6D: "module"}.get(tag, chr(tag)), "function": at, "label": self.rows["functions"][at]["label"]}
        self.put("used_functions", ordinal=i, **row)

    def used_object_prop(self, i: int) -> None:
        owner = self.type()
        text = self.rows["types"][owner]["text"] if owner is not None else "void"
        if self.dialect == OLD:
            self.put("used_object_props", ordinal=i, owner_text=text, name=self.text(), place=None)
        else:
            self.put("used_object_props", ordinal=i, owner_text=text, name=None, place=self.int())

    def tail(self) -> None:
        """Eleven sections; the last must end where the module ends."""

        def used_type(i: int) -> None:
            t = self.type()
            self.put("used_types", ordinal=i, type=t, text=self.rows["types"][t]["text"] if t is not None else "void")

        def used_type_id(i: int) -> None:
            t = self.data_type()
            self.put("used_type_ids", ordinal=i, type=t, text=self.shown(t))

        def used_global(i: int) -> None:
            name, space, t = self.text(), self.text(), self.data_type()
            self.put("used_global_props", ordinal=i, name=name, namespace=space, type=t, of_module=bool(self.byte()))

        def bound(i: int) -> None:
            self.function("bind info")
            self.string()

        self.section("typedefs", 4096, self.typedef)
        self.section("global properties", 1 << 18, self.global_property)
        self.section("module functions", 1 << 18, lambda i: self.function_or_error("module function"))
        self.section("global functions", 1 << 18, lambda i: self.function_or_error("global function"))
        self.section("bind info", 1 << 16, bound)
        self.section("used types", 1 << 18, used_type)
        self.section("used type ids", 1 << 18, used_type_id)
        self.section("used functions", 1 << 20, self.used_function)
        self.section("used global properties", 1 << 18, used_global)
        self.section("used strings", 1 << 20, lambda i: self.put("used_strings", ordinal=i, value=self.string()))
        self.section("used object properties", 1 << 20, self.used_object_prop)
        if self.at != len(self.data):
            raise FormatError(f"the tail ended at {self.at} of {len(self.data)} bytes")


def read_head(walk: Walk, n_enums: int) -> None:
    for _ in range(n_enums):
        walk.enum()


def candidates(data: bytes) -> list[dict]:
    """Every reading of a module's head that holds some enums, with its score: classes complete, classes, end, enums."""
    out = []
    for dialect in (OLD, NEW):
        starts: list[tuple[int, int | None]] = [(s, None) for s in range(1, 6)]
        try:
            _, p = decode_int(data, 0)
            n, start = decode_int(data, p)
            if 0 <= n <= 4096:
                starts.insert(0, (start, n))
        except IndexError:
            pass
        for start, n in starts:
            walk = Walk(data, dialect, start)
            walk.tracing, found, end, whole = False, 0, start, True
            try:
                while found < (4096 if n is None else n):
                    walk.enum()
                    found, end = found + 1, walk.at
            except DAMAGE:
                whole = n is None
            if not whole or (n is None and not found):
                continue
            # enums that broke off may have left strings behind: read again up to the last whole one
            walk = Walk(data, dialect, start)
            walk.tracing = False
            declared, parsed = -1, 0
            try:
                read_head(walk, found)
                declared = walk.int()
                for _ in range(declared if 0 <= declared <= 1 << 20 else 0):
                    walk.declaration()
                    parsed += 1
            except DAMAGE:
                pass
            out.append({"dialect": dialect, "start": start, "n_enums": found, "complete": int(parsed > 0 and parsed == declared), "parsed": parsed, "end": walk.at if 0 <= declared <= 1 << 20 else start})
    return out


def score(c: dict) -> tuple:
    return c["complete"], c["parsed"], c["end"], c["n_enums"]


def walk_module(data: bytes, head: dict, operands: dict[int, int] | None, template_namespace: bool, tracing: bool = True) -> tuple[Walk, str, str | None]:
    """The walk, how far it came ('tail', 'blocks' or 'head'), and why it ended early."""
    walk = Walk(data, head["dialect"], head["start"], operands, template_namespace)
    walk.tracing = tracing
    walk.note("raw", raw=data[: head["start"]])
    reached = "head"
    try:
        read_head(walk, head["n_enums"])
        walk.classes_declared = walk.count(1 << 20, "classes")
        for _ in range(walk.classes_declared):
            row = walk.declaration()
            walk.put("classes", **row, is_interface=bool(row["flags"] & SCRIPT_OBJECT[walk.dialect]) and row["size"] == 0, derived_from=None)
        walk.funcdefs_declared = walk.count(1 << 20, "function definitions")
        for _ in range(walk.funcdefs_declared):
            walk.function("function definition")
            walk.funcdefs_read += 1
        if operands is not None:
            walk.class_blocks()
            reached = "blocks"
            walk.tail()
            reached = "tail"
        return walk, reached, None
    except DAMAGE as e:
        return walk, reached, f"{type(e).__name__}: {e}"


def decode(data: bytes, operands: dict[int, int] | None, tracing: bool = True) -> tuple[Walk | None, dict]:
    """The best walk of a module and facts about it. Templates are read with a namespace first, then without one."""
    heads = candidates(data)
    best = max(heads, key=score, default=None)  # the first of equals
    if best is None or not best["parsed"]:
        return None, {"reached": "nothing", "size": len(data), "error": "no dialect reads the head", "candidates": heads}
    tries = [(walk_module(data, best, operands, space, tracing), space) for space in (True, False)]
    rank = lambda t: (t[0][1] == "tail", sum(s["name"].startswith("class ") for s in t[0][0].rows["sections"]), t[0][0].at)
    (walk, reached, error), space = tries[0] if tries[0][0][1] == "tail" or rank(tries[0]) >= rank(tries[1]) else tries[1]
    facts = {"dialect": best["dialect"], "start": best["start"], "size": len(data), "end": walk.at, "reached": reached, "error": error}
    return walk, facts | {"template_namespace": space, "n_enums": best["n_enums"], "classes_declared": walk.classes_declared, "funcdefs_declared": walk.funcdefs_declared, "funcdefs_read": walk.funcdefs_read, "candidates": heads}


def trace_of(data: bytes, operands: dict[int, int]) -> list[dict]:
    """Every field of a module in order; an error unless the walk reached the module's end, for part of a trace would write part of a module."""
    walk, facts = decode(data, operands)
    if walk is None or facts["reached"] != "tail":
        raise FormatError(f"no trace: the walk ended at {facts.get('end', 0)} of {len(data)} bytes ({facts['error']})")
    return walk.rows["trace"]


def peek(data: bytes) -> dict:
    """What a module's first bytes say: debug flag, number of enums (if that is a small number) and the likely dialect."""
    if len(data) < 3:
        return {"no_debug": None, "enums": None, "dialect": None}
    try:
        enums, at = decode_int(data, 1)
        after = data[at] if at < len(data) else None
    except IndexError:
        enums, after = None, None
    dialect = OLD if after == 0x6E else NEW if after is not None and after % 2 == 0 else None
    return {"no_debug": bool(data[0]), "enums": enums if enums is not None and 0 <= enums <= 4096 else None, "dialect": dialect}


def literals_at(data: bytes, dialect: str | None = None) -> list[tuple[int, bytes]]:
    """Distinct plausible literals with the offset at which each comes first, in order."""
    if dialect is None:
        best = max(candidates(data), key=score, default=None)
        dialect = best["dialect"] if best and best["parsed"] else NEW
    out: dict[bytes, int] = {}
    for at in range(len(data) - 1):
        try:
            if dialect == OLD:
                if data[at] != 0x6E:
                    continue
                n, start = decode_int(data, at + 1)
            else:
                n, start = decode_int(data, at)
                if n & 1:
                    continue
                n >>= 1
        except IndexError:
            continue
        if 1 <= n <= 512 and start + n <= len(data) and plausible_literal(raw := data[start : start + n]):
            out.setdefault(raw, at)
    return [(at, raw) for raw, at in out.items()]


def literals(data: bytes, dialect: str | None = None) -> list[bytes]:
    """Distinct plausible literals at any offset, in order."""
    return [raw for _, raw in literals_at(data, dialect)]


def harvested(modules: DataFrame) -> DataFrame:
    """module_id, nr, offset and literal: the distinct plausible literals at any offset of each module (module_id, content)."""

    def run(batches):
        for batch in batches:
            for module, data in zip(*(batch.column(c).to_pylist() for c in ("module_id", "content")), strict=True):
                found = literals_at(data or b"")
                cols = [pa.array([module] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array([at for at, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())]
                yield pa.record_batch(cols, ["module_id", "nr", "offset", "literal"])

    return modules.select("module_id", "content").mapInArrow(run, "module_id string, nr long, offset long, literal binary")


def peeked(modules: DataFrame) -> DataFrame:
    """module_id, no_debug, enums and dialect as the first bytes of each module tell them."""

    def run(batches):
        for batch in batches:
            seen = [peek(x or b"") for x in batch.column("content").to_pylist()]
            kinds = {"no_debug": pa.bool_(), "enums": pa.int64(), "dialect": pa.string()}
            yield pa.record_batch([batch.column("module_id"), *(pa.array([x[c] for x in seen], k) for c, k in kinds.items())], ["module_id", *kinds])

    return modules.select("module_id", F.substring("content", 1, 16).alias("content")).mapInArrow(run, "module_id string, no_debug boolean, enums long, dialect string")


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in TABLES[table].split(", ")]


def read_module(data: bytes | None, operands: dict[int, int], tracing: bool = True) -> dict[str, list[dict]]:
    """The rows of every table of one module. Whatever goes wrong is told in its `modules` row, so one module ends no batch."""
    try:
        walk, facts = decode(data or b"", operands, tracing)
    except Exception as e:
        walk, facts = None, {"reached": "nothing", "size": len(data or b""), "error": f"{type(e).__name__}: {e}"}
    return (walk.rows if walk else {}) | {"modules": [facts], "candidates": facts.get("candidates", [])}


def decoded(modules: DataFrame, opcodes: dict[int, dict], only: Iterable[str] | None = None) -> DataFrame:
    """One row a table row of each module (module_id, content): module_id, table, nr, and the row itself in the column of its table.

    A module is a task's work from end to end. With only, nothing but these tables leaves the task, and fields are traced only if
    `trace` is one. Every use of the result decodes again unless it is kept: `stored` writes it once, partitioned by table.
    """
    operands = {int(k): v["operands"] for k, v in opcodes.items()}
    wanted = [t for t in TABLES if only is None or t in {"modules", *only}]
    kinds = {t: pa.struct([(c, ARROW[k]) for c, k in columns_of(t)]) for t in wanted}

    def run(batches):
        for batch in batches:
            for module, data in zip(*(batch.column(c).to_pylist() for c in ("module_id", "content")), strict=True):
                found = read_module(data, operands, "trace" in wanted)
                for t in wanted:
                    rows = found.get(t, [])
                    for lo in range(0, len(rows), ROWS):
                        part = rows[lo : lo + ROWS]
                        n = len(part)
                        own = pa.StructArray.from_arrays([pa.array([r.get(c) for r in part], ARROW[k]) for c, k in columns_of(t)], [c for c, _ in columns_of(t)])
                        head = [pa.array([module] * n, pa.string()), pa.array([t] * n, pa.string()), pa.array(range(lo, lo + n), pa.int64())]
                        yield pa.record_batch([*head, *(own if x == t else pa.nulls(n, kinds[x]) for x in wanted)], ["module_id", "table", "nr", *wanted])

    shape = ", ".join(f"`{t}` struct<{', '.join(f'`{c}`: {k.replace("long", "bigint")}' for c, k in columns_of(t))}>" for t in wanted)
    return modules.select("module_id", "content").mapInArrow(run, f"module_id string, `table` string, nr long, {shape}")


def stored(modules: DataFrame, opcodes: dict[int, dict], place: str, only: Iterable[str] | None = None) -> DataFrame:
    """`decoded`, written once to place (a folder that all executors share), a part for each table: a table's reader reads no other."""
    rows = decoded(modules, opcodes, only)
    rows.write.partitionBy("table").mode("overwrite").parquet(place)
    return modules.sparkSession.read.schema(rows.schema).parquet(place)


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """A decoded table: module_id, its columns, and nr (the row's place in it)."""
    return rows.where(F.col("table") == name).select("module_id", f"{name}.*", "nr")


def module_facts(rows: DataFrame) -> DataFrame:
    return table_of(rows, "modules").drop("nr")
