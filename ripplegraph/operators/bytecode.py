"""Class files to info rows: the class, its fields, its methods and what their code calls.

A class file is read by its layout: constant pool, fields, methods, and the instructions of each Code attribute, of which only the
five that call are looked at. Files that aren't class files, or end early, give a diagnostic row. Jars are read entry by entry.
"""

from __future__ import annotations

import io
import struct
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BYTECODE = "file string, error string, kind string, line int, owner string, method string, descriptor string, modifiers array<string>, target_owner string, target_method string, target_descriptor string, super_name string, interfaces array<string>"
# The class file format.
MAGIC = 0xCAFEBABE
_POOL = {3: 4, 4: 4, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x100: "native", 0x400: "abstract"}
_SYNTHETIC, _BRIDGE = 0x1000, 0x40
_CALLS = frozenset((0xB6, 0xB7, 0xB8, 0xB9, 0xBA))  # virtual, special, static, interface, dynamic
#: bytes after the instruction's own, for those that have any and a fixed number of them
_OPERANDS = (
    {k: 1 for k in (0x10, 0x12, 0x15, 0x16, 0x17, 0x18, 0x19, 0x36, 0x37, 0x38, 0x39, 0x3A, 0xA9, 0xBC)}
    | {k: 2 for k in (0x11, 0x13, 0x14, 0x84, *range(0x99, 0xA9), *range(0xB2, 0xB9), 0xBB, 0xBD, 0xC0, 0xC1, 0xC6, 0xC7)}
    | {0xC5: 3, 0xB9: 4, 0xBA: 4, 0xC8: 4, 0xC9: 4}
)
_TABLE, _LOOKUP, _WIDE, _IINC = 0xAA, 0xAB, 0xC4, 0x84


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, kind: str) -> int:
        size = struct.calcsize(kind)
        if self.at + size > len(self.raw):
            raise ValueError("the class file ends early")
        self.at += size
        return struct.unpack_from(kind, self.raw, self.at - size)[0]

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.raw):
            raise ValueError("the class file ends early")
        self.at += n
        return self.raw[self.at - n : self.at]


def _text(raw: bytes) -> str:
    """The JVM's own UTF-8, with its two-byte zero and surrogate pairs."""
    return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Pool:
    def __init__(self, r: Reader):
        self.held: list = [None]
        n = r.take(">H")
        while len(self.held) < n:
            tag = r.take(">B")
            if tag == 1:
                self.held.append(_text(r.bytes(r.take(">H"))))
            elif tag in (5, 6):
                self.held += [r.bytes(8), None]
            elif tag in _POOL:
                self.held.append((tag, r.bytes(_POOL[tag])))
            else:
                raise ValueError(f"unknown constant {tag}")

    def name(self, k: int) -> str:
        """A class by its entry, with dots."""
        return self.held[struct.unpack(">H", self.held[k][1])[0]].replace("/", ".")

    def reference(self, k: int) -> tuple[str, str, str]:
        """Owner, name and descriptor of a field or method; a dynamic call has no owner."""
        tag, raw = self.held[k]
        first, both = struct.unpack(">HH", raw)
        name, kind = struct.unpack(">HH", self.held[both][1])
        return "" if tag == 18 else self.name(first), self.held[name], self.held[kind]


def _calls(code: bytes):
    """(offset, pool entry) of each call in a method's instructions."""
    at = 0
    while at < len(code):
        op = code[at]
        if op in _CALLS:
            yield at, struct.unpack_from(">H", code, at + 1)[0]
        if op in (_TABLE, _LOOKUP):
            k = at + 4 - at % 4
            if op == _TABLE:
                low, high = struct.unpack_from(">ii", code, k + 4)
                at = k + 12 + 4 * (high - low + 1)
            else:
                at = k + 8 + 8 * struct.unpack_from(">i", code, k + 4)[0]
        elif op == _WIDE:
            at += 6 if code[at + 1] == _IINC else 4
        else:
            at += 1 + _OPERANDS.get(op, 0)


def classfile(raw: bytes) -> list[dict]:
    r = Reader(raw)
    if r.take(">I") != MAGIC:
        raise ValueError("not a class file")
    r.take(">I")
    pool = Pool(r)
    flags, owner, above = r.take(">H"), pool.name(r.take(">H")), r.take(">H")
    interfaces = [pool.name(r.take(">H")) for _ in range(r.take(">H"))]
    named = lambda f: [v for k, v in _FLAGS.items() if f & k]
    out = [{"kind": "class", "owner": owner, "modifiers": named(flags), "super_name": pool.name(above) if above else None, "interfaces": interfaces}]
    for kind in ("field", "method"):
        for _ in range(r.take(">H")):
            f, name, descriptor = r.take(">H"), pool.held[r.take(">H")], pool.held[r.take(">H")]
            row = {"kind": kind, "owner": owner, "method": name, "descriptor": descriptor, "modifiers": named(f)}
            made = not f & (_SYNTHETIC | _BRIDGE if kind == "method" else _SYNTHETIC)
            calls, lines = [], []
            for _ in range(r.take(">H")):
                title, body = pool.held[r.take(">H")], Reader(r.bytes(r.take(">I")))
                if title != "Code":
                    continue
                body.take(">I")
                calls = list(_calls(body.bytes(body.take(">I"))))
                body.bytes(8 * body.take(">H"))
                for _ in range(body.take(">H")):
                    inner, part = pool.held[body.take(">H")], Reader(body.bytes(body.take(">I")))
                    if inner == "LineNumberTable":
                        lines += [(part.take(">H"), part.take(">H")) for _ in range(part.take(">H"))]
            if not made:
                continue
            lines.sort()
            line_at = lambda at, known=lines: max((x for x in known if x[0] <= at), default=(0, 0))[1]
            out.append(row | {"line": lines[0][1] if lines else 0})
            for at, k in calls:
                to, called, onto = pool.reference(k)
                if to:
                    out.append(row | {"kind": "call", "line": line_at(at), "target_owner": to, "target_method": called, "target_descriptor": onto})
    return out


def read(path: str, raw: bytes) -> list[dict]:
    """Rows of a class file, or of all class files of a jar; one row with an error for each that can't be read."""
    if not path.endswith((".jar", ".war", ".zip")):
        try:
            return [{"file": path, **x} for x in classfile(raw)]
        except (ValueError, IndexError, KeyError, struct.error, TypeError, AttributeError) as e:
            return [{"file": path, "error": f"{type(e).__name__}: {e}"}]
    try:
        out = []
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name in z.namelist():
                if name.endswith(".class"):
                    out += read(f"{path}!/{name}", z.read(name))
        return out
    except zipfile.BadZipFile as e:
        return [{"file": path, "error": f"{type(e).__name__}: {e}"}]


def bytecode_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of BYTECODE for files with their bytes, as spark.read.format("binaryFile") gives them."""
    schema = to_arrow_schema(StructType.fromDDL(BYTECODE))

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(read(p, raw or b""), schema)

    return files.select(path, content).mapInArrow(run, BYTECODE)
