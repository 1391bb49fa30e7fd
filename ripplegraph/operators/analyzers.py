"""Analyzers: source text to info rows, for formats that Spark's functions don't read.

Each is a function of (path, content) that yields rows, run over files by `analyse`; a file that can't be parsed gives one
diagnostic row instead of failing its task. Java classes, bytecode and flow rows are imported (see mappers for their
columns); the rest is read here: MyBatis and Struts XML, dicon and web.xml files, report definitions, and JSP pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rows = Iterator[dict]
#: Rows that a reader's task holds before it hands them on.
BATCH_ROWS = 10_000
_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", re.S)


def analyse(files: DataFrame, reader: Callable[[str, str], Rows], ddl: str, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of ddl, with file and error first; error is null but for the row of a file that couldn't be read."""
    ddl = f"file string, error string, {ddl}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for b in batches:
            out = []
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [{"file": p, **r} for r in reader(p, text or "")]
                except (ElementTree.ParseError, ValueError) as e:
                    out.append({"file": p, "error": f"{type(e).__name__}: {e}"})
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select(F.col(path).cast("string"), F.col(content).cast("string")).mapInArrow(run, ddl)


def xml(text: str) -> ElementTree.Element:
    return ElementTree.fromstring(_DOCTYPE.sub("", text.lstrip("﻿ \r\n\t")))


def line_of(text: str, needle: str) -> int:
    at = text.find(needle)
    return text.count("\n", 0, at) + 1 if at >= 0 else 1


# --- MyBatis ---

MYBATIS = "namespace string, statement_id string, verb string, dynamic boolean, sql string, line int"
_DYNAMIC = frozenset("if choose when otherwise trim where set foreach bind".split())


def mybatis(path: str, text: str) -> Rows:
    """Statements of a mapper, with <include> put in (a fragment isn't put into itself)."""
    root = xml(text)
    if root.tag != "mapper":
        return
    space = root.get("namespace", "")
    fragments = {e.get("id", ""): e for e in root.iter("sql")}

    def flat(e: ElementTree.Element, inside: tuple[str, ...]) -> str:
        parts = [e.text or ""]
        for x in e:
            if x.tag == "include":
                ref = x.get("refid", "")
                ref = ref.removeprefix(f"{space}.") if ref not in fragments else ref
                if ref in fragments and ref not in inside:
                    parts.append(flat(fragments[ref], (*inside, ref)))
            elif x.tag != "selectKey":
                parts.append(f" {flat(x, inside)} ")
            parts.append(x.tail or "")
        return "".join(parts)

    for e in root:
        if e.tag in ("select", "insert", "update", "delete") and e.get("id"):
            used = {x.tag for x in e.iter()} | {x.tag for ref in e.iter("include") for f in [fragments.get(ref.get("refid", ""))] if f is not None for x in f.iter()}
            yield {"namespace": space, "statement_id": e.get("id"), "verb": e.tag, "dynamic": bool(used & _DYNAMIC) or "${" in flat(e, ()), "sql": " ".join(flat(e, ()).split()), "line": line_of(text, f'id="{e.get("id")}"')}


# --- Struts ---

STRUTS = "kind string, name string, path string, type string, dispatch string, method string, value string, forwards array<struct<name:string,path:string>>, line int"


def struts(path: str, text: str) -> Rows:
    """Actions with their forwards, form beans, global forwards, exceptions, plug-ins, controllers and message resources."""
    root = xml(text)
    if root.tag != "struts-config":
        return
    at = lambda needle: line_of(text, needle)
    forwards = lambda e: [{"name": f.get("name", ""), "path": f.get("path", "")} for f in e.findall("forward")]
    for e in root.iter("action"):
        parameter, cls = e.get("parameter") or "", e.get("type") or ""
        dispatch = "mapping" if re.search(r"MappingDispatch|EventDispatch", cls) else "dispatch" if parameter and re.search(r"Dispatch", cls) else "none"
        own = forwards(e)
        if e.get("forward"):
            own.append({"name": "forward", "path": e.get("forward")})
        yield {"kind": "action", "name": e.get("name"), "path": e.get("path", ""), "type": cls, "dispatch": dispatch, "method": parameter if dispatch == "mapping" else None, "value": parameter, "forwards": own, "line": at(f'path="{e.get("path", "")}"')}
    for e in root.iter("form-bean"):
        yield {"kind": "form-bean", "name": e.get("name"), "type": e.get("type"), "forwards": [], "line": at(f'name="{e.get("name")}"')}
        for p in e.findall("form-property"):
            yield {"kind": "form-property", "name": p.get("name"), "type": p.get("type"), "value": e.get("name"), "forwards": [], "line": at(f'name="{p.get("name")}"')}
    for box in root.findall("global-forwards"):
        for f in box.findall("forward"):
            yield {"kind": "global-forward", "name": f.get("name"), "path": f.get("path"), "forwards": [], "line": at(f'path="{f.get("path")}"')}
    for tag in ("exception", "plug-in", "controller", "message-resources"):
        for e in root.iter(tag):
            yield {"kind": tag, "name": e.get("key"), "path": e.get("path"), "type": e.get("type") or e.get("className") or e.get("processorClass"), "value": e.get("parameter"), "forwards": [], "line": at(f"<{tag}")}


# --- dicon, web.xml ---

DICON = "kind string, name string, type string, value string, line int"


def dicon(path: str, text: str) -> Rows:
    root = xml(text)
    if root.tag != "components":
        return
    if root.get("namespace"):
        yield {"kind": "namespace", "name": root.get("namespace"), "type": "", "value": "", "line": 1}
    for e in root.iter("include"):
        yield {"kind": "include", "name": "", "type": "", "value": e.get("path", ""), "line": line_of(text, e.get("path", ""))}
    for e in root.iter("component"):
        cls = e.get("class") or ""
        name = e.get("name") or cls.rpartition(".")[2]
        here = line_of(text, f'name="{e.get("name")}"' if e.get("name") else cls)
        yield {"kind": "component", "name": name, "type": cls, "value": "", "line": here}
        if cls.endswith("Interceptor"):
            yield {"kind": "interceptor", "name": name, "type": cls, "value": "", "line": here}
        for p in e.findall("property"):
            yield {"kind": "property", "name": name, "type": cls, "value": p.get("name", ""), "line": line_of(text, f'name="{p.get("name")}"')}
        for a in e.findall("aspect"):
            yield {"kind": "aspect", "name": name, "type": cls, "value": " ".join((a.text or a.get("pointcut") or "").split()), "line": here}


WEB_XML = "kind string, name string, value string"


def web_xml(path: str, text: str) -> Rows:
    """Servlet mappings, context parameters, Struts configurations and page encodings."""
    root = xml(re.sub(r'\sxmlns="[^"]*"', "", text))
    if root.tag != "web-app":
        return
    said = lambda e, tag: " ".join((e.findtext(tag) or "").split())
    for e in root.findall("servlet-mapping"):
        for u in e.findall("url-pattern"):
            yield {"kind": "servlet-mapping", "name": said(e, "servlet-name"), "value": (u.text or "").strip()}
    for e in root.findall("servlet"):
        yield {"kind": "servlet", "name": said(e, "servlet-name"), "value": said(e, "servlet-class") or said(e, "jsp-file")}
        for p in e.findall("init-param"):
            key = said(p, "param-name")
            if key == "config" or key.startswith("config/"):
                for c in said(p, "param-value").split(","):
                    yield {"kind": "struts-config", "name": key.partition("/")[2], "value": c.strip()}
    for e in root.findall("context-param"):
        yield {"kind": "context-param", "name": said(e, "param-name"), "value": said(e, "param-value")}
    for e in root.iter("jsp-property-group"):
        if said(e, "page-encoding"):
            for u in e.findall("url-pattern"):
                yield {"kind": "page-encoding", "name": (u.text or "").strip(), "value": said(e, "page-encoding")}


# --- reports ---

REPORT = "format string, report string, kind string, name string, table_name string, column_name string, line int"
#: format -> (extensions, field elements, parameter elements)
REPORT_FORMATS = {
    "layout": ((".layout.xml",), ("field", "item", "textField"), ("parameter", "param")),
    "field-definition": ((".fields.xml", ".fielddef.xml"), ("field", "fieldDefinition"), ("parameter",)),
    "pmd": ((".pmd", ".pmd.xml"), ("field", "item"), ("parameter",)),
    "psf": ((".psf", ".psf.xml"), ("field", "item"), ("parameter",)),
    "svf": ((".svf.xml", ".xml.svf"), ("field", "Field", "record-field"), ("parameter", "query-parameter")),
    "bip": ((".xdo.xml", ".bip.xml", ".xdm"), ("element", "field", "dataField"), ("parameter",)),
    "list-creator": ((".lcd.xml", ".listcreator.xml"), ("item", "field"), ("parameter", "param")),
}


def report_format(path: str) -> str | None:
    low = path.lower()
    return next((k for k, (ends, _, _) in REPORT_FORMATS.items() if low.endswith(ends)), None)


def report(path: str, text: str) -> Rows:
    """Fields and parameters of a report definition, of the first format that takes the file."""
    kind = report_format(path)
    if kind is None:
        return
    root = xml(text)
    title = root.get("name") or root.get("id") or path.rpartition("/")[2].partition(".")[0]
    _, fields, parameters = REPORT_FORMATS[kind]
    seen: set[tuple] = set()
    for e in root.iter():
        tag = e.tag.rpartition("}")[2]
        name = e.get("name") or e.get("id") or e.get("value")
        what = "field" if tag in fields else "parameter" if tag in parameters else None
        if what and name and (what, name) not in seen:
            seen.add((what, name))
            column = e.get("column") or e.get("columnName") or e.get("source")
            table = e.get("table") or e.get("tableName")
            if column and not table and "." in column:
                table, _, column = column.rpartition(".")
            yield {"format": kind, "report": title, "kind": what, "name": name, "table_name": table, "column_name": column, "line": line_of(text, name)}


# --- descriptors ---

# The JVM's letters for primitive types.
_LETTERS = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}


def type_descriptor(name: Column) -> Column:
    """The erased JVM descriptor of a type's qualified name, like java.util.List<String>[]."""
    bare = F.regexp_replace(F.regexp_replace(name, r"<.*>", ""), r"\s+|\.\.\.$", "")
    bare = F.when(F.trim(name).endswith("..."), F.concat(bare, F.lit("[]"))).otherwise(bare)
    depth = (F.length(bare) - F.length(F.replace(bare, F.lit("[]"), F.lit("")))) / 2
    base = F.replace(bare, F.lit("[]"), F.lit(""))
    letter = F.lit(None).cast("string")
    for k, v in _LETTERS.items():
        letter = F.when(base == k, F.lit(v)).otherwise(letter)
    return F.concat(F.repeat(F.lit("["), depth.cast("int")), F.coalesce(letter, F.concat(F.lit("L"), F.replace(base, F.lit("."), F.lit("/")), F.lit(";"))))


def method_descriptor(parameters: Column, returns: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(parameters, type_descriptor), ""), F.lit(")"), type_descriptor(returns))
