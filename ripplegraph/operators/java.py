"""Java sources to info rows: declarations, calls, Spring parts, JDBC statements, JPA entities and flows of variables.

A file is read by itself, as tokens: declarations by their shape, bodies by what stands before brackets and equals signs. Types
are named by the file's imports and own types, java.lang, else its package. What other files would tell (the parameters of a
method that is called there) is left open, and `call_rows` joins it by owner, name and number of arguments. Readers are functions
of (path, text) for `analyzers.analyse`; a file whose brackets don't match gives its diagnostic row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegraph.operators.analyzers import Rows, analyse
from ripplegraph.sources.lineage import cut

# Words, types and marks of Java and of the frameworks that are read.
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
KEYWORDS = frozenset("if for while switch catch synchronized return new throw else do try finally case assert instanceof super this yield import package class interface enum extends implements throws".split())
PRIMITIVES = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}
LANG = frozenset(
    "Object String StringBuilder StringBuffer CharSequence Integer Long Short Byte Character Boolean Double Float Number Math System Thread Runnable Exception RuntimeException Throwable Error Iterable Class Void Override Deprecated Process Record Enum Comparable AutoCloseable Runtime IllegalArgumentException IllegalStateException".split()
)
JDBC_PREPARE = ("prepareStatement", "prepareCall")
JDBC_EXECUTE = ("execute", "executeQuery", "executeUpdate", "executeLargeUpdate")
JDBC_STATEMENTS = ("java.sql.Statement", "java.sql.PreparedStatement", "java.sql.CallableStatement")
VERBS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
ALL_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "TRACE"]
COMPONENTS = {"RestController": "REST_CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Component": "COMPONENT"}
INJECTIONS = frozenset(("Autowired", "Inject", "Resource"))

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(.*?)"""|"((?:\\.|[^"\\\n])*)"|(\'(?:\\.|[^\'\\\n])*\')|([A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(\d[\w.]*)|(\.\.\.|->|::|[-+*/%&|^<>=!]=|&&|\|\||\S)', re.S)
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " "}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str  # id, str, chr, num, op
    text: str
    at: int


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u+([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[2], 16)) if m[2] else _ESCAPE.get(m[3], m[3]), text, flags=re.S)


def tokens(text: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(text):
        if m[1] is not None:
            lines = m[1].split("\n")[1:]
            margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
            out.append(Token("str", _unescaped("\n".join(x[margin:].rstrip() for x in lines)), m.start()))
        elif m[2] is not None:
            out.append(Token("str", _unescaped(m[2]), m.start()))
        elif m[3] is not None:
            out.append(Token("chr", m[3], m.start()))
        elif m[4] is not None:
            out.append(Token("id", m[4], m.start()))
        elif m[5] is not None:
            out.append(Token("num", m[5], m.start()))
        elif m[6] is not None:
            out.append(Token("op", m[6], m.start()))
    return out


@dataclass
class Parameter:
    name: str
    type: str  # as written, without type arguments


@dataclass
class Member:
    """A field, method or constructor ("<init>"). body: the places of its tokens, from after the opening bracket on."""

    name: str
    type: str
    annotations: list[tuple[str, list[Token]]]
    modifiers: set[str]
    at: int
    parameters: list[Parameter] | None = None
    body: tuple[int, int] | None = None
    value: tuple[int, int] | None = None


@dataclass
class Type:
    name: str
    kind: str
    annotations: list[tuple[str, list[Token]]]
    at: int
    variables: set[str]
    members: list[Member] = field(default_factory=list)

    @property
    def fields(self) -> list[Member]:
        return [m for m in self.members if m.parameters is None]

    @property
    def methods(self) -> list[Member]:
        return [m for m in self.members if m.parameters is not None]


class Source:
    """A compilation unit."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens(text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close = self._matched()
        self.open = {c: o for o, c in self.close.items()}
        self.package, self.imports, self.types = "", {}, []
        self._declarations(0, len(self.tokens), None)
        self.by_simple = {t.name.rpartition(".")[2].rpartition("$")[2]: t.name for t in reversed(self.types)}
        self.by_name = {t.name: t for t in self.types}

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def _matched(self) -> dict[int, int]:
        """The place of the closing bracket of each opening one."""
        out, stack = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "op" and t.text in _PAIRS:
                stack.append(k)
            elif t.kind == "op" and t.text in ")]}":
                if not stack or _PAIRS[self.tokens[stack[-1]].text] != t.text:
                    raise ValueError(f"brackets don't match in line {self.line(t.at)}")
                out[stack.pop()] = k
        if stack:
            raise ValueError(f"a bracket of line {self.line(self.tokens[stack[-1]].at)} isn't closed")
        return out

    def is_op(self, k: int, text: str) -> bool:
        return k < len(self.tokens) and self.tokens[k].kind == "op" and self.tokens[k].text == text

    def _angles(self, k: int) -> int:
        """The place after type arguments that start at k, k itself if none do."""
        if not self.is_op(k, "<"):
            return k
        depth = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "op":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if not depth:
                        return k + 1
                elif t.text not in (",", ".", "?", "&", "[", "]", "@"):
                    return -1
            elif t.kind not in ("id", "str"):
                return -1
            k += 1
        return -1

    def type_at(self, k: int) -> tuple[str, int] | None:
        """A type as written, without type arguments, and the place after it."""
        parts = []
        while k < len(self.tokens) and self.tokens[k].kind == "id" and (self.tokens[k].text not in KEYWORDS or parts):
            parts.append(self.tokens[k].text)
            k = self._angles(k + 1)
            if k < 0:
                return None
            if not (self.is_op(k, ".") and k + 1 < len(self.tokens) and self.tokens[k + 1].kind == "id"):
                break
            k += 1
        if not parts:
            return None
        dims = 0
        while self.is_op(k, "[") and self.close[k] == k + 1:
            dims, k = dims + 1, k + 2
        if self.is_op(k, "..."):
            dims, k = dims + 1, k + 1
        return ".".join(parts) + "[]" * dims, k

    def _annotations(self, k: int) -> tuple[list[tuple[str, list[Token]]], set[str], int]:
        """Annotations with their arguments, and modifiers, before a declaration."""
        found, modifiers = [], set()
        while k < len(self.tokens):
            t = self.tokens[k]
            if self.is_op(k, "@") and not (k + 1 < len(self.tokens) and self.tokens[k + 1].text == "interface"):
                k += 1
                name = []
                while k < len(self.tokens) and self.tokens[k].kind == "id":
                    name.append(self.tokens[k].text)
                    k += 1
                    if not self.is_op(k, "."):
                        break
                    k += 1
                inside: list[Token] = []
                if self.is_op(k, "("):
                    inside = self.tokens[k + 1 : self.close[k]]
                    k = self.close[k] + 1
                found.append((".".join(name), inside))
            elif t.kind == "id" and t.text in MODIFIERS:
                modifiers.add(t.text)
                k += 1
            elif t.kind == "id" and t.text == "non" and self.is_op(k + 1, "-"):
                k += 3
            else:
                break
        return found, modifiers, k

    def _skip(self, k: int, end: int) -> int:
        """The place after the next ';' or block at this level."""
        while k < end:
            if self.is_op(k, ";"):
                return k + 1
            if k in self.close:
                block = self.is_op(k, "{")
                k = self.close[k] + 1
                if block:
                    return k
            else:
                k += 1
        return end

    def _declarations(self, k: int, end: int, owner: Type | None) -> None:
        while k < end:
            t = self.tokens[k]
            if t.kind == "id" and owner is None and t.text in ("package", "import"):
                stop = k
                while not self.is_op(stop, ";") and stop < end:
                    stop += 1
                words = [x.text for x in self.tokens[k + 1 : stop]]
                if t.text == "package":
                    self.package = "".join(words)
                elif words and words[0] != "static" and words[-1] != "*":
                    self.imports[words[-1]] = "".join(words)
                k = stop + 1
                continue
            if self.is_op(k, ";"):
                k += 1
                continue
            annotations, modifiers, k = self._annotations(k)
            if k >= end:
                return
            t = self.tokens[k]
            if self.is_op(k, "{"):  # an initialiser
                k = self.close[k] + 1
                continue
            kind = "annotation" if self.is_op(k, "@") else t.text
            if kind in ("class", "interface", "enum", "annotation") or kind == "record" and k + 2 < end and self.tokens[k + 1].kind == "id" and (self.is_op(k + 2, "(") or self.is_op(k + 2, "<")):
                k = self._type(k + 1 + (kind == "annotation"), end, kind, annotations, owner)
                continue
            if owner is None:
                k = self._skip(k, end)
                continue
            after = self._angles(k)
            k = self._member(after if after > 0 else k, end, owner, annotations, modifiers)

    def _type(self, k: int, end: int, kind: str, annotations, owner: Type | None) -> int:
        simple, at = self.tokens[k].text, self.tokens[k].at
        variables = {x.text for x in self.tokens[k + 1 : max(k + 1, self._angles(k + 1))] if x.kind == "id"}
        name = f"{owner.name}${simple}" if owner else f"{self.package}.{simple}" if self.package else simple
        made = Type(name, kind, annotations, at, variables | (owner.variables if owner else set()))
        self.types.append(made)
        k += 1
        while k < end and not self.is_op(k, "{"):
            if kind == "record" and self.is_op(k, "("):
                made.members += [Member(p.name, p.type, [], {"private", "final"}, at) for p in self._parameters(k)]
            k = self.close[k] + 1 if k in self.close else k + 1
        if k >= end:
            return end
        first, last = k + 1, self.close[k]
        if kind == "enum":  # constants up to the ';'
            while first < last and not self.is_op(first, ";"):
                first = self.close[first] + 1 if first in self.close else first + 1
        self._declarations(first, last, made)
        return last + 1

    def _parameters(self, k: int) -> list[Parameter]:
        out, end, k = [], self.close[k], k + 1
        while k < end:
            _, _, k = self._annotations(k)
            got = self.type_at(k)
            if got is None or got[1] >= end or self.tokens[got[1]].kind != "id":
                return out
            name, k = self.tokens[got[1]].text, got[1] + 1
            dims = 0
            while self.is_op(k, "["):
                dims, k = dims + 1, k + 2
            if name != "this":
                out.append(Parameter(name, got[0] + "[]" * dims))
            k += self.is_op(k, ",")
        return out

    def _member(self, k: int, end: int, owner: Type, annotations, modifiers: set[str]) -> int:
        simple = owner.name.rpartition("$")[2].rpartition(".")[2]
        start = self.tokens[k].at
        if self.tokens[k].kind == "id" and self.tokens[k].text == simple and (self.is_op(k + 1, "(") or self.is_op(k + 1, "{")):
            got, name, k = ("void", k), "<init>", k + 1
            if self.is_op(k, "{"):  # a record's short constructor
                return self.close[k] + 1
        else:
            got = self.type_at(k)
            if got is None or got[1] >= end or self.tokens[got[1]].kind != "id":
                return self._skip(k, end)
            name, k = self.tokens[got[1]].text, got[1] + 1
        if self.is_op(k, "("):
            made = Member(name, got[0], annotations, modifiers, start, self._parameters(k))
            k = self.close[k] + 1
            while k < end and not self.is_op(k, "{") and not self.is_op(k, ";"):
                k = self.close[k] + 1 if k in self.close else k + 1
            if self.is_op(k, "{"):
                made.body = (k + 1, self.close[k])
                k = self.close[k]
            owner.members.append(made)
            return k + 1
        while True:  # fields of one declaration
            dims = 0
            while self.is_op(k, "["):
                dims, k = dims + 1, k + 2
            value = None
            if self.is_op(k, "="):
                first = k + 1
                while k < end and not self.is_op(k, ";") and not self.is_op(k, ","):
                    k = self.close[k] + 1 if k in self.close else k + 1
                value = (first, k)
            owner.members.append(Member(name, got[0] + "[]" * dims, annotations, modifiers, start, value=value))
            if not self.is_op(k, ",") or k + 1 >= end or self.tokens[k + 1].kind != "id":
                return self._skip(k, end)
            name, k = self.tokens[k + 1].text, k + 2

    # --- names ---

    def qualified(self, name: str, owner: Type | None = None) -> str:
        """The qualified name of a type as written; primitives and type variables' bound (Object) included."""
        base, dims = name.replace("[]", ""), name.count("[]")
        head, _, rest = base.partition(".")
        if base in PRIMITIVES:
            out = base
        elif owner and base in owner.variables:
            out = "java.lang.Object"
        elif head in self.by_simple:
            out = self.by_simple[head] + (f"${rest.replace('.', '$')}" if rest else "")
        elif head in self.imports:
            out = self.imports[head] + (f"${rest.replace('.', '$')}" if rest else "")
        elif rest and not head[:1].isupper():
            out = base
        else:
            around = "java.lang" if head in LANG else self.package
            out = f"{around}.{head}" if around else head
            out += f"${rest.replace('.', '$')}" if rest else ""
        return out + "[]" * dims

    def descriptor(self, name: str, owner: Type | None = None) -> str:
        base = self.qualified(name, owner)
        dims, base = base.count("[]"), base.replace("[]", "")
        return "[" * dims + PRIMITIVES.get(base, f"L{base.replace('.', '/')};")

    def signature(self, m: Member, owner: Type) -> str:
        return "(" + "".join(self.descriptor(p.type, owner) for p in m.parameters or ()) + ")" + self.descriptor(m.type, owner)

    # --- bodies ---

    def split(self, first: int, end: int) -> list[tuple[int, int]]:
        """The stretches between commas at one level; none if it is empty."""
        out, start, k = [], first, first
        while k < end:
            if self.is_op(k, ","):
                out.append((start, k))
                start = k + 1
            k = self.close[k] + 1 if k in self.close else k + 1
        return [*out, (start, end)] if end > first else []

    def expression_end(self, k: int, end: int) -> int:
        """Where an expression that starts at k ends: at a ';' or a comma at its level, or where its bracket closes."""
        while k < end and not self.is_op(k, ";") and not self.is_op(k, ",") and not (self.tokens[k].kind == "op" and self.tokens[k].text in ")]}"):
            if k in self.close:
                k = self.close[k]
            k += 1
        return k

    def reads(self, first: int, end: int) -> list[str]:
        """Names of variables that a stretch of tokens reads, in order, each once."""
        out: dict[str, None] = {}
        for k in range(first, end):
            t = self.tokens[k]
            if t.kind == "id" and t.text not in KEYWORDS and t.text not in PRIMITIVES and t.text not in ("true", "false", "null") and not self.is_op(k - 1, ".") and not self.is_op(k + 1, "(") and not self.is_op(k + 1, "::") and not (k > first and self.tokens[k - 1].text == "new") and not t.text[:1].isupper():
                out[t.text] = None
        return list(out)

    def events(self, m: Member) -> Iterator[tuple]:
        """What happens in a body, in source order: ("define", place, name, type or None, first, end, final) of variables with a type or
        a new value, and ("call", place, name, target, arguments), target as its tokens' places or None."""
        if m.body is None:
            return
        k, end = m.body
        found: list[tuple] = []
        while k < end:
            t = self.tokens[k]
            if t.kind == "id":
                before = self.tokens[k - 1]
                fresh = before.kind == "op" and before.text in "{};(" or before.text in ("final", "else", "do", "->", ":") or self._after_mark(k)
                if fresh and t.text not in KEYWORDS and t.text not in MODIFIERS and (got := self.type_at(k)) and got[1] < end and self.tokens[got[1]].kind == "id" and self.tokens[got[1]].text not in KEYWORDS and (self.is_op(got[1] + 1, "=") or self.is_op(got[1] + 1, ";") or self.is_op(got[1] + 1, ",") or self.is_op(got[1] + 1, ":")):
                    at, final = got[1], before.text == "final"
                    while True:
                        first = last = at + 1
                        if self.is_op(at + 1, "="):
                            first, last = at + 2, self.expression_end(at + 2, end)
                        found.append(("define", at, self.tokens[at].text, got[0], first, last, final))
                        if not self.is_op(last, ",") or last + 1 >= end or self.tokens[last + 1].kind != "id":
                            break
                        at = last + 1
                    k = got[1] + 1
                    continue
                if self.is_op(k + 1, "=") and not self.is_op(k - 1, ".") and t.text not in KEYWORDS:
                    found.append(("define", k, t.text, None, k + 2, self.expression_end(k + 2, end), False))
                elif self.is_op(k + 1, "(") and (t.text not in KEYWORDS) and before.text != "new" and not self._constructed(k):
                    target = self._target(k, m.body[0])
                    found.append(("call", k, t.text, target, self.split(k + 2, self.close[k + 1])))
            k += 1
        # by line, then column: that of a call is where its whole expression starts
        yield from sorted(found, key=lambda e: (self.tokens[e[3][0] if e[0] == "call" and e[3] else e[1]].at, e[1]))

    def _after_mark(self, k: int) -> bool:
        """Whether k follows an annotation."""
        return self.is_op(k - 2, "@") or (self.is_op(k - 1, ")") and self.is_op(self.open[k - 1] - 2, "@"))

    def _constructed(self, k: int) -> bool:
        """Whether the name at k is that of a class after `new`, perhaps with a package."""
        while self.is_op(k - 1, ".") and self.tokens[k - 2].kind == "id":
            k -= 2
        return k > 0 and self.tokens[k - 1].text == "new"

    def _target(self, k: int, start: int) -> tuple[int, int] | None:
        """The tokens of what a call at k is made on."""
        if not self.is_op(k - 1, "."):
            return None
        at = k - 1
        while at > start:
            t = self.tokens[at - 1]
            if t.kind == "op" and t.text in ")]":
                at = self.open[at - 1]
                if at > start and self.tokens[at - 1].kind == "id" and self.tokens[at - 1].text not in ("return", "if", "while"):
                    at -= 1
            elif t.kind in ("id", "str"):
                at -= 1
            else:
                break
            if self.is_op(at - 1, "."):
                at -= 1
            elif at > start and self.tokens[at - 1].text == "new":
                at -= 1
                break
            else:
                break
        return at, k - 1

    def variable(self, part: tuple[int, int] | None) -> str:
        """The name, if a stretch of tokens is one variable (perhaps of this)."""
        if part is None:
            return ""
        first, end = part
        if end - first == 3 and self.tokens[first].text == "this":
            first += 2
        return self.tokens[first].text if end - first == 1 and self.tokens[first].kind == "id" and self.tokens[first].text not in KEYWORDS else ""

    def literal(self, part: tuple[int, int]) -> str:
        return self.tokens[part[0]].text if part[1] - part[0] == 1 and self.tokens[part[0]].kind == "str" else ""

    def constant(self, first: int, end: int, known: dict[str, str]) -> str | None:
        """The value of string literals and constants that are put together."""
        out, want = [], True
        k = first
        while k < end:
            t = self.tokens[k]
            if want and t.kind == "str":
                out.append(t.text)
            elif want and t.kind == "id" and t.text in known:
                out.append(known[t.text])
            elif want and self.is_op(k, "("):
                inner = self.constant(k + 1, self.close[k], known)
                if inner is None:
                    return None
                out.append(inner)
                k = self.close[k]
            elif not (not want and self.is_op(k, "+")):
                return None
            want = not want
            k += 1
        return "".join(out) if out and not want else None

    def type_of(self, part: tuple[int, int] | None, types: dict[str, str], owner: Type) -> str:
        """The qualified type of what a call is made on: of a variable, a class or this; '' if the file doesn't tell."""
        if part is None:
            return owner.name
        first, end = part
        words = [t.text for t in self.tokens[first:end]]
        if words == ["this"]:
            return owner.name
        name = self.variable(part)
        if name and name in types:
            return self.qualified(types[name], owner)
        if words and words[0] == "new" and (got := self.type_at(first + 1)):
            return self.qualified(got[0], owner)
        if all(t.kind == "id" or t.text == "." for t in self.tokens[first:end]) and words[-1][:1].isupper():
            return self.qualified("".join(words), owner)
        return ""

    def types_in(self, m: Member, owner: Type) -> dict[str, str]:
        return {f.name: f.type for f in owner.fields} | {p.name: p.type for p in m.parameters or ()}


def simple(name: str) -> str:
    return name.rpartition(".")[2]


def annotation(annotations: list[tuple[str, list[Token]]], *names: str) -> tuple[str, list[Token]] | None:
    return next((a for a in annotations if simple(a[0]) in names), None)


def values(inside: list[Token], *attributes: str) -> list[str]:
    """An annotation's strings and names by attribute; "value" is also what stands there without a name."""
    out, name, depth = [], "value", 0
    k = 0
    while k < len(inside):
        t = inside[k]
        if t.kind == "op" and t.text in "({":
            depth += 1
        elif t.kind == "op" and t.text in ")}":
            depth -= 1
        elif t.kind == "op" and t.text == "," and not depth:
            name = "value"
        elif t.kind == "id" and not depth and k + 1 < len(inside) and inside[k + 1].text == "=":
            name, k = t.text, k + 1
        elif name in attributes and t.kind == "str":
            out.append(t.text)
        elif name in attributes and t.kind == "id" and not (k + 1 < len(inside) and inside[k + 1].text == "."):
            out.append(t.text)
        k += 1
    return out


# --- declarations and calls ---

JAVA = "kind string, line int, owner string, method string, descriptor string, annotations array<string>, modifiers array<string>, target_owner string, target_method string, target_descriptor string, n_arguments int, no_classpath boolean"


def java(path: str, text: str) -> Rows:
    """Classes, methods, fields and direct calls. A call to a method of another file has no target_descriptor yet."""
    s = Source(text)
    names = lambda x: [s.imports.get(a, a) for a, _ in x]
    for t in s.types:
        yield {"kind": "class", "line": s.line(t.at), "owner": t.name, "annotations": names(t.annotations), "no_classpath": True}
        for m in t.members:
            row = {"line": s.line(m.at), "owner": t.name, "method": m.name, "annotations": names(m.annotations), "modifiers": sorted(m.modifiers), "no_classpath": True}
            if m.parameters is None:
                yield row | {"kind": "field", "descriptor": s.descriptor(m.type, t)}
                continue
            own = s.signature(m, t)
            yield row | {"kind": "method", "descriptor": own}
            types = s.types_in(m, t)
            for e in s.events(m):
                if e[0] == "define":
                    if e[3]:
                        types[e[2]] = e[3]
                    continue
                _, at, name, target, arguments = e
                to = s.type_of(target, types, t)
                if not to:
                    continue
                yield {"kind": "call", "line": s.line(s.tokens[at].at), "owner": t.name, "method": m.name, "descriptor": own, "target_owner": to, "target_method": name, "target_descriptor": _declared(s, to, name, len(arguments)), "n_arguments": len(arguments), "no_classpath": True}


def _declared(s: Source, owner: str, name: str, n: int) -> str | None:
    """The descriptor of a method of the file with so many parameters, if there is one such."""
    if (t := s.by_name.get(owner)) is None:
        return None
    fit = {s.signature(m, t) for m in t.methods if m.name == name and len(m.parameters or ()) == n}
    return fit.pop() if len(fit) == 1 else None


def call_rows(rows: DataFrame, methods: DataFrame) -> DataFrame:
    """rows with the descriptors of calls to other files, where one method of that owner, name and number fits in `methods`
    (rows of kind method). Only rows that lack one are joined, so those without a call don't meet in one task, and always by
    merging: Spark takes what is read out of files for no larger than the files, and would broadcast every method of them."""
    n = F.size(F.filter(F.split(F.regexp_replace(F.regexp_extract("descriptor", r"^\(([^)]*)\)", 1), r"\[*(?:L[^;]*;|[ZBCSIJFD])", "x"), ""), lambda x: x == "x"))
    known = methods.where("kind = 'method'").select(F.col("owner").alias("o"), F.col("method").alias("m"), n.alias("n"), F.col("descriptor").alias("d"))
    known = known.groupBy("o", "m", "n").agg(F.min("d").alias("d"), F.max("d").alias("z")).where("d = z").drop("z")
    lacks = F.col("target_owner").isNotNull() & F.col("target_descriptor").isNull()
    held = rows.where(lacks).join(known.hint("merge"), (F.col("target_owner") == F.col("o")) & (F.col("target_method") == F.col("m")) & (F.col("n_arguments") == F.col("n")), "left")
    return rows.where(~lacks).unionByName(held.withColumn("target_descriptor", F.col("d")).drop("o", "m", "n", "d"))


def java_rows(files: DataFrame) -> DataFrame:
    """Rows of JAVA. They are kept as a table, as calls and methods of all files meet: the files are read once."""
    rows = cut(analyse(files, java, JAVA), "java-rows")
    return call_rows(rows, rows)


# --- Spring ---

SPRING = "kind string, line int, owner string, method string, descriptor string, component string, type string, class_paths array<string>, method_paths array<string>, http_methods array<string>"


def spring(path: str, text: str) -> Rows:
    """kind component, injection (component: field, method or constructor) and route."""
    s = Source(text)
    for t in s.types:
        kind = next((v for k, v in COMPONENTS.items() if annotation(t.annotations, k)), None)
        if kind:
            yield {"kind": "component", "line": s.line(t.at), "owner": t.name, "component": kind}
        made = [m for m in t.methods if m.name == "<init>"]
        for m in t.members:
            row = {"kind": "injection", "line": s.line(m.at), "owner": t.name, "method": m.name}
            marked = annotation(m.annotations, *INJECTIONS) is not None
            if m.parameters is None:
                if marked:
                    yield row | {"component": "FIELD", "type": s.qualified(m.type, t)}
            elif m.name == "<init>":
                if kind and (marked or len(made) == 1):
                    yield from (row | {"component": "CONSTRUCTOR", "type": s.qualified(p.type, t)} for p in m.parameters)
            elif marked:
                yield from (row | {"component": "METHOD", "type": s.qualified(p.type, t)} for p in m.parameters)
        if not annotation(t.annotations, "Controller", "RestController"):
            continue
        whole = annotation(t.annotations, "RequestMapping")
        paths = (whole and values(whole[1], "value", "path")) or [""]
        verbs = [x.upper() for x in values(whole[1], "method")] if whole else []
        for m in t.methods:
            own = annotation(m.annotations, "RequestMapping", *VERBS)
            if own is None:
                continue
            mine = [VERBS[simple(own[0])]] if simple(own[0]) in VERBS else [x.upper() for x in values(own[1], "method")]
            both = list(dict.fromkeys([*verbs, *mine])) or ALL_VERBS
            yield {"kind": "route", "line": s.line(m.at), "owner": t.name, "method": m.name, "descriptor": s.signature(m, t), "class_paths": paths, "method_paths": values(own[1], "value", "path") or [""], "http_methods": both}


# --- JDBC ---

JDBC = "line int, owner string, method string, descriptor string, statement_id string, sql string, parameter int"


def jdbc(path: str, text: str) -> Rows:
    """A row for each statement whose text is known, and one more for each parameter that is set on its variable."""
    s = Source(text)
    for t in s.types:
        for m in t.methods:
            types, known, events = s.types_in(m, t), {}, list(s.events(m))
            bound: dict[str, set[int]] = {}
            for e in events:
                if e[0] == "call" and e[2].startswith("set") and len(e[4]) >= 2 and (name := s.variable(e[3])):
                    first, end = e[4][0]
                    if end - first == 1 and s.tokens[first].kind == "num" and s.tokens[first].text.isdigit() and int(s.tokens[first].text) > 0:
                        bound.setdefault(name, set()).add(int(s.tokens[first].text))
            held = {e[4]: e[2] for e in events if e[0] == "define" and e[3]}  # where a variable's first value starts
            for e in events:
                if e[0] == "define" and e[3] and e[6] and (value := s.constant(e[4], e[5], known)) is not None:
                    known[e[2]] = value
            for e in events:
                if e[0] == "define":
                    if e[3]:
                        types[e[2]] = e[3]
                    continue
                _, at, name, target, arguments = e
                on = s.type_of(target, types, t) if target else ""
                if not arguments or not (name in JDBC_PREPARE and on == "java.sql.Connection" or name in JDBC_EXECUTE and on in JDBC_STATEMENTS):
                    continue
                sql = s.constant(*arguments[0], known)
                if not (sql or "").strip():
                    continue
                line, own = s.line(s.tokens[target[0]].at), s.signature(m, t)
                row = {"line": line, "owner": t.name, "method": m.name, "descriptor": own, "statement_id": f"{t.name}.{m.name}{own}@{line}", "sql": sql}
                variable = held.get(target[0])
                parameters = sorted(bound.get(variable, ())) if variable else []
                yield from (row | {"parameter": k} for k in parameters or (None,))


# --- JPA ---

JPA = "line int, owner string, table_name string, field string, column_name string, schema_name string, type string"


def jpa(path: str, text: str) -> Rows:
    """An entity with its table, and its fields that are kept, with their columns."""
    s = Source(text)
    named = lambda marks, mark, attribute, other: (next(iter(values(a[1], attribute)), "").strip() if (a := annotation(marks, mark)) else "") or other
    for t in s.types:
        if not annotation(t.annotations, "Entity"):
            continue
        row = {"owner": t.name, "table_name": named(t.annotations, "Table", "name", t.name.rpartition(".")[2].rpartition("$")[2]), "schema_name": named(t.annotations, "Table", "schema", "")}
        yield row | {"line": s.line(t.at)}
        for f in t.fields:
            if not f.modifiers & {"static", "transient"} and not annotation(f.annotations, "Transient"):
                yield row | {"line": s.line(f.at), "field": f.name, "column_name": named(f.annotations, "Column", "name", f.name), "type": s.descriptor(f.type, t)}


# --- variables ---

TRACES = (
    "kind string, line int, owner string, method string, descriptor string, name string, variable string, source string, object string, property string,"
    " index int, type string, target_owner string, target_method string, target_descriptor string, target_index int, target_type string, n_arguments int"
)
PASSED = ("request_argument", "parameter_argument")


def _property(name: str, n: int, setter: bool = False) -> str:
    for prefix in ("set",) if setter else ("get", "is"):
        if name.startswith(prefix) and len(name) > len(prefix) and n == setter:
            return name[len(prefix)].lower() + name[len(prefix) + 1 :]
    return ""


def traces(path: str, text: str) -> Rows:
    """What happens to a method's variables, in source order and without branches. Kinds: def (variable gets source's value; name:
    what source stands for), use (as an argument), request (name: the parameter or attribute; method in property), form (a
    property read of an action form), bean (object.property goes to name's property `variable`), request_argument and
    parameter_argument (a request's value, or the method's own parameter `index`, is passed on)."""
    return _traces(Source(text))


def flows(path: str, text: str) -> Rows:
    """The passed arguments of `traces`, and a row of kind method for each of the file's methods."""
    s = Source(text)
    yield from (r for r in _traces(s) if r["kind"] in PASSED)
    for t in s.types:
        for m in t.methods:
            yield {"kind": "method", "line": s.line(m.at), "owner": t.name, "method": m.name, "descriptor": s.signature(m, t)}


def _traces(s: Source) -> Rows:
    for t in s.types:
        for m in t.methods:
            own = s.signature(m, t)
            types = s.types_in(m, t)
            declared = {p.name: p.type for p in m.parameters or ()}
            alias: dict[str, str] = {}
            asked: dict[str, str] = {}
            got: dict[str, tuple[str, str]] = {}
            mine = {p.name: (k, s.descriptor(p.type, t)) for k, p in enumerate(m.parameters or ())}
            for e in s.events(m):
                base = {"line": s.line(s.tokens[e[1]].at), "owner": t.name, "method": m.name, "descriptor": own}
                if e[0] == "define":
                    _, _, name, kind, first, end, _ = e
                    if kind:
                        types[name] = declared[name] = kind
                    if first >= end and not kind:
                        continue
                    reads, copied = s.reads(first, end), s.variable((first, end))
                    asks, gets = _asked(s, first, end), _got(s, first, end)
                    for held, new in ((asked, asks), (got, gets), (mine, None)):
                        value = new or held.get(copied)
                        if value:
                            held[name] = value
                        else:
                            held.pop(name, None)
                    alias[name] = alias.get(copied, copied) if copied else name
                    for x in reads:
                        yield base | {"kind": "def", "variable": name, "source": x, "name": alias.get(x, x)}
                    continue
                _, _, called, target, arguments = e
                on = s.variable(target)
                if on == "request" and called in ("getParameter", "getAttribute", "setAttribute") and arguments and (key := s.literal(arguments[0])).strip():
                    value = (s.reads(*arguments[1]) or [""])[0] if called == "setAttribute" and len(arguments) > 1 else ""
                    yield base | {"kind": "request", "property": called, "name": key, "variable": value, "source": alias.get(value, value)}
                if on:
                    kind = s.qualified(declared.get(on) or types.get(on, ""), t) if on in types else ""
                    if kind.endswith("ActionForm"):
                        read = s.literal(arguments[0]) if called == "get" and arguments else _property(called, len(arguments))
                        if read:
                            yield base | {"kind": "form", "object": on, "type": kind, "property": read}
                    if (set_ := _property(called, len(arguments), True)) and (value := (s.reads(*arguments[0]) or [""])[0]) in got:
                        yield base | {"kind": "bean", "object": got[value][0], "property": got[value][1], "name": on, "variable": set_, "source": value}
                to = s.type_of(target, types, t)
                for k, part in enumerate(arguments):
                    reads = s.reads(*part)
                    for x in reads:
                        yield base | {"kind": "use", "variable": x, "name": alias.get(x, x)}
                    if not to or not reads:
                        continue
                    x = reads[0]
                    d = _declared(s, to, called, len(arguments))
                    onto = {"target_owner": to, "target_method": called, "target_descriptor": d, "target_index": k, "n_arguments": len(arguments), "variable": x}
                    if x in asked:
                        yield base | onto | {"kind": "request_argument", "name": asked[x]}
                    if x in mine:
                        yield base | onto | {"kind": "parameter_argument", "index": mine[x][0], "type": mine[x][1]}


def _call_in(s: Source, first: int, end: int) -> tuple[str, str, list[tuple[int, int]]] | None:
    """(target variable, method, arguments), if a stretch of tokens is one call on a variable."""
    if end - first >= 5 and s.is_op(first + 1, ".") and s.is_op(first + 3, "(") and s.close[first + 3] == end - 1:
        return s.tokens[first].text, s.tokens[first + 2].text, s.split(first + 4, end - 1)
    return None


def _asked(s: Source, first: int, end: int) -> str | None:
    c = _call_in(s, first, end)
    return (s.literal(c[2][0]) or None) if c and c[:2] == ("request", "getParameter") and c[2] else None


def _got(s: Source, first: int, end: int) -> tuple[str, str] | None:
    c = _call_in(s, first, end)
    name = _property(c[1], len(c[2])) if c else ""
    return (c[0], name) if name else None


def flow_rows(rows: DataFrame, methods: DataFrame, scope: str) -> DataFrame:
    """Rows for mappers.variable_flows: passed arguments of TRACES whose target is known, in the file or by `methods` (rows of
    kind method)."""
    passed = rows.where(F.col("kind").isin(*PASSED))
    plain = passed.withColumn("from_descriptor", F.col("descriptor")).withColumn("from_owner", F.col("owner")).withColumn("from_method", F.col("method"))
    done = call_rows(plain, methods).where("target_descriptor is not null")
    parts = F.regexp_extract_all(F.regexp_extract("target_descriptor", r"^\(([^)]*)\)", 1), F.lit(r"(\[*(?:L[^;]*;|[ZBCSIJFD]))"), F.lit(1))
    asked = F.col("kind") == "request_argument"
    return done.select(
        "file", "line", F.lit(scope).alias("scope"), F.when(asked, F.col("name")).alias("parameter"), F.col("from_owner").alias("owner"), F.col("from_method").alias("method"), F.col("from_descriptor").alias("descriptor"),
        "index", "type", "target_owner", "target_method", "target_descriptor", "target_index", F.get(parts, F.col("target_index")).alias("target_type"),
    )
