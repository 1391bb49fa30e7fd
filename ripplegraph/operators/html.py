"""Pages to rows to facts.

Links of pages are column functions. The whole analysis (forms, inputs, links, scripts, requests and event handlers, with
lines) is a table function in Python: its state runs across lines, which no column function expresses.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions import web
from ripplegraph.functions.ids import entrypoint, let, symbol
from ripplegraph.operators.mappers import Context, facts_from

INFO = "page_path string, kind string, line int, column int, name string, value string, method string, form_key string"
_BLANK = re.compile(r"[^\n]")
_TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>")
_ATTR = re.compile(web.ATTRIBUTE)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
# The events whose handlers are read.
_HANDLERS = ("onclick", "onsubmit")
#: comments; strings and templates with what they hold; words; other signs
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'((?:\\.|[^'\\\n])*)'|\"((?:\\.|[^\"\\\n])*)\"|`((?:\\.|[^`\\])*)`|([A-Za-z_$][\w$]*)|(\.\.\.|=>|[=!]==?|[-+*/%&|^<>]=|\S)", re.S)
# The objects that fetch and location are members of.
_GLOBALS = ("window", "self", "globalThis")
_LOCATED = (*_GLOBALS, "document", "top", "parent")
HERE = "?"  # an empty address: the page itself


class Script:
    """The tokens of a script: (kind, text, offset), kind word, text (a literal that nothing is put into), dynamic or sign."""

    def __init__(self, code: str):
        self.held: list[tuple[str, str, int]] = []
        for m in _TOKEN.finditer(code):
            literal = next((x for x in m.groups()[:3] if x is not None), None)
            if literal is not None:
                self.held.append(("dynamic" if m[3] is not None and "${" in literal else "text", re.sub(r"\\(.)", r"\1", literal, flags=re.S), m.start()))
            elif m[4] is not None:
                self.held.append(("word", m[4], m.start()))
            elif m[5] is not None:
                self.held.append(("sign", m[5], m.start()))

    def sign(self, k: int, *signs: str) -> bool:
        return 0 <= k < len(self.held) and self.held[k][0] == "sign" and self.held[k][1] in signs

    def word(self, k: int, *words: str) -> bool:
        return 0 <= k < len(self.held) and self.held[k][0] == "word" and self.held[k][1] in words

    def of_global(self, k: int, names: tuple[str, ...]) -> bool:
        """Whether the name at k stands alone or is a member of one of the global objects."""
        return not self.sign(k - 1, ".") or (self.word(k - 2, *names) and not self.sign(k - 3, "."))

    def literal(self, k: int, *after: str) -> str | None:
        """The literal at k, if one of the signs or the end of the script follows; an empty one is HERE."""
        if k < len(self.held) and self.held[k][0] == "text" and (k + 1 == len(self.held) or self.sign(k + 1, *after)):
            return self.held[k][1] or HERE
        return None

    def verb(self, k: int) -> str | None:
        """The method that the options at k give; None if they aren't an object, or tell only when they run."""
        if not self.sign(k, "{"):
            return None
        found, depth, key = "GET", 0, False
        while k < len(self.held):
            if self.sign(k, "{", "(", "["):
                depth, key = depth + 1, depth == 0
            elif self.sign(k, "}", ")", "]"):
                depth -= 1
                if not depth:
                    return found if self.sign(k + 1, ")", ",") else None
            elif depth == 1 and self.sign(k, ","):
                key = True
            elif depth == 1 and self.sign(k, "..."):
                return None
            elif depth == 1 and key:
                key = False
                if self.held[k][0] in ("word", "text") and self.held[k][1] == "method":
                    if not self.sign(k + 1, ":") or (value := self.literal(k + 2, ",", "}")) is None:
                        return None
                    found = value.upper()
            k += 1
        return None

    def requests(self) -> list[tuple[int, str, str]]:
        """(offset, method, url) of each fetch of a literal address with a literal method."""
        out = []
        for k, (_, _, at) in enumerate(self.held):
            if self.word(k, "fetch") and self.sign(k + 1, "(") and self.of_global(k, _GLOBALS) and (url := self.literal(k + 2, ",", ")")) is not None:
                plain = self.sign(k + 3, ")") or (self.sign(k + 3, ",") and self.sign(k + 4, ")"))
                verb = "GET" if plain else self.verb(k + 4)
                if verb:
                    out.append((at, verb, url))
        return out

    def targets(self) -> list[str]:
        """Literal addresses that the page goes to."""
        out = []
        for k in range(len(self.held)):
            to = None
            if self.word(k, "location") and self.of_global(k, _LOCATED):
                if self.sign(k + 1, "="):
                    to = self.literal(k + 2, ";", "}", ")", ",")
                elif self.sign(k + 1, ".") and self.word(k + 2, "href") and self.sign(k + 3, "="):
                    to = self.literal(k + 4, ";", "}", ")", ",")
                elif self.sign(k + 1, ".") and self.word(k + 2, "assign", "replace") and self.sign(k + 3, "("):
                    to = self.literal(k + 4, ")")
            elif self.word(k, "open") and self.word(k - 2, "window") and self.sign(k - 1, ".") and not self.sign(k - 3, ".") and self.sign(k + 1, "("):
                to = self.literal(k + 2, ")", ",")
            if to is not None:
                out.append(to)
        return out


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4])
    return out


def analyse(path: str, page: str) -> list[tuple]:
    """Rows of INFO. A .js file is all script."""
    if path.lower().endswith(".js"):
        code = page or ""
        own = [(path, "request", code.count("\n", 0, k) + 1, 0, "", url, verb, "") for k, verb, url in Script(code).requests()]
        return [(path, "page", 1, 0, "", "", "", ""), *own]
    text = _COMMENT.sub(lambda m: _BLANK.sub(" ", m[0]), page or "")
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out: list[tuple] = [(path, "page", 1, 0, "", "", "", "")]

    def place(at: int) -> tuple[int, int]:
        low, high = 0, len(starts)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if starts[mid] <= at else (low, mid)
        return low + 1, at - starts[low]

    at, form = 0, ""
    while m := _TAG.search(text, at):
        at = m.end()
        name, (line, column) = m[2].lower(), place(m.start())
        if m[1]:
            form = "" if name == "form" else form
            continue
        a = _attributes(m[3])
        if name == "form":
            action, method = a.get("action", ""), a.get("method", "get")
            form = f"{action}:{method}:{line}:{column}"
            out.append((path, "form", line, column, form, action, method, form))
        elif name in ("input", "select", "textarea") and a.get("name", "").strip():
            kind = a.get("type", "text") if name == "input" else name
            out.append((path, "input", line, 0, a["name"], kind, "", form))
        elif name == "a" and a.get("href", "").strip():
            out.append((path, "link", line, 0, "", a["href"], "", ""))
        elif name == "script":
            if a.get("src", "").strip():
                out.append((path, "script", line, 0, "", a["src"], "", ""))
            end = re.compile(r"</script\s*>", re.I).search(text, at)
            stop = end.start() if end else len(text)
            if not a.get("src", "").strip() and a.get("type", "").partition(";")[0].strip().lower() in web.EXECUTABLE_TYPES:
                out += [(path, "request", place(at + k)[0], 0, "", url, verb, "") for k, verb, url in Script(text[at:stop]).requests()]
            at = end.end() if end else len(text)
            continue
        for h in _ATTR.finditer(m[3]):
            if h[1].lower() not in _HANDLERS:
                continue
            spot = place(m.start(3) + h.start())
            code = Script(next(x for x in h.groups()[1:] if x is not None))
            out += [(path, "event", *spot, h[1].lower(), to, "NAVIGATES_TO", "") for to in code.targets()]
            out += [(path, "event", *spot, h[1].lower(), url, verb, "") for _, verb, url in code.requests()]
    return out


def html_rows(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    names = [f.split()[0] for f in INFO.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = [r for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in analyse(p, h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return pages.select(F.col(path).cast("string"), F.col(html).cast("string")).mapInArrow(run, INFO)


def page_path(url: Column) -> Column:
    """A page's path below its web root, from its address."""
    p = web.ascii_path(web.collapsed(F.regexp_replace(web.strip(url), r"^[A-Za-z0-9+.\-]+://[^/]*", "")))
    return F.when(p == "", F.lit("_root")).otherwise(p)


def html_links(pages: DataFrame) -> DataFrame:
    """page_id, position, href, navigable of pages (page_id, html)."""
    found = pages.select("page_id", F.posexplode(web.hrefs(F.col("html"))).alias("position", "href"))
    return found.withColumn("navigable", web.is_navigable(F.col("href")))


def html_facts(rows: DataFrame, context: Context) -> DataFrame:
    """Facts and evidence columns of html_rows."""
    c, p, m, root = F.col, context.project, context.module, context.root
    rows = rows.withColumn("__page", web.ascii_path(web.route(c("page_path"))))
    page = symbol("html-page", p, m, root, c("__page"))
    line = c("line").cast("string")
    fid = lambda kind, fragment: symbol(kind, p, m, root, c("__page"), fragment)

    def form_key(key: Column) -> Column:
        tail = F.regexp_extract(key, r"(:[^:]*:\d+:\d+)$", 1)
        named = lambda a: F.when(web.is_external(a), F.concat(F.lit("/"), web.route(a))).when(a.startswith("/"), F.concat(F.lit("/"), web.collapsed(a))).otherwise(a)
        return F.concat(web.ascii_path(let(web.strip(F.regexp_extract(key, r"(?s)^(.*):[^:]*:\d+:\d+$", 1)), named)), web.ascii_path(tail))

    rows = rows.withColumn("__form", fid("html-form", F.concat(F.lit("form["), form_key(c("form_key")), F.lit("]"))))
    form_id = c("__form")
    input_id = F.concat(F.lit("html-input://"), F.regexp_replace(form_id, "^[^:]*://", ""), F.lit(":input["), web.ascii_path(c("name")), F.lit(":"), web.ascii_path(c("value")), F.lit(":"), line, F.lit(":0]"))
    param = symbol("request-param", p, m, root, web.ascii_path(c("name")))
    rows = rows.withColumn("__to", web.route(web.resolve(c("page_path"), c("value"))))
    script_id = symbol("script-resource", p, m, root, web.ascii_path(c("__to")))
    link_id = fid("html-link", F.concat(F.lit("link["), web.ascii_path(web.strip(c("value"))), F.lit(":"), line, F.lit(":0]")))
    called = F.concat(F.lit("/"), F.when(c("__to") == "_root", F.lit("")).otherwise(c("__to")))
    request_id = fid("client-request", F.concat(F.lit("fetch["), c("method"), F.lit(":"), web.ascii_path(called), F.lit(":"), line, F.lit(":0]")))
    event_id = fid("dom-event-handler", F.concat(F.lit("event["), c("name"), F.lit(":"), line, F.lit(":"), c("column").cast("string"), F.lit("]")))
    rows = rows.withColumn("__goes", web.navigation_target(p, m, root, c("page_path"), c("value"))).withColumn("__asks", web.request_target(p, m, c("page_path"), c("method"), c("value")))
    goes, asks = c("__goes"), c("__asks")
    known = F.upper(F.trim(c("method"))).isin(*web.HTTP_METHODS)
    navigable = web.is_navigable(c("value"))
    bound = (c("kind") == "input") & (c("form_key") != "")
    usable = bound | c("kind").isin("page", "form", "script", "link", "request", "event")
    rows = rows.withColumn("__entry", entrypoint(p, m, "html", web.ascii_path(web.collapsed(web.route(c("page_path"))))))
    entry = c("__entry")
    # what a row gives, in order: condition, source, target, relation, qualifier, confidence
    edges = [
        (usable, page, entry, "DECLARES_ENTRYPOINT", "html-page", "LIKELY"),
        (c("kind") == "form", page, form_id, "CONTAINS", "html-structure", "CERTAIN"),
        ((c("kind") == "form") & ((F.trim(c("value")) == "") | navigable), form_id, asks, "SUBMITS_TO", "html-form", "LIKELY"),
        (bound, page, input_id, "CONTAINS", "html-structure", "CERTAIN"),
        (bound, form_id, input_id, "RENDERS_INPUT", "html-form-input", "CERTAIN"),
        (bound, input_id, param, "BINDS_TO", "html-input", "LIKELY"),
        (c("kind") == "script", page, script_id, "CONTAINS", "html-structure", "CERTAIN"),
        (c("kind") == "script", page, script_id, "LOADS_SCRIPT", "script-src", "CERTAIN"),
        (c("kind") == "link", page, link_id, "CONTAINS", "html-structure", "CERTAIN"),
        ((c("kind") == "link") & navigable, link_id, goes, "NAVIGATES_TO", "html-link", "LIKELY"),
        ((c("kind") == "request") & navigable & known, request_id, asks, "CALLS_HTTP", "fetch", "LIKELY"),
        ((c("kind") == "event") & (c("method") == "NAVIGATES_TO") & navigable, event_id, goes, "NAVIGATES_TO", "dom-event", "LIKELY"),
        ((c("kind") == "event") & (c("method") != "NAVIGATES_TO") & navigable & known, event_id, asks, "CALLS_HTTP", "dom-event", "LIKELY"),
    ]
    return facts_from(rows, edges, context, "html-client", "HTML_TOKEN", c("page_path"), c("line"))


def page_entrypoints(pages: DataFrame, context: Context) -> DataFrame:
    """page_id, path, entrypoint of pages (page_id, url)."""
    path = page_path(F.col("url"))
    return pages.select("page_id", path.alias("path"), entrypoint(context.project, context.module, "html", path).alias("entrypoint"))


