"""JSP pages to info rows: directives, tag libraries, includes, forwards, forms, inputs and request parameters.

A page is cut into its parts first: comments, directives, code, and the template about them. Tags are read in the template less
HTML comments and scripts; expressions (${param.x}) in the template with scripts; getParameter in code, by its tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from ripplegraph.operators.analyzers import Rows
from ripplegraph.operators.java import tokens

JSP = "page_path string, kind string, name string, value string, method string, form_key string, line int"
_PART = re.compile(r"<%--.*?(?:--%>|\Z)|<%@(.*?)(?:%>|\Z)|<%[!=]?(.*?)(?:%>|\Z)|<jsp:(scriptlet|expression|declaration)\b[^>]*>(.*?)(?:</jsp:\3\s*>|\Z)", re.S)
_SCRIPT = re.compile(r"(<script\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)(.*?)(</script\s*>|\Z)", re.S | re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][\w:.-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))")
_NAME = re.compile(r"\s*([\w:]+)(.*)", re.S)
_EL = re.compile(r"[$#]\{[^{}]*\}")
_EL_PARAM = re.compile(r"(?<![\w.])param(?:Values)?\s*(?:\.\s*(\w+)|\[\s*(?:'([^']*)'|\"([^\"]*)\")\s*\])")
# The elements of forms, inputs, includes and forwards, with the method that a form has and the type an input has if it doesn't say.
_FORMS = {"form": "get", "html:form": "post", "form:form": "post", "s:form": "post"}
_INPUTS = {
    "input": "text", "select": "select", "textarea": "textarea", "html:text": "text", "html:hidden": "hidden", "html:password": "password", "html:checkbox": "checkbox", "html:select": "select",
    "html:textarea": "textarea", "form:input": "text", "form:hidden": "hidden", "form:select": "select", "form:textarea": "textarea", "s:textfield": "text",
}
_INCLUDES = {"jsp:include": ("page",), "c:import": ("url",)}
_FORWARDS = {"jsp:forward": ("page",), "c:redirect": ("url",), "logic:forward": ("name",)}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1], next(x for x in m.groups()[1:] if x is not None))
    return found


def read_parameters(code: str) -> list[tuple[int, str]]:
    """(offset, name) of each parameter that code asks the request for by a literal."""
    t = tokens(code)
    return [
        (x.at, t[k + 4].text)
        for k, x in enumerate(t[:-5])
        if (x.kind, x.text) == ("id", "request") and t[k + 1].text == "." and t[k + 2].text in ("getParameter", "getParameterValues") and t[k + 3].text == "(" and t[k + 4].kind == "str" and t[k + 5].text == ")"
    ]


def jsp(path: str, text: str) -> Rows:
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    row = lambda kind, at, name="", value="", method="", form="": {"page_path": path, "kind": kind, "name": name, "value": value, "method": method, "form_key": form, "line": line(at)}
    yield row("page", 0)
    template, last, asked, dynamic = [], 0, [], []
    for m in _PART.finditer(text):
        template += [text[last : m.start()], _blank(m[0])]
        last = m.end()
        if m[1] is not None and (d := _NAME.match(m[1])):
            a = attributes(d[2])
            if d[1] == "include":
                yield row("include", m.start(), "directive", a.get("file", ""))
            elif d[1] == "taglib":
                yield row("taglib", m.start(), a.get("prefix", ""), a.get("uri") or a.get("tagdir", ""))
            else:
                yield row("directive", m.start(), d[1], " ".join(f"{k}={v}" for k, v in sorted(a.items())))
        elif m[2] is not None or m[4] is not None:
            k = 2 if m[2] is not None else 4
            asked += [(m.start(k) + at, name) for at, name in read_parameters(m[k])]
            dynamic.append(m.start())
    page = "".join([*template, text[last:]])
    shown = _COMMENT.sub(lambda m: _blank(m[0]), page)
    markup = _SCRIPT.sub(lambda m: m[1] + _blank(m[2]) + m[3], shown)
    form = ""
    for m in _TAG.finditer(markup):
        tag, a = m[2], attributes(m[3])
        if m[1]:
            form = "" if tag.lower() in _FORMS else form
            continue
        filled = bisect_left(dynamic, m.end()) > bisect_left(dynamic, m.start())  # code stands in the tag
        if tag.lower() in _FORMS:
            action, method = a.get("action") or a.get("modelAttribute", ""), a.get("method") or _FORMS[tag.lower()]
            form = f"{action}:{method}:{line(m.start())}:{m.start() - starts[line(m.start()) - 1]}"
            yield row("form", m.start(), form, action, method, form)
        elif tag.lower() in _INPUTS and (name := a.get("name") or a.get("property") or a.get("path")):
            yield row("input", m.start(), name, a.get("type") if tag.lower() == "input" and a.get("type") else _INPUTS[tag.lower()], "", form)
        elif tag in _INCLUDES or tag in _FORWARDS:
            value = next((a[x].strip() for x in (_INCLUDES.get(tag) or _FORWARDS[tag]) if a.get(x, "").strip()), "")
            if value and not filled and not _EL.search(value):
                yield row("include" if tag in _INCLUDES else "forward", m.start(), tag, value)
    for at, name in asked:
        yield row("param", at, name)
    for m in _EL.finditer(shown):
        for x in _EL_PARAM.finditer(m[0]):
            yield row("param", m.start(), next(y for y in x.groups() if y is not None))
