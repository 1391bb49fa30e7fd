"""Ids by what they name: builders over a file's path, a flow's base, a scope or an artifact, from templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplegraph.functions.ids import let, relative, split_root, symbol
from ripplegraph.functions.registry import FLOW_SUFFIX, SOURCE_ROOTS

# Kind, the part of a file's id after '#', the flow's fragment.
FILES = {
    "jsp_page": ("jsp-page", None, None),
    "jsp_form": ("jsp-form", "form[%s]", None),
    "jsp_input": ("jsp-input", "form[%s]", "input[%s]"),
    "jsp_tag": ("jsp-tag", "tag[%s:%s:%s:%s]", None),
    "html_page": ("html-page", None, None),
    "html_form": ("html-form", "form[%s]", None),
    "html_input": ("html-input", "form[%s]", "input[%s]"),
    "script_resource": ("script-resource", None, None),
    "client_request": ("client-request", "request[%s:%s:%s:%s:%s]", None),
    "sql_statement": ("sql-statement", "%s", None),
    "config_key": ("config-key", "%s", None),
    "report": ("report-definition", None, None),
    "report_definition": ("report-definition", "%s", None),
    "report_field": ("report-field", "%s", None),
    "sql_param": ("sql-param", "%s", "param[%s]"),
    "sql_branch_condition": ("sql-branch-condition", "%s", "branch[%s]"),
}
# The same for ids that name a method, given as owner, name and descriptor.
METHODS = {
    "java_method": ("method", None),
    "param_slot": ("param-slot", "param[%s:%s]"),
    "return_slot": ("return-slot", "return[%s]"),
    "method_summary": ("method-summary", None),
}
# Kinds of a scope and a name, and of a run (or none) and an id.
SCOPES = {"request_param": "request-param", "request_attr": "request-attr", "session_attr": "session-attr", "model_attr": "model-attr"}
ARTIFACTS = {"feature_seed": "feature-seed", "feature_scope": "feature-scope", "change_plan": "change-plan", "architecture_health": "architecture-health"}
ROOT_ARTIFACTS = {"import_review": "import-review", "analysis_scope_decision": "analysis-scope-decision", "saved_query": "saved-query", "watch_subscription": "watch-subscription"}


def _counted(template: str | None, values: list[Column]) -> tuple[Column | None, list[Column]]:
    if template is None:
        return None, values
    n = template.count("%s")
    return F.format_string(template, *values[:n]), values[n:]


def file_symbol(name: str, project, module, workspace: str, path: Column, *values: Column, roots=SOURCE_ROOTS) -> Column:
    """The id of a file, or of a part of it."""
    kind, part, flow = FILES[name]
    inner, rest = _counted(part, list(values))
    tail, _ = _counted(flow, rest)

    def of(at: Column) -> Column:
        owner = at["owner"] if inner is None or tail is None else F.concat(at["owner"], F.lit("#"), inner)
        fragment = tail if tail is not None else inner
        return symbol(kind, project, module, at["root"], owner, fragment)

    return let(split_root(relative(path, workspace), roots), of)


def method_symbol(name: str, project, module, workspace: str, path: Column, owner: Column, method: Column, descriptor: Column, *values: Column, roots=SOURCE_ROOTS) -> Column:
    """The id of a method, or of a slot of it; the file only gives the source root."""
    kind, flow = METHODS[name]
    base = F.concat(owner, F.lit("#"), method, descriptor)
    tail, _ = _counted(flow, list(values) or [descriptor])
    found = let(split_root(relative(path, workspace), roots), lambda at: symbol(kind, project, module, at["root"], base))
    return found if tail is None else F.concat(found, F.lit(FLOW_SUFFIX[kind][0]), tail)


def scope_symbol(name: str, project, scope: Column, value: Column) -> Column:
    return symbol(SCOPES[name], project, "_root", "", scope, value)


def artifact_symbol(name: str, project, identifier: Column, run: Column | None = None) -> Column:
    if name in ROOT_ARTIFACTS:
        return symbol(ROOT_ARTIFACTS[name], project, "_root", "", identifier)
    return F.concat(F.lit(f"{ARTIFACTS[name]}://{project}/"), run, F.lit("/"), identifier)
