"""Identity functions as columns: keys, the id grammar, paths and id builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplegraph.functions.registry import API_ROOT, FLOW_SUFFIX, FRAGMENT_KINDS, HTTP_METHODS, IDENTITY_TYPE, SCOPE_ONLY_FLOWS, SOURCE_ROOTS


def stable_key(prefix: str, *parts: Column) -> Column:
    """prefix, a colon and the first 16 bytes of SHA-256 over the parts, each ended by a NUL."""
    ended = [x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.char(F.lit(0)))]
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat(*ended), 256), 1, 32))


def fact_key(source: Column, target: Column, relation: Column, qualifier: Column) -> Column:
    return stable_key("fact", source, target, relation, qualifier)


def evidence_key(analyzer: Column, scope: Column, path: Column, location: Column, schema_version: Column) -> Column:
    return stable_key("evidence", analyzer, scope, path, location, schema_version)


def provisional_descriptor(text: Column) -> Column:
    """The descriptor of a method whose types are unresolved."""
    return F.concat(F.lit("(U"), F.substring(F.sha2(text, 256), 1, 12), F.lit(")U"))


def short_hash(text: Column) -> Column:
    """12 characters of SHA-256 in URL-safe Base64."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_"), 1, 12)


def kind_of(symbol: Column) -> Column:
    return F.substring_index(symbol, "://", 1)


def _has(kind: Column, kinds) -> Column:
    return kind.isin(*kinds)


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _suffix_at(kind: Column, rest: Column) -> Column:
    """Where the fragment's delimiter stands, from 0; -1 without one."""
    at = F.instr(rest, "#") - 1
    for k, token in FLOW_SUFFIX.items():
        own = (F.length(rest) - F.instr(F.reverse(rest), "@")) if token == "@" else F.instr(rest, token) - 1
        at = F.when((kind == k) & (F.instr(rest, token) > 0), own).otherwise(at)
    return at


def _identity_type(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for t in ("SYMBOL_ID", "FLOW_ID", "ARTIFACT_ID"):
        out = F.when(_has(kind, [k for k, v in IDENTITY_TYPE.items() if v == t]), F.lit(t)).otherwise(out)
    return out


def _root(kind: Column, identity: Column, remainder: Column) -> Column:
    root = F.when(F.instr(remainder, "/") > 0, F.substring_index(remainder, "/", 1)).otherwise("")
    for r in sorted([*SOURCE_ROOTS, API_ROOT], key=len):  # the longest is asked first
        root = F.when(remainder.startswith(f"{r}/") & ((kind == "api-endpoint") | F.lit(r != API_ROOT)), F.lit(r)).otherwise(root)
    return F.when((identity == "ARTIFACT_ID") | (kind == "datasource"), F.lit("")).otherwise(root)


def parse_symbol(symbol: Column) -> Column:
    """struct<kind, identity_type, project, module, source_root, owner_path, fragment> of a well-formed id; null parts if it has none."""

    def cut_at(a: Column) -> Column:
        return let(_suffix_at(a["kind"], a["rest"]), lambda at: F.struct(a["kind"].alias("kind"), F.when(at >= 0, F.substring(a["rest"], F.lit(1), at)).otherwise(a["rest"]).alias("path"), F.when(at >= 0, F.substring(a["rest"], at + 2, F.length(a["rest"]))).alias("fragment")))

    def parts_of(a: Column) -> Column:
        return let(F.split(a["path"], "/", -1), lambda p: F.struct(a["kind"].alias("kind"), _identity_type(a["kind"]).alias("identity"), F.get(p, 0).alias("project"), F.get(p, 1).alias("module"), F.array_join(F.slice(p, 3, 1_000_000), "/").alias("remainder"), a["fragment"].alias("fragment")))

    def whole(a: Column) -> Column:
        def named(root: Column) -> Column:
            owner = F.when(root == "", a["remainder"]).otherwise(F.substring(a["remainder"], F.length(root) + 2, F.length(a["remainder"])))
            owner = F.when(a["kind"] == "datasource", F.lit("")).otherwise(owner)
            return F.struct(a["kind"].alias("kind"), a["identity"].alias("identity_type"), a["project"].alias("project"), a["module"].alias("module"), root.alias("source_root"), owner.alias("owner_path"), a["fragment"].alias("fragment"))

        return let(_root(a["kind"], a["identity"], a["remainder"]), named)

    first = F.struct(kind_of(symbol).alias("kind"), F.regexp_replace(symbol, r"^[^:]*://", "").alias("rest"))
    return let(let(let(first, cut_at), parts_of), whole)


def canonical(parsed: Column) -> Column:
    """The id of a parsed symbol."""

    def of(p: Column) -> Column:
        delimiter = F.lit("#")
        for k, token in FLOW_SUFFIX.items():
            delimiter = F.when(p["kind"] == k, F.lit(token[0])).otherwise(delimiter)
        part = lambda c: F.when(p[c] == "", F.lit("")).otherwise(F.concat(F.lit("/"), p[c]))
        tail = F.when(F.coalesce(F.trim(p["fragment"]), F.lit("")) == "", F.lit("")).otherwise(F.concat(delimiter, p["fragment"]))
        return F.concat(p["kind"], F.lit("://"), p["project"], F.lit("/"), p["module"], part("source_root"), part("owner_path"), tail)

    return let(parsed, of)


def symbol_errors(symbol: Column) -> Column:
    """Names of the rules that an id breaks; empty for a valid one."""
    methods = "|".join(HTTP_METHODS)
    unsafe = r"[\\?\x00-\x20\x7f]|[^\x00-\x7f]"

    def of(x: Column) -> Column:
        p, path = x["p"], x["path"]
        kind, owner, fragment = p["kind"], p["owner_path"], F.coalesce(p["fragment"], F.lit(""))
        api = kind == "api-endpoint"
        flow_owner = (p["identity_type"] == "FLOW_ID") & ~_has(kind, SCOPE_ONLY_FLOWS)
        parts = F.size(F.split(path, "/", -1))
        rules = {
            "blank": F.coalesce(F.trim(symbol), F.lit("")) == "",
            "scheme": ~symbol.rlike(r"^[^:]+://"),
            "kind": ~_has(kind, IDENTITY_TYPE),
            "fragment": p["fragment"].isNotNull() & ~_has(kind, FRAGMENT_KINDS) & (p["identity_type"] != "FLOW_ID"),
            "unsafe": symbol.rlike(unsafe) | fragment.contains("#") | (~flow_owner & owner.contains("#")),
            "relative": path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"),
            "parts": F.when(kind == "datasource", parts != 2).otherwise(parts < 3),
            "blank_part": (F.coalesce(p["project"], F.lit("")) == "") | (F.coalesce(p["module"], F.lit("")) == ""),
            "owner": F.when(kind == "datasource", F.lit(False)).otherwise((owner == "") | owner.contains("//") | owner.startswith("/") | (owner.endswith("/") & ~(api & owner.endswith(":/")))),
            "root": (kind != "datasource") & (p["identity_type"] != "ARTIFACT_ID") & (p["source_root"] == "") & ~_has(kind, (*SCOPE_ONLY_FLOWS, "db-schema")),
            "separator": F.when(api, ~owner.rlike(rf"^({methods}):/(?!.*:/)") | (p["source_root"] == "")).otherwise(path.contains(":/")),
        }
        return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))

    path = F.regexp_replace(F.regexp_replace(symbol, r"^[^:]*://", ""), "#.*$", "")
    return let(F.struct(parse_symbol(symbol).alias("p"), path.alias("path")), of)


def table_of(column: Column) -> Column:
    """The table's id of a column's id; other ids stay."""
    return F.when(column.startswith("db-column://"), F.regexp_replace(F.regexp_replace(column, "#[^#]*$", ""), "^db-column", "db-table")).otherwise(column)


def owner_method(slot: Column) -> Column:
    """The method's id of a parameter slot's id, else ''."""
    known = slot.startswith("param-slot://") & (F.instr(slot, ":param[") > 0)
    return F.when(known, F.concat(F.lit("method://"), F.substring(F.substring_index(slot, ":param[", 1), 14, 1_000_000))).otherwise("")


def has_kind(symbol: Column, kinds) -> Column:
    out = F.lit(False)
    for k in kinds:
        out = out | symbol.startswith(f"{k}://")
    return out


def path_start(ids: Column) -> Column:
    return F.element_at(ids, 1)


def path_end(ids: Column) -> Column:
    return F.element_at(ids, -1)


def path_depth(ids: Column) -> Column:
    return F.size(ids) - 1


def path_key(ids: Column) -> Column:
    return F.concat(F.array_join(ids, "|"), F.lit("|"))


# --- builders ---


def symbol(kind: str, project, module, root, owner, fragment: Column | None = None) -> Column:
    """An id from its parts; each may be a column or a string."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    head = [F.lit(f"{kind}://"), col(project), F.lit("/"), col(module)]
    for p in (root, owner):
        head += [let(p, lambda x: F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("/"), x))) if isinstance(p, Column) else F.lit(f"/{p}" if p else "")]
    if fragment is not None:
        head += [F.lit(FLOW_SUFFIX.get(kind, "#")[0]), fragment]
    return F.concat(*head)


def relative(path: Column, workspace: str) -> Column:
    """A physical path with '/' separators, relative to the workspace."""
    root = workspace.replace("\\", "/").rstrip("/") + "/"
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(p.startswith(root), F.substring(p, len(root) + 1, 1_000_000)).otherwise(p)


def split_root(path: Column, roots=SOURCE_ROOTS) -> Column:
    """struct<root, owner> of a relative path: the longest known root that starts it or stands within it."""
    out = F.struct(F.lit(None).cast("string").alias("root"), F.lit(None).cast("string").alias("owner"))
    for r in sorted(roots, key=len):
        at = F.instr(F.concat(F.lit("/"), path), f"/{r}/")
        out = F.when(at > 0, F.struct(F.lit(r).alias("root"), F.substring(path, at + F.lit(len(r) + 1), F.lit(1_000_000)).alias("owner"))).otherwise(out)
    return out


def java_method(project, module, root, owner: Column, name: Column, descriptor: Column) -> Column:
    return symbol("method", project, module, root, owner, F.concat(name, descriptor))


def java_field(project, module, root, owner: Column, name: Column) -> Column:
    return symbol("field", project, module, root, owner, name)


def slot(kind: str, base: Column, template: str, *values: Column) -> Column:
    """A flow id of a method's or page's id: template like 'param[%s:%s]'."""
    return F.concat(F.lit(f"{kind}://"), F.regexp_replace(base, "^[^:]*://", ""), F.lit(":"), F.format_string(template, *values))


def entrypoint(project, module, framework: str, owner: Column) -> Column:
    return symbol("entrypoint", project, module, "_entrypoints", F.concat(F.lit(f"{framework}/"), owner))


def sql_table(project, datasource, schema: str, name: Column) -> Column:
    """A table's id; the context's own schema in front of the name goes, in any case of letters."""
    return symbol("db-table", project, datasource, schema, F.regexp_replace(name, f"(?i)^{schema}\\.", ""))


def sql_column(project, datasource, schema: str, table: Column, name: Column) -> Column:
    return symbol("db-column", project, datasource, schema, F.regexp_replace(table, f"(?i)^{schema}\\.", ""), name)
