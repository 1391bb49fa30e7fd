"""Info rows to facts. A mapper is a list of edges: condition, source, target, relation, qualifier, confidence[, priority].

All edges of a row come from one pass over the rows; of facts with the same key the first stays, by the rows' order
(file, line, row) and the edge's place in the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.ids import entrypoint, evidence_key, fact_key, java_field, java_method, sql_column, sql_table, symbol
from ripplegraph.functions.registry import API_ROOT, FAMILY
from ripplegraph.functions.web import ascii_path, http_method, join_paths


@dataclass(frozen=True)
class Context:
    """What all facts of a batch share."""

    project: str = "shop"
    module: str = "_root"
    root: str = "src/main/java"
    snapshot: str = "snap-1"
    analysis_run: str = "analysis-1"
    scope_run: str = "scope-1"
    scope: str = "src/main/java"
    datasource: str = "mainDs"
    schema: str = "public"


def facts_from(rows: DataFrame, edges: list[tuple], context: Context, analyzer: str, source_type: str, path: Column, line: Column) -> DataFrame:
    """Facts with their evidence (path, location). rows may have a column `row_ord`."""
    made = []
    for k, (ok, source, target, relation, qualifier, confidence, *priority) in enumerate(edges):
        col = lambda x: x if isinstance(x, Column) else F.lit(x)
        rel = col(relation)
        made.append(
            F.when(
                F.coalesce(ok, F.lit(False)) & source.isNotNull() & target.isNotNull(),
                F.struct(F.lit(k).alias("edge"), source.alias("s"), target.alias("t"), rel.alias("r"), col(qualifier).alias("q"), col(confidence).alias("c"), (priority[0] if priority else F.lit(100)).cast("int").alias("p")),
            )
        )
    order = F.col("row_ord") if "row_ord" in rows.columns else F.lit(0)
    e = rows.select(path.alias("path"), line.cast("int").alias("line"), order.alias("o"), F.explode(F.array_compact(F.array(*made))).alias("e"))
    known = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    location = F.concat(F.lit("line:"), F.col("line").cast("string"))
    f = e.select(
        fact_key(F.col("e.s"), F.col("e.t"), F.col("e.r"), F.col("e.q")).alias("fact_key"),
        F.struct("path", "line", "o", "e.edge").alias("at"),
        F.col("e.s").alias("source_identity_id"),
        F.col("e.t").alias("target_identity_id"),
        F.col("e.r").alias("relation_type"),
        F.col("e.q").alias("qualifier"),
        F.col("e.c").alias("confidence"),
        F.col("e.p").alias("priority"),
        F.col("path").alias("evidence_path"),
        location.alias("location"),
        evidence_key(F.lit(analyzer), F.lit(context.scope), F.col("path"), location, F.lit(1)).alias("evidence_key"),
    )
    rest = [c for c in f.columns if c not in ("fact_key", "at")]
    first = f.groupBy("fact_key").agg(F.min_by(F.struct(*rest), "at").alias("f")).select("fact_key", "f.*")
    fixed = {"project_id": context.project, "snapshot_id": context.snapshot, "analysis_run_id": context.analysis_run, "scope_run_id": context.scope_run, "analyzer_id": analyzer, "scope_key": context.scope, "source_type": source_type}
    out = first.withColumn("relation_family", F.try_element_at(known, F.col("relation_type")))
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"schema_version": F.lit(1), "active": F.lit(True), "tombstone": F.lit(False)})


def evidence_of(facts: DataFrame) -> DataFrame:
    """The evidence rows of kept facts."""
    return facts.groupBy("evidence_key").agg(*[F.min(c).alias(c) for c in ("analyzer_id", "scope_key", "evidence_path", "location", "schema_version", "source_type")])


def union_all(*batches: DataFrame) -> DataFrame:
    """A pipeline's mappers, as a bag."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


c = F.col


def _class(x: Context, owner: Column) -> Column:
    return symbol("class", x.project, x.module, x.root, owner)


def _method(x: Context, owner="owner", name="method", descriptor="descriptor") -> Column:
    return java_method(x.project, x.module, x.root, c(owner), c(name), c(descriptor))


def _statement(x: Context, root: str = "src/main/resources") -> Column:
    return symbol("sql-statement", x.project, x.module, root, c("file"), c("statement_id"))


def java_source(rows: DataFrame, x: Context) -> DataFrame:
    """rows: kind class | method | field | call, file, line, owner, method, descriptor, annotations, modifiers, target_owner,
    target_method, target_descriptor, no_classpath. Calls whose target isn't known have a null target_descriptor (see
    joins.resolve_calls)."""
    sure = F.when(c("no_classpath"), "LIKELY").otherwise("CERTAIN")
    file = symbol("source-file", x.project, x.module, x.root, c("file"))
    kind = c("kind")
    has = lambda *names: F.exists(F.coalesce(c("annotations"), F.array().cast("array<string>")), lambda a: F.substring_index(a, ".", -1).isin(*names))
    is_main = (kind == "method") & (c("method") == "main") & c("descriptor").startswith("([Ljava/lang/String;)") & F.array_contains(F.coalesce(c("modifiers"), F.array().cast("array<string>")), "static")
    # The annotations of listeners.
    listener = has("JmsListener", "KafkaListener", "RabbitListener", "MessageMapping")
    edges = [
        (kind == "class", file, _class(x, c("owner")), "DECLARES", "class", sure),
        (kind == "method", _class(x, c("owner")), _method(x), "DECLARES", "method", sure),
        (kind == "field", _class(x, c("owner")), java_field(x.project, x.module, x.root, c("owner"), c("method")), "DECLARES", "field", sure),
        (is_main, _method(x), entrypoint(x.project, x.module, "main", F.concat(c("owner"), F.lit("/main"))), "DECLARES_ENTRYPOINT", "main", sure),
        ((kind == "method") & has("Scheduled"), _method(x), entrypoint(x.project, x.module, "scheduler", F.concat(c("owner"), F.lit("/"), c("method"))), "DECLARES_ENTRYPOINT", "scheduler", sure),
        ((kind == "method") & listener, _method(x), entrypoint(x.project, x.module, "message", F.concat(c("owner"), F.lit("/"), c("method"), F.lit("/"), F.translate(c("descriptor"), "/", "."))), "DECLARES_ENTRYPOINT", "message", sure),
        ((kind == "call") & c("target_descriptor").isNotNull(), _method(x), _method(x, "target_owner", "target_method", "target_descriptor"), "CALLS", "direct", sure),
    ]
    return facts_from(rows, edges, x, "spoon", "SPOON", c("file"), c("line"))


def native_methods(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, owner, method, descriptor, is_native, loads (a library that load or loadLibrary is called with, or null)."""
    lib = symbol("native-library", x.project, x.module, "_native", ascii_path(F.coalesce(c("loads"), F.lit(""))))
    edge = symbol("boundary-symbol", x.project, x.module, "_native", c("owner"), F.concat(c("method"), c("descriptor")))
    edges = [
        (c("is_native"), _method(x), edge, "HAS_NATIVE_BOUNDARY", "native-method", "CERTAIN"),
        (c("loads").isNotNull() & (c("loads") != ""), _method(x), lib, "CALLS_NATIVE", "load-library", "LIKELY"),
    ]
    return facts_from(rows, edges, x, "spoon-native", "BOUNDARY_SYMBOL", c("file"), c("line"))


def spring_routes(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, owner, method, descriptor, class_paths, method_paths, http_methods (arrays; empty ones count as one blank)."""
    one = lambda a: F.when(F.size(F.coalesce(c(a), F.array().cast("array<string>"))) > 0, c(a)).otherwise(F.array(F.lit("")))
    r = rows.withColumn("cp", F.explode(one("class_paths"))).withColumn("mp", F.explode(one("method_paths"))).withColumn("hm", F.explode(one("http_methods")))
    path = join_paths(c("cp"), c("mp"))
    end = symbol("api-endpoint", x.project, x.module, API_ROOT, F.concat(http_method(c("hm")), F.lit(":"), ascii_path(path)))
    bare = F.btrim(path, F.lit("/"))
    start = entrypoint(x.project, x.module, "spring", F.concat(http_method(c("hm")), F.lit("/"), F.when(bare == "", F.lit("_root")).otherwise(ascii_path(bare))))
    edges = [(F.lit(True), end, _method(x), "ROUTES_TO", "spring-mvc", "LIKELY"), (F.lit(True), _method(x), start, "DECLARES_ENTRYPOINT", "spring-mvc", "LIKELY")]
    return facts_from(r, edges, x, "spring-mvc", "SPRING", c("file"), c("line"))


def struts_actions(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, path, type (class), dispatch (none | dispatch | mapping), method, forwards array<struct<name, path>>."""
    action = symbol("action-path", x.project, x.module, "_actions", ascii_path(F.btrim(c("path"), F.lit("/"))))
    start = entrypoint(x.project, x.module, "struts", ascii_path(F.btrim(c("path"), F.lit("/"))))
    sure = F.when(c("dispatch") == "none", "LIKELY").otherwise("POSSIBLE")
    name = F.when(c("dispatch") == "none", F.lit("execute")).otherwise(F.coalesce(c("method"), F.lit("execute")))
    run = symbol("method", x.project, x.module, x.root, c("type"), name)
    base = [
        (F.lit(True), action, start, "DECLARES_ENTRYPOINT", "struts-action", "LIKELY"),
        (c("type").isNotNull() & (c("type") != ""), action, run, "ROUTES_TO", F.concat(F.lit("struts-"), c("dispatch")), sure),
    ]
    first = facts_from(rows, base, x, "struts-config", "STRUTS", c("file"), c("line"))
    f = rows.withColumn("fw", F.explode("forwards"))
    to = F.btrim(c("fw.path"), F.lit("/"))
    page = F.when(to.rlike(r"\.jspx?$"), symbol("jsp-page", x.project, x.module, "src/main/webapp", ascii_path(to))).when(to.rlike(r"\.html?$"), symbol("html-page", x.project, x.module, "src/main/webapp", ascii_path(to))).otherwise(symbol("action-path", x.project, x.module, "_actions", ascii_path(F.regexp_replace(to, r"\.do$", ""))))
    second = facts_from(f, [(c("fw.path") != "", action, page, "FORWARDS_TO", F.concat(F.lit("forward-"), c("fw.name")), "LIKELY")], x, "struts-config", "STRUTS", c("file"), c("line"))
    return union_all(first, second)


def jsp_pages(rows: DataFrame, x: Context) -> DataFrame:
    """rows: page_path, kind page | form | input | forward | include | taglib | param, line, name, value, method, form_key."""
    root, kind = "src/main/webapp", c("kind")
    path = ascii_path(F.btrim(c("page_path"), F.lit("/")))
    page = symbol("jsp-page", x.project, x.module, root, path)
    form = symbol("jsp-form", x.project, x.module, root, path, F.concat(F.lit("form["), ascii_path(c("form_key")), F.lit("]")))
    own = F.concat(F.lit("jsp-input://"), F.regexp_replace(form, "^[^:]*://", ""), F.lit(":input["), ascii_path(c("name")), F.lit(":"), ascii_path(c("value")), F.lit(":"), c("line").cast("string"), F.lit(":0]"))
    param = symbol("request-param", x.project, x.module, root, ascii_path(c("name")))
    from ripplegraph.functions.web import request_target, resolve, route

    target = symbol("jsp-page", x.project, x.module, root, ascii_path(route(resolve(c("page_path"), c("value")))))
    bound = (kind == "input") & (c("form_key") != "")
    edges = [
        (F.lit(True), page, entrypoint(x.project, x.module, "jsp", path), "DECLARES_ENTRYPOINT", "jsp-page", "LIKELY"),
        (kind == "form", page, form, "CONTAINS", "jsp-structure", "CERTAIN"),
        (kind == "form", form, request_target(x.project, x.module, c("page_path"), c("method"), c("value")), "SUBMITS_TO", "jsp-form", "LIKELY"),
        (bound, page, own, "CONTAINS", "jsp-structure", "CERTAIN"),
        (bound, own, param, "BINDS_TO", "jsp-input", "LIKELY"),
        (kind == "param", page, param, "READS_REQUEST_PARAM", "jsp-param", "LIKELY"),
        (kind == "forward", page, target, "FORWARDS_TO", "jsp-forward", "LIKELY"),
        (kind == "include", page, target, "INCLUDES", "jsp-include", "CERTAIN"),
    ]
    return facts_from(rows, edges, x, "jsp-token", "JSP_TOKEN", c("page_path"), c("line"))


def mybatis_bindings(bound: DataFrame, x: Context) -> DataFrame:
    """bound: what joins.mapper_bindings gives, with owner, method, descriptor, file, statement_id, line."""
    return facts_from(bound, [(F.lit(True), _method(x), _statement(x), "BINDS_TO", "mybatis", "CERTAIN")], x, "mybatis", "MYBATIS_DYNAMIC", c("file"), c("line"))


def jdbc_statements(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, owner, method, descriptor, statement_id, parameter (index, or null)."""
    stmt = _statement(x, x.root)
    param = F.concat(F.lit("sql-param://"), F.regexp_replace(stmt, "^[^:]*://", ""), F.lit(":param["), c("parameter").cast("string"), F.lit("]"))
    edges = [
        (F.lit(True), _method(x), stmt, "BINDS_TO", "jdbc", "CERTAIN"),
        (c("parameter").isNotNull(), stmt, param, "HAS_PARAM", F.concat(F.lit("param-"), c("parameter").cast("string")), "CERTAIN"),
    ]
    return facts_from(rows, edges, x, "jdbc-sql", "SQL", c("file"), c("line"))


def sql_accesses(rows: DataFrame, x: Context) -> DataFrame:
    """rows of sqlscan.accesses: statement (its id), table_name, column_name (null: the table), access, fallback, file, line."""
    table = sql_table(x.project, x.datasource, x.schema, c("table_name"))
    column = sql_column(x.project, x.datasource, x.schema, c("table_name"), c("column_name"))
    is_table = c("column_name").isNull()
    verb = lambda what: F.concat(F.when(c("access") == "READ", "READS_").otherwise("WRITES_"), F.lit(what))
    edges = [
        (is_table, c("statement"), table, verb("TABLE"), "sql-table", F.when(c("fallback"), "POSSIBLE").otherwise("CERTAIN"), F.when(c("fallback"), 70).otherwise(100)),
        (~is_table, c("statement"), column, verb("COLUMN"), "sql-column", "CERTAIN"),
    ]
    return facts_from(rows, edges, x, "sql-table", "SQL", c("file"), c("line"))


def jpa_entities(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, owner, table_name, field (null: the entity itself), column_name."""
    field = java_field(x.project, x.module, x.root, c("owner"), c("field"))
    edges = [
        (c("field").isNull(), _class(x, c("owner")), sql_table(x.project, x.datasource, x.schema, c("table_name")), "BINDS_TO", "jpa-table", "LIKELY"),
        (c("field").isNotNull(), field, sql_column(x.project, x.datasource, x.schema, c("table_name"), c("column_name")), "MAPS_TO_COLUMN", "jpa-column", "LIKELY"),
    ]
    return facts_from(rows, edges, x, "jpa-entity", "JPA", c("file"), c("line"))


def variable_flows(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, scope (web root), parameter (a request's name, or null), owner, method, descriptor, index, type,
    target_owner, target_method, target_descriptor, target_index, target_type. Null owner: the flow starts at the request."""
    base = lambda o, m, d: F.concat(F.lit(f"{x.project}/{x.module}/{x.root}/"), c(o), F.lit("#"), c(m), c(d))
    slot = lambda o, m, d, i, t: F.concat(F.lit("param-slot://"), base(o, m, d), F.lit(":param["), c(i).cast("string"), F.lit(":"), c(t), F.lit("]"))
    to = slot("target_owner", "target_method", "target_descriptor", "target_index", "target_type")
    request = symbol("request-param", x.project, x.module, "", c("scope"), ascii_path(F.coalesce(c("parameter"), F.lit(""))))
    edges = [
        (c("parameter").isNotNull(), request, to, "PASSES_PARAM", "request-derived", "LIKELY", F.lit(90)),
        (c("parameter").isNull(), slot("owner", "method", "descriptor", "index", "type"), to, "PASSES_PARAM", "parameter-derived", "LIKELY", F.lit(90)),
    ]
    return facts_from(rows, edges, x, "variable-trace", "IMPACT_FLOW", c("file"), c("line"))


def dicon_components(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, kind component | include | binding | property | aspect, name, type (a class), value."""
    own = lambda name: symbol("dicon-component", x.project, x.module, "src/main/resources", c("file"), name)
    file = symbol("source-file", x.project, x.module, "src/main/resources", c("file"))
    other = symbol("source-file", x.project, x.module, "src/main/resources", ascii_path(F.btrim(c("value"), F.lit("/"))))
    kind = c("kind")
    edges = [
        (kind == "component", file, own(c("name")), "DECLARES", "dicon-component", "POSSIBLE"),
        (kind == "include", file, other, "INCLUDES", "dicon-include", "POSSIBLE"),
        ((kind == "component") & (c("type") != ""), own(c("name")), _class(x, c("type")), "AUTO_BINDS_TO", "dicon-class", "POSSIBLE"),
        (kind == "property", own(c("name")), symbol("config-key", x.project, x.module, "src/main/resources", c("file"), F.concat(c("name"), F.lit("."), c("value"))), "CONFIGURES_PROPERTY", "dicon-property", "POSSIBLE"),
        (kind == "aspect", own(c("value")), own(c("name")), "INTERCEPTS", "dicon-aspect", "POSSIBLE"),
    ]
    return facts_from(rows, edges, x, "seasar2-dicon", "XML", c("file"), c("line"))


def report_definitions(rows: DataFrame, x: Context) -> DataFrame:
    """rows: file, line, report, kind field | parameter, name, table_name, column_name (both may be null)."""
    report = symbol("report-definition", x.project, x.module, "report", ascii_path(c("report")))
    field = symbol("report-field", x.project, x.module, "report", ascii_path(c("report")), ascii_path(c("name")))
    param = symbol("report-parameter", x.project, x.module, "report", ascii_path(c("report")), ascii_path(c("name")))
    table = sql_table(x.project, "default", "default", c("table_name"))
    column = sql_column(x.project, "default", "default", c("table_name"), c("column_name"))
    whole = c("table_name").isNotNull() & c("column_name").isNotNull()
    low = F.lit(50)
    edges = [
        (c("kind") == "field", report, field, "CONTAINS", "report-field", "POSSIBLE", low),
        (c("kind") == "parameter", report, param, "CONTAINS", "report-parameter", "POSSIBLE", low),
        ((c("kind") == "field") & whole, field, column, "MAPS_TO_COLUMN", "report-field", "POSSIBLE", low),
        (c("table_name").isNotNull(), report, table, "READS_TABLE", "report", "POSSIBLE", low),
        (whole, report, column, "READS_COLUMN", "report", "POSSIBLE", low),
    ]
    return facts_from(rows, edges, x, "report-definition", "XML", c("file"), c("line"))
