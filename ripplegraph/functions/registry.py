"""Registries: symbol kinds, relations, node types, source types, and their small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Symbol kinds by identity type.
SYMBOL_KINDS = (
    "project module source-file class method field jsp-page jsp-include jsp-tag jsp-expression jsp-scriptlet html-page html-form html-link "
    "script-resource client-request jsp-form api-endpoint action-path dicon-component entrypoint schedule cron-trigger message-queue "
    "message-topic domain-event message-listener batch-job cli-command shell-script external-command sql-statement sql-variant datasource "
    "db-schema db-table db-column db-index db-constraint db-view config-key report-definition report-field report-parameter native-library "
    "boundary-symbol synthetic-symbol"
).split()
FLOW_KINDS = (
    "param-slot return-slot request-param request-attr session-attr model-attr sql-param sql-branch-condition method-summary html-input "
    "jsp-input dom-event-handler html-render-slot client-init-data reflection-candidate"
).split()
ARTIFACT_KINDS = (
    "feature-seed feature-scope change-plan architecture-health architecture-metric hotspot-candidate import-review "
    "analysis-scope-decision change-item saved-query watch-subscription review-comment policy-violation export-artifact"
).split()
# Kinds that may carry a '#' fragment besides the flow kinds; what starts a flow kind's suffix.
FRAGMENT_KINDS = (
    "method field jsp-form jsp-tag jsp-expression jsp-scriptlet dicon-component html-form html-link client-request config-key sql-statement "
    "sql-variant db-column db-index db-constraint report-definition report-field synthetic-symbol boundary-symbol native-library report-parameter"
).split()
FLOW_SUFFIX = {
    "method-summary": "@",
    "param-slot": ":param[",
    "sql-param": ":param[",
    "return-slot": ":return[",
    "sql-branch-condition": ":branch[",
    "html-input": ":input[",
    "jsp-input": ":input[",
    "reflection-candidate": ":reflect[",
}
SCOPE_ONLY_FLOWS = ("request-param", "request-attr", "session-attr", "model-attr")
# Source roots known to the id grammar.
SOURCE_ROOTS = ("src/main/java", "src/test/java", "src/main/resources", "src/test/resources", "src/main/webapp", "WEB-INF/classes")
API_ROOT = "_api"
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE")

# Relations by family; a star marks those that aren't in the first version's set.
RELATIONS = {
    "STRUCTURE": "DECLARES DECLARES_ENTRYPOINT INCLUDES CONTAINS",
    "CALL": "CALLS ROUTES_TO INVOKES INTERCEPTS*",
    "WEB": "SUBMITS_TO FORWARDS_TO USES_TAGLIB RENDERS_INPUT LOADS_SCRIPT NAVIGATES_TO HANDLES_DOM_EVENT CALLS_HTTP",
    "DATA": "BINDS_TO READS_FIELD WRITES_FIELD GUARDED_BY AUTO_BINDS_TO*",
    "FLOW": "BINDS_PARAM READS_PARAM WRITES_PARAM PASSES_PARAM RETURNS READS_MODEL_ATTR READS_REQUEST_PARAM READS_SESSION_ATTR WRITES_MODEL_ATTR WRITES_REQUEST_ATTR WRITES_SESSION_ATTR HAS_PARAM",
    "DATABASE": "READS_TABLE WRITES_TABLE READS_COLUMN WRITES_COLUMN HAS_VARIANT MAPS_TO_COLUMN",
    "CONFIGURATION": "USES_CONFIG CONFIGURES_PROPERTY*",
    "ASYNC": "SCHEDULES TRIGGERS PUBLISHES_TO CONSUMES_FROM",
    "BOUNDARY": "CALLS_COMMAND EXPORTS_SYMBOL REFERENCES_SYMBOL CALLS_NATIVE* HAS_NATIVE_BOUNDARY*",
    "CANDIDATE": "REFLECTS_TO*",
    "AI_ASSISTED_CANDIDATE": "AI_SUGGESTS_RELATION*",
    "PLANNING": "MATCHES REQUIRES_CHANGE SUGGESTS_REVIEW REQUIRES_TEST IMPACTS COVERED_BY CONFIRMED_SCOPE SUMMARIZES*",
    "WORKFLOW": "WATCHES CHANGED_IN HAS_DIAGNOSTIC NOTIFIES ACKNOWLEDGES COMMENTS_ON* VIOLATES_POLICY* SUPPRESSED_BY* EXPORTED_AS*",
}
# Confidence from the strongest, source types.
CONFIDENCE = ("CERTAIN", "LIKELY", "POSSIBLE", "UNKNOWN")
SOURCE_TYPES = (
    "SPOON IMPACT_FLOW METHOD_SUMMARY_FLOW ASM CLASSGRAPH PROGUARDCORE JASPER JSP_SMAP JSP_TOKEN HTML_TOKEN JS_STATIC JAVAPARSER_FAST SPRING "
    "STRUTS XML SQL JPA MYBATIS_DYNAMIC REFLECTION BOUNDARY_SYMBOL SHELL GIT JOERN TABBY WALA SOOTUP_HEROS TAI_E AI_ASSISTED USER_CONFIRMATION"
).split()
# Node labels that aren't the kind's name in capitals-and-words, and the layers.
_LABELS = {"entrypoint": "EntryPoint", "request-param": "RequestParameter", "request-attr": "RequestAttribute", "session-attr": "SessionAttribute", "model-attr": "ModelAttribute", "sql-param": "SqlParameter", "datasource": "DataSource"}
_STRUCTURE_LAYER = ("project", "module", "source-file", "class", "method", "field")
_FLOW_LAYER = ("entrypoint", "db-column")
IDENTITY_PROPERTY = {"SYMBOL_ID": "symbolId", "FLOW_ID": "flowId", "ARTIFACT_ID": "artifactId"}

IDENTITY_TYPE = {k: t for t, ks in (("SYMBOL_ID", SYMBOL_KINDS), ("FLOW_ID", FLOW_KINDS), ("ARTIFACT_ID", ARTIFACT_KINDS)) for k in ks}
FAMILY = {r.rstrip("*"): f for f, rs in RELATIONS.items() for r in rs.split()}

# Relation sets of the queries.
CALL_EDGES = ("CALLS", "INVOKES")
DOWNSTREAM_EDGES = ("ROUTES_TO", "SUBMITS_TO", "CALLS_HTTP", "CALLS", "INVOKES", "BINDS_TO", "READS_TABLE", "WRITES_TABLE", "READS_COLUMN", "WRITES_COLUMN")
COLUMN_EDGES = ("READS_COLUMN", "WRITES_COLUMN", "MAPS_TO_COLUMN")
DB_EDGES = ("READS_TABLE", "WRITES_TABLE", *COLUMN_EDGES)
TRACE_EDGES = ("BINDS_TO", "PASSES_PARAM")
REPORT_EDGES = ("EXPORTS_SYMBOL", "REFERENCES_SYMBOL")
TRACE_SINKS = ("sql-param", "db-table", "db-column", "sql-statement")
BACKEND_SINKS = ("sql-statement", "db-table", "db-column")


def label(kind: str) -> str:
    return _LABELS.get(kind) or "".join(w.capitalize() for w in kind.split("-"))


def layer(kind: str) -> str:
    if IDENTITY_TYPE[kind] == "ARTIFACT_ID":
        return "PLANNING_REVIEW"
    if IDENTITY_TYPE[kind] == "FLOW_ID" or kind in _FLOW_LAYER:
        return "IMPACT_FLOW"
    return "CODE_STRUCTURE" if kind in _STRUCTURE_LAYER else "FRAMEWORK_SEMANTICS"


def symbol_kinds(spark: SparkSession) -> DataFrame:
    rows = [(k, t, t == "FLOW_ID" or k in FRAGMENT_KINDS, FLOW_SUFFIX.get(k, "")) for k, t in IDENTITY_TYPE.items()]
    return spark.createDataFrame(rows, "kind string, identity_type string, allows_fragment boolean, flow_suffix string")


def relations(spark: SparkSession) -> DataFrame:
    rows = [(r.rstrip("*"), f, not r.endswith("*")) for f, rs in RELATIONS.items() for r in rs.split()]
    return spark.createDataFrame(rows, "name string, family string, mvp boolean")


def node_types(spark: SparkSession) -> DataFrame:
    rows = [(label(k), k, t, IDENTITY_PROPERTY[t], layer(k), t != "ARTIFACT_ID") for k, t in IDENTITY_TYPE.items()]
    return spark.createDataFrame(rows, "label string, kind string, identity_type string, identity_property string, layer string, default_query_fact boolean")
