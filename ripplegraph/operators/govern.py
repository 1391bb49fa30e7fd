"""Governed tool calls: who may call what, what arguments may hold, and the audit of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegraph.functions.ids import let
from ripplegraph.functions.text import audit_redact

# The tools, the profiles' tools, and what arguments may not hold.
TOOLS = (
    "symbol.search graph.findCallers graph.findCallees graph.findImpactPaths impact.analyzeDiff db.findCodeImpacts variable.findImpacts "
    "jsp.findBackendFlow feature.planChange feature.planAddition rag.semanticSearch rag.answerDraft report.getImpactReport project.overview"
).split()
PROFILES = {
    "IMPACT_ANALYSIS": "symbol.search graph.findImpactPaths impact.analyzeDiff report.getImpactReport".split(),
    "DB_IMPACT": "db.findCodeImpacts graph.findImpactPaths report.getImpactReport".split(),
    "VARIABLE_TRACE": "variable.findImpacts symbol.search".split(),
    "VARIABLE_IMPACT": "variable.findImpacts graph.findImpactPaths".split(),
    "FEATURE_CHANGE_PLAN": "feature.planChange rag.semanticSearch rag.answerDraft".split(),
    "FEATURE_ADDITION_PLAN": "feature.planAddition rag.semanticSearch rag.answerDraft".split(),
    "CODE_QUESTION": "symbol.search rag.semanticSearch rag.answerDraft project.overview".split(),
}
RAW_STATEMENT = r"(?is)\b(select|insert|update|delete|merge|match|create|drop|alter|call)\b.+"
FILE_GLOB = r"(^|[\\/\s])\*\*?|\{[^}]+}"
SHELL = r"(?i)\b(powershell|cmd\.exe|cmd /c|bash|sh -c|git\s+|gradle\s+|npm\s+)\b"


def argument_rejection(key: Column, value: Column) -> Column:
    """Why an argument is rejected, or null."""
    k = F.lower(key)
    raw = value.rlike(f"{RAW_STATEMENT[:5]}^(?:{RAW_STATEMENT[5:]})\\z")
    return (
        F.when(k.contains("cypher") | k.contains("sql") | raw, "raw Cypher or SQL is not allowed")
        .when(k.contains("glob") | value.rlike(FILE_GLOB), "file glob is not allowed")
        .when(k.contains("command") | value.rlike(SHELL), "shell command is not allowed")
    )


def arguments_rejection(arguments: Column) -> Column:
    """Of a map: the first of its entries that is rejected decides."""
    found = F.transform(F.map_entries(arguments), lambda e: argument_rejection(e["key"], e["value"]))
    return F.get(F.array_compact(found), 0)


def decisions(requests: DataFrame, projects, registered=TOOLS) -> DataFrame:
    """requests (request_id, profile, tool_name, project_id, arguments, within_rate) with `reason`, null if allowed.

    The rate comes before the arguments, so a call with bad ones uses up its quota; a call that is rejected before
    doesn't (within_rate is streaming.limiter's verdict over the calls that get there, see `counted`).
    """
    known = F.col("tool_name").isin(*TOOLS)
    own = F.lit(False)
    for p, tools in PROFILES.items():
        own = own | ((F.col("profile") == p) & F.col("tool_name").isin(*tools))
    reason = (
        F.when(~known, "unknown MCP tool")
        .when(~own, "out-of-profile tool")
        .when(~F.col("project_id").isin(*projects), "project not allowed")
        .when(~F.col("within_rate"), "rate limited")
        .otherwise(F.coalesce(arguments_rejection(F.col("arguments")), F.when(~F.col("tool_name").isin(*registered), "tool handler not registered")))
    )
    return requests.withColumn("reason", reason)


def counted(requests: DataFrame, projects) -> DataFrame:
    """The requests that reach the rate limiter."""
    d = decisions(requests.withColumn("within_rate", F.lit(True)), projects)
    return d.where(F.col("reason").isNull() | ~F.col("reason").isin("unknown MCP tool", "out-of-profile tool", "project not allowed")).select(*requests.columns)


def audit(decided: DataFrame) -> DataFrame:
    """Audit rows: the arguments redacted, in one line."""
    pairs = let(F.map_entries("arguments"), lambda e: F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit("="), audit_redact(x["value"]))), ","))
    return decided.select("request_id", "principal", "project_id", "tool_name", pairs.alias("parameter_summary"), F.coalesce("result_count", F.lit(0)).alias("result_count"), F.lit("redacted").alias("redaction_state"), F.col("reason").alias("rejection_reason"))


def pick(candidates: DataFrame) -> DataFrame:
    """query_id, needs_picker, follow_up: several candidates need a choice, of several scopes one of scope."""
    scope = F.concat_ws("/", "project_id", "module_key", "datasource_key")
    g = candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct(scope).alias("scopes"))
    # The follow-up questions.
    text = F.when(F.col("n") <= 1, F.lit(None).cast("string")).when(F.col("scopes") > 1, "Choose project, module and datasource before continuing.").otherwise("Please choose one candidate before continuing.")
    return g.select("query_id", (F.col("n") > 1).alias("needs_picker"), text.alias("follow_up"))
