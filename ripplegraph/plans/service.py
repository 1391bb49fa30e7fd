"""The service surface: endpoints and tools by name, each a function of the store's facts to a table.

A request is a mapping; every list is a page (offset, limit). Artifacts (saved queries, subscriptions, threads, policies, CI
checks, exports) are rows of an artifact table by kind.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import ids
from ripplegraph.operators import govern, impact, retrieve, traverse
from ripplegraph.sources import sinks, store
from ripplegraph.sources.lineage import cut

VIEWS = ("PATHS", "TABLE", "TREE", "GRAPH", "SQL", "REPORT", "TIMELINE", "SUMMARY")
ARTIFACTS = {"saved-queries": "saved-query", "subscriptions": "watch-subscription", "review-threads": "review-comment", "policies": "policy-violation", "ci-checks": "policy-violation", "exports": "export-artifact"}


class Service:
    """facts, and the other tables that requests read (each may be absent): runs, reviews, reports, evidence, artifacts, documents."""

    def __init__(self, spark: SparkSession, facts: DataFrame, **tables: DataFrame):
        self.spark, self.facts, self.tables = spark, facts, tables
        self.handlers: dict[str, Callable[[dict], DataFrame]] = {
            "symbol.search": self.symbol_search,
            "graph.findCallers": self.callers,
            "graph.findCallees": self.callees,
            "graph.findImpactPaths": self.impact_paths,
            "impact.analyzeDiff": self.analyze_diff,
            "db.findCodeImpacts": self.db_impact,
            "variable.findImpacts": self.variable_trace,
            "jsp.findBackendFlow": self.backend_flow,
            "rag.semanticSearch": self.semantic_search,
            "rag.answerDraft": self.answer_draft,
            "report.getImpactReport": self.report,
            "project.overview": self.overview,
            "feature.planChange": self.plan_change,
            "feature.planAddition": self.plan_addition,
        }
        self.endpoints: dict[str, Callable[[dict], DataFrame]] = {
            "workspaces": lambda r: spark.createDataFrame([("default",)], "workspace string"),
            "projects": lambda r: self.facts.select("project_id").distinct(),
            "import-reviews": lambda r: self.listed("reviews", r),
            "analysis-runs": lambda r: self.listed("runs", r),
            "snapshots": lambda r: store.active_snapshots(self.facts, r["project"]),
            "projects/overview": self.overview,
            "symbols/search": self.symbol_search,
            "graph/callers": self.callers,
            "graph/callees": self.callees,
            "graph/paths": lambda r: traverse.paths_between(self.visible(r), self.seed(r), r["to"], r.get("depth", 5), r.get("paths", 100)),
            "impact/analyze-diff": self.analyze_diff,
            "impact/reports": lambda r: self.listed("reports", r),
            "impact/report-impact": lambda r: self.report_impact(r)["paths"],
            "features/plan-change": lambda r: self.job("feature-change", "change-plan", r),
            "features/plan-addition": lambda r: self.job("feature-addition", "change-plan", r),
            "admin/projects": lambda r: self.delete_project(r["project"], bool(r.get("confirm")), r.get("key")),
            "variable-trace": self.variable_trace,
            "db-impact": self.db_impact,
            "architecture-health": self.health,
            "jsp-backend-flow": self.backend_flow,
            "sql-table-impact": self.db_impact,
            "reports": lambda r: self.listed("reports", r),
            "evidence": lambda r: self.tables["evidence"].where(F.col("evidence_key") == r["id"]),
            "query/plan": lambda r: spark.createDataFrame([(str(r.get("intent")), str(r.get("id")))], "intent string, id string"),
            "result-view-contract": lambda r: spark.createDataFrame([(v,) for v in VIEWS], "view string"),
        }
        for path, kind in ARTIFACTS.items():
            self.endpoints[path] = lambda r, k=kind: self.page(self.tables["artifacts"].where(F.col("kind") == k), r)

    # --- parts ---

    def visible(self, r: dict) -> DataFrame:
        return store.active_facts(self.facts, r["project"], r["snapshot"])

    def seed(self, r: dict) -> DataFrame:
        return self.spark.createDataFrame([(r["id"], 0)], "seed string, seed_ord int")

    def page(self, df: DataFrame, r: dict) -> DataFrame:
        return sinks.page(df, df.columns[:1], r.get("offset", 0), r.get("limit", 100))

    def listed(self, name: str, r: dict) -> DataFrame:
        return self.page(self.tables[name], r)

    # --- requests ---

    def symbol_search(self, r: dict) -> DataFrame:
        """Ids that contain the text, the shortest first."""
        f = self.visible(r)
        known = f.select(F.col("source_identity_id").alias("id")).union(f.select("target_identity_id")).distinct()
        found = known.where(F.lower("id").contains(r["q"].lower())).withColumn("n", F.length("id"))
        return sinks.page(found, ["n", "id"], r.get("offset", 0), r.get("limit", 100)).drop("n")

    def callers(self, r: dict) -> DataFrame:
        return traverse.find_callers(self.visible(r), self.seed(r), r.get("depth", 5), r.get("paths", 100))

    def callees(self, r: dict) -> DataFrame:
        return traverse.search(traverse.edges_of(self.visible(r), ("CALLS", "INVOKES")), self.seed(r), r.get("depth", 5), r.get("paths", 100))

    def impact_paths(self, r: dict) -> DataFrame:
        return impact.diff_paths(self.visible(r), self.seed(r), r.get("depth", 5), r.get("paths", 100))

    def analyze_diff(self, r: dict) -> DataFrame:
        return impact.analyze_diff(self.visible(r), r["project"], r["snapshot"], r["changed"], r.get("depth", 5), r.get("paths", 100))

    def db_impact(self, r: dict) -> DataFrame:
        f = self.visible(r)
        hits = impact.table_facts(f, r["id"]) if r["id"].startswith("db-table://") else impact.column_facts(f, r["id"])
        kind = F.when(impact.is_read(), "read").when(impact.is_write(), "write").otherwise("display")
        bound = impact.upstream_bindings(f, hits).withColumn("use", F.lit("binding"))
        return hits.withColumn("use", kind).unionByName(bound)

    def variable_trace(self, r: dict) -> DataFrame:
        run = {"source": traverse.trace_sources, "sink": traverse.trace_sinks, "combined": traverse.trace_combined}[r.get("mode", "combined")]
        return run(self.visible(r), self.seed(r), r.get("depth", 5), r.get("paths", 100))

    def backend_flow(self, r: dict) -> DataFrame:
        return traverse.find_backend_flows(self.visible(r), self.seed(r), r.get("depth", 5), r.get("paths", 100))

    def report_impact(self, r: dict) -> dict[str, DataFrame]:
        """Reports of a column or table, or the columns of a report."""
        return impact.affected_columns(self.visible(r), r["id"]) if r["id"].startswith("report-definition://") else impact.affected_reports(self.visible(r), r["id"])

    def job(self, kind: str, result: str, r: dict) -> DataFrame:
        """What a request that runs later gets: job_id, report_id, status. Equal requests have equal ids."""
        key = hashlib.sha256(json.dumps([kind, sorted((k, str(v)) for k, v in r.items())]).encode()).hexdigest()[:12]
        return self.spark.createDataFrame([(f"job-{kind}-{key}", f"{result}-{key}", "QUEUED")], "job_id string, report_id string, status string")

    def plan_change(self, r: dict) -> DataFrame:
        """id, kind, n_paths, depth of what a change of an id reaches, the nearest first: what the change has to look at."""
        paths = self.impact_paths(r)
        ends = paths.groupBy(F.element_at("ids", -1).alias("id")).agg(F.count("*").alias("n_paths"), F.min("depth").alias("depth"))
        return sinks.page(ends.select("id", ids.kind_of(F.col("id")).alias("kind"), "n_paths", "depth"), ["depth", "id"], r.get("offset", 0), r.get("limit", 100))

    def plan_addition(self, r: dict) -> DataFrame:
        """id, kind, n_uses of ids that contain a new feature's name, the most used first: where it may belong."""
        found = self.symbol_search(r | {"limit": 100, "offset": 0})
        uses = self.visible(r).groupBy(F.col("target_identity_id").alias("id")).agg(F.count("*").alias("n_uses"))
        rows = found.join(uses, "id", "left").select("id", ids.kind_of(F.col("id")).alias("kind"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"))
        return rows.orderBy(F.desc("n_uses"), "id").limit(r.get("limit", 100))

    def semantic_search(self, r: dict) -> DataFrame:
        return retrieve.hybrid_search(self.tables["documents"], r["q"], r["project"], r["snapshot"], r.get("limit", 10))

    def answer_draft(self, r: dict) -> DataFrame:
        return retrieve.answer_draft(retrieve.evidence_pack(self.tables["snippets"], r["project"], r["snapshot"], r.get("budget", 12000)), r["q"])

    def report(self, r: dict) -> DataFrame:
        return self.tables["reports"].where(F.col("id") == r["id"])

    def overview(self, r: dict) -> DataFrame:
        """project_id, facts, families, kinds."""
        own = self.facts.where((F.col("project_id") == r["project"]) & store.visible())
        kind = ids.kind_of(F.col("target_identity_id"))
        return own.groupBy("project_id").agg(F.count("*").alias("n_facts"), F.sort_array(F.collect_set("relation_family")).alias("families"), F.sort_array(F.collect_set(kind)).alias("kinds"))

    def health(self, r: dict) -> DataFrame:
        """metric, id, value: hotspots, mutual calls and orphan entry points."""
        f = self.visible(r)
        hot = impact.hotspots(f, r.get("limit", 25)).select(F.lit("hotspot").alias("metric"), "id", F.col("score").cast("long").alias("value"))
        cyc = impact.two_cycles(f).select(F.lit("cycle").alias("metric"), F.concat_ws(" ", "a", "b").alias("id"), F.lit(2).cast("long").alias("value"))
        lone = impact.orphan_entrypoints(f).select(F.lit("orphan").alias("metric"), "id", F.lit(0).cast("long").alias("value"))
        return hot.unionByName(cyc).unionByName(lone)

    def delete_project(self, project: str, confirmed: bool = False, key: str | None = None) -> DataFrame:
        """The facts without a project; it needs a confirmation or an idempotency key."""
        if not confirmed and not key:
            raise ValueError("confirm, or give an idempotency key")
        return store.delete_project(self.facts, project)

    # --- governed calls ---

    def dispatch(self, requests: DataFrame, projects) -> tuple[dict, DataFrame]:
        """The results of allowed requests by request_id, and the audit of all. Requests of one dispatch are few: they come from agents."""
        decided = govern.decisions(requests, projects, list(self.handlers)).collect()
        out, counts = {}, []
        for r in decided:
            if r.reason is None:
                # written once: the count and the caller's reading don't compute it again
                out[r.request_id] = cut(self.handlers[r.tool_name]({"project": r.project_id, **r.arguments}), "answer")
                counts.append((r.request_id, out[r.request_id].count()))
        done = self.spark.createDataFrame(counts, "request_id string, result_count long")
        return out, govern.audit(govern.decisions(requests, projects, list(self.handlers)).join(done, "request_id", "left"))
