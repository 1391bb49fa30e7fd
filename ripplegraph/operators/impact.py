"""Impact queries over visible facts: tables, columns, reports, whole diffs, rules, tests and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegraph.functions import registry
from ripplegraph.functions.ids import has_kind, path_key, table_of
from ripplegraph.operators.traverse import DEFAULT_LIMIT, find_callers, find_downstream
from ripplegraph.sources.lineage import cut


def _rel() -> Column:
    return F.col("relation_type")


def _src() -> Column:
    return F.col("source_identity_id")


def _dst() -> Column:
    return F.col("target_identity_id")


def upstream_bindings(facts: DataFrame, db_facts: DataFrame) -> DataFrame:
    """BINDS_TO facts whose target is a statement among the sources of db_facts."""
    ids = db_facts.where(_src().startswith("sql-statement://")).select(_src().alias("target_identity_id")).distinct()
    return facts.where(_rel() == "BINDS_TO").join(ids, "target_identity_id", "left_semi")


def table_facts(facts: DataFrame, table: str) -> DataFrame:
    """Database facts of a table or of one of its columns: the column's table is derived, so the test is an equality."""
    return facts.where(_rel().isin(*registry.DB_EDGES) & (_table_by_prefix(_dst()) == table))


def _table_by_prefix(target: Column) -> Column:
    """table_of for a target, cut at its first '#', as a table's prefix matches there."""
    return F.when(target.startswith("db-column://"), F.regexp_replace(F.substring_index(target, "#", 1), "^db-column", "db-table")).otherwise(target)


def column_facts(facts: DataFrame, column: str) -> DataFrame:
    return facts.where(_rel().isin(*registry.COLUMN_EDGES) & (_dst() == column))


def is_read(relation: Column | None = None) -> Column:
    return (_rel() if relation is None else relation).isin("READS_TABLE", "READS_COLUMN")


def is_write(relation: Column | None = None) -> Column:
    return (_rel() if relation is None else relation).isin("WRITES_TABLE", "WRITES_COLUMN")


def db_counts(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """For each id of targets (a table or column): reads, writes, upstream bindings. All targets at once."""
    t = targets.select(F.col("id").alias("target")).distinct()
    db = facts.where(_rel().isin(*registry.DB_EDGES)).select("fact_ord", "relation_type", "source_identity_id", _dst().alias("at"))
    by_table = db.select("*", _table_by_prefix(F.col("at")).alias("target")).join(t.where(F.col("target").startswith("db-table://")), "target")
    by_column = db.where(F.col("relation_type").isin(*registry.COLUMN_EDGES)).select("*", F.col("at").alias("target")).join(t.where(F.col("target").startswith("db-column://")), "target")
    hits = by_table.unionByName(by_column)
    counts = hits.groupBy("target").agg(F.count_if(is_read(F.col("relation_type"))).alias("n_reads"), F.count_if(is_write(F.col("relation_type"))).alias("n_writes"))
    statements = hits.where(F.col("source_identity_id").startswith("sql-statement://")).select("target", F.col("source_identity_id").alias("stmt")).distinct()
    bound = facts.where(_rel() == "BINDS_TO").groupBy(_dst().alias("stmt")).agg(F.count("*").alias("n"))
    ups = statements.join(bound, "stmt").groupBy("target").agg(F.sum("n").alias("n_bindings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(counts, "target", "left").join(ups, "target", "left").select("target", zero("n_reads"), zero("n_writes"), zero("n_bindings"))


def affected_reports(facts: DataFrame, column: str) -> dict[str, DataFrame]:
    """column_facts, report_facts, paths (ids, first_ord), fallback (one row): a column's reports, by its own facts or its table's."""
    table = column
    if column.startswith("db-column://"):
        table = "db-table://" + column.removeprefix("db-column://").rpartition("#")[0]
        if "#" not in column:
            table = column.replace("db-column://", "db-table://")
    hits = facts.where(_rel().isin(*registry.DB_EDGES) & _dst().isin(column, table))
    fallback = hits.agg(F.coalesce(F.bool_or(_dst() == table), F.lit(False)).alias("fallback")) if column.startswith("db-column://") else hits.agg(F.lit(False).alias("fallback"))
    mid = hits.select("source_identity_id").distinct()
    reports = facts.where(_rel().isin(*registry.REPORT_EDGES)).join(mid, "source_identity_id", "left_semi")
    paths = reports.groupBy(F.array(F.lit(column), _src(), _dst()).alias("ids")).agg(F.min("fact_ord").alias("first_ord"))
    ids = reports.select(_dst().alias("id")).distinct()
    by_source = facts.join(ids, _src() == F.col("id"), "left_semi")
    by_target = facts.join(ids, _dst() == F.col("id"), "left_semi")
    return {"column_facts": hits, "report_facts": by_source.unionByName(by_target).dropDuplicates(["fact_ord"]), "paths": paths, "fallback": fallback}


def affected_columns(facts: DataFrame, report: str) -> dict[str, DataFrame]:
    """report_facts, column_facts (a bag), paths: what a report's sources read, write or map to."""
    reports = facts.where(_rel().isin(*registry.REPORT_EDGES) & (_dst() == report))
    mid = reports.select("source_identity_id").distinct()
    columns = facts.where(_rel().isin(*registry.DB_EDGES)).join(mid, "source_identity_id", "left_semi")
    paths = columns.groupBy(F.array(F.lit(report), _src(), _dst()).alias("ids")).agg(F.min("fact_ord").alias("first_ord"))
    return {"report_facts": reports, "column_facts": columns, "paths": paths}


# --- whole diffs ---


def diff_paths(facts: DataFrame, changed: DataFrame, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Callers and downstream paths of each changed id (columns seed, seed_ord): with side and, in report order, position."""
    a = find_callers(facts, changed, max_depth, limit).withColumn("side", F.lit("callers"))
    b = find_downstream(facts, changed, max_depth, limit).withColumn("side", F.lit("downstream"))
    return a.unionByName(b).join(changed.select("seed", "seed_ord"), "seed")


def affected(paths: DataFrame) -> DataFrame:
    """id, first: the ends of paths, by where they are first met."""
    at = F.struct("seed_ord", F.when(F.col("side") == "callers", 0).otherwise(1).alias("side"), F.col("rank").alias("rank"))
    return paths.groupBy(F.element_at("ids", -1).alias("id")).agg(F.min(at).alias("first"))


def analyze_diff(facts: DataFrame, project: str, snapshot: str, changed, max_depth: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One row: the impact report of a diff, nested. changed: the ids in order. What it collects is bounded by ids x limit."""
    spark = facts.sparkSession
    seeds = spark.createDataFrame([(x, k) for k, x in enumerate(changed)], "seed string, seed_ord int")
    paths = cut(diff_paths(facts, seeds, max_depth, limit), "diff")
    order = F.struct("seed_ord", F.when(F.col("side") == "callers", 0).otherwise(1).alias("s"), "rank", F.col("ids").alias("identityIds"), "depth")
    listed = paths.agg(F.sort_array(F.collect_list(order)).alias("p"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"))
    ends = affected(paths)
    symbols = ends.agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "id"))), lambda x: x["id"]).alias("affectedSymbols"))
    db = ends.where(has_kind(F.col("id"), ("db-table", "db-column")))
    impacts = db_counts(facts, db).join(db, F.col("target") == F.col("id")).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("first", "target", "n_reads", "n_writes", "n_bindings"))),
            lambda x: F.struct(x["target"].alias("targetIdentityId"), x["n_reads"].alias("readCount"), x["n_writes"].alias("writeCount"), x["n_bindings"].alias("upstreamBindingCount")),
        ).alias("dbImpacts")
    )
    detail = lambda x: F.struct(x["identityIds"].alias("identityIds"), F.lit("MEDIUM").alias("risk"), F.lit("LIKELY").alias("confidence"), F.lit("IMPACT_FLOW").alias("sourceType"), F.array().cast("array<string>").alias("evidenceKeys"))
    one = listed.crossJoin(symbols).crossJoin(impacts)  # three one-row tables
    return one.select(
        F.lit(project).alias("projectId"),
        F.lit(snapshot).alias("snapshotId"),
        F.array(*map(F.lit, changed)).cast("array<string>").alias("changedSymbols"),
        "affectedSymbols",
        F.transform("p", lambda x: F.struct(x["identityIds"].alias("identityIds"), x["depth"].alias("depth"))).alias("paths"),
        F.transform("p", detail).alias("pathDetails"),
        "dbImpacts",
        F.array().cast("array<string>").alias("suggestedTests"),
        F.lit(False).alias("aiEnabled"),
        "truncated",
    )


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("json"))


def report_markdown(report: DataFrame) -> str:
    """The report as text; its row is collected, which the search's limits bound."""
    r = report.first()
    ticked = lambda items: "".join(f"- `{x}`\n" for x in items) or "- None\n"
    flag = lambda b: str(bool(b)).lower()
    paths = "".join("- " + " -> ".join(f"`{x}`" for x in p.identityIds) + "\n" for p in r.paths) or "- None\n"
    details = "".join(f"- Risk `{d.risk}`, confidence `{d.confidence}`, source `{d.sourceType}`, evidence [{', '.join(d.evidenceKeys)}]\n" for d in r.pathDetails)
    db = "".join(f"- `{x.targetIdentityId}`: {x.readCount} read, {x.writeCount} write, {x.upstreamBindingCount} upstream bindings\n" for x in r.dbImpacts) or "- None\n"
    sections = {
        "Changed Symbols": ticked(r.changedSymbols),
        "Affected Symbols": ticked(r.affectedSymbols),
        "Impact Paths": paths,
        **({"Path Evidence": details} if details else {}),
        "DB Impacts": db,
        "Suggested Tests": "".join(f"- {x}\n" for x in r.suggestedTests) or "- None\n",
    }
    head = f"# Fast Impact Report\n\n- Project: `{r.projectId}`\n- Snapshot: `{r.snapshotId}`\n- AI Enabled: `{flag(r.aiEnabled)}`\n- Truncated: `{flag(r.truncated)}`\n"
    return head + "".join(f"\n## {name}\n\n{body}" for name, body in sections.items())


# --- aggregates over paths ---


def confidence_rank(confidence: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, registry.CONFIDENCE)), confidence).cast("int") - 1


def best_confidence(confidence: Column) -> Column:
    """An aggregate: the strongest of a group, UNKNOWN of none."""
    return F.coalesce(F.min_by(confidence, confidence_rank(confidence)), F.lit("UNKNOWN"))


def weakest_edge(paths: DataFrame, facts: DataFrame) -> DataFrame:
    """seed, rank, confidence: the weakest edge of each path."""
    steps = paths.select("seed", "rank", F.explode("ords").alias("fact_ord"))
    rank = confidence_rank(F.col("confidence"))
    return steps.join(facts.select("fact_ord", "confidence"), "fact_ord").groupBy("seed", "rank").agg(F.max_by("confidence", rank).alias("confidence"))


def layer_violation(ids: Column, low: str, high: str) -> Column:
    return (F.size(ids) == 2) & F.element_at(ids, 1).contains(low) & F.element_at(ids, -1).contains(high)


def check_rules(paths: DataFrame, rules: dict[str, tuple[str, object]]) -> DataFrame:
    """rule, severity, ids of each violation. rules: id -> (severity, function of the ids column)."""
    hit = F.array_compact(F.array(*[F.when(rule(F.col("ids")), F.struct(F.lit(k).alias("rule"), F.lit(severity).alias("severity"))) for k, (severity, rule) in rules.items()]))
    return paths.select("ids", F.explode(hit).alias("v")).select("v.rule", "v.severity", "ids")


def violation_summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule").agg(F.count("*").alias("n_violations"), F.bool_or(F.col("severity") == "ERROR").alias("has_errors"))


def evaluate(reported: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of counts, precision and recall; both have a column ids. Repeated reported paths all count."""
    r = reported.select(path_key(F.col("ids")).alias("k"))
    want = labels.select(path_key(F.col("ids")).alias("k")).distinct()
    hits = r.join(want.withColumn("hit", F.lit(1)), "k", "left").agg(F.count("*").alias("n_reported"), F.count("hit").alias("true_positives"))
    missed = want.join(r.distinct().withColumn("hit", F.lit(1)), "k", "left").agg(F.count("*").alias("n_labels"), F.count_if(F.col("hit").isNull()).alias("false_negatives"))
    one = hits.crossJoin(missed)  # two one-row tables
    found = F.col("n_labels") - F.col("false_negatives")
    return one.select(
        "n_reported",
        "true_positives",
        (F.col("n_reported") - F.col("true_positives")).alias("false_positives"),
        "false_negatives",
        F.when(F.col("n_reported") == 0, 0.0).otherwise(F.col("true_positives") / F.col("n_reported")).alias("precision"),
        F.when(F.col("n_labels") == 0, 1.0).otherwise(found / F.col("n_labels")).alias("recall"),
    )


def test_scores(tests: DataFrame, paths: DataFrame, risk: DataFrame, changes: DataFrame) -> DataFrame:
    """test_ord, test, score: risk and change count summed over all nodes of all paths, the same for each test. risk: id, risk; changes: id, n."""
    nodes = paths.select(F.explode("ids").alias("id"))
    total = nodes.join(risk, "id", "left").join(changes, "id", "left").agg(F.coalesce(F.sum(F.coalesce("risk", F.lit(0)) + F.coalesce("n", F.lit(0))), F.lit(0)).alias("score"))
    return tests.crossJoin(total)  # a one-row table


# --- architecture health ---


def fan(facts: DataFrame) -> DataFrame:
    """id, fan_in, fan_out over call edges."""
    calls = facts.where(_rel().isin(*registry.CALL_EDGES))
    ends = calls.select(F.explode(F.array(F.struct(_src().alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(_dst().alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def hotspots(facts: DataFrame, k: int) -> DataFrame:
    return fan(facts).withColumn("score", F.col("fan_in") * F.col("fan_out")).orderBy(F.desc("score"), "id").limit(k)


def two_cycles(facts: DataFrame) -> DataFrame:
    """a < b that call each other."""
    e = facts.where(_rel().isin(*registry.CALL_EDGES)).select(_src().alias("a"), _dst().alias("b")).where("a <> b").distinct()
    pair = e.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).count()
    return pair.where("count = 2").select(F.col("x").alias("a"), F.col("y").alias("b"))


def orphan_entrypoints(facts: DataFrame) -> DataFrame:
    """Targets of routes that call nothing."""
    routed = facts.where(_rel() == "ROUTES_TO").select(_dst().alias("id")).distinct()
    return routed.join(facts.where(_rel().isin(*registry.CALL_EDGES)).select(_src().alias("id")), "id", "left_anti")


def reports_by_table(facts: DataFrame) -> DataFrame:
    """report, table: all pairs that share a source."""
    db = facts.where(_rel().isin(*registry.DB_EDGES)).select("source_identity_id", table_of(_dst()).alias("table_id")).distinct()
    reports = facts.where(_rel().isin(*registry.REPORT_EDGES)).select("source_identity_id", _dst().alias("report_id")).distinct()
    return db.join(reports, "source_identity_id").select("report_id", "table_id").distinct()


# --- ranks and verdicts ---


def path_priority(depth: Column, confidence: Column, end: Column) -> Column:
    """A score to sort paths by: short, certain and ending at data first. It never changes a path's confidence."""
    sink = F.when(has_kind(end, ("db-table", "db-column")), 20).when(has_kind(end, ("sql-statement",)), 10).otherwise(0)
    return sink + 10 * (3 - confidence_rank(confidence)) - depth


def limited(paths: DataFrame, max_nodes: int) -> DataFrame:
    """Paths of each seed while they name at most max_nodes different nodes, in rank order, with the reason for the cut."""
    first = paths.select("seed", "rank", F.explode("ids").alias("id")).groupBy("seed", "id").agg(F.min("rank").alias("rank"))
    new = first.groupBy("seed", "rank").agg(F.count("*").alias("n_new"))
    p = paths.join(new, ["seed", "rank"], "left")
    p = p.withColumn("n_nodes", F.sum(F.coalesce("n_new", F.lit(0))).over(Window.partitionBy("seed").orderBy("rank")))
    cut_ = F.max(F.col("n_nodes") > max_nodes).over(Window.partitionBy("seed"))
    reason = F.when(cut_, "HOT_NODE").when(F.col("truncated"), "PATHS").otherwise("")
    return p.withColumn("truncation_reason", reason).where(F.col("n_nodes") <= max_nodes).drop("n_new", "n_nodes")


# The targets of the two benchmark profiles.
BENCHMARKS = {"small-fixture": (5_000, 256 << 20), "impact-report": (30_000, 512 << 20)}


def benchmark_verdicts(measurements: DataFrame, profiles: DataFrame) -> DataFrame:
    """profile, passed: whether the last measurement (profile, ts, p95_ms, heap_bytes) keeps the profile's targets; false without one."""
    last = measurements.groupBy("profile").agg(F.max_by(F.struct("p95_ms", "heap_bytes"), "ts").alias("m"))
    ok = F.coalesce((F.col("m.p95_ms") <= F.col("target_p95_ms")) & (F.col("m.heap_bytes") <= F.col("target_heap")), F.lit(False))
    return profiles.join(last, "profile", "left").select("profile", ok.alias("passed"))
