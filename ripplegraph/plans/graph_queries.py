"""Queries over the synthetic fact graph: scans, ids, traversals, impact, diffs, store mutations, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import ids, registry
from ripplegraph.operators import impact, traverse
from ripplegraph.plans.registered import query
from ripplegraph.sources import sinks, store
from ripplegraph.sources.lineage import cut, fresh_path
from ripplegraph.sources.starfacts import TABLES, facts_sql, star_facts

SNAP, OTHER = "snap-1", "snap-2"
BASE = "shop/_root/src/main/java/com.shop."


def method(name: str) -> str:
    return f"method://{BASE}{name}#run()V"


PARTS = [method(f"Part{k}") for k in (3, 7, 11, 19)]
ORDERS = [method(f"Order{k}") for k in range(1, 9)]
TABLE = "db-table://shop/mainDs/public/economy"
COLUMN = "db-column://shop/mainDs/public/economy#Brand_2"
REPORT = "report-definition://shop/_root/report/asia"
SLOTS = [f"param-slot://{BASE}Part{k}#run()V:param[0:I]" for k in (5, 8, 100000)]
REQUESTS = [f"request-param://shop/_root/src/main/webapp/nation{k}" for k in (2, 4)]

# --- SQL pieces ---

FACTS = f"facts AS MATERIALIZED ({facts_sql()})"
ACTIVE = "active AND NOT tombstone AND project_id = 'shop'"
VISIBLE = f"{FACTS}, v AS (SELECT * FROM facts WHERE {ACTIVE} AND snapshot_id = '{SNAP}')"
KEY = "'fact:' || substring(sha256(source_identity_id || chr(0) || target_identity_id || chr(0) || relation_type || chr(0) || qualifier || chr(0)), 1, 32)"


def listed(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def values(items) -> str:
    return ", ".join(f"('{x}')" for x in items)


def edges_text(relations, forward: bool) -> str:
    a, b = ("source_identity_id", "target_identity_id") if forward else ("target_identity_id", "source_identity_id")
    return f"SELECT {a} AS src, {b} AS dst, fact_ord AS ord FROM v WHERE relation_type IN ({listed(relations)})"


def search_text(edges: str, seeds, depth: int, limit: int, emit: str = "true", name: str = "p", seeded: bool = False) -> str:
    """CTEs name (all paths) and name_r (the emitted ones with rank)."""
    own = " AND (e.seed IS NULL OR e.seed = p.seed)" if seeded else ""
    return (
        f"{name}_e AS MATERIALIZED ({edges}), {name} AS (SELECT s AS seed, [s] AS ids, CAST([] AS BIGINT[]) AS ords, 0 AS depth FROM (VALUES {values(seeds)}) t(s)"
        f" UNION ALL SELECT p.seed, list_append(p.ids, e.dst), list_append(p.ords, e.ord), p.depth + 1 FROM {name} p JOIN {name}_e e ON p.ids[-1] = e.src{own} WHERE p.depth < {depth} AND NOT list_contains(p.ids, e.dst)),"
        f" {name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, ords) AS rank FROM {name} WHERE depth > 0 AND {emit}) WHERE rank <= {limit})"
    )


SHOWN = "seed, array_to_string(ids, '>') AS path, CAST(depth AS INTEGER) AS depth, CAST(rank AS INTEGER) AS rank, count(*) OVER (PARTITION BY seed) >= {limit} AS truncated"


def shown(paths: DataFrame) -> DataFrame:
    return paths.select("seed", traverse.emitted_key(F.col("ids")).alias("path"), "depth", F.col("rank").cast("int").alias("rank"), "truncated")


_stores: dict[tuple, store.FactStore] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of a table folder, from a store that is written once for as long as the tables' files stay as they are.

    Within a snapshot they are sorted by relation and target, so predicates on these prune row groups.
    """
    at = lambda t: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stamps = tuple((x.getModificationTime(), x.getLen()) for x in (at(t).getFileSystem(conf).getFileStatus(at(t)) for t in TABLES))
    key = (spark.sparkContext.applicationId, sf_dir, stamps)
    if key not in _stores:
        made = store.FactStore(spark, fresh_path(spark, "facts"))
        made.append(star_facts(spark, sf_dir).sortWithinPartitions("project_id", "snapshot_id", "relation_type", "target_identity_id"))
        _stores[key] = made
    return _stores[key].facts()


def visible(spark: SparkSession, sf_dir: str, snapshot: str = SNAP) -> DataFrame:
    return store.active_facts(stored(spark, sf_dir), "shop", snapshot)


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible facts, written once: for queries that go through them again and again."""
    return cut(visible(spark, sf_dir), "pinned")


def seeds(spark: SparkSession, items) -> DataFrame:
    return spark.createDataFrame([(x, k) for k, x in enumerate(items)], "seed string, seed_ord int")


# --- scans ---

BRIEF = ["fact_ord", "fact_key", "source_identity_id", "target_identity_id", "relation_type", "relation_family", "qualifier", "confidence"]
_BRIEF = f"fact_ord, {KEY} AS fact_key, source_identity_id, target_identity_id, relation_type, relation_family, qualifier, confidence"


@query("active_facts", f"WITH {VISIBLE} SELECT {_BRIEF} FROM v")
def _(spark, sf_dir):
    return visible(spark, sf_dir).select(*BRIEF)


@query("facts_by_relation", f"WITH {VISIBLE} SELECT {_BRIEF} FROM v WHERE relation_type = 'BINDS_TO'")
def _(spark, sf_dir):
    return store.by_relation(stored(spark, sf_dir), "shop", SNAP, "BINDS_TO").select(*BRIEF)


@query("facts_by_source", f"WITH {VISIBLE} SELECT {_BRIEF} FROM v WHERE source_identity_id = '{PARTS[0]}'")
def _(spark, sf_dir):
    return store.by_source(stored(spark, sf_dir), "shop", SNAP, PARTS[0]).select(*BRIEF)


@query("facts_by_target", f"WITH {VISIBLE} SELECT {_BRIEF} FROM v WHERE target_identity_id = '{PARTS[0]}'")
def _(spark, sf_dir):
    return store.by_target(stored(spark, sf_dir), "shop", SNAP, PARTS[0]).select(*BRIEF)


@query("active_fact_count", f"WITH {FACTS} SELECT count(*) AS n FROM facts WHERE {ACTIVE}")
def _(spark, sf_dir):
    return store.active_count(stored(spark, sf_dir), "shop")


@query("active_snapshots", f"WITH {FACTS} SELECT snapshot_id, min(fact_ord) AS first_ord FROM facts WHERE {ACTIVE} GROUP BY 1")
def _(spark, sf_dir):
    return store.active_snapshots(stored(spark, sf_dir), "shop")


@query("report_scan", f"WITH {VISIBLE} SELECT relation_type, count(*) AS n, min(fact_ord) AS first_ord, max(fact_ord) AS last_ord FROM v GROUP BY 1")
def _(spark, sf_dir):
    return visible(spark, sf_dir).groupBy("relation_type").agg(F.count("*").alias("n"), F.min("fact_ord").alias("first_ord"), F.max("fact_ord").alias("last_ord"))


@query("materialized_edges", f"WITH {VISIBLE} SELECT {KEY} AS fact_key, source_identity_id, target_identity_id, relation_type, relation_family, qualifier, project_id, snapshot_id, confidence FROM v")
def _(spark, sf_dir):
    return store.materialized_edges(visible(spark, sf_dir)).drop("evidence_key")


@query("stable_batch_order", f"WITH {VISIBLE} SELECT fact_key, fact_ord, row_number() OVER (ORDER BY fact_key, fact_ord) AS place FROM (SELECT {KEY} AS fact_key, fact_ord FROM v)")
def _(spark, sf_dir):
    return sinks.placed(visible(spark, sf_dir).select("fact_key", "fact_ord"), ["fact_key", "fact_ord"])


@query("facts_page", f"WITH {VISIBLE} SELECT fact_ord, relation_type FROM v ORDER BY fact_ord LIMIT 100 OFFSET 50")
def _(spark, sf_dir):
    return sinks.page(visible(spark, sf_dir).select("fact_ord", "relation_type"), ["fact_ord"], 50, 100)


@query("classpath_scope_facts", f"WITH {VISIBLE} SELECT fact_ord FROM v WHERE contains(source_identity_id || chr(10) || target_identity_id, '/webapp/') OR contains(source_identity_id || chr(10) || target_identity_id, '/webapp#')")
def _(spark, sf_dir):
    both = F.concat("source_identity_id", F.lit("\n"), "target_identity_id")
    return visible(spark, sf_dir).where(both.contains("/webapp/") | both.contains("/webapp#")).select("fact_ord")


def broken(facts: DataFrame) -> DataFrame:
    """Facts of which some break rules."""
    hit = lambda n, k, c, v: F.when(F.col("fact_ord") % n == k, F.lit(v)).otherwise(F.col(c))
    changes = [(101, 3, "project_id", "other"), (103, 5, "confidence", "SURE"), (107, 2, "schema_version", 0), (109, 4, "source_type", "AI_ASSISTED"), (113, 6, "evidence_key", " "), (127, 8, "qualifier", "else"), (131, 9, "relation_family", "FLOW"), (137, 1, "priority", -1)]
    return facts.withColumns({c: hit(n, k, c, v) for n, k, c, v in changes})


_BROKEN = [
    ("key", "fact_ord % 127 = 8 AND qualifier <> 'else'"),
    ("family", "fact_ord % 131 = 9 AND relation_family <> 'FLOW'"),
    ("source_project", "fact_ord % 101 = 3"),
    ("target_project", "fact_ord % 101 = 3"),
    ("confidence", "fact_ord % 103 = 5"),
    ("schema_version", "fact_ord % 107 = 2"),
    ("priority", "fact_ord % 137 = 1"),
    ("ai_family", "fact_ord % 109 = 4"),
    ("ai_certain", "fact_ord % 109 = 4 AND confidence = 'CERTAIN' AND fact_ord % 103 <> 5"),
    ("evidence_key", "fact_ord % 113 = 6"),
]


@query("fact_errors", f"WITH {FACTS} SELECT * FROM (SELECT fact_ord, concat_ws(',', {', '.join(f'CASE WHEN {rule} THEN {name!r} END' for name, rule in _BROKEN)}) AS errors FROM facts) WHERE errors <> ''")
def _(spark, sf_dir):
    return store.fact_errors(broken(stored(spark, sf_dir))).select("fact_ord", F.array_join("errors", ",").alias("errors"))


# --- ids ---


@query("fact_keys", f"WITH {FACTS} SELECT {KEY} AS fact_key, count(*) AS n FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return stored(spark, sf_dir).groupBy("fact_key").agg(F.count("*").alias("n"))


@query("evidence_keys", f"WITH {FACTS} SELECT DISTINCT 'evidence:' || substring(sha256(analyzer_id || chr(0) || scope_key || chr(0) || source_identity_id || chr(0) || 'line:1' || chr(0) || '1' || chr(0)), 1, 32) AS evidence_key, analyzer_id, source_identity_id FROM facts")
def _(spark, sf_dir):
    return stored(spark, sf_dir).select("evidence_key", "analyzer_id", "source_identity_id").distinct()


_IDS = f"{FACTS}, i AS (SELECT source_identity_id AS id FROM facts UNION SELECT target_identity_id FROM facts)"


def all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = stored(spark, sf_dir)
    return f.select(F.col("source_identity_id").alias("id")).union(f.select("target_identity_id")).distinct()


_REST = "regexp_replace(id, '^[^:]*://', '')"
_FLOW = "CASE WHEN kind IN ('param-slot', 'sql-param') THEN ':param[' WHEN kind = 'jsp-input' THEN ':input[' END"
_PARSED = (
    f"{_IDS}, k AS (SELECT id, split_part(id, '://', 1) AS kind, {_REST} AS rest FROM i), t AS (SELECT *, {_FLOW} AS tok FROM k),"
    " c AS (SELECT *, CASE WHEN tok IS NOT NULL AND strpos(rest, tok) > 0 THEN strpos(rest, tok) WHEN strpos(rest, '#') > 0 THEN strpos(rest, '#') END AS cut FROM t),"
    " q AS (SELECT *, CASE WHEN cut IS NULL THEN rest ELSE left(rest, cut - 1) END AS path, CASE WHEN cut IS NOT NULL THEN substring(rest, cut + 1) END AS fragment FROM c),"
    " o AS (SELECT *, array_to_string(string_split(path, '/')[3:], '/') AS rem FROM q),"
    " r AS (SELECT *, CASE WHEN starts_with(rem, 'src/main/resources/') THEN 'src/main/resources' WHEN starts_with(rem, 'src/main/webapp/') THEN 'src/main/webapp' WHEN starts_with(rem, 'src/main/java/') THEN 'src/main/java'"
    " WHEN kind = 'api-endpoint' THEN '_api' WHEN strpos(rem, '/') > 0 THEN split_part(rem, '/', 1) ELSE '' END AS source_root FROM o)"
)


@query(
    "parse_symbols",
    f"WITH {_PARSED} SELECT id, kind, CASE WHEN kind IN ({listed(registry.FLOW_KINDS)}) THEN 'FLOW_ID' ELSE 'SYMBOL_ID' END AS identity_type, split_part(path, '/', 1) AS project, split_part(path, '/', 2) AS module, source_root, CASE WHEN source_root = '' THEN rem ELSE substring(rem, length(source_root) + 2) END AS owner_path, fragment FROM r",
)
def _(spark, sf_dir):
    return all_ids(spark, sf_dir).select("id", ids.parse_symbol(F.col("id")).alias("p")).select("id", "p.*")


_BARE = ("db-table", "api-endpoint", "html-page", "report-definition")
_IS_BARE = " OR ".join(f"starts_with(id, '{k}://')" for k in _BARE)


@query("canonical_symbols", f"WITH {_IDS} SELECT id, id AS canonical FROM i UNION ALL SELECT id || '#', id FROM i WHERE {_IS_BARE}")
def _(spark, sf_dir):
    """Ids as they are, and some that end in an empty fragment."""
    i = all_ids(spark, sf_dir)
    i = i.unionByName(i.where(ids.has_kind(F.col("id"), _BARE)).select(F.concat("id", F.lit("#")).alias("id")))
    return i.select("id", ids.canonical(ids.parse_symbol(F.col("id"))).alias("canonical"))


#: ways to break a table's id, and the rules it then breaks
_BREAKS = [
    ("replace(id, 'db-table://', 'db-tabel://')", "kind"),
    ("replace(id, '://', ':/')", "scheme,kind,separator"),
    ("id || '#x'", "fragment"),
    ("id || chr(9)", "unsafe"),
    ("replace(id, '/public/', '/../')", "relative"),
    ("id || '/'", "owner"),
    ("replace(id, '/public/', ':/')", "root,separator"),
    ("'db-table://shop/' || split_part(id, '/', 6)", "parts,owner,root"),
]


@query("symbol_validation", f"WITH {_IDS} SELECT id, '' AS errors FROM i" + "".join(f" UNION ALL SELECT {how}, '{rules}' FROM i WHERE starts_with(id, 'db-table://')" for how, rules in _BREAKS))
def _(spark, sf_dir):
    i = all_ids(spark, sf_dir)
    tables = i.where(ids.has_kind(F.col("id"), ("db-table",)))
    for how, _ in _BREAKS:
        i = i.unionByName(tables.select(F.expr(how).alias("id")))
    return i.select("id", F.array_join(ids.symbol_errors(F.col("id")), ",").alias("errors"))


@query("table_of_column", f"WITH {_IDS} SELECT id, CASE WHEN starts_with(id, 'db-column://') THEN 'db-table://' || regexp_replace(substring(id, 13), '#[^#]*$', '') ELSE id END AS table_id FROM i WHERE starts_with(id, 'db-')")
def _(spark, sf_dir):
    return all_ids(spark, sf_dir).where(F.col("id").startswith("db-")).select("id", ids.table_of(F.col("id")).alias("table_id"))


@query("owner_methods", f"WITH {_IDS} SELECT id, 'method://' || split_part(substring(id, 14), ':param[', 1) AS owner FROM i WHERE starts_with(id, 'param-slot://')")
def _(spark, sf_dir):
    return all_ids(spark, sf_dir).where(F.col("id").startswith("param-slot://")).select("id", ids.owner_method(F.col("id")).alias("owner"))


@query("symbol_search", f"WITH {_IDS} SELECT id, CAST(strpos(id, 'Part12') AS INTEGER) AS at FROM i WHERE contains(lower(id), 'part12') ORDER BY length(id), id LIMIT 50")
def _(spark, sf_dir):
    found = all_ids(spark, sf_dir).where(F.lower("id").contains("part12"))
    return found.orderBy(F.length("id"), "id").limit(50).select("id", F.instr("id", "Part12").alias("at"))


# --- traversals ---


def _search(name: str, items, relations, forward: bool, depth: int, limit: int, run, where: str = "true"):
    sql = f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(relations, forward), items, depth, limit)}, s AS (SELECT {SHOWN.format(limit=limit)}, ids FROM p_r) SELECT seed, path, depth, rank, truncated FROM s WHERE {where}"
    query(name, sql)(lambda spark, sf_dir: shown(run(visible(spark, sf_dir), seeds(spark, items), depth, limit)))


_BACKEND = " OR ".join(f"starts_with(ids[-1], '{k}://')" for k in registry.BACKEND_SINKS)
_search("find_callers", PARTS[:1], registry.CALL_EDGES, False, 3, 100, traverse.find_callers)
_search("find_callers_multi_seed", PARTS, registry.CALL_EDGES, False, 3, 60, traverse.find_callers)
_search("find_downstream", ORDERS, registry.DOWNSTREAM_EDGES, True, 3, 80, traverse.find_downstream)
_search("backend_flows", ORDERS, registry.DOWNSTREAM_EDGES, True, 4, 120, traverse.find_backend_flows, _BACKEND)
_search("trace_sources", SLOTS, registry.TRACE_EDGES, False, 4, 50, traverse.trace_sources)
_search("graph_paths_between", ORDERS, registry.DOWNSTREAM_EDGES, True, 4, 2000, lambda f, s, d, k: traverse.paths_between(f, s, TABLE, d, k), f"ids[-1] = '{TABLE}'")
_search("entrypoint_search", [f"sql-statement://shop/_root/src/main/resources/com/shop/Part.xml#stmt{k}" for k in (3, 4)], registry.DOWNSTREAM_EDGES, False, 3, 4000, traverse.find_entrypoints, "starts_with(ids[-1], 'api-endpoint://')")


@query("cached_callers", f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), PARTS[:2], 2, 50)} SELECT {SHOWN.format(limit=50)} FROM p_r")
def _(spark, sf_dir):
    cache = traverse.AdjacencyCache()
    f = visible(spark, sf_dir)
    cache.rebuild(f, "shop", SNAP)
    out = shown(cache.find_callers(f, "shop", SNAP, seeds(spark, PARTS[:2]), 2, 50))
    cache.invalidate("shop", SNAP)
    return out


@query("find_callees_one_hop", f"WITH {VISIBLE} SELECT fact_ord AS ord, target_identity_id AS id FROM v WHERE relation_type IN ('CALLS', 'INVOKES') AND source_identity_id = '{PARTS[1]}'")
def _(spark, sf_dir):
    return traverse.one_hop(visible(spark, sf_dir), PARTS[1])


@query("adjacency", f"WITH {VISIBLE} SELECT source_identity_id AS src, string_agg(target_identity_id, '>' ORDER BY fact_ord) AS neighbours, count(*) AS n FROM v WHERE relation_type IN ('CALLS', 'INVOKES') GROUP BY 1")
def _(spark, sf_dir):
    return traverse.adjacency(visible(spark, sf_dir)).select("src", F.array_join("neighbours", ">").alias("neighbours"), F.size("neighbours").cast("long").alias("n"))


@query("fan_out_cap", f"WITH {VISIBLE}, e AS ({edges_text(registry.CALL_EDGES, True)}) SELECT src, dst, ord FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ord) AS n FROM e) WHERE n <= 2")
def _(spark, sf_dir):
    return traverse.capped(traverse.edges_of(visible(spark, sf_dir), registry.CALL_EDGES), 2)


def sink_edges_text(items) -> str:
    own = lambda c: f"CASE WHEN starts_with({c}, 'param-slot://') AND contains({c}, ':param[') THEN 'method://' || split_part(substring({c}, 14), ':param[', 1) END"
    phase = traverse.PHASE
    b = "SELECT * FROM v WHERE relation_type = 'BINDS_TO' AND starts_with(source_identity_id, 'method://')"
    return (
        f"SELECT source_identity_id AS src, target_identity_id AS dst, fact_ord AS ord, CAST(NULL AS VARCHAR) AS seed FROM v WHERE relation_type IN ({listed(registry.TRACE_EDGES)})"
        f" UNION ALL SELECT k.src, b.target_identity_id, b.fact_ord + {phase}, NULL FROM (SELECT DISTINCT source_identity_id AS src FROM v WHERE relation_type IN ({listed(registry.TRACE_EDGES)})) k JOIN ({b}) b ON {own('k.src')} = b.source_identity_id"
        f" UNION ALL SELECT source_identity_id, target_identity_id, fact_ord + {2 * phase}, NULL FROM v WHERE relation_type IN ('HAS_PARAM', 'READS_TABLE', 'WRITES_TABLE')"
        f" UNION ALL SELECT s, b.target_identity_id, b.fact_ord + {3 * phase}, s FROM (VALUES {values(items)}) t(s) JOIN ({b}) b ON {own('s')} = b.source_identity_id"
    )


_SINK = " OR ".join(f"starts_with(ids[-1], '{k}://')" for k in registry.TRACE_SINKS)
_STARTS = [*REQUESTS, *SLOTS]


@query("trace_sinks", f"WITH RECURSIVE {VISIBLE}, {search_text(sink_edges_text(_STARTS), _STARTS, 4, 40, f'({_SINK})', seeded=True)} SELECT {SHOWN.format(limit=40)} FROM p_r")
def _(spark, sf_dir):
    return shown(traverse.trace_sinks(visible(spark, sf_dir), seeds(spark, _STARTS), 4, 40))


@query(
    "trace_combined",
    f"WITH RECURSIVE {VISIBLE}, {search_text(sink_edges_text(SLOTS), SLOTS, 3, 30, f'({_SINK})', seeded=True)}, {search_text(edges_text(registry.TRACE_EDGES, False), SLOTS, 3, 30, name='b')},"
    f" u AS (SELECT 'sink' AS side, * FROM p_r UNION ALL SELECT 'source', * FROM b_r), n AS (SELECT seed, max(n) >= 30 AS truncated FROM (SELECT seed, side, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)"
    " SELECT side, u.seed, array_to_string(ids, '>') AS path, CAST(depth AS INTEGER) AS depth, CAST(rank AS INTEGER) AS rank, truncated FROM u JOIN n USING (seed)",
)
def _(spark, sf_dir):
    found = traverse.trace_combined(visible(spark, sf_dir), seeds(spark, SLOTS), 3, 30)
    return shown(found.withColumn("seed", F.struct("seed", "side"))).select("seed.side", "seed.seed", "path", "depth", "rank", "truncated")


# --- impact ---

_TABLE_HIT = f"(target_identity_id = '{TABLE}' OR starts_with(target_identity_id, '{TABLE.replace('db-table', 'db-column')}#'))"
_DB = listed(registry.DB_EDGES)


def db_shown(df: DataFrame) -> DataFrame:
    r = F.col("relation_type")
    return df.select("fact_ord", "relation_type", "source_identity_id", "target_identity_id", impact.is_read(r).alias("is_read"), impact.is_write(r).alias("is_write"))


_DB_SHOWN = "fact_ord, relation_type, source_identity_id, target_identity_id, relation_type IN ('READS_TABLE', 'READS_COLUMN') AS is_read, relation_type IN ('WRITES_TABLE', 'WRITES_COLUMN') AS is_write"


@query("table_impact", f"WITH {VISIBLE} SELECT {_DB_SHOWN} FROM v WHERE relation_type IN ({_DB}) AND {_TABLE_HIT}")
def _(spark, sf_dir):
    return db_shown(impact.table_facts(visible(spark, sf_dir), TABLE))


@query("column_impact", f"WITH {VISIBLE} SELECT {_DB_SHOWN} FROM v WHERE relation_type IN ({listed(registry.COLUMN_EDGES)}) AND target_identity_id = '{COLUMN}'")
def _(spark, sf_dir):
    return db_shown(impact.column_facts(visible(spark, sf_dir), COLUMN))


@query("upstream_bindings", f"WITH {VISIBLE} SELECT fact_ord, source_identity_id, target_identity_id FROM v WHERE relation_type = 'BINDS_TO' AND target_identity_id IN (SELECT source_identity_id FROM v WHERE relation_type IN ({_DB}) AND {_TABLE_HIT} AND starts_with(source_identity_id, 'sql-statement://'))")
def _(spark, sf_dir):
    f = visible(spark, sf_dir)
    return impact.upstream_bindings(f, impact.table_facts(f, TABLE)).select("fact_ord", "source_identity_id", "target_identity_id")


_HITS = f"h AS (SELECT * FROM v WHERE relation_type IN ({_DB}) AND target_identity_id IN ('{COLUMN}', '{TABLE}'))"
_REPORTS = f"r AS (SELECT * FROM v WHERE relation_type IN ({listed(registry.REPORT_EDGES)}) AND source_identity_id IN (SELECT source_identity_id FROM h))"


@query("affected_reports", f"WITH {VISIBLE}, {_HITS}, {_REPORTS} SELECT '{COLUMN}>' || source_identity_id || '>' || target_identity_id AS path, min(fact_ord) AS first_ord, (SELECT count(*) > 0 FROM h WHERE target_identity_id = '{TABLE}') AS fallback FROM r GROUP BY 1")
def _(spark, sf_dir):
    found = impact.affected_reports(pinned(spark, sf_dir), COLUMN)
    return found["paths"].select(F.array_join("ids", ">").alias("path"), "first_ord").crossJoin(found["fallback"])


_ENDS = "t AS MATERIALIZED (SELECT DISTINCT target_identity_id AS id FROM r), x AS (SELECT fact_ord FROM v SEMI JOIN t ON source_identity_id = t.id UNION SELECT fact_ord FROM v SEMI JOIN t ON target_identity_id = t.id)"


@query("affected_report_facts", f"WITH {VISIBLE}, {_HITS}, {_REPORTS}, {_ENDS} SELECT fact_ord, relation_type, source_identity_id, target_identity_id FROM v JOIN x USING (fact_ord)")
def _(spark, sf_dir):
    return impact.affected_reports(pinned(spark, sf_dir), COLUMN)["report_facts"].select("fact_ord", "relation_type", "source_identity_id", "target_identity_id")


@query("affected_columns", f"WITH {VISIBLE}, r AS (SELECT source_identity_id FROM v WHERE relation_type IN ({listed(registry.REPORT_EDGES)}) AND target_identity_id = '{REPORT}') SELECT '{REPORT}>' || source_identity_id || '>' || target_identity_id AS path, min(fact_ord) AS first_ord FROM v WHERE relation_type IN ({_DB}) AND source_identity_id IN (SELECT source_identity_id FROM r) GROUP BY 1")
def _(spark, sf_dir):
    return impact.affected_columns(visible(spark, sf_dir), REPORT)["paths"].select(F.array_join("ids", ">").alias("path"), "first_ord")


@query("report_tables", f"WITH {VISIBLE}, d AS (SELECT DISTINCT source_identity_id, CASE WHEN starts_with(target_identity_id, 'db-column://') THEN 'db-table://' || regexp_replace(substring(target_identity_id, 13), '#[^#]*$', '') ELSE target_identity_id END AS table_id FROM v WHERE relation_type IN ({_DB})) SELECT DISTINCT r.target_identity_id AS report_id, d.table_id FROM v r JOIN d USING (source_identity_id) WHERE r.relation_type IN ({listed(registry.REPORT_EDGES)})")
def _(spark, sf_dir):
    return impact.reports_by_table(visible(spark, sf_dir))


# --- diffs ---

CHANGED = [PARTS[0], ORDERS[0], ORDERS[1], method("Part42")]
_DIFF = f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), CHANGED, 2, 60, name='a')}, {search_text(edges_text(registry.DOWNSTREAM_EDGES, True), CHANGED, 3, 60, name='b')}, u AS (SELECT 'callers' AS side, * FROM a_r UNION ALL SELECT 'downstream', * FROM b_r)"


def diff(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Callers to depth 2 and downstream to depth 3."""
    f = pinned(spark, sf_dir)
    s = seeds(spark, CHANGED)
    a = traverse.find_callers(f, s, 2, 60).withColumn("side", F.lit("callers"))
    b = traverse.find_downstream(f, s, 3, 60).withColumn("side", F.lit("downstream"))
    return f, a.unionByName(b).join(s, "seed")


def analyze_diff_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all impact paths of a diff."""
    return diff(spark, sf_dir)[1].select("side", "seed", F.array_join("ids", ">").alias("path"), "depth", F.col("rank").cast("int").alias("rank"))


query("analyze_diff_paths", f"{_DIFF} SELECT side, seed, array_to_string(ids, '>') AS path, CAST(depth AS INTEGER) AS depth, CAST(rank AS INTEGER) AS rank FROM u")(analyze_diff_paths)


@query("analyze_diff_affected", f"{_DIFF} SELECT ids[-1] AS id, count(*) AS n_paths FROM u GROUP BY 1")
def _(spark, sf_dir):
    return diff(spark, sf_dir)[1].groupBy(F.element_at("ids", -1).alias("id")).agg(F.count("*").alias("n_paths"))


_DB_HITS = (
    f"hd AS (SELECT t.target, v.* FROM t JOIN v ON (starts_with(t.target, 'db-table://') AND v.relation_type IN ({_DB}) AND (v.target_identity_id = t.target OR starts_with(v.target_identity_id, replace(t.target, 'db-table://', 'db-column://') || '#'))) OR (starts_with(t.target, 'db-column://') AND v.relation_type IN ({listed(registry.COLUMN_EDGES)}) AND v.target_identity_id = t.target)),"
    " hb AS (SELECT s.target, count(*) AS n FROM (SELECT DISTINCT target, source_identity_id FROM hd WHERE starts_with(source_identity_id, 'sql-statement://')) s JOIN v ON v.relation_type = 'BINDS_TO' AND v.target_identity_id = s.source_identity_id GROUP BY 1)"
)
_DB_COUNTS = "SELECT t.target, count(*) FILTER (d.relation_type IN ('READS_TABLE', 'READS_COLUMN')) AS n_reads, count(*) FILTER (d.relation_type IN ('WRITES_TABLE', 'WRITES_COLUMN')) AS n_writes, CAST(coalesce(max(hb.n), 0) AS BIGINT) AS n_bindings FROM t LEFT JOIN hd d ON d.target = t.target LEFT JOIN hb ON hb.target = t.target GROUP BY 1"
_IS_DB = "(starts_with(id, 'db-table://') OR starts_with(id, 'db-column://'))"


@query("analyze_diff_db_counts", f"{_DIFF}, t AS (SELECT DISTINCT ids[-1] AS target FROM u WHERE {_IS_DB.replace('id,', 'ids[-1],')}), {_DB_HITS} {_DB_COUNTS}")
def _(spark, sf_dir):
    f, paths = diff(spark, sf_dir)
    ends = paths.select(F.element_at("ids", -1).alias("id")).where(ids.has_kind(F.col("id"), ("db-table", "db-column")))
    return impact.db_counts(f, ends)


def report_text(depth: int, limit: int) -> str:
    """CTEs u (paths in report order), ends (affected ids in it), i (database impacts) and cut (whether a search was)."""
    seeded = ", ".join(f"('{x}', {k})" for k, x in enumerate(CHANGED))
    both = " UNION ALL ".join(f"SELECT seed_ord, {k} AS side, rank, ids, depth, seed FROM {name}_r JOIN c USING (seed)" for k, name in enumerate("ab"))
    return (
        f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), CHANGED, depth, limit, name='a')}, {search_text(edges_text(registry.DOWNSTREAM_EDGES, True), CHANGED, depth, limit, name='b')},"
        f" c AS (SELECT * FROM (VALUES {seeded}) x(seed, seed_ord)), u AS (SELECT *, row_number() OVER (ORDER BY seed_ord, side, rank) AS place FROM ({both})),"
        f" ends AS (SELECT ids[-1] AS id, min(place) AS first FROM u GROUP BY 1), t AS (SELECT id AS target FROM ends WHERE {_IS_DB}), {_DB_HITS},"
        f" i AS (SELECT * FROM ({_DB_COUNTS}) JOIN ends ON target = id), cut AS (SELECT coalesce(bool_or(n >= {limit}), false) AS yes FROM (SELECT count(*) AS n FROM u GROUP BY seed, side))"
    )


_JSON = (
    "SELECT CAST(to_json({"
    f"'projectId': 'shop', 'snapshotId': '{SNAP}', 'changedSymbols': [{listed(CHANGED)}], 'affectedSymbols': (SELECT list(id ORDER BY first) FROM ends), 'paths': (SELECT list({{'identityIds': ids, 'depth': depth}} ORDER BY place) FROM u),"
    " 'pathDetails': (SELECT list({'identityIds': ids, 'risk': 'MEDIUM', 'confidence': 'LIKELY', 'sourceType': 'IMPACT_FLOW', 'evidenceKeys': CAST([] AS VARCHAR[])} ORDER BY place) FROM u),"
    " 'dbImpacts': (SELECT coalesce(list({'targetIdentityId': target, 'readCount': n_reads, 'writeCount': n_writes, 'upstreamBindingCount': n_bindings} ORDER BY first), []) FROM i), 'suggestedTests': CAST([] AS VARCHAR[]), 'aiEnabled': false, 'truncated': (SELECT yes FROM cut)}) AS VARCHAR) AS json"
)


@query("analyze_diff_json", f"{report_text(3, 60)} {_JSON}")
def _(spark, sf_dir):
    return impact.report_json(impact.analyze_diff(pinned(spark, sf_dir), "shop", SNAP, CHANGED, 3, 60))


_TICKED = lambda what, rows: f"coalesce((SELECT string_agg('- `' || {what} || '`' || chr(10), '' ORDER BY first) FROM {rows}), '- None' || chr(10))"
_MARKDOWN = (
    f"SELECT '# Fast Impact Report' || chr(10) || chr(10) || '- Project: `shop`' || chr(10) || '- Snapshot: `{SNAP}`' || chr(10) || '- AI Enabled: `false`' || chr(10) || '- Truncated: `' || (SELECT yes FROM cut) || '`' || chr(10)"
    " || chr(10) || '## Changed Symbols' || chr(10) || chr(10) || " + " || ".join(f"'- `{x}`' || chr(10)" for x in CHANGED) + f" || chr(10) || '## Affected Symbols' || chr(10) || chr(10) || {_TICKED('id', 'ends')}"
    " || chr(10) || '## Impact Paths' || chr(10) || chr(10) || (SELECT string_agg('- `' || array_to_string(ids, '` -> `') || '`' || chr(10), '' ORDER BY place) FROM u)"
    " || chr(10) || '## Path Evidence' || chr(10) || chr(10) || (SELECT repeat('- Risk `MEDIUM`, confidence `LIKELY`, source `IMPACT_FLOW`, evidence []' || chr(10), CAST(count(*) AS INTEGER)) FROM u)"
    " || chr(10) || '## DB Impacts' || chr(10) || chr(10) || coalesce((SELECT string_agg('- `' || target || '`: ' || n_reads || ' read, ' || n_writes || ' write, ' || n_bindings || ' upstream bindings' || chr(10), '' ORDER BY first) FROM i), '- None' || chr(10))"
    " || chr(10) || '## Suggested Tests' || chr(10) || chr(10) || '- None' || chr(10) AS markdown"
)


@query("analyze_diff_markdown", f"{report_text(2, 20)} {_MARKDOWN}")
def _(spark, sf_dir):
    report = impact.analyze_diff(pinned(spark, sf_dir), "shop", SNAP, CHANGED, 2, 20)
    return spark.createDataFrame([(impact.report_markdown(report),)], "markdown string")


@query(
    "architecture_violations",
    f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.DOWNSTREAM_EDGES, True), ORDERS, 2, 80)}, r AS (SELECT 'order-part' AS rule, 'ERROR' AS severity, ids FROM p_r WHERE len(ids) = 2 AND contains(ids[1], 'Order') AND contains(ids[-1], 'Part') UNION ALL SELECT 'deep', 'WARNING', ids FROM p_r WHERE len(ids) > 2) SELECT rule, count(*) AS n_violations, bool_or(severity = 'ERROR') AS has_errors FROM r GROUP BY 1",
)
def _(spark, sf_dir):
    paths = traverse.find_downstream(visible(spark, sf_dir), seeds(spark, ORDERS), 2, 80)
    rules = {"order-part": ("ERROR", lambda p: impact.layer_violation(p, "Order", "Part")), "deep": ("WARNING", lambda p: F.size(p) > 2), "never": ("ERROR", lambda p: impact.layer_violation(p, "Part", "Order"))}
    return impact.violation_summary(impact.check_rules(paths, rules))


@query(
    "test_priority",
    f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), PARTS, 2, 60)}, n AS (SELECT unnest(ids) AS id FROM p_r), f AS (SELECT target_identity_id AS id, count(*) AS risk FROM v WHERE relation_type = 'CALLS' GROUP BY 1), g AS (SELECT source_identity_id AS id, count(*) AS n FROM v WHERE relation_type = 'CALLS' GROUP BY 1)"
    " SELECT t.test_ord, t.test, CAST(s.score AS BIGINT) AS score FROM (VALUES (0, 'OrderTest'), (1, 'PartTest')) t(test_ord, test), (SELECT sum(coalesce(risk, 0) + coalesce(g.n, 0)) AS score FROM n LEFT JOIN f USING (id) LEFT JOIN g USING (id)) s",
)
def _(spark, sf_dir):
    f = visible(spark, sf_dir)
    calls = f.where("relation_type = 'CALLS'")
    paths = traverse.find_callers(f, seeds(spark, PARTS), 2, 60)
    tests = spark.createDataFrame([(0, "OrderTest"), (1, "PartTest")], "test_ord int, test string")
    risk = calls.groupBy(F.col("target_identity_id").alias("id")).agg(F.count("*").alias("risk"))
    changes = calls.groupBy(F.col("source_identity_id").alias("id")).agg(F.count("*").alias("n"))
    return impact.test_scores(tests, paths, risk, changes)


@query(
    "evaluate_precision_recall",
    f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), PARTS, 2, 60)}, rep AS (SELECT array_to_string(ids, '|') || '|' AS k FROM p_r), lab AS (SELECT DISTINCT target_identity_id || '|' || source_identity_id || '|' AS k FROM v WHERE relation_type = 'CALLS' AND target_identity_id IN ({listed(PARTS)}) AND fact_ord % 2 = 0),"
    " a AS (SELECT count(*) AS n_reported, count(lab.k) AS true_positives FROM rep LEFT JOIN lab USING (k)), b AS (SELECT count(*) AS n_labels, count(*) FILTER (k NOT IN (SELECT k FROM rep)) AS false_negatives FROM lab)"
    " SELECT n_reported, true_positives, n_reported - true_positives AS false_positives, false_negatives, CASE WHEN n_reported = 0 THEN 0.0 ELSE true_positives / n_reported END AS precision, CASE WHEN n_labels = 0 THEN 1.0 ELSE (n_labels - false_negatives) / n_labels END AS recall FROM a, b",
)
def _(spark, sf_dir):
    f = visible(spark, sf_dir)
    labels = f.where((F.col("relation_type") == "CALLS") & F.col("target_identity_id").isin(*PARTS) & (F.col("fact_ord") % 2 == 0))
    return impact.evaluate(traverse.find_callers(f, seeds(spark, PARTS), 2, 60), labels.select(F.array("target_identity_id", "source_identity_id").alias("ids")))


_RANK = "CASE confidence WHEN 'CERTAIN' THEN 0 WHEN 'LIKELY' THEN 1 WHEN 'POSSIBLE' THEN 2 ELSE 3 END"


@query("confidence_aggregate", f"WITH {VISIBLE} SELECT target_identity_id, arg_min(confidence, {_RANK}) AS confidence, count(*) AS n FROM v GROUP BY 1")
def _(spark, sf_dir):
    return visible(spark, sf_dir).groupBy("target_identity_id").agg(impact.best_confidence(F.col("confidence")).alias("confidence"), F.count("*").alias("n"))


@query("path_weakest_confidence", f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), PARTS, 2, 60)}, s AS (SELECT seed, rank, unnest(ords) AS fact_ord FROM p_r) SELECT seed, CAST(rank AS INTEGER) AS rank, arg_max(confidence, {_RANK}) AS confidence FROM s JOIN v USING (fact_ord) GROUP BY 1, 2")
def _(spark, sf_dir):
    f = visible(spark, sf_dir)
    return impact.weakest_edge(traverse.find_callers(f, seeds(spark, PARTS), 2, 60), f).withColumn("rank", F.col("rank").cast("int"))


# --- store mutations ---

#: a batch: every third BINDS_TO fact again, with another confidence, and some facts that are new
_BATCH = f"b AS (SELECT * REPLACE ('POSSIBLE' AS confidence) FROM facts WHERE relation_type = 'BINDS_TO' AND snapshot_id = '{SNAP}' AND fact_ord % 3 = 0 UNION ALL SELECT * REPLACE ('extra' AS qualifier) FROM facts WHERE relation_type = 'BINDS_TO' AND snapshot_id = '{SNAP}' AND fact_ord % 7 = 0)"
_LAST = "(SELECT max(fact_ord) + 1 FROM facts)"
_ROW = f"fact_ord, {KEY} AS fact_key, confidence, active, tombstone"


def batch(f: DataFrame) -> DataFrame:
    binds = f.where(f"relation_type = 'BINDS_TO' and snapshot_id = '{SNAP}'")
    again = binds.where("fact_ord % 3 = 0").withColumn("confidence", F.lit("POSSIBLE"))
    new = binds.where("fact_ord % 7 = 0").withColumn("qualifier", F.lit("extra"))
    new = new.withColumn("fact_key", ids.fact_key(*map(F.col, ("source_identity_id", "target_identity_id", "relation_type", "qualifier"))))
    return again.unionByName(new.select(*again.columns))


_COLS = ["fact_ord", "fact_key", "confidence", "active", "tombstone"]


@query("append_facts", f"WITH {FACTS}, {_BATCH} SELECT count(*) AS n, count(DISTINCT fact_ord) AS n_ords, max(fact_ord) AS last_ord FROM (SELECT fact_ord FROM facts UNION ALL SELECT fact_ord + {_LAST} FROM b)")
def _(spark, sf_dir):
    f = stored(spark, sf_dir)
    return store.append(f, batch(f)).agg(F.count("*").alias("n"), F.countDistinct("fact_ord").alias("n_ords"), F.max("fact_ord").alias("last_ord"))


@query("upsert_facts", f"WITH {FACTS}, {_BATCH}, k AS (SELECT DISTINCT {KEY} AS k, snapshot_id, analyzer_id FROM b) SELECT {_ROW} FROM facts f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.k = {KEY} AND k.snapshot_id = f.snapshot_id AND k.analyzer_id = f.analyzer_id) UNION ALL SELECT fact_ord + {_LAST}, {KEY}, confidence, active, tombstone FROM b")
def _(spark, sf_dir):
    f = stored(spark, sf_dir)
    return store.upsert(f, batch(f)).select(*_COLS)


_MINE = f"(snapshot_id = '{SNAP}' AND analyzer_id = 'mybatis')"
#: rows of another analyzer, with keys that the owner holds, and again rows that this analyzer holds
_FOREIGN = f"o AS (SELECT * FROM facts UNION ALL SELECT * REPLACE (fact_ord + 1000 AS fact_ord, 'other' AS analyzer_id) FROM facts WHERE relation_type = 'BINDS_TO' AND snapshot_id = '{SNAP}' AND fact_ord % 5 < 2), c AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('other' AS analyzer_id) FROM facts WHERE relation_type = 'BINDS_TO' AND snapshot_id = '{SNAP}' AND fact_ord % 5 = 0)"


@query(
    "replace_scope_facts",
    f"WITH {FACTS}, {_BATCH}, {_FOREIGN}, k AS (SELECT {KEY} AS k, snapshot_id, analyzer_id FROM c), m AS (SELECT *, {KEY} AS key, {KEY} IN (SELECT k FROM k) AS again FROM o)"
    f" SELECT fact_ord, key AS fact_key, analyzer_id, confidence, active, tombstone OR ({_MINE} AND NOT again) AS tombstone FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.k = m.key AND k.snapshot_id = m.snapshot_id AND k.analyzer_id = m.analyzer_id)"
    f" UNION ALL SELECT fact_ord + (SELECT max(fact_ord) + 1 FROM o), {KEY}, analyzer_id, confidence, active, tombstone FROM c",
)
def _(spark, sf_dir):
    f = stored(spark, sf_dir)
    foreign = f.where(f"relation_type = 'BINDS_TO' and snapshot_id = '{SNAP}'").withColumn("analyzer_id", F.lit("other"))
    old = f.unionByName(foreign.where("fact_ord % 5 < 2").withColumn("fact_ord", F.col("fact_ord") + 1000))
    new = batch(f).unionByName(foreign.where("fact_ord % 5 = 0"))
    owner = {"project_id": "shop", "snapshot_id": SNAP, "analyzer_id": "mybatis", "scope_key": "src/main/java"}
    return store.replace_scope(old, new, owner).select(*_COLS, "analyzer_id")


@query("purge_tombstones", f"WITH {FACTS} SELECT snapshot_id, count(*) AS n FROM facts WHERE NOT (snapshot_id = '{SNAP}' AND tombstone) GROUP BY 1")
def _(spark, sf_dir):
    return store.purge_tombstones(stored(spark, sf_dir), "shop", SNAP).groupBy("snapshot_id").agg(F.count("*").alias("n"))


@query("delete_project", f"WITH {FACTS} SELECT fact_ord FROM facts WHERE fact_ord % 5 = 0")
def _(spark, sf_dir):
    f = stored(spark, sf_dir).withColumn("project_id", F.when(F.col("fact_ord") % 5 == 0, "other").otherwise(F.col("project_id")))
    return store.delete_project(f, "shop").select("fact_ord")


_FACT = "source_identity_id, target_identity_id, relation_type, qualifier"


@query(
    "snapshot_diff",
    f"WITH {FACTS}, s AS (SELECT {_FACT}, min(CASE WHEN snapshot_id = '{SNAP}' THEN confidence END) AS a, min(CASE WHEN snapshot_id = '{OTHER}' THEN confidence END) AS b FROM facts WHERE {ACTIVE} GROUP BY ALL)"
    f" SELECT {KEY} AS fact_key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change FROM s WHERE (a IS NOT NULL OR b IS NOT NULL) AND a IS DISTINCT FROM b",
)
def _(spark, sf_dir):
    return store.snapshot_diff(stored(spark, sf_dir), "shop", SNAP, OTHER)


@query("interval_visibility", f"WITH {FACTS}, s AS (SELECT *, CASE WHEN snapshot_id = '{SNAP}' THEN 1 ELSE 2 END AS since, CASE fact_ord % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS until FROM facts WHERE {ACTIVE}) SELECT snapshot_id, relation_type, count(*) AS n FROM s WHERE since <= 2 AND (until IS NULL OR until > 2) GROUP BY 1, 2")
def _(spark, sf_dir):
    """A third of the facts ends with the second snapshot, a third with the next."""
    order = spark.createDataFrame([(SNAP, 1), (OTHER, 2), ("snap-3", 3)], "snapshot_id string, snapshot_ord int")
    until = F.when(F.col("fact_ord") % 3 == 0, OTHER).when(F.col("fact_ord") % 3 == 1, "snap-3").otherwise("")
    seen = store.interval_visible(stored(spark, sf_dir).withColumn("valid_to_snapshot", until), order, "shop", OTHER)
    return seen.groupBy("snapshot_id", "relation_type").agg(F.count("*").alias("n"))


@query("store_recommendation", f"WITH {FACTS} SELECT project_id, count(*) AS n, CASE WHEN count(*) >= 5000000 THEN 'REJECT' WHEN count(*) >= 500000 THEN 'SWITCH_RECOMMENDED' ELSE 'OK' END AS advice FROM facts WHERE {ACTIVE} GROUP BY 1")
def _(spark, sf_dir):
    n = stored(spark, sf_dir).where(store.visible()).groupBy("project_id").agg(F.count("*").alias("n"))
    return n.withColumn("advice", store.size_advice(F.col("n")))


@query("rebuild_notice", f"WITH {FACTS}, {_BATCH} SELECT project_id, snapshot_id, 'DATA' AS families, count(*) FILTER (active AND NOT tombstone) AS n_active FROM b GROUP BY 1, 2")
def _(spark, sf_dir):
    return store.distinct_families(batch(stored(spark, sf_dir))).withColumn("families", F.array_join("families", ","))


# --- health ---

_FAN = "e AS (SELECT source_identity_id AS id, 0 AS i, 1 AS o FROM v WHERE relation_type IN ('CALLS', 'INVOKES') UNION ALL SELECT target_identity_id, 1, 0 FROM v WHERE relation_type IN ('CALLS', 'INVOKES')), f AS (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM e GROUP BY 1)"


@query("fan_in_out", f"WITH {VISIBLE}, {_FAN} SELECT * FROM f")
def _(spark, sf_dir):
    return impact.fan(visible(spark, sf_dir))


@query("hotspots", f"WITH {VISIBLE}, {_FAN} SELECT *, fan_in * fan_out AS score FROM f ORDER BY score DESC, id LIMIT 25")
def _(spark, sf_dir):
    return impact.hotspots(visible(spark, sf_dir), 25)


@query("two_cycles", f"WITH {VISIBLE}, e AS (SELECT DISTINCT source_identity_id AS a, target_identity_id AS b FROM v WHERE relation_type IN ('CALLS', 'INVOKES')) SELECT x.a, x.b FROM e x JOIN e y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def _(spark, sf_dir):
    return impact.two_cycles(visible(spark, sf_dir))


@query("orphan_entrypoints", f"WITH {VISIBLE} SELECT DISTINCT target_identity_id AS id FROM v WHERE relation_type = 'ROUTES_TO' AND target_identity_id NOT IN (SELECT source_identity_id FROM v WHERE relation_type IN ('CALLS', 'INVOKES'))")
def _(spark, sf_dir):
    return impact.orphan_entrypoints(visible(spark, sf_dir))


# --- registries ---


def _rows(items) -> str:
    return ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in items)


@query("registry_relations", f"SELECT * FROM (VALUES {_rows((r.rstrip('*'), f, not r.endswith('*')) for f, rs in registry.RELATIONS.items() for r in rs.split())}) t(name, family, mvp)")
def _(spark, sf_dir):
    return registry.relations(spark)


@query("registry_symbol_kinds", f"SELECT * FROM (VALUES {_rows((k, t, t == 'FLOW_ID' or k in registry.FRAGMENT_KINDS, registry.FLOW_SUFFIX.get(k, '')) for k, t in registry.IDENTITY_TYPE.items())}) t(kind, identity_type, allows_fragment, flow_suffix)")
def _(spark, sf_dir):
    return registry.symbol_kinds(spark)


@query("registry_node_types", f"SELECT * FROM (VALUES {_rows((registry.label(k), k, t, registry.IDENTITY_PROPERTY[t], registry.layer(k), t != 'ARTIFACT_ID') for k, t in registry.IDENTITY_TYPE.items())}) t(label, kind, identity_type, identity_property, layer, default_query_fact)")
def _(spark, sf_dir):
    return registry.node_types(spark)


@query(
    "graph_ddl",
    f"WITH t AS (SELECT * FROM (VALUES {_rows((registry.label(k), registry.IDENTITY_PROPERTY[t]) for k, t in registry.IDENTITY_TYPE.items())}) t(label, p)), s AS (SELECT label, p, lower(ltrim(regexp_replace(label, '([A-Z])', '_\\1', 'g'), '_')) AS l, lower(regexp_replace(p, '([A-Z])', '_\\1', 'g')) AS q FROM t)"
    f" SELECT 'CREATE CONSTRAINT {sinks.PREFIX}_' || l || '_' || q || '_snapshot_id IF NOT EXISTS FOR (n:' || label || ') REQUIRE (n.' || p || ', n.snapshotId) IS UNIQUE' AS statement FROM s UNION ALL SELECT * FROM (VALUES {_rows((x,) for x in sinks.index_statements())}) i(statement)",
)
def _(spark, sf_dir):
    return sinks.graph_ddl(spark)


@query("path_priority", f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.DOWNSTREAM_EDGES, True), ORDERS, 4, 120)} SELECT seed, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN starts_with(ids[-1], 'db-') THEN 20 WHEN starts_with(ids[-1], 'sql-statement://') THEN 10 ELSE 0 END + 20 - depth AS INTEGER) AS priority FROM p_r")
def _(spark, sf_dir):
    p = traverse.find_downstream(visible(spark, sf_dir), seeds(spark, ORDERS), 4, 120)
    return p.select("seed", F.col("rank").cast("int").alias("rank"), impact.path_priority(F.col("depth"), F.lit("LIKELY"), F.element_at("ids", -1)).alias("priority"))


@query("node_limit", f"WITH RECURSIVE {VISIBLE}, {search_text(edges_text(registry.CALL_EDGES, False), PARTS, 3, 60)}, n AS (SELECT seed, id, min(rank) AS rank FROM (SELECT seed, rank, unnest(ids) AS id FROM p_r) GROUP BY 1, 2), c AS (SELECT p.seed, p.rank, (SELECT count(*) FROM n WHERE n.seed = p.seed AND n.rank <= p.rank) AS nodes FROM p_r p) SELECT seed, CAST(rank AS INTEGER) AS rank FROM c WHERE nodes <= 12")
def _(spark, sf_dir):
    p = traverse.find_callers(visible(spark, sf_dir), seeds(spark, PARTS), 3, 60)
    return impact.limited(p, 12).select("seed", F.col("rank").cast("int").alias("rank"))
