"""Queries over rows of code: statements, bindings, hunks, symbols, files, tasks, runs and candidates.

The star schema has no code, so rows are derived from its tables by rules that SQL states too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions import builders, ids
from ripplegraph.operators import analyzers, govern, impact, joins, mappers, retrieve, sqlscan, workspace
from ripplegraph.plans.registered import query
from ripplegraph.streaming import runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL ---

_TYPE = "lower(p_type)"


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("p_type")
    sql = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("SELECT a.name, a.size FROM "), t, F.lit(" a LEFT JOIN stock s ON s.part = a.id WHERE a.brand = #{b}")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("INSERT INTO "), t, F.lit(" (name, size) VALUES (?, ?)")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("UPDATE "), t, F.lit(" SET name = ?, size = ? WHERE brand = ?")))
        .otherwise(F.concat(F.lit("DELETE FROM "), t, F.lit(" WHERE brand IN (SELECT brand FROM gone)")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("stmt"), F.col("p_partkey").cast("string")).alias("statement"), sql.alias("sql"))


_TABLE_ROWS = (
    f"SELECT p_partkey, {_TYPE} AS table_name, CASE WHEN p_partkey % 4 = 0 THEN 'READ' ELSE 'WRITE' END AS access FROM part"
    " UNION ALL SELECT p_partkey, 'stock', 'READ' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'gone', 'READ' FROM part WHERE p_partkey % 4 = 3"
)


@query("sql_table_access", f"SELECT 'stmt' || p_partkey AS statement, table_name, access, false AS fallback FROM ({_TABLE_ROWS})")
def _(spark, sf_dir):
    return sqlscan.accesses(statements(spark, sf_dir)).where("column_name is null").select("statement", "table_name", "access", "fallback")


_COLUMN_ROWS = (
    f"SELECT p_partkey, {_TYPE} AS table_name, unnest(['name', 'size', 'id', 'brand']) AS column_name, 'READ' AS access FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 'stock', 'part', 'READ' FROM part WHERE p_partkey % 4 = 0"
    f" UNION ALL SELECT p_partkey, {_TYPE}, unnest(['name', 'size']), 'WRITE' FROM part WHERE p_partkey % 4 IN (1, 2) UNION ALL SELECT p_partkey, {_TYPE}, 'brand', 'READ' FROM part WHERE p_partkey % 4 = 2"
)


@query("sql_column_access", f"SELECT 'stmt' || p_partkey AS statement, table_name, column_name, access FROM ({_COLUMN_ROWS})")
def _(spark, sf_dir):
    return sqlscan.accesses(statements(spark, sf_dir)).where("column_name is not null").select("statement", "table_name", "column_name", "access")


@query(
    "sql_normalized",
    f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'SELECT a.name, a.size FROM ' || {_TYPE} || ' a LEFT JOIN stock s ON s.part = a.id WHERE a.brand = ?' WHEN 1 THEN 'INSERT INTO ' || {_TYPE} || ' (name, size) VALUES (?, ?)' WHEN 2 THEN 'UPDATE ' || {_TYPE} || ' SET name = ?, size = ? WHERE brand = ?' ELSE 'DELETE FROM ' || {_TYPE} || ' WHERE brand IN (SELECT brand FROM gone)' END AS sql FROM part",
)
def _(spark, sf_dir):
    return statements(spark, sf_dir).select("p_partkey", sqlscan.normalized(F.col("sql")).alias("sql"))


@query("sql_facts", f"SELECT CASE access WHEN 'READ' THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END AS relation_type, 'db-table://shop/mainDs/public/' || table_name AS target_identity_id, count(*) AS n FROM ({_TABLE_ROWS}) GROUP BY 1, 2 UNION ALL SELECT CASE access WHEN 'READ' THEN 'READS_COLUMN' ELSE 'WRITES_COLUMN' END, 'db-column://shop/mainDs/public/' || table_name || '#' || column_name, count(*) FROM ({_COLUMN_ROWS}) GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = sqlscan.accesses(statements(spark, sf_dir))
    rows = rows.withColumn("statement", F.concat(F.lit("sql-statement://shop/_root/src/main/resources/Part.xml#"), "statement"))
    return mappers.sql_accesses(rows, mappers.Context()).groupBy("relation_type", "target_identity_id").agg(F.count("*").alias("n"))


# --- joins ---


@query("mapper_bindings", "WITH m AS (SELECT p_brand AS owner, 'find' || (p_size % 30) AS method, count(*) AS n, min(p_partkey) AS id FROM part GROUP BY 1, 2) SELECT p.p_partkey, m.id AS method_id FROM part p JOIN m ON m.n = 1 AND p.p_brand = m.owner AND 'find' || (p.p_size % 30) = m.method")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("find"), (F.col("p_size") % 30).cast("string"))
    methods = p.select(F.col("p_brand").alias("owner"), name.alias("method"), F.col("p_partkey").alias("method_id"))
    return joins.mapper_bindings(p.select("p_partkey", F.col("p_brand").alias("namespace"), name.alias("statement_id")), methods).select("p_partkey", "method_id")


_SYMBOLS = "s AS (SELECT 'src/F' || (p_partkey % 50) || '.java' AS path, p_partkey AS id, p_size * 10 AS start_line, p_size * 10 + p_partkey % 15 AS end_line FROM part), h AS (SELECT 'src/F' || (s_suppkey % 40) || '.java' AS path, s_suppkey % 100 * 5 AS start, s_suppkey % 7 AS cnt FROM supplier)"


def symbols_and_hunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    file = lambda c, n: F.concat(F.lit("src/F"), (F.col(c) % n).cast("string"), F.lit(".java"))
    a = p.select(file("p_partkey", 50).alias("path"), F.col("p_partkey").alias("id"), (F.col("p_size") * 10).alias("start_line"), (F.col("p_size") * 10 + F.col("p_partkey") % 15).alias("end_line"))
    return a, s.select(file("s_suppkey", 40).alias("path"), (F.col("s_suppkey") % 100 * 5).alias("start"), (F.col("s_suppkey") % 7).alias("count"))


@query("hunk_overlap", f"WITH {_SYMBOLS} SELECT DISTINCT s.path, s.id FROM s JOIN h ON s.path = h.path AND start_line <= start + greatest(cnt, 1) - 1 AND greatest(start_line, end_line) >= start")
def _(spark, sf_dir):
    return joins.hunk_symbols(*symbols_and_hunks(spark, sf_dir)).select("path", "id")


@query("changed_symbols", f"WITH {_SYMBOLS}, x AS (SELECT DISTINCT s.path, s.id FROM s JOIN h ON s.path = h.path AND start_line <= start + greatest(cnt, 1) - 1 AND greatest(start_line, end_line) >= start) SELECT id, path, 'changed' AS origin FROM x WHERE path NOT IN ('src/F45.java', 'src/F3.java') UNION ALL SELECT id, path, CASE path WHEN 'src/F3.java' THEN 'deleted' ELSE 'changed' END FROM s WHERE path IN ('src/F45.java', 'src/F3.java')")
def _(spark, sf_dir):
    symbols, hunks = symbols_and_hunks(spark, sf_dir)
    diff = spark.createDataFrame([("src/F45.java", "MODIFY"), ("src/F3.java", "DELETE"), ("src/F1.java", "MODIFY")], "path string, change_type string")
    return workspace.changed_symbols(diff, symbols, hunks)


@query("origin_merge", "SELECT 'class' AS kind, coalesce(a.k, b.k) AS key, a.k IS NOT NULL AS from_source, b.k IS NOT NULL AS from_bytecode FROM (SELECT DISTINCT p_name AS k FROM part WHERE p_size < 20) a FULL JOIN (SELECT DISTINCT p_name AS k FROM part WHERE p_size % 2 = 0) b ON a.k = b.k")
def _(spark, sf_dir):
    side = lambda where: table(spark, sf_dir, "part").where(where).select(F.lit("class").alias("kind"), F.col("p_name").alias("key"))
    return joins.origin_merge(side("p_size < 20"), side("p_size % 2 = 0"))


@query("resolve_calls", "WITH m AS (SELECT p_brand AS o, p_type AS t, arg_min('(I' || p_partkey || ')V', p_partkey) AS d FROM part GROUP BY 1, 2) SELECT s_suppkey AS call_id, d AS target_descriptor FROM supplier LEFT JOIN m ON o = 'Brand#' || (s_suppkey % 30) AND t = 'SMALL'")
def _(spark, sf_dir):
    methods = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_type").alias("method"), F.concat(F.lit("(I"), F.col("p_partkey").cast("string"), F.lit(")V")).alias("descriptor"), F.col("p_partkey").alias("ord"))
    calls = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("call_id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("target_owner"), F.lit("SMALL").alias("target_method"), F.lit("").alias("signature"))
    return joins.resolve_calls(calls, methods).select("call_id", "target_descriptor")


# --- files ---

_EXT = "['.java', '.jar', '.xml', '.sh', '.c', '.md', '.zzz', '.JSP', '.cbl', '.html']"
_FILES = f"f AS (SELECT p_partkey, 'm' || (p_partkey % 7) || CASE p_partkey % 3 WHEN 0 THEN '/src/main/java/a/' WHEN 1 THEN '/lib/' ELSE '/WebRoot/x/' END || CASE WHEN p_partkey % 41 = 0 THEN 'pom.xml' ELSE 'f' || p_partkey || {_EXT}[p_partkey % 10 + 1] END AS path, p_size * 1000000 AS size FROM part)"
_LEVEL = "CASE WHEN e IN ('.jar', '.class') THEN 'L1_STRUCTURED' WHEN size > 20971520 THEN 'L5_SKIPPED' WHEN ends_with(path, '/pom.xml') THEN 'L2_SEMI_STRUCTURED' WHEN e IN ('.c', '.cbl') THEN 'L3_BOUNDARY' WHEN e IN ('.java', '.xml', '.jsp') THEN 'L1_STRUCTURED' WHEN e = '.sh' THEN 'L2_SEMI_STRUCTURED' WHEN e IN ('.md', '.html') THEN 'L4_INVENTORY' ELSE 'L5_SKIPPED' END"
_E = f"{_FILES}, e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS e FROM f), l AS (SELECT *, {_LEVEL} AS level FROM e)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, [".java", ".jar", ".xml", ".sh", ".c", ".md", ".zzz", ".JSP", ".cbl", ".html"])), (k % 10 + 1).cast("int"))
    folder = F.when(k % 3 == 0, "/src/main/java/a/").when(k % 3 == 1, "/lib/").otherwise("/WebRoot/x/")
    name = F.when(k % 41 == 0, F.lit("pom.xml")).otherwise(F.concat(F.lit("f"), k.cast("string"), ext))
    f = table(spark, sf_dir, "part").select(k, F.concat(F.lit("m"), (k % 7).cast("string"), folder, name).alias("path"), (F.col("p_size") * 1000000).cast("long").alias("size"))
    f = f.withColumn("level", workspace.capability(F.col("path"), F.col("size"))).withColumn("content", F.lit("x"))
    return f.withColumn("diagnostic", workspace.diagnostic(F.col("path"), F.col("size"), F.col("level"), F.encode(F.lit("x"), "utf-8")))


@query("file_capability", f"WITH {_E} SELECT p_partkey, path, level FROM l")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("p_partkey", "path", "level")


@query("file_diagnostics", f"WITH {_E} SELECT CASE WHEN level = 'L5_SKIPPED' AND size > 20971520 THEN 'FILE_TOO_LARGE' WHEN level = 'L5_SKIPPED' THEN 'UNSUPPORTED_FILE_TYPE' WHEN e = '.jar' THEN 'BINARY' ELSE 'TEXT' END AS diagnostic, count(*) AS n FROM l GROUP BY 1")
def _(spark, sf_dir):
    return files(spark, sf_dir).groupBy("diagnostic").agg(F.count("*").alias("n"))


@query("project_roots", f"WITH {_E} SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND e <> '.jar' THEN 'm' || (p_partkey % 7) || '/lib' WHEN p_partkey % 3 = 2 AND e = '.jar' THEN 'm' || (p_partkey % 7) ELSE 'm' || (p_partkey % 7) END AS root FROM l")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("p_partkey", workspace.project_root(F.col("path")).alias("root"))


@query("workspace_overview", f"WITH {_FILES} SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes FROM f")
def _(spark, sf_dir):
    return workspace.overview(files(spark, sf_dir))


@query("capability_coverage", f"WITH {_E} SELECT DISTINCT CASE WHEN level = 'L5_SKIPPED' THEN 'UNSUPPORTED' WHEN ends_with(path, '/pom.xml') THEN 'BUILD_SYSTEM' WHEN e = '.java' THEN 'JAVA_SOURCE' WHEN e = '.jar' THEN 'JAVA_BYTECODE' WHEN e = '.jsp' THEN 'JSP_WEB' WHEN e = '.html' THEN 'HTML_JS' WHEN e = '.sh' THEN 'SHELL' WHEN e = '.c' THEN 'C_NATIVE' WHEN e = '.cbl' THEN 'COBOL' END AS area FROM l WHERE level = 'L5_SKIPPED' OR ends_with(path, '/pom.xml') OR e NOT IN ('.xml', '.md')")
def _(spark, sf_dir):
    return workspace.coverage(files(spark, sf_dir))


@query("boundary_diagnostics", f"WITH {_E} SELECT path, CASE WHEN level = 'L5_SKIPPED' THEN 'UNSUPPORTED' WHEN e = '.c' THEN 'C_BOUNDARY' ELSE 'COBOL_BOUNDARY' END AS boundary FROM l WHERE level = 'L5_SKIPPED' OR e IN ('.c', '.cbl')")
def _(spark, sf_dir):
    return workspace.boundaries(files(spark, sf_dir)).select("path", "boundary")


_REVIEW = (
    f"{_E}, w AS (SELECT *, ends_with(path, '/pom.xml') AS pom, 'm' || (p_partkey % 7) || CASE WHEN p_partkey % 3 = 1 AND e <> '.jar' THEN '/lib' ELSE '' END AS root FROM l),"
    " lay AS (SELECT root, bool_or(pom) AS maven, bool_or(contains(path, '/src/main/java/')) AS src, bool_or(contains(path, '/WebRoot/')) AS web, bool_or(e = '.jar') AS code FROM w WHERE level <> 'L5_SKIPPED' AND (e = '.jar' OR pom OR level = 'L3_BOUNDARY' OR p_partkey % 3 <> 1) GROUP BY 1),"
    " own AS (SELECT w.*, coalesce(i.root, o.root) AS holder FROM w LEFT JOIN lay i ON p_partkey % 3 = 1 AND i.root = 'm' || (p_partkey % 7) || '/lib' LEFT JOIN lay o ON o.root = 'm' || (p_partkey % 7)),"
    " n AS (SELECT holder AS root, count(*) FILTER (pom OR (e = '.jsp' AND level <> 'L5_SKIPPED')) AS n_clues, count(*) FILTER (e = '.jsp' AND level <> 'L5_SKIPPED') AS pages, count(*) FILTER (e IN ('.c', '.cbl') AND level <> 'L5_SKIPPED') AS n_boundaries FROM own GROUP BY 1),"
    " status AS (SELECT root, CASE WHEN maven THEN 'MAVEN' WHEN src THEN 'SOURCE_ONLY' ELSE 'UNKNOWN_LEGACY' END AS layout_type, CASE WHEN src OR code THEN 'READY' WHEN web OR pages > 0 OR maven OR n_clues > 0 THEN 'PARTIAL' WHEN n_boundaries > 0 THEN 'BOUNDARY_ONLY' ELSE 'UNKNOWN' END AS status, n_clues, n_boundaries, CASE WHEN src THEN root || '/src/main/java' ELSE '' END AS source_roots, CASE WHEN web THEN root || '/WebRoot' ELSE '' END AS web_roots FROM lay JOIN n USING (root))"
)


@query("project_status", f"WITH {_REVIEW} SELECT * FROM status")
def _(spark, sf_dir):
    return workspace.review(files(spark, sf_dir)).select("root", "layout_type", "status", "n_clues", "n_boundaries", F.array_join("source_roots", ",").alias("source_roots"), F.array_join("web_roots", ",").alias("web_roots"))


@query(
    "scope_decisions",
    f"WITH {_REVIEW} SELECT root, CASE WHEN root = 'm1' THEN 'EXCLUDED' WHEN root = 'm2' THEN 'SHARED_LIBRARY' WHEN status = 'READY' THEN 'INCLUDED' WHEN status IN ('BOUNDARY_ONLY', 'UNKNOWN') THEN 'UNANALYZABLE' ELSE 'DEGRADED' END AS disposition, CASE WHEN root = 'm1' THEN 'user excluded project' WHEN root = 'm2' THEN 'project marked as shared library' WHEN status = 'READY' THEN 'project selected for analysis' ELSE status END AS reason FROM status UNION ALL SELECT 'elsewhere', 'SHARED_LIBRARY', 'external shared library'",
)
def _(spark, sf_dir):
    return workspace.decide_scopes(workspace.review(files(spark, sf_dir)), exclude=["m1"], shared=["m2", "elsewhere"])


@query("import_gate", f"WITH {_REVIEW} SELECT 'WARNING' AS severity, 'FILE_TOO_LARGE' AS code, path FROM l WHERE level = 'L5_SKIPPED' AND size > 20971520 UNION ALL SELECT 'WARNING', 'LEGACY_JAVA_LAYOUT', root FROM status WHERE status = 'READY' AND layout_type = 'SOURCE_ONLY'")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return workspace.gate(f, workspace.review(f), True)


_SCOPES = "s AS (SELECT 'm' || m AS root, a AS analyzer FROM range(7) t(m), (VALUES ('java-source'), ('java-bytecode'), ('jsp-web')) v(a))"


@query(
    "plan_tasks",
    f"WITH {_E}, {_SCOPES}, d AS (SELECT split_part(path, '/', 1) AS root, CASE e WHEN '.java' THEN 'java-source' WHEN '.jar' THEN 'java-bytecode' WHEN '.jsp' THEN 'jsp-web' WHEN '.html' THEN 'jsp-web' END AS analyzer FROM l WHERE p_partkey % 97 = 5 GROUP BY ALL), t AS (SELECT s.*, d.root IS NOT NULL AS changed, s.root IN ('m0', 'm1', 'm2', 'm3') AS hit FROM s LEFT JOIN d ON s.root = d.root AND s.analyzer = d.analyzer WHERE s.root <> 'm6')"
    " SELECT analyzer, root, analyzer || ':' || root AS scope_key, CASE WHEN changed OR NOT hit THEN 'FAST_REPORT' ELSE 'BACKGROUND_DEEP' END AS queue, CASE WHEN changed THEN 'CHANGED_SCOPE' WHEN NOT hit THEN 'CACHE_MISS' ELSE 'CACHED_BACKGROUND_REFRESH' END AS reason, CASE WHEN changed THEN 0 WHEN NOT hit THEN 1 ELSE 10 END AS priority FROM t",
)
def _(spark, sf_dir):
    roots = spark.range(7).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("root"))
    scopes = roots.select("root", F.explode(F.array(*map(F.lit, ("java-source", "java-bytecode", "jsp-web")))).alias("analyzer"))
    diff = files(spark, sf_dir).where("p_partkey % 97 = 5").select("path")
    cached = scopes.where("root < 'm4'").select(F.concat_ws(":", "analyzer", "root").alias("scope_key"))
    return workspace.ordered_tasks(workspace.plan_tasks(scopes, roots.where("root <> 'm6'"), diff, cached))


@query("incremental_cache", f"WITH {_FILES} SELECT p_partkey, p_partkey % 3 = 0 AS cached FROM f")
def _(spark, sf_dir):
    f = files(spark, sf_dir).select("p_partkey", "path", F.sha2("path", 256).alias("sha256"))
    before = f.where("p_partkey % 3 = 0").unionByName(f.where("p_partkey % 3 = 1").withColumn("sha256", F.lit("old")))
    return joins.changed_files(f, before).select("p_partkey", "cached")


# --- runs, candidates, configuration ---


@query(
    "run_transitions",
    "WITH e AS (SELECT o_custkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey % 5 AS s FROM orders), n AS (SELECT *, ['PLANNED', 'RUNNING', 'STAGED', 'COMMITTED', 'FAILED'][CASE WHEN s = 4 AND ord > 2 THEN 5 ELSE least(ord, 4) END] AS status FROM e), l AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ord) AS before FROM n)"
    " SELECT run_id, ord, status, CASE WHEN before IS NULL THEN status = 'PLANNED' ELSE (before = 'PLANNED' AND status IN ('RUNNING', 'FAILED')) OR (before = 'RUNNING' AND status IN ('STAGED', 'FAILED')) OR (before = 'STAGED' AND status IN ('COMMITTED', 'FAILED')) END AS legal FROM l",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("run_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("ord"), (F.col("o_orderkey") % 5).alias("s"))
    names = F.array(*map(F.lit, ("PLANNED", "RUNNING", "STAGED", "COMMITTED", "FAILED")))
    status = F.element_at(names, F.when((F.col("s") == 4) & (F.col("ord") > 2), F.lit(5)).otherwise(F.least("ord", F.lit(4))).cast("int"))
    return runs.transitions(e.select("run_id", "ord", status.alias("status")))


_CANDIDATES = "c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE 'shop' END AS project_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS days, c_nationkey % 4 = 0 AS stale FROM customer)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    day = F.when(k % 3 != 0, F.timestamp_seconds(k * 86400))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, "other").otherwise("shop").alias("project_id"), F.lit("snap-1").alias("snapshot_id"), F.concat(F.lit("s"), (k % 10).cast("string")).alias("source_identity_id"), F.lit("t1").alias("target_identity_id"),
        F.when(k % 7 == 0, "CALLS").when(k % 11 == 0, "NOPE").otherwise("AI_SUGGESTS_RELATION").alias("relation_name"), F.lit("e1").alias("evidence_key"), F.when(k % 13 == 0, "CERTAIN").otherwise("POSSIBLE").alias("confidence"), day.alias("expires_at"), (F.col("c_nationkey") % 4 == 0).alias("stale"),
    )


@query("candidate_ttl", f"WITH {_CANDIDATES} SELECT id FROM c WHERE project_id = 'shop' AND NOT stale AND (days IS NULL OR days > 100)")
def _(spark, sf_dir):
    return retrieve.active_candidates(candidates(spark, sf_dir), "shop", "snap-1", F.timestamp_seconds(F.lit(100 * 86400))).select("id")


@query("candidate_purge", f"WITH {_CANDIDATES} SELECT id FROM c WHERE days IS NULL OR days > 100")
def _(spark, sf_dir):
    return retrieve.purge_expired(candidates(spark, sf_dir), F.timestamp_seconds(F.lit(100 * 86400))).select("id")


@query("candidate_stale", f"WITH {_CANDIDATES} SELECT id, stale OR project_id = 'shop' AS stale FROM c")
def _(spark, sf_dir):
    return retrieve.mark_stale(candidates(spark, sf_dir), "shop", "snap-1", "e1").select("id", "stale")


@query(
    "candidate_errors",
    f"WITH {_CANDIDATES} SELECT id, array_to_string(list_filter([CASE WHEN id % 7 <> 0 AND id % 11 = 0 THEN 'allowed relation type not registered: NOPE' END, CASE WHEN id % 7 = 0 THEN 'AI candidate must use AI_ASSISTED_CANDIDATE relation family' END, CASE WHEN id % 13 = 0 THEN 'AI candidate confidence cannot be CERTAIN' END, CASE WHEN project_id = 'other' THEN 'project permission denied' END, CASE WHEN project_id = 'other' OR id % 10 >= 8 THEN 'source identity missing' END, CASE WHEN project_id = 'other' THEN 'target identity missing' END, CASE WHEN project_id = 'other' THEN 'evidenceKey missing' END, CASE WHEN days IS NULL AND NOT stale THEN 'AI candidate must have expiresAt or staleAgainstSnapshot' END], lambda x: x IS NOT NULL), '; ') AS errors FROM c",
)
def _(spark, sf_dir):
    known = spark.createDataFrame([("shop", "snap-1", x) for x in [f"s{k}" for k in range(8)] + ["t1"]], "project_id string, snapshot_id string, id string")
    evidence = spark.createDataFrame([("shop", "snap-1", "e1")], "project_id string, snapshot_id string, evidence_key string")
    return retrieve.candidate_errors(candidates(spark, sf_dir), known, evidence, ["shop"]).select("id", F.array_join("errors", "; ").alias("errors"))


@query("configuration", "SELECT 'p' || n_nationkey AS project_id, n_regionkey <> 1 AS enabled, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'default' END AS provider FROM nation")
def _(spark, sf_dir):
    system = spark.createDataFrame([(False, "default")], "enabled boolean, provider string")
    own = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("project_id"), F.when(F.col("n_regionkey") != 1, F.lit(True)).alias("enabled"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("provider"))
    return retrieve.resolve_configuration(system, own)


@query("provisional_methods", "SELECT p_partkey, '(U' || substring(sha256(p_name), 1, 12) || ')U' AS descriptor FROM part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ids.provisional_descriptor(F.col("p_name")).alias("descriptor"))


@query("symbol_redirects", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'method://shop/_root/src/main/java/a.B#m' || p_partkey || '(I)V' ELSE 'method://shop/_root/src/main/java/a.B#m' || p_partkey || '(U' || substring(sha256(p_name), 1, 12) || ')U' END AS now FROM part")
def _(spark, sf_dir):
    stem = F.concat(F.lit("method://shop/_root/src/main/java/a.B#m"), F.col("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(stem, ids.provisional_descriptor(F.col("p_name"))).alias("id"), F.concat(stem, F.lit("(I)V")).alias("to_id"))
    moved = p.where("p_partkey % 2 = 0").select(F.col("id").alias("from_id"), "to_id")
    return p.join(joins.redirects(p.select("id"), moved), "id").select("p_partkey", "now")


@query("jvm_descriptors", "SELECT * FROM (VALUES ('a', '(ILjava/lang/String;[J)V'), ('b', '()Ljava/util/List;'), ('c', '([[Z[Ljava/lang/Object;)D')) t(id, descriptor)")
def _(spark, sf_dir):
    rows = [("a", ["int", "java.lang.String", "long[]"], "void"), ("b", [], "java.util.List<java.lang.String>"), ("c", ["boolean[][]", "java.lang.Object..."], "double")]
    return spark.createDataFrame(rows, "id string, p array<string>, r string").select("id", analyzers.method_descriptor(F.col("p"), F.col("r")).alias("descriptor"))


SMAP = "SMAP\nA_jsp.java\nJSP\n*S JSP\n*F\n+ 0 a.jsp\nweb/a.jsp\n1 b.jsp\n*L\n1,5:100\n10#1,2:200,3\n20:300\n*E\n"


@query("smap_lines", "SELECT * FROM (VALUES (102, 'web/a.jsp', 3), (203, 'b.jsp', 11), (205, 'b.jsp', 11), (300, 'b.jsp', 20)) t(line, file, source_line)")
def _(spark, sf_dir):
    ranges = joins.smap_lines(spark.createDataFrame([("A", SMAP)], "class_name string, text string").withColumn("text", F.replace("text", F.lit("1,5:100"), F.lit("1#0,5:100"))))
    asked = spark.createDataFrame([("A", k) for k in (102, 203, 205, 300, 999)], "class_name string, line int")
    return joins.map_lines(asked, ranges).select("line", "file", "source_line")


# --- governed calls ---


@query(
    "tool_decisions",
    f"WITH r AS (SELECT conv_id * 1000 + turn AS request_id, {[*govern.TOOLS, 'shell.run']}[conv_id % 15 + 1] AS tool, CASE WHEN conv_id % 9 = 0 THEN 'hidden' ELSE 'shop' END AS project, turn FROM conversations) SELECT request_id, CASE WHEN tool = 'shell.run' THEN 'unknown MCP tool' WHEN tool NOT IN ('symbol.search', 'rag.semanticSearch', 'rag.answerDraft', 'project.overview') THEN 'out-of-profile tool' WHEN project = 'hidden' THEN 'project not allowed' WHEN turn = 1 THEN 'raw Cypher or SQL is not allowed' ELSE '' END AS reason FROM r",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    tools = F.array(*map(F.lit, (*govern.TOOLS, "shell.run")))
    r = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.lit("CODE_QUESTION").alias("profile"), F.element_at(tools, (F.col("conv_id") % 15 + 1).cast("int")).alias("tool_name"),
        F.when(F.col("conv_id") % 9 == 0, "hidden").otherwise("shop").alias("project_id"), F.create_map(F.when(F.col("turn") == 1, "sqlText").otherwise("query"), F.lit("x")).alias("arguments"), F.lit(True).alias("within_rate"),
    )
    return govern.decisions(r, ["shop"]).select("request_id", F.coalesce("reason", F.lit("")).alias("reason"))


# --- builders, verdicts ---


@query(
    "symbol_builders",
    "SELECT p_partkey, 'jsp-input://shop/core/src/main/webapp/p' || p_partkey || '.jsp#form[f]:input[i' || p_size || ']' AS jsp_input, 'param-slot://shop/core/src/main/java/a.B#m(I)V:param[' || p_size || ':I]' AS param_slot, 'request-param://shop/_root/s#n' || p_size AS request_param, 'change-plan://shop/r1/' || p_partkey AS change_plan FROM part",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    page = F.concat(F.lit("C:\\w\\src\\main\\webapp\\p"), key, F.lit(".jsp"))
    return p.select(
        "p_partkey",
        builders.file_symbol("jsp_input", "shop", "core", "C:\\w", page, F.lit("f"), F.concat(F.lit("i"), size)).alias("jsp_input"),
        builders.method_symbol("param_slot", "shop", "core", "/w", F.lit("/w/src/main/java/a/B.java"), F.lit("a.B"), F.lit("m"), F.lit("(I)V"), size, F.lit("I")).alias("param_slot"),
        builders.scope_symbol("request_param", "shop", F.lit("s"), F.concat(F.lit("n"), size)).alias("request_param"),
        builders.artifact_symbol("change_plan", "shop", key, F.lit("r1")).alias("change_plan"),
    )


@query("entry_points", "SELECT p_partkey, 'entrypoint://shop/_root/_entrypoints/client-http/GET/' || lower(p_type) AS client_http, 'entrypoint://shop/_root/_entrypoints/scheduler/a.B/run' || p_size AS scheduler FROM part")
def _(spark, sf_dir):
    at = lambda kind, *parts: ids.entrypoint("shop", "_root", kind, F.concat_ws("/", *parts))
    return table(spark, sf_dir, "part").select("p_partkey", at("client-http", F.lit("GET"), F.lower("p_type")).alias("client_http"), at("scheduler", F.lit("a.B"), F.concat(F.lit("run"), F.col("p_size").cast("string"))).alias("scheduler"))


@query("benchmark_verdicts", "WITH m AS (SELECT event_type AS profile, arg_max(value, ts) AS v FROM events GROUP BY 1) SELECT profile, v <= 50 AS passed FROM m UNION ALL SELECT 'never', false")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    measured = e.select(F.col("event_type").alias("profile"), "ts", F.col("value").alias("p95_ms"), F.lit(1).alias("heap_bytes"))
    profiles = e.select(F.col("event_type").alias("profile")).distinct().union(spark.createDataFrame([("never",)], "profile string"))
    return impact.benchmark_verdicts(measured, profiles.select("profile", F.lit(50.0).alias("target_p95_ms"), F.lit(1).alias("target_heap")))
