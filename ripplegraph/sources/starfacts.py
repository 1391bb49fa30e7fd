"""A synthetic fact graph over the star schema, as one text of the SQL that Spark and DuckDB share.

Each edge set has a phase; fact_ord is phase * 10^12 plus a key of its rows, so the order of insertion needs no sort of
the whole. Rows of lineitem repeat (l_orderkey, l_linenumber); a row number within the order tells them apart, and its
window is partitioned by the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.functions.ids import evidence_key, fact_key
from ripplegraph.functions.registry import FAMILY

PROJECT = "shop"
TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")
_BASE = "shop/_root/src/main/java/com.shop."
_STMT = "shop/_root/src/main/resources/com/shop/Part.xml#stmt"
_TYPE = "lower(p.p_type)"
_COLUMN = f"'db-column://shop/mainDs/public/' || {_TYPE} || '#' || replace(p.p_brand, '#', '_')"


def _method(kind: str, key: str) -> str:
    return f"'method://{_BASE}{kind}' || CAST({key} AS STRING) || '#run()V'"


def _stmt(key: str) -> str:
    return f"'sql-statement://{_STMT}' || CAST({key} AS STRING)"


def _snap(ts: str) -> str:
    return f"CASE WHEN year({ts}) % 2 = 0 THEN 'snap-1' ELSE 'snap-2' END"


#: phase, key within the phase, source, target, relation, qualifier, snapshot (None: both), confidence, analyzer, from
_CONFIDENCE = "CASE l.l_returnflag WHEN 'A' THEN 'CERTAIN' WHEN 'N' THEN 'LIKELY' ELSE 'POSSIBLE' END"
_LINES = (
    "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, row_number() OVER (PARTITION BY l_orderkey"
    " ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem) l"
)
_KEY = "l.l_orderkey * 1000 + l.rn"
_SETS = [
    (1, "o.o_orderkey", "'api-endpoint://shop/_root/_api/GET:/customer/' || CAST(o.o_custkey AS STRING)", _method("Order", "o.o_orderkey"), "'ROUTES_TO'", "'route'", _snap("o.o_orderdate"), "'LIKELY'", "'spring-mvc'", "orders o"),
    (2, _KEY, _method("Order", "l.l_orderkey"), _method("Part", "l.l_partkey"), "'CALLS'", "'line-' || CAST(l.l_linenumber AS STRING)", _snap("l.l_shipdate"), _CONFIDENCE, "'spoon-' || CAST(l.l_linenumber % 3 AS STRING)", _LINES),
    (3, _KEY, _method("Part", "l.l_partkey"), _method("Part", "(l.l_partkey * 31 + l.l_suppkey) % n.n"), "'CALLS'", "'self'", _snap("l.l_shipdate"), _CONFIDENCE, "'spoon-' || CAST(l.l_linenumber % 3 AS STRING)", f"{_LINES} CROSS JOIN (SELECT count(*) AS n FROM part) n WHERE l.l_linenumber = 1"),
    (4, "p.p_partkey", _method("Part", "p.p_partkey"), _stmt("p.p_partkey % 50"), "'BINDS_TO'", "'mapper'", None, "'CERTAIN'", "'mybatis'", "part p"),
    (5, "p.p_partkey", _stmt("p.p_partkey % 50"), f"'db-table://shop/mainDs/public/' || {_TYPE}", "CASE WHEN p.p_size % 2 = 0 THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END", "'sql-' || CAST(p.p_partkey AS STRING)", None, "'CERTAIN'", "'sql-table'", "part p"),
    (6, "p.p_partkey", _stmt("p.p_partkey % 50"), _COLUMN, "CASE WHEN p.p_size % 2 = 0 THEN 'READS_COLUMN' ELSE 'WRITES_COLUMN' END", "'sql-' || CAST(p.p_partkey AS STRING)", None, "'CERTAIN'", "'sql-table'", "part p"),
    (7, "p.p_partkey", f"'field://{_BASE}Part' || CAST(p.p_partkey AS STRING) || '#brand'", _COLUMN, "'MAPS_TO_COLUMN'", "'jpa'", None, "'LIKELY'", "'jpa-entity'", "part p WHERE p.p_partkey % 20 = 0"),
    (8, "p.p_partkey", _stmt("p.p_partkey % 50"), f"'sql-param://{_STMT}' || CAST(p.p_partkey % 50 AS STRING) || ':param[' || CAST(p.p_partkey % 3 + 1 AS STRING) || ']'", "'HAS_PARAM'", "'param-' || CAST(p.p_partkey AS STRING)", None, "'CERTAIN'", "'jdbc-sql'", "part p"),
    (9, "n.n_nationkey", "'jsp-input://shop/_root/src/main/webapp/page' || CAST(n.n_regionkey AS STRING) || '.jsp#form[f]:input[i' || CAST(n.n_nationkey AS STRING) || ']'", "'request-param://shop/_root/src/main/webapp/nation' || CAST(n.n_nationkey AS STRING)", "'BINDS_TO'", "'jsp-input'", None, "'LIKELY'", "'jsp-token'", "nation n"),
    (10, "c.c_custkey", "'request-param://shop/_root/src/main/webapp/nation' || CAST(c.c_nationkey AS STRING)", f"'param-slot://{_BASE}Part' || CAST(c.c_custkey % n.n AS STRING) || '#run()V:param[0:I]'", "'PASSES_PARAM'", "'slot'", None, "'LIKELY'", "'variable-trace'", "customer c CROSS JOIN (SELECT count(*) AS n FROM part) n"),
    (11, "r.r_regionkey * 100 + k.k", _stmt("k.k"), "'report-definition://shop/_root/report/' || lower(replace(r.r_name, ' ', '_'))", "CASE WHEN k.k % 2 = 0 THEN 'EXPORTS_SYMBOL' ELSE 'REFERENCES_SYMBOL' END", "'report'", None, "'POSSIBLE'", "'report-definition'", "region r CROSS JOIN (SELECT DISTINCT p_partkey % 50 AS k FROM part) k WHERE (r.r_regionkey + k.k) % 5 = 0"),
    (12, "n.n_nationkey", "'html-page://shop/_root/src/main/webapp/region' || CAST(n.n_regionkey AS STRING) || '.html'", "'html-link://shop/_root/src/main/webapp/region' || CAST(n.n_regionkey AS STRING) || '.html#link[' || CAST(n.n_nationkey AS STRING) || ']'", "'CONTAINS'", "'html-structure'", None, "'CERTAIN'", "'html-client'", "nation n"),
]


def _family(relation: str) -> str:
    cases = " ".join(f"WHEN '{r}' THEN '{f}'" for r, f in FAMILY.items() if r in _used())
    return f"CASE {relation} {cases} END"


def _used() -> set[str]:
    text = " ".join(s[4] for s in _SETS)
    return {r for r in FAMILY if f"'{r}'" in text}


def facts_sql() -> str:
    """The text; tables by their names."""
    out = []
    for phase, key, source, target, relation, qualifier, snap, confidence, analyzer, origin in _SETS:
        base = phase * 10**12
        for s, shift in ((snap, 0),) if snap else (("'snap-1'", 0), ("'snap-2'", 5 * 10**11)):
            out.append(f"SELECT {base + shift} + CAST({key} AS BIGINT) AS fact_ord, {source} AS source_identity_id, {target} AS target_identity_id, {relation} AS relation_type, {qualifier} AS qualifier, {s} AS snapshot_id, {confidence} AS confidence, {analyzer} AS analyzer_id FROM {origin}")
    union = " UNION ALL ".join(out)
    return (
        f"SELECT fact_ord, source_identity_id, target_identity_id, relation_type, {_family('relation_type')} AS relation_family, qualifier, 'shop' AS project_id, snapshot_id,"
        " 'analysis-1' AS analysis_run_id, 'scope-1' AS scope_run_id, analyzer_id, 'src/main/java' AS scope_key, 1 AS schema_version, fact_ord % 89 <> 7 AS active, fact_ord % 97 = 13 AS tombstone,"
        f" snapshot_id AS valid_from_snapshot, '' AS valid_to_snapshot, confidence, 100 AS priority, 'SPOON' AS source_type FROM ({union}) u"
    )


def star_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, keys included."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    text = facts_sql()
    for t in TABLES:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"FROM {t})", f"FROM {{{t}}})")
    df = spark.sql(text, **{t: d for t, d in tables.items() if f"{{{t}}}" in text})
    c = F.col
    return df.withColumn("fact_key", fact_key(c("source_identity_id"), c("target_identity_id"), c("relation_type"), c("qualifier"))).withColumn(
        "evidence_key", evidence_key(c("analyzer_id"), c("scope_key"), c("source_identity_id"), F.lit("line:1"), c("schema_version"))
    )
