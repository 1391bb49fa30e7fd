"""Queries over Java sources: a class for each part, whose text SQL can state, read by tokens and mapped to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegraph.operators import java, mappers, sqlscan
from ripplegraph.operators.analyzers import analyse
from ripplegraph.plans.registered import query
from ripplegraph.sources.lineage import cut

_CODE = """package com.shop.p{p};
import java.sql.Connection;
import java.sql.PreparedStatement;
import javax.servlet.http.HttpServletRequest;

/* class Part{k} {{ is no bracket here */
@RestController
@RequestMapping("/s{s}")
@Entity @Table(name = "T_{s}")
public class Part{k} {{
    @Column(name = "C_{s}") private String brand;
    private int size;
    @GetMapping("/{k}")
    public String show(int id, String... more) {{
        for (String m : more) keep(m);
        return helper(id);
    }}
    @RequestMapping(value = {{"a", "b"}}, method = {{RequestMethod.POST, RequestMethod.PUT}})
    void save() {{ Other{p}.touch(size); }}
    private String helper(int id) {{ return "x); }}"; }}
    void load(Connection con, String who) {{
        final String table = "t" + "{s}";
        PreparedStatement ps = con.prepareStatement("select a from " + table + " where b = ? and c = ?");
        ps.setString(1, who);
        ps.setInt(2, size);
    }}
    void handle(HttpServletRequest request) {{
        String code = request.getParameter("p{k}");
        String again = code;
        keep(again);
    }}
    void keep(String value) {{ }}
}}
"""
_OTHER = "package com.shop.p{p}; class Other{p} {{ static void touch(long n) {{ }} }}"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content. The text is hundreds of times as large as the table, so it is made in more tasks than the table's files give."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    k, own, size = (F.col(c).cast("string") for c in ("k", "p", "s"))
    p = p.select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 7).alias("p"), F.col("p_size").alias("s"))
    text = F.lit(_CODE.replace("{{", "{").replace("}}", "}"))
    for name, column in (("{k}", k), ("{p}", own), ("{s}", size)):
        text = F.replace(text, F.lit(name), column)
    one = p.select(F.concat(F.lit("com/shop/p"), own, F.lit("/Part"), k, F.lit(".java")).alias("path"), text.alias("content"))
    other = p.select(own.alias("p")).distinct().select(F.concat(F.lit("com/shop/p"), "p", F.lit("/Other"), "p", F.lit(".java")).alias("path"), F.replace(F.lit(_OTHER.replace("{{", "{").replace("}}", "}")), F.lit("{p}"), F.col("p")).alias("content"))
    return one.unionByName(other)


def edges(facts: DataFrame) -> DataFrame:
    return facts.select("source_identity_id", "target_identity_id", "relation_type", "qualifier", "confidence")


_P = (
    "p AS (SELECT CAST(p_partkey AS VARCHAR) AS k, CAST(p_partkey % 7 AS VARCHAR) AS p, CAST(p_size AS VARCHAR) AS s FROM part),"
    " c AS (SELECT *, 'shop/_root/src/main/java/com.shop.p' || p || '.Part' || k AS cls, 'com/shop/p' || p || '/Part' || k || '.java' AS file FROM p),"
    " o AS (SELECT DISTINCT p, 'shop/_root/src/main/java/com.shop.p' || p || '.Other' || p AS cls, 'com/shop/p' || p || '/Other' || p || '.java' AS file FROM p)"
)
_SHOW, _HELPER, _KEEP = "#show(I[Ljava/lang/String;)Ljava/lang/String;", "#helper(I)Ljava/lang/String;", "#keep(Ljava/lang/String;)V"
_LOAD, _HANDLE = "#load(Ljava/sql/Connection;Ljava/lang/String;)V", "#handle(Ljavax/servlet/http/HttpServletRequest;)V"


def _rows(*rows: tuple[str, str, str, str, str], table: str = "c") -> str:
    names = ("source_identity_id", "target_identity_id", "relation_type", "qualifier", "confidence")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for n, v in zip(names, (r[0], r[1], f"'{r[2]}'", f"'{r[3]}'", f"'{r[4]}'"), strict=True)) + f" FROM {table}" for r in rows)


_SOURCE = "'source-file://shop/_root/src/main/java/' || file"
_DECLARED = _rows(
    (_SOURCE, "'class://' || cls", "DECLARES", "class", "LIKELY"),
    *[("'class://' || cls", f"'field://' || cls || '#{x}'", "DECLARES", "field", "LIKELY") for x in ("brand", "size")],
    *[("'class://' || cls", f"'method://' || cls || '{x}'", "DECLARES", "method", "LIKELY") for x in (_SHOW, "#save()V", _HELPER, _LOAD, _HANDLE, _KEEP)],
    *[(f"'method://' || cls || '{a}'", f"'method://' || cls || '{b}'", "CALLS", "direct", "LIKELY") for a, b in ((_SHOW, _KEEP), (_SHOW, _HELPER), (_HANDLE, _KEEP))],
    ("'method://' || cls || '#save()V'", "'method://shop/_root/src/main/java/com.shop.p' || p || '.Other' || p || '#touch(J)V'", "CALLS", "direct", "LIKELY"),
)
_DECLARED += " UNION ALL " + _rows((_SOURCE, "'class://' || cls", "DECLARES", "class", "LIKELY"), ("'class://' || cls", "'method://' || cls || '#touch(J)V'", "DECLARES", "method", "LIKELY"), table="o")


@query("java_facts", f"WITH {_P} {_DECLARED}")
def _(spark, sf_dir):
    return edges(mappers.java_source(java.java_rows(sources(spark, sf_dir)), mappers.Context()))


_ROUTES = [("GET", "'/s' || s || '/' || k", _SHOW), *[(verb, f"'/s' || s || '/{path}'", "#save()V") for verb in ("POST", "PUT") for path in "ab"]]
_ROUTED = _rows(
    *[(f"'api-endpoint://shop/_root/_api/{verb}:' || {path}", f"'method://' || cls || '{m}'", "ROUTES_TO", "spring-mvc", "LIKELY") for verb, path, m in _ROUTES],
    *[(f"'method://' || cls || '{m}'", f"'entrypoint://shop/_root/_entrypoints/spring/{verb}' || {path}", "DECLARES_ENTRYPOINT", "spring-mvc", "LIKELY") for verb, path, m in _ROUTES],
)


@query("spring_facts", f"WITH {_P} {_ROUTED}")
def _(spark, sf_dir):
    rows = analyse(sources(spark, sf_dir), java.spring, java.SPRING).where("kind = 'route'")
    return edges(mappers.spring_routes(rows, mappers.Context()))


_STATEMENT = f"'://shop/_root/src/main/java/' || file || '#com.shop.p' || p || '.Part' || k || '.{_LOAD[1:]}@23'"
_BOUND = _rows((f"'method://' || cls || '{_LOAD}'", f"'sql-statement' || {_STATEMENT}", "BINDS_TO", "jdbc", "CERTAIN"), *[(f"'sql-statement' || {_STATEMENT}", f"'sql-param' || {_STATEMENT} || ':param[{n}]'", "HAS_PARAM", f"param-{n}", "CERTAIN") for n in (1, 2)])


@query("jdbc_facts", f"WITH {_P} SELECT DISTINCT * FROM ({_BOUND})")
def _(spark, sf_dir):
    return edges(mappers.jdbc_statements(analyse(sources(spark, sf_dir), java.jdbc, java.JDBC), mappers.Context())).distinct()


@query("jdbc_sql", f"WITH {_P} SELECT 'com.shop.p' || p || '.Part' || k AS owner, 'select a from t' || s || ' where b = ? and c = ?' AS sql, 't' || s AS table_name FROM c")
def _(spark, sf_dir):
    """The statements' text, and the tables that they read."""
    rows = analyse(sources(spark, sf_dir), java.jdbc, java.JDBC).select("owner", "sql", F.col("statement_id").alias("statement")).distinct()
    found = sqlscan.accesses(rows.select("statement", "sql")).where("column_name is null").select("statement", "table_name")
    return rows.join(found, "statement").select("owner", "sql", "table_name")


_MAPPED = _rows(
    ("'class://' || cls", "'db-table://shop/mainDs/public/T_' || s", "BINDS_TO", "jpa-table", "LIKELY"),
    ("'field://' || cls || '#brand'", "'db-column://shop/mainDs/public/T_' || s || '#C_' || s", "MAPS_TO_COLUMN", "jpa-column", "LIKELY"),
    ("'field://' || cls || '#size'", "'db-column://shop/mainDs/public/T_' || s || '#size'", "MAPS_TO_COLUMN", "jpa-column", "LIKELY"),
)


@query("jpa_facts", f"WITH {_P} {_MAPPED}")
def _(spark, sf_dir):
    return edges(mappers.jpa_entities(analyse(sources(spark, sf_dir), java.jpa, java.JPA), mappers.Context()))


_PASSED = _rows(
    ("'request-param://shop/_root/src/main/webapp#p' || k", f"'param-slot://' || cls || '{_KEEP}:param[0:Ljava/lang/String;]'", "PASSES_PARAM", "request-derived", "LIKELY"),
    (f"'param-slot://' || cls || '{_SHOW}:param[0:I]'", f"'param-slot://' || cls || '{_HELPER}:param[0:I]'", "PASSES_PARAM", "parameter-derived", "LIKELY"),
)


@query("variable_facts", f"WITH {_P} {_PASSED}")
def _(spark, sf_dir):
    rows = cut(analyse(sources(spark, sf_dir), java.flows, java.TRACES), "flows")
    return edges(mappers.variable_flows(java.flow_rows(rows, rows, "src/main/webapp"), mappers.Context()))
